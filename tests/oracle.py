"""Compare a query with its DuckDB SQL: columns, rows and values."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


def ordered(rows, columns) -> list:
    place = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in place) for r in rows), key=repr)


def check(frame, sql: str, sf_dir: str) -> None:
    db = duckdb.connect()
    db.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = db.sql(sql)
    assert sorted(want.columns) == sorted(frame.columns)
    assert ordered(frame.collect(), frame.columns) == ordered(want.fetchall(), want.columns)
