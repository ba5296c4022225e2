"""Operators 11 to 13 against plain versions of themselves, the libraries and SQL."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from oracle import check

from docstrata.llm import align, concurrency, pieces, queries

A, B = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")
WORDS = ["the", "ther", "Energie", "don't", "naïve", "中文", "<|endoftext|>", "<s>", "12,345", "\U0001f600", "a\nb", "\t", "x  y", "\r\n", "▁", " ", "", "…", "...", "&&&", "a\0b", " z"]


def mixed(n: int, seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    made = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))) for _ in range(n)]
    return [*made, None, "", " ", "\n", "▁", "a▁b", "the " * 3000, "x" * 5000, made[0], made[0]]


def frame(spark, texts):
    return spark.createDataFrame([(k if k % 17 else None, t, "x", [1]) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, block array<int>").repartition(3)


def keyed(rows) -> Counter:
    return Counter((r["doc_id"], *(r[c] for c in r.asDict() if c != "doc_id")) for r in rows)


def token_bytes():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    spec = json.load(open(A, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    return t, {i: bytes(byte[c] for c in w) for w, i in spec["model"]["vocab"].items() if all(c in byte for c in w)}


def brute_alignment(texts):
    import sentencepiece

    t, spelled = token_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    per, holds = [], Counter()
    for x in texts:
        a = t.encode(" " + x, add_special_tokens=False).ids if x else []
        b = sp.encode(x or "")
        words = [[spelled[i] for i in a], [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]]
        if not x or any(b"".join(w) != (" " + x).encode() for w in words):
            per.append(None)
            continue
        a_to, b_to = (np.cumsum([len(y) for y in w]) for w in words)
        links = [(i, j) for i, v, n in zip(a, a_to, map(len, words[0]), strict=True) for j, w, m in zip(b, b_to, map(len, words[1]), strict=True) if v - n < w and w - m < v]
        groups, low = [], 0
        for end in sorted(set(a_to.tolist()) & set(b_to.tolist())):
            parts = [",".join(str(i) for i, e in zip(ids, to, strict=True) if low < e <= end) for ids, to in ((a, a_to), (b, b_to))]
            groups.append("|".join(parts))
            low = end
        per.append((len(a), len(b), len(groups), links, ";".join(groups)))
        holds.update(set(links))
    best = defaultdict(int)
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(holds[k] == best[k[0]] for k in p[3]), sum(holds[k] for k in p[3]), hashlib.sha256(p[4].encode()).hexdigest()) for p in per]


def test_alignment_equals_brute_force(spark):
    texts = [t for t in mixed(150, 1) if t is None or len(t) < 400]
    docs = frame(spark, texts)
    got = Counter((r["doc_id"], *tuple(r)[1:]) for r in align.alignment_report(docs, A, B).collect())
    assert got == Counter((k if k % 17 else None, *row) for k, row in enumerate(brute_alignment(texts)))


def test_alignment_of_documents_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 700").select("doc_id", "text").limit(60).collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in align.alignment_report(docs, A, B).collect()} == dict(zip([r.doc_id for r in rows], brute_alignment([r.text for r in rows]), strict=True))


def test_aligned_groups_spell_the_same_bytes(spark):
    _, spelled = token_bytes()
    model = pieces.piece_model(B)
    texts = mixed(40, 2)
    for row in align.aligned(frame(spark, texts), A, B).collect():
        i = j = 0
        for g in row.groups:
            assert b"".join(spelled[x] for x in row.a_ids[i : g.a_end]) == b"".join(model.spelled[x] for x in row.b_ids[j : g.b_end])
            i, j = g.a_end, g.b_end
        assert (i, j) == (len(row.a_ids), len(row.b_ids))


def test_alignment_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment_report(none, A, B).collect() == [] == align.aligned(none, A, B).collect()


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    texts = mixed(400, 3)
    docs = frame(spark, texts)
    want = [sp.encode(t or "") for t in texts]
    assert Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(docs, B).collect()) == Counter((k if k % 17 else None, tuple(x)) for k, x in enumerate(want))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert keyed(pieces.piece_digests(docs, B).collect()) == Counter((k if k % 17 else None, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for k, x in enumerate(want))
    coded = spark.createDataFrame([(k, x) for k, x in enumerate(want)] + [(-1, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(coded, B).collect()} == {k: sp.decode(x) for k, x in enumerate(want)} | {-1: None}


def test_agenda_and_decoder_on_any_input():
    import sentencepiece

    sp, model, rnd = sentencepiece.SentencePieceProcessor(model_file=B), pieces.piece_model(B), random.Random(4)
    letters = list("ab e\n\tthr.,▁é中 \r0123<>/|") + ["the ", "▁▁", "\U0001f600", "\0"]
    chunks = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))) for _ in range(3000)]
    ids = model.many_ids(chunks)
    assert ids == [model.chunk_ids(c) for c in chunks]  # arrays and heaps
    assert ids == [x[2:] for x in sp.encode(["\n" + c for c in chunks])]
    odd = [[rnd.choice([rnd.randrange(32000), rnd.randrange(262), 28705]) for _ in range(rnd.randint(0, 7))] for _ in range(5000)]
    assert [model.text_of(x) for x in odd] == [sp.decode(x) for x in odd]


def test_chunk_table_keeps_what_is_frequent(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 8)
    import pyarrow as pa

    pieces._table.cache_clear()
    model = pieces.piece_model(B)
    for seed in range(4):
        texts = [t for t in mixed(30, seed) if t]
        assert [[i for c in row for i in c] for row in pieces._rows(B, pieces._chunk_lists, pa.array(texts))] == model.library.encode(texts)
    pieces._table.cache_clear()


def test_a_unigram_or_broken_model_is_refused(tmp_path):
    (tmp_path / "x.model").write_bytes(b"\x01nothing")
    with pytest.raises(Exception):  # noqa: B017
        pieces.PieceModel(str(tmp_path / "x.model"))


def test_range_tree_equals_arrays():
    rnd = np.random.default_rng(5)
    for leaves in (1, 2, 3, 8, 13, 64):
        tree = concurrency.RangeTree(3, leaves)
        n, cents = np.zeros((3, leaves), np.int64), np.zeros((3, leaves), np.int64)
        which, first = rnd.integers(0, 3, 200), rnd.integers(0, leaves, 200)
        a, b = rnd.integers(-5, 6, 200), rnd.integers(-500, 600, 200)
        tree.add(which, first, a, b)
        for t, f, x, y in zip(which, first, a, b, strict=True):
            n[t, f:] += x
            cents[t, f:] += y
        sizes = np.array([leaves, max(1, leaves // 2), 1])
        tree.settle(sizes)
        at = [(t, k) for t in range(3) for k in range(sizes[t])]
        ts, ks = (np.array(x) for x in zip(*at, strict=True))
        got_n, got_cents = tree.points(ts, ks)
        assert got_n.tolist() == n[ts, ks].tolist() and got_cents.tolist() == cents[ts, ks].tolist()
        assert tree.highest(ts, ks).tolist() == [n[t, : k + 1].max() for t, k in at]
        assert tree.peak().tolist() == [n[t, : sizes[t]].max() for t in range(3)]


SHOP = ("sale_id long, client_id long, total double, sold_at timestamp_ntz, group_id int", "sale_id long, shipped_at timestamp_ntz, minute long", "client_id long, nation_id int, chunk long")


def brute_sweep(sales, lines, clients):
    day = timedelta(days=7)
    minute = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() // 60)
    end, nation = {}, {}
    for s, t, _ in lines:
        if s is not None and t is not None:
            end[s] = max(end.get(s, t), t)
    for c, n, _ in clients:
        if c is not None and n is not None:
            nation[c] = min(nation.get(c, n), n)
    changes = defaultdict(lambda: [0, 0])
    for s, c, total, sold, _ in sales:
        if sold is None or (s in end and minute(end[s] + day) <= minute(sold)):
            continue
        cents = int(np.floor(100 * total + 0.5)) if total is not None and np.isfinite(total) else 0
        for g in (nation.get(c, -1), -2):
            for at, sign in ((minute(sold), 1), *([(minute(end[s] + day), -1)] if s in end else [])):
                changes[g, at][0] += sign
                changes[g, at][1] += sign * cents
    out = []
    for g in sorted({k[0] for k in changes}):
        at = sorted(m for h, m in changes if h == g and changes[h, m] != [0, 0])
        n = cents = high = 0
        rows = []
        for k, m in enumerate(at):
            n, cents = n + changes[g, m][0], cents + changes[g, m][1]
            high = max(high, n)
            rows.append([g, m * 60, at[k + 1] * 60 if k + 1 < len(at) else None, n, cents, high])
        out += [(*r, r[3] == high) for r in rows]
    return out


def shop(seed: int, n: int, years: int):
    rnd = random.Random(seed)
    when = lambda: datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(-years * 86400 * 365, 86400 * 40 * (years + 1)) * 1.0, microseconds=rnd.randrange(10**6))
    sales = [(rnd.choice([None, *range(n)]), rnd.choice([None, 0, 0, *range(9)]), rnd.choice([None, 1.005, float("nan"), float("inf"), -3.335, 12.5]), rnd.choice([None, when(), when(), when()]), 1) for _ in range(n)]
    lines = [(rnd.choice([None, *range(n)]), rnd.choice([None, when(), when()]), 1) for _ in range(2 * n)]
    clients = [(rnd.choice([None, *range(7)]), rnd.choice([None, 0, 3, 24]), 1) for _ in range(9)]
    return sales + sales[: n // 5], lines, clients


@pytest.mark.parametrize(("n", "years"), [(0, 0), (1, 0), (60, 0), (400, 0), (120, 60)])
def test_sweep_equals_brute_force(spark, n, years):
    tables = shop(n, n, years)
    frames = [spark.createDataFrame(rows, kind) for rows, kind in zip(tables, SHOP, strict=True)]
    got = [tuple(r) for r in concurrency.open_sales(*frames).collect()]
    assert sorted(got, key=lambda r: r[:2]) == brute_sweep(*tables)


def test_sweep_reads_zoneless_times_as_utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        tables = shop(9, 50, 0)
        frames = [spark.createDataFrame(rows, kind) for rows, kind in zip(tables, SHOP, strict=True)]
        assert sorted((tuple(r) for r in concurrency.open_sales(*frames).collect()), key=lambda r: r[:2]) == brute_sweep(*tables)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sweep_of_the_tables(spark, sf_dir):
    check(queries.op13_peak_concurrency(spark, sf_dir), queries.OP13_SQL, sf_dir)
