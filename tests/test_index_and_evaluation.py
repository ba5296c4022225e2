"""The segment index against fresh fits; evaluation, replies and dump digests against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from docstrata.functions import replies
from docstrata.operators import bm25, evaluation, segments
from docstrata.sources import corpus

WORDS = [f"w{k}" for k in range(30)]


def texts(rnd: random.Random, ids) -> list[tuple]:
    return [(i, rnd.choice([None, "", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 12)))]) if rnd.random() < 0.3 else " ".join(rnd.choices(WORDS, k=rnd.randint(1, 12)))) for i in ids]


def same_as_fresh(spark, path, state: dict) -> None:
    queries = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k} zz") for k in range(12)], "query_id long, text string")
    index = segments.load(spark, path)
    fresh = bm25.fit(spark.createDataFrame(sorted(state.items()), "doc_id long, text string"))
    pick = lambda x: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in bm25.search(x, queries, 5).collect())
    assert pick(index) == pick(fresh)
    for table in ("postings", "terms", "docs", "stats"):
        a, b = segments.in_force(index) if table == "postings" else getattr(index, table), getattr(fresh, table)
        assert sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.select(b.columns).collect()) == sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())


def test_index_after_upserts_and_deletes_equals_a_fresh_fit(spark, tmp_path):
    path, rnd, state = f"file://{tmp_path}/index", random.Random(1), {}
    assert segments.load(spark, path) is None
    for batch in range(5):
        new = texts(rnd, rnd.sample(range(30), 12))
        gone = rnd.sample(range(35), 5)
        docs = spark.createDataFrame([*new, (None, "w1")], "doc_id long, text string")
        for _ in range(2 if batch in (1, 3) else 1):  # a batch that runs again changes nothing
            segments.append(docs, path, batch, gone=spark.createDataFrame([(g,) for g in gone] + [(None,)], "doc_id long"))
        for g in gone:
            state.pop(g, None)
        state |= {i: t or "" for i, t in new}
        if batch == 2:
            segments.compact(spark, path)
            assert [s[:2] for s in segments.segments(spark, path)] == [(0, 2)]
        if batch in (0, 2, 4):
            same_as_fresh(spark, path, state)
    with pytest.raises(ValueError, match="compacted"):
        segments.append(docs, path, 1)


def test_index_of_nothing_and_of_repeated_rows(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    none = spark.createDataFrame([], "doc_id long, text string")
    segments.append(none, path, 0)
    assert segments.load(spark, path).docs.count() == 0
    twice = spark.createDataFrame([(1, "w1 w2"), (1, "w1 w2"), (1, "w3"), (2, None)], "doc_id long, text string")
    segments.append(twice, path, 1)
    index = segments.load(spark, path)
    assert index.docs.count() == 2 and index.stats.first().n == 2
    segments.append(none, path, 2, gone=spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert segments.load(spark, path).docs.count() == 0 == segments.load(spark, path).terms.count()


def test_a_segment_without_a_log_entry_counts_as_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    segments.append(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), path, 0)
    spark.createDataFrame([(9, 1, "x")], "doc_id long, dl long, digest string").write.parquet(f"{path}/segment-1-1/docs")
    assert [r.doc_id for r in segments.load(spark, path).docs.collect()] == [1]


def test_the_index_job_cleans_and_composes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    segments.build(spark.createDataFrame([(1, "﻿café  \tle")], "doc_id long, text string"), path, 0)
    assert sorted(r.term for r in segments.load(spark, path).postings.collect()) == ["café", "le"]


def test_states_and_their_counts_in_one_pass(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, question string")
    outputs = spark.createDataFrame([(2, 0.5), (3, 1.0), (None, 0.1)], "id long, score double")
    seen = Observation("seen")
    got = evaluation.states(items, outputs, "id", seen).collect()
    assert sorted((r.id or 0, r.state) for r in got) == [(0, "missing"), (0, "unknown"), (1, "missing"), (2, "matched"), (3, "unknown")]
    assert seen.get == {"matched": 1, "missing": 2, "unknown": 2}


def test_report_keeps_nulls(spark):
    rows = spark.createDataFrame([("s", "matched", 1.0, None), ("s", "matched", None, None), ("s", "missing", None, None), ("s", "unknown", 0.0, 1.0)], "system string, state string, a double, b double")
    got = {r.metric: r for r in evaluation.report(rows, ["a", "b"]).collect()}
    assert got["a"][2:7] == (1.0, 1, 1, 1, 1) and got["b"][2:7] == (None, 0, 2, 1, 1)
    assert json.loads(got["b"].json) == {"system": "s", "metric": "b", "mean": None, "n": 0, "not_available": 2, "missing": 1, "unknown": 1}
    assert evaluation.report(rows.limit(0), ["a"]).collect() == []


def test_breakdown_has_three_scopes(spark):
    kind = "hit_at_3 double, mrr double, ndcg_at_5 double, groundedness double, rubric double, critical boolean, is_abstention boolean, risk string, intent string"
    rows = [(1.0, 0.5, 0.25, 0.9, 5.0, False, True, "high", "x"), (0.0, 1.0, 0.75, 0.4, 3.0, True, True, None, None), (1.0, 1.0, 1.0, 1.0, 4.0, None, None, "medium", "x")]
    got = {(r.scope, r.bucket): r for r in evaluation.breakdown(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {("overall", None), ("risk", "high"), ("risk", "medium"), ("intent", "x"), ("intent", "general")}
    whole = got["overall", None]
    assert (whole.n, whole.hit_at_3, whole.groundedness, whole.rubric, whole.critical, whole.n_abstention, whole.abstention_accuracy) == (3, 0.6667, 0.7667, 4.0, 1, 2, 0.5)
    assert got["risk", "medium"].n == 2 and got["intent", "x"].abstention_accuracy == 1.0
    values = {r.gate: r.value for r in evaluation.gate_values(evaluation.breakdown(spark.createDataFrame(rows, kind))).collect()}
    assert values["groundedness_high_risk"] == 0.9 and values["critical_contradictions"] == 1.0 and values["rubric"] == 4.0
    assert evaluation.breakdown(spark.createDataFrame([], kind)).collect() == []


REPLIES = [
    ('{"named_entities": [{"name": "A", "category": "c"}]}', "parsed", ["A"]), ('```json\n[{"name": "B"}]\n```', "parsed", ["B"]), ('```\n{"output": [{"name": "C"}, 5, {"x": 1}]}\n``` thanks', "parsed", ["C"]),
    ('Here: {"named_entities": [{"name": "}] \\" {"}]} and more {', "recovered", ['}] " {']), ('[{"name": "D"', "rejected", None), ("no brackets", "rejected", None), ("", "empty", None), ("  ", "empty", None), (None, "empty", None),
    ("[]", "parsed", []), ('{"output": {"named_entities": []}}', "parsed", []), ("7", "parsed", None),
]


def test_replies_are_decoded_with_tolerance(spark):
    rows = spark.createDataFrame([(k, r[0]) for k, r in enumerate(REPLIES)], "k int, reply string").withColumn("x", replies.decoded("reply"))
    good = F.transform(F.filter(replies.entities(F.col("x.value")), lambda e: e["fault"].isNull()), lambda e: e["name"])
    got = {r.k: (r.status, r.names) for r in rows.select("k", "x.status", good.alias("names")).collect()}
    assert got == {k: (status, names) for k, (_, status, names) in enumerate(REPLIES)}


def test_triples_and_left_out_entities(spark):
    reply = '{"triples": [["a", "b", "c"], {"subject": "s", "predicate": "p", "object": "o"}, ["a", "b"], ["a", "", "c"], {"subject": "s"}, "x", ["a", "b", "c", "d"]]}'
    row = spark.createDataFrame([(reply, '{"named_entities": [{"name": "A", "official_name": "AA"}, {"name": "B"}]}', ["A", "C"])], "t string, e string, asked array<string>")
    found = replies.triples(replies.decoded("t")["value"])
    got = row.select(found.alias("t"), replies.standardised(replies.decoded("e")["value"], F.col("asked")).alias("e")).first()
    assert [tuple(t) for t in got.t] == [("a", "b", "c", None), ("s", "p", "o", None), (None, None, None, "not three"), *[(None, None, None, "incomplete")] * 3, (None, None, None, "not three")]
    assert [tuple(e) for e in got.e] == [("A", "AA"), ("B", "B"), ("C", "C")]


def test_digests_see_swapped_contents(spark):
    kind = "label string, id long, name string"
    rows = [("x", k, f"n{k % 7}") for k in range(50)] + [("y", 1, None), ("y", 1, None), (None, 3, "-")]
    whole = corpus.content_digests(spark.createDataFrame(rows, kind), "label")
    shuffled = corpus.content_digests(spark.createDataFrame(rows[::-1], kind).repartition(7), "label")
    assert corpus.restore_faults(whole, shuffled).collect() == []
    swapped = [("x", k, f"n{(k + (k in (1, 2))) % 7}") for k in range(50)] + [("y", 1, None), ("z", 1, "-")]
    got = {r.label: r.fault for r in corpus.restore_faults(whole, corpus.content_digests(spark.createDataFrame(swapped, kind), "label")).collect()}
    assert got == {"x": "content", "y": "count", None: "lost", "z": "new"}
