"""Cases of the third round's findings, each small."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from docstrata import catalog
from docstrata.functions import replies
from docstrata.functions import text as T
from docstrata.operators import assembly, graph, metrics, push, ranking, splitters


def canonical(spark, phrase: str) -> str:
    return spark.createDataFrame([(phrase,)], "phrase string").select(T.canonical_id("phrase").alias("id")).first()["id"]


def test_canonical_ids_of_long_numbers(spark):
    assert canonical(spark, "Luật An ninh số 123456/2015/QH13") == "luật 123456 2015 qh13"
    assert canonical(spark, "Quyết định số 7654321/QĐ-TTg") == "quyết định 7654321 qđ ttg"
    assert canonical(spark, "Luật a12 2015 qh13, 5/2016/QH14 và 6/2017/QH14") == "luật 5 2016 qh14"


def test_metadata_of_a_law_before_number_zero(spark, tmp_path):
    spark.createDataFrame([(0, 3), (1, 6), (2, 4)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/o")
    next((tmp_path / "o").glob("*.parquet")).rename(tmp_path / "orders.parquet")
    for name in ("metadata_edges", "metadata_nodes", "graph_fingerprint"):
        oracle.check(catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLE[name], str(tmp_path))
    assert canonical(spark, "-1/2020/QH14") == "-1 2020 qh14" != canonical(spark, "1/2020/QH14")
    assert canonical(spark, "- 5 - 6") == "5 6"


def by_brute_force(rows: list[tuple], k: int) -> list[tuple]:
    out = []
    with np.errstate(all="ignore"):
        sums = lambda a, b: np.float64(sum((np.float64(x) * np.float64(y) for x, y in zip(a, b, strict=True)), np.float64(0.0)))
        for q, a in rows:
            found = []
            for d, b in rows:
                if a and b and len(a) == len(b) and None not in a + b and (norms := (np.sqrt(sums(b, b)), np.sqrt(sums(a, a)))) and all(norms):
                    s = float(sums(b, a) / (norms[0] * norms[1]))
                    found.append((-math.inf if math.isnan(s) else -round(s, 9), d))
            out += [(q, d, n) for n, (_, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("side", [100_000, 150])
def test_dense_search_in_cells(spark, monkeypatch, side):
    """Copies beyond k, near copies under the rounding, two dimensions, and vectors that have no score or no number as one."""
    monkeypatch.setattr(ranking, "SIDE", side)
    x = np.random.default_rng(5).normal(size=(300, 4))
    x[40:90], x[100:110] = x[7], x[8] * (1 + np.arange(10)[:, None] * 1e-12) + np.arange(10)[:, None] * 1e-11
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900 + k, v[:2].tolist()) for k, v in enumerate(x[:20])]
    rows += [(990, [0.0] * 4), (991, None), (992, []), (993, [1.0, None, 1.0, 1.0]), (994, [math.nan, 1.0, 1.0, 1.0]), (995, [1e200, 1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, v array<double>")
    found = ranking.dense_search(vectors, vectors.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), 12, side)
    assert sorted(tuple(r) for r in found.select("query_id", "doc_id", "rank").collect()) == by_brute_force(rows, 12)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_shuffled_for_hits(spark, sf_dir):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("evidence_support", "prompt_contexts", "hybrid_retrieve"):
            assert "SortMergeJoin [doc_id" not in catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString(), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("values", [[0.0, 1.0, 1.0, 0.0, 1.0], [0.1 * k * k for k in range(301)]])
def test_bootstrap_draws(values):
    rng, n = random.Random(7), len(values)
    assert metrics._resampled(np.array(values), 50, 7) == [sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(50)]


def test_bootstrap_of_many_values(spark):
    rows = spark.range(60_000).select(F.lit("m").alias("metric"), F.col("id").alias("question_id"), (F.col("id") % 2).cast("double").alias("value"))
    begin = time.time()
    row = metrics.bootstrap_intervals(rows).first()
    assert 0.49 < row.low < 0.5 < row.high < 0.51 and time.time() - begin < 12


def test_few_texts_move_to_be_counted(spark, tmp_path):
    """Copies, rows that come twice, a very common text and null ids; only what may be a copy is shuffled."""
    from tokenizers import Tokenizer

    from docstrata.llm import tokencount
    from docstrata.llm.queries import tokenizer_path

    rng = random.Random(3)
    texts = [f"{rng.getrandbits(16_000):x}" for _ in range(600)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[k]) for k in range(20)] + [(5, texts[5]), (None, texts[7]), (None, "alone"), (None, None)] + [(2000 + k, "common") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before, kept = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    whole = Tokenizer.from_file(tokenizer_path())
    want = sorted((repr(i), len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    try:
        first, again = (tokencount.count_tokens(docs, tokenizer_path(), f"{tmp_path}/cache").collect() for _ in range(2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert shuffled() - before < sum(map(len, texts)) / 3
    for got in (first, again):
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert spark.read.parquet(f"{tmp_path}/cache").count() == len({t or "" for _, t in rows})


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_labels_of_citations_are_matched_once(spark):
    rows = [(1, "Điều 5\x1e khoản 2 Luật số 45/2019/QH14"), (2, "điểm b\x1f, khoản 3 Điều 7 của 100/2019/NĐ-CP và Điều 7"), (3, None)]
    cited = splitters.citations(spark.createDataFrame(rows, "answer_id long, text string"))
    assert optimized(cited).count("nghị\\s*quyết") == 1
    found = [(r.answer_id, r.document_id, r.article, r.clause, r.point) for r in cited.collect() if r.article != "5"]
    assert found[0] == (1, "45/2019/QH14", None, "2", None)
    assert sorted(map(repr, found[1:])) == sorted(map(repr, [(2, "100/2019/NĐ-CP", "7", "3", None), (2, "100/2019/NĐ-CP", "7", None, None)]))


def test_numbers_of_article_headings_are_read_once(spark):
    docs = spark.createDataFrame([("a", "# Điều 1. Một\n#Điều 2\n## Mẫu\n### Điều 2. Trong\n## Điều 2. Hai")], "source string, text string")
    found = splitters.article_headings(docs)
    assert optimized(found).count(splitters.ARTICLE_HEADING) == 1
    assert [tuple(r) for r in found.collect()] == [("a", 1, "Điều 1. Một", 0), ("a", 2, "Điều 2. Hai", 4)]


def test_rows_of_a_table_are_split_once(spark):
    table = spark.createDataFrame([("Giá\n| a |\n|---|\n| 1 |\n| 2 |\nHết",), ("không",)], "text string").select(splitters.table_parts(F.col("text"), 28).alias("parts"))
    assert optimized(table).count("split(") == 1
    assert [r.parts for r in table.collect()] == [["Giá\n| a |\n|---|\n| 1 |\nHết", "Giá\n| a |\n|---|\n| 2 |\nHết"], None]


def test_ends_of_triples_are_joined_once(spark):
    triples = spark.createDataFrame([("c", "Điều 1", "imposes", "Phạt 1"), ("c", None, "imposes", "!!"), (None, "Điều 1", "imposes", "Phạt 1")], "chunk_id string, subject string, predicate string, object string")
    entities = spark.createDataFrame([("c", "Điều  1", "Article"), ("c", "phạt 1", "Sanction"), ("c", "?", "Article"), ("c", None, "Article")], "chunk_id string, name string, label string")
    checked = graph.checked_triples(triples, entities)
    assert optimized(checked).count("Join LeftOuter") == 4
    assert sorted(map(repr, (r.status for r in checked.collect()))) == ["'ACCEPTED'", "'INVALID_ENDPOINT_TYPES'", "'UNRESOLVED_ENDPOINT'"]


def test_brackets_are_closed_by_tokens(spark):
    cases = {'x {"a": "}\\\\"} y}': '{"a": "}\\\\"}', '[{"a\\"]": 1}, "é😀]"] z': '[{"a\\"]": 1}, "é😀]"]', '{"a': None, '{"a\\': None, "no": None, "[}": "[}", "": None}
    frame = spark.createDataFrame([(k,) for k in [*cases, None]], "reply string")
    got = frame.select("reply", replies.balanced(F.col("reply")).alias("part"))
    assert "split(" not in optimized(got)
    assert {r.reply: r.part for r in got.collect()} == {**cases, None: None}


def test_rounds_of_a_push_are_no_jobs(spark):
    """A ring that takes over a hundred rounds, next to questions that stop earlier or have no edges."""
    edges = [("a", "b"), ("b", "a"), ("b", "a"), ("c", "d"), ("d", "end")]
    seeds = [(1, "a"), (2, "c"), (3, "none"), (4, "a"), (4, "end")]
    frames = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "question int, id string")
    spark.sparkContext.setJobGroup("push", "")
    try:
        found = push.forward_push(*frames, 1e-6).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("push"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60, jobs
    want, rounds = {}, 0
    out = {n: [b for a, b in edges if a == n] for n in ("a", "b", "c", "d", "end", "none")}
    for q in (1, 2, 3, 4):
        own = [n for i, n in seeds if i == q]
        score, left = dict.fromkeys(out, 0.0), {n: 1 / len(own) if n in own else 0.0 for n in out}
        n = 0
        while hot := {k: r for k, r in left.items() if r > 1e-6 * max(len(out[k]), 1)}:
            n += 1
            left = {k: 0.0 if k in hot else r for k, r in left.items()}
            for k, r in hot.items():
                score[k] += 0.15 * r
                for b in out[k] or own:
                    left[b] += 0.85 * r / len(out[k] or own)
        want |= {(q, k): (score[k], left[k]) for k in out if score[k] or left[k]}
        rounds = max(rounds, n)
    assert rounds > 60 and {(r.question, r.id) for r in found} == set(want)
    for r in found:
        assert abs(r.score - want[r.question, r.id][0]) < 1e-12 and abs(r.residual - want[r.question, r.id][1]) < 1e-12


def test_entities_of_chunks_are_dealt_once_by_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_LINES", 500)
    found = catalog.QUERIES["extracted_identities"](spark, sf_dir)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(chunk_id" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
    assert found.rdd.getNumPartitions() >= spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500


def test_canonical_ids_are_not_computed_again(spark):
    rows = [("c", 1, "Điều 1", "Article", None), ("c", 2, "điều  1", "Article", None), ("c", None, "Điều 1", "Article", None), ("c", 3, " ?", "Article", None)]
    empty = spark.createDataFrame([], "chunk_id string, position int, name string, category string, target string")
    once = assembly.cleaned_entities(spark.createDataFrame(rows, empty.schema), empty, spark.createDataFrame([("Article",)], "label string"))
    assert {(r.name, r.position.origin, r.position.position) for r in once.collect()} == {("Điều 1", 1, None), ("điều  1", 1, 2), (" ?", 1, 3)}
    named = assembly.identities(once)
    assert optimized(named).count("hiến pháp") == 1
    assert [(r.key, r.name, r.reason) for r in named.collect()] == [("điều 1", "Điều 1", "no target")]


def test_canonical_ids_take_two_patterns(spark):
    rows = [("Quyết định số 7/QĐ-TTg ngày 1", "quyết định 7 qđ ttg"), (" Luật An-ninh số 45/2019/QH14, x", "luật 45 2019 qh14"), ("-5 x", "-5 x"), ("--5?x", "5 x"), ("?!", ""), (None, None)]
    ids = spark.createDataFrame([r[:1] for r in rows], "phrase string").repartition(1).select("phrase", T.canonical_id("phrase").alias("id"))
    assert optimized(ids).count("regexp_replace(") == 2
    assert dict(tuple(r) for r in ids.collect()) == dict(rows)


def test_heading_trees_go_by_arrow(spark):
    rows = [("a", "# Một\nx [y](z)<br>w\n| 1 |\n#không\n## Hai\n"), ("b", None), (None, "lời"), ("c", "")]
    tree = splitters.heading_tree(spark.createDataFrame(rows, "source string, text string"))
    assert "MapInArrow" in optimized(tree) and "MapInPandas" not in optimized(tree)
    found = {(r.source_path, r.name, r.content, r.type, r.level, r.parent) for r in tree.collect()}
    assert found == {
        ("a", "Một", "| 1 |", "Table", 1, "Một"), ("a", "Một", "x y (z)\nw\n#không", "Text", 1, None), ("a", "Một / Hai", "", "Text", 2, "Một"), (None, "", "lời", "Text", 0, None),
    }
