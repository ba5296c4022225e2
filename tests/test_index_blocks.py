"""The segment index: scores by blocks of documents, and lengths that are sums of counts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docstrata.operators import bm25, segments


def test_scores_by_blocks_are_those_of_joined_hits(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{min(int(rng.expovariate(0.08)), 60)}" for _ in range(n))
    rows = [(i, text(rng.randrange(0, 40))) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]  # ties by id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "index")
    segments.append(docs.withColumn("text", F.concat("text", F.lit(" old"))), path, 0)
    segments.append(docs.filter("doc_id % 2 = 0"), path, 1, gone=docs.filter("doc_id % 7 = 1").select("doc_id"))
    queries = spark.createDataFrame([(f"q{i}", text(12)) for i in range(9)] + [("odd", "nothing known"), ("none", None)], "query_id string, text string")
    found = lambda: sorted(map(tuple, bm25.search(segments.load(spark, path), queries, 6).collect()))
    monkeypatch.setattr(bm25, "BLOCK", 300)
    blocks = found()
    monkeypatch.setattr(bm25, "CELLS", 0)
    assert blocks == found() and len(blocks) == 54


def test_lengths_are_sums_of_counts(spark, tmp_path):
    path = str(tmp_path / "index")
    segments.append(spark.createDataFrame([(1, "a b a"), (2, None), (3, "c"), (3, "c")], "doc_id long, text string"), path, 0)
    index = segments.load(spark, path)
    assert sorted((r.doc_id, r.dl) for r in index.docs.collect()) == [(1, 3), (2, 0), (3, 1)]
    assert sorted(map(tuple, index.postings.select("doc_id", "term", "tf").collect())) == [(1, "a", 2), (1, "b", 1), (3, "c", 1)]
