"""Queries over whole tables against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import numpy as np
import pytest

from docstrata import catalog
from docstrata.plans import retrieval
from docstrata.functions import text as T

GROUPED = [
    "1.000.000 a b c d e f g", "1 000 a b c d", "a 12,345 b 6 c", "phạt 100.000.000 đồng", "2026.01 1.2.3 a b", "1234 567 8 9", "không tìm thấy 1.000 văn bản",
    "no information on 1 000 000", "insufficient", "12.345 có", "", None, "x y z",
]


def brute_normal(text: str | None) -> str:
    out = re.sub(r"[*`#_|~]", "", unicodedata.normalize("NFC", text or ""))
    out = re.sub(r"(?<![0-9])[0-9]{1,3}(?:[ .,\u00a0\u202f][0-9]{3})+(?![0-9])", lambda m: re.sub("[^0-9]", "", m[0]), out)
    return " ".join(out.lower().split())


def test_every_document_is_counted(spark, tmp_path):
    spark.createDataFrame(list(enumerate(GROUPED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n for r in catalog.QUERIES["token_counter"](spark, str(tmp_path)).collect()}
    assert got == {k: max(len(re.findall(catalog.MATCH, brute_normal(t))), math.ceil(len(t or "") / 4)) for k, t in enumerate(GROUPED)}
    assert got[0] == 8 and got[1] == 5


def test_every_turn_is_judged(spark, tmp_path):
    spark.createDataFrame([(1, k, t) for k, t in enumerate(GROUPED)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.abstains for r in catalog.QUERIES["abstention"](spark, str(tmp_path)).collect()}
    assert got == {k: any(c in brute_normal(t) for c in T.ABSTENTION_CUES) if brute_normal(t) else None for k, t in enumerate(GROUPED)}
    assert got[6] is True and got[7] is True and got[3] is False


def test_bootstrap_takes_a_thousand_resamples(spark, tmp_path):
    quality = [(k * 7) % 5 % 2 for k in range(53)]
    spark.createDataFrame([(k, "en") for k in range(53)], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    (got,) = catalog.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()
    rng = random.Random(20260101)
    means = [sum(quality[rng.randrange(53)] for _ in range(53)) / 53 for _ in range(1000)]
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert (got.low, got.high) != pytest.approx(tuple(np.quantile(means[:200], [0.025, 0.975])))


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Passages 0 to 29, each in one document, and vectors 0 to 119."""
    folder = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 8)).round(3)
    spark.createDataFrame([(k, x[k].tolist(), k % 5) for k in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k}") for k in range(30)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} common") for k in range(120)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return folder, (x @ x.T).round(9)


def brute_top(scores: np.ndarray, k: int) -> list[int]:
    return sorted(range(len(scores)), key=lambda d: (-scores[d], d))[:k]


def brute_fused(near: list[int], own: int, weights: dict[str, float]) -> list[int]:
    score, seen = {}, {}
    for channel, order, found in (("vector", 0, near), ("bm25", 1, [own])):
        for rank, d in enumerate(found, 1):
            score[d] = score.get(d, 0) + weights.get(channel, 1) / (60 + rank)
            seen.setdefault(d, (order, rank))
    return sorted(score, key=lambda d: (-round(score[d], 12), seen[d], d))[:10]


def ranked(rows, k: str = "query_id") -> dict:
    out = {}
    for r in sorted(rows, key=lambda r: (r[k], r["rank"])):
        out.setdefault(r[k], []).append(r.doc_id)
    return out


def test_dense_search_of_one_in_fifty(spark, vectors):
    folder, cosine = vectors
    assert ranked(catalog.QUERIES["dense_topk"](spark, folder).collect()) == {q: brute_top(cosine[q], 10) for q in (0, 50, 100)}


@pytest.mark.parametrize("name, weights", [("rrf_fuse", {}), ("rrf_weighted", retrieval.WEIGHTS)])
def test_fusion_of_all_common_queries(spark, vectors, name, weights):
    folder, cosine = vectors
    assert ranked(catalog.QUERIES[name](spark, folder).collect()) == {q: brute_fused(brute_top(cosine[q], 10), q, weights) for q in range(30)}


def test_every_passage_has_both_channels(spark, vectors):
    folder, cosine = vectors
    got = ranked(catalog.QUERIES["hybrid_retrieve"](spark, folder).collect())
    assert set(got) == set(range(30))
    for q, found in got.items():
        candidates = brute_fused(brute_top(cosine[q], 10), q, retrieval.WEIGHTS)
        assert found[0] == q and len(found) == 5 and set(found) <= set(candidates)


def test_every_name_is_linked(spark, vectors):
    folder, cosine = vectors
    usable = [d for d in range(120) if d % 5 != 3]
    want = {q: min(usable, key=lambda d: (-cosine[q][d], d)) for q in range(120)}
    got = {r.query_id: r.doc_id for r in catalog.QUERIES["entity_link"](spark, folder).collect()}
    assert got == {q: d for q, d in want.items() if cosine[q][d] >= 0.4}


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """Twelve customers in four nations in two regions; edges and seeds as Python."""
    folder = str(tmp_path_factory.mktemp("customers"))
    rows = [(k, k * k % 4, ("BUILDING", "MACHINERY", None)[k % 3]) for k in range(12)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(n, n % 2) for n in range(4)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    edges = [(f"c{k}", "in", f"n{n}") for k, n, _ in rows] + [(f"n{n}", "part", f"r{n % 2}") for n in range(4)]
    return folder, edges, [f"c{k}" for k, _, segment in rows if segment == "BUILDING"]


def test_one_hop_from_a_segment(spark, customers):
    folder, edges, seeds = customers
    got = [tuple(r) for r in catalog.QUERIES["one_hop"](spark, folder).select("src", "label", "dst").collect()]
    assert sorted(got) == sorted(e for e in edges if e[0] in seeds)


def test_pagerank_takes_ten_rounds(spark, customers):
    folder, edges, seeds = customers
    names = sorted({x for s, _, d in edges for x in (s, d)})
    restart = {x: (x in seeds) / len(seeds) for x in names}
    out = {x: [d for s, _, d in edges if s == x] for x in names}
    rounds = [restart]
    for _ in range(10):
        last = rounds[-1]
        lost = sum(last[x] for x in names if not out[x])
        rounds.append({x: 0.85 * (sum(last[s] / len(out[s]) for s in names if x in out[s]) + lost * restart[x]) + 0.15 * restart[x] for x in names})
    got = {r.id: r.score for r in catalog.QUERIES["pagerank"](spark, folder).collect()}
    assert got == pytest.approx(rounds[10], abs=1e-8) and got != pytest.approx(rounds[2], abs=1e-3)
