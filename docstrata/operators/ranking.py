"""Dense retrieval, rank fusion, reranking and context handling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .bm25 import top


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Vectors on a side of a cell of pairs: some 17 MB of 64 single-precision components.
SIDE = 32_768
FOUND = "query_id {}, doc_id {}, score double"


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension in double precision, and which of them have no null component."""
    column = column.combine_chunks()
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values, ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(column), -1).any(axis=1)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, component after component as ``dot`` adds them."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(docs: pa.Table, queries: pa.Table) -> pa.Table:
        """A superset of the ``k`` best of each query of a cell: all that may be among them once scores are rounded, but of equal scores the first ``k`` ids."""
        names = pa.schema([("query_id", queries["query_id"].type), ("doc_id", docs["doc_id"].type), ("score", pa.float64())])
        if not len(docs) or not len(queries):
            return names.empty_table()
        docs = docs.sort_by("doc_id")
        with np.errstate(all="ignore"):
            (v, v_whole), (q, q_whole) = _matrix(docs["v"]), _matrix(queries["q"])
            v_norm, q_norm = np.sqrt(_sums(v, v)), np.sqrt(_sums(q, q))
            # Norms of 0 have no score; where squares may over- or underflow, every pair is looked at.
            v_ids, q_ids = (np.flatnonzero(whole & (norm != 0)) for whole, norm in ((v_whole, v_norm), (q_whole, q_norm)))
            unit = lambda x, norm: np.where(((norm > 1e-100) & (norm < 1e100))[:, None], x / norm[:, None], np.nan)
            v_unit, q_unit = unit(v[v_ids], v_norm[v_ids]), unit(q[q_ids], q_norm[q_ids])
            kept = []
            for at in range(0, len(q_ids), 512):
                some, own = q_unit[at : at + 512], q_ids[at : at + 512]
                rows, ids, scores = (np.empty(0, t) for t in (np.int64, np.int64, np.float64))
                least = np.full(len(own), -np.inf)
                for begin in range(0, len(v_ids), 4096):
                    near = some @ v_unit[begin : begin + 4096].T
                    floor = least
                    if begin == 0 and near.shape[1] > k:
                        floor = np.partition(np.where(np.isnan(near), np.inf, near), near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                    r, c = np.nonzero(~(near < (floor - 4e-9)[:, None]))
                    i = v_ids[c + begin]
                    norm = v_norm[i] * q_norm[own[r]]
                    r, i, norm = r[norm != 0], i[norm != 0], norm[norm != 0]
                    exact = _sums(v[i], q[own[r]]) / norm
                    rows, ids, scores = np.concatenate([rows, r]), np.concatenate([ids, i]), np.concatenate([scores, exact])
                    rows, ids, scores, least = _best(rows, ids, scores, least, k)
                kept.append((own[rows], ids, scores))
        rows, ids, scores = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([queries["query_id"].take(pa.array(rows)), docs["doc_id"].take(pa.array(ids)), pa.array(scores)], schema=names)

    return search


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What may be among the best ``k`` of each row, in the order of row, score (no number is the highest) and id, with the row's k-th score."""
    height = np.where(np.isnan(scores), np.inf, scores)
    order = np.lexsort((ids, -height, rows))
    if not len(order):
        return rows, ids, scores, least
    rows, ids, scores, height = rows[order], ids[order], scores[order], height[order]
    place = np.arange(len(rows))
    new_row = np.r_[True, rows[1:] != rows[:-1]]
    new_score = new_row | np.r_[True, height[1:] != height[:-1]]
    at = place - np.maximum.accumulate(np.where(new_row, place, 0))
    least = least.copy()
    least[rows[at == k - 1]] = height[at == k - 1]
    fine = (place - np.maximum.accumulate(np.where(new_score, place, 0)) < k) & ~(height < least[rows] - 4e-9)
    return rows[fine], ids[fine], scores[fine], least


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = SIDE) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` by cosine, for ``vectors(doc_id, v)`` and ``queries(query_id, q)``.

    Exact search: all pairs, laid out as a grid of cells with up to about ``most_queries`` queries and
    ``SIDE`` vectors of one dimension each.  A cell's products come from a matrix product in double
    precision; what may be among a query's best is computed once more in the order of ``cosine``, and
    the best of all cells are ranked.  Nothing is broadcast; a task holds a cell.  Vectors that are null
    or zero or hold nulls take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    q_parts, v_parts = (max(1, -(-df.count() // side)) for df, side in ((queries, most_queries), (vectors, SIDE)))
    # Few cells are cut finer along the vectors, so that all cores have some.
    v_parts = max(v_parts, -(-2 * spark.sparkContext.defaultParallelism // q_parts))
    key = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = queries.select("query_id", "q", F.size("q").alias("n"), key("query_id", q_parts).alias("i")).filter("n > 0").withColumn("j", every(v_parts))
    docs = vectors.select("doc_id", "v", F.size("v").alias("n"), key("doc_id", v_parts).alias("j")).filter("n > 0").withColumn("i", every(q_parts))
    # More partitions than cells, so that few cells meet in one task.
    cells = min(4_096, 3 * q_parts * v_parts)
    own, docs = (df.repartition(cells, "n", "i", "j").groupBy("n", "i", "j") for df in (own, docs))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = docs.cogroup(own).applyInArrow(_nearest(k), FOUND.format(kind(queries, "query_id"), kind(vectors, "doc_id")))
    return top(found.withColumn("score", F.round("score", 9)), k)


def link_entities(names: DataFrame, vectors: DataFrame, threshold: float, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The nearest vector of each name at or above the threshold, without excluded labels."""
    usable = vectors.filter(~F.col("label").isin(*excluded)) if excluded else vectors
    return dense_search(usable.select("doc_id", "v"), names, 1).filter(F.col("score") >= threshold)


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = 60, top_k: int = 10, last_payload: bool = False) -> DataFrame:
    """Reciprocal rank fusion of ``ranked(query_id, channel, channel_order, rank, doc_id)``.

    A key counts once per channel, at its best rank.  Ties go to what was seen first: by channel
    order, then rank.  ``payload_channel`` is the first channel that holds the key, or the last.
    """
    best = ranked.groupBy("query_id", "channel", "channel_order", "doc_id").agg(F.min("rank").alias("rank"))
    weight = F.lit(1.0)
    for channel, w in (weights or {}).items():
        weight = F.when(F.col("channel") == channel, F.lit(float(w))).otherwise(weight)
    payload = F.max_by if last_payload else F.min_by
    fused = best.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 12).alias("score"),
        F.min(F.struct("channel_order", "rank")).alias("seen"),
        payload("channel", "channel_order").alias("payload_channel"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("seen")


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], top_k: int) -> DataFrame:
    """``candidates(query_id, doc_id, query, text)`` by a model's score, which replaces the fused one."""
    return top(candidates.withColumn("score", score(F.col("query"), F.col("text"))), top_k)


def within_budget(contexts: DataFrame, budget: int) -> DataFrame:
    """``contexts(query_id, rank, size)`` that a greedy reader keeps: in rank order, what still fits; the rest is skipped.

    The list of one query is bounded by its retrieval depth.
    """
    listed = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "size"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, c: Column) -> Column:
        more = F.struct((s["used"] + c["size"]).cast("long").alias("used"), F.concat(s["kept"], F.array(c["rank"].cast("int"))).alias("kept"))
        return F.when(s["used"] + c["size"] <= budget, more).otherwise(s)

    kept = listed.select("query_id", F.explode(F.aggregate("all", start, step)["kept"]).alias("rank"))
    return contexts.join(kept, ["query_id", "rank"])


def dedup_contexts(contexts: DataFrame, key: str, order: str, by: str = "query_id") -> DataFrame:
    """The first context of each key, with dense new ranks."""
    first = contexts.withColumn("_n", F.row_number().over(Window.partitionBy(by, key).orderBy(order))).filter("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def citation_previews(contexts: DataFrame, length: int = 200) -> DataFrame:
    """Numbered sources of an answer: a snippet each, one per chunk, with the number of its first context."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    kept = contexts.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return kept.select("query_id", F.col("rank").alias("number"), "chunk_id", F.substring("text", 1, length).alias("snippet"))


def format_context(contexts: DataFrame) -> DataFrame:
    """One prompt block per query: its contexts in rank order, numbered and headed by their source."""
    block = F.format_string("[%d] %s\n%s", F.col("rank"), F.coalesce("source", F.lit("")), F.col("text"))
    listed = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("all"))
    return listed.select("query_id", F.array_join(F.transform("all", lambda x: x["block"]), "\n\n").alias("context"))
