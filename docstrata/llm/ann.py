"""Nearest neighbours by additive quantisation (operator 9).

After Babenko & Lempitsky, "Additive Quantization for Extreme Vector Compression" (2014).  A vector
is the sum of one word from each of several full-dimensional codebooks, found by beam search; its
reconstruction's norm is stored for distances.  Codebooks start as residual k-means and are then
refined by least squares, on a bounded sample.  Every row is encoded.

Search: candidates form super-blocks of bounded size, and the queries stream past each of them.
Lookup tables score all codes, a shortlist that is a fixed share of the block is reranked with the
original vectors in double precision, and each block's best are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import prepared



@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions

    @property
    def dim(self) -> int:
        return self.words.shape[2]

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes of each row: in every book, the ``beam`` best partial sums go on."""
        books, words, _ = self.words.shape
        norms = (self.words**2).sum(2)
        out = np.empty((len(x), books), np.uint8)
        for at in range(0, len(x), 1024):
            rest = x[at : at + 1024, None, :].astype(np.float32)
            codes = np.zeros((len(rest), 1, 0), np.uint8)
            for m in range(books):
                error = (rest**2).sum(2)[:, :, None] - 2 * rest @ self.words[m].T + norms[m]
                flat = error.reshape(len(rest), -1)
                width = min(beam, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width]
                part, word = best // words, best % words
                rows = np.arange(len(rest))[:, None]
                codes = np.concatenate([codes[rows, part], word[:, :, None].astype(np.uint8)], axis=2)
                rest = rest[rows, part] - self.words[m][word]
            out[at : at + 1024] = codes[np.arange(len(rest)), (rest**2).sum(2).argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def lookup(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products, queries x codes, as sums of table entries."""
        tables = np.einsum("qd,mkd->mqk", queries.astype(np.float32), self.words)
        score = tables[0][:, codes[:, 0]]
        for m in range(1, len(tables)):
            score += tables[m][:, codes[:, m]]
        return score


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def train(sample: np.ndarray, books: int = 8, words: int = 256, refine: int = 2, seed: int = 5) -> Codebooks:
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    words = int(max(1, min(words, len(x))))
    rest, made = x.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, rng)
        rest = rest - centres[((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)]
        made.append(centres)
    model = Codebooks(np.stack(made).astype(np.float32))
    for _ in range(refine):
        codes = model.encode(x)
        at = codes.astype(np.int64) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float32)
        right = np.zeros((books * words, x.shape[1]), np.float32)
        for m in range(books):
            np.add.at(right, at[:, m], x)
            for o in range(books):
                np.add.at(gram, (at[:, m], at[:, o]), 1)
        gram[np.diag_indices_from(gram)] += 0.1
        own = model.words.reshape(-1, x.shape[1])
        model = Codebooks(np.linalg.solve(gram, right + 0.1 * own).reshape(model.words.shape).astype(np.float32))
    return model


def _valid(rows: DataFrame) -> DataFrame:
    """``(vec_id, v)`` without vectors that are null, empty, zero or hold null or non-finite components."""
    # Components stay doubles where the table has doubles: scores are those of the original vectors.
    kind = rows.schema["embedding"].dataType
    own_kind = "float" if isinstance(getattr(kind, "elementType", None), T.FloatType) else "double"
    x = F.transform(F.col("embedding"), lambda c: c.cast(own_kind))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).filter("vec_id is not null and size(v) > 0")
    return own.filter(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    )


def fit(vectors: DataFrame, bound: int = 16000, **options) -> Codebooks | None:
    """Codebooks from about ``bound`` rows, drawn by a hash of vec_id; None without rows.

    The dimension is that of most sampled rows; rows of other dimensions take no part in the index.
    """
    n = vectors.count()
    share = min(1.0, bound / max(n, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("v").toArrow().column("v")
    rows = [x.as_py() for x in drawn]
    if not rows:
        return None
    sizes, counts = np.unique([len(x) for x in rows], return_counts=True)
    dim = sizes[counts.argmax()]
    return train(_coded(np.array([x for x in rows if len(x) == dim])), **options)


def encoded(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """The index: ``(vec_id, v, codes, norm)`` for every valid row; norm is the vector's as a multiple of its reconstruction's.

    Codes shrink vectors, the more the worse they fit; the stored norm undoes that in the scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("v"), model.dim)
            codes = model.encode(_coded(x))
            near = np.linalg.norm(model.decode(codes).astype(np.float64), axis=1)
            norms = np.where(near > 0, np.linalg.norm(_coded(x).astype(np.float64), axis=1) / np.maximum(near, 1e-30), 1.0)
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())],
                names=["vec_id", "v", "codes", "norm"],
            )

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.filter(F.size("v") == model.dim).mapInArrow(run, f"vec_id long, v {kind}, codes binary, norm float")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _coded(x: np.ndarray) -> np.ndarray:
    """As the codebooks take them: 32 bits, within what their squares can hold."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores of each row, ties to the smaller id; columns are in the order of ids."""
    if score.shape[1] <= k:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape).copy()
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    over = score > edge
    need = k - over.sum(1, keepdims=True)
    level = score == edge
    chosen = over | (level & (np.cumsum(level, axis=1) <= need))
    return np.nonzero(chosen)[1].reshape(len(score), k)


def search(
    vectors: DataFrame, is_query: F.Column, k: int = 20, shortlist: int = 100, least_block: int = 8192, most_block: int = 131072, model: Codebooks | None = None, share: float = 0.07, **options
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row under ``is_query`` its ``k`` nearest by inner product.

    ``vectors`` has vec_id and embedding.  Null ids and vectors that are null, empty, zero, of another
    dimension or with null or non-finite components take no part.  A query isn't its own neighbour.
    Ties go to the smaller vec_id.  A vec_id that is there twice is one query (with the
    smaller vector, component by component) and one candidate per row.  An empty table gives no rows.

    Each block reranks its best ``share`` of the codes, ``shortlist`` at least: with a fixed number
    the share of true neighbours among them falls as the block grows.
    """
    spark = vectors.sparkSession
    prepared(spark)
    own = _valid(vectors)
    model = model or fit(own, **options)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = encoded(own, model)
    total = own.count()
    size = int(min(most_block, max(least_block, total / (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, math.ceil(total / size))
    held = index.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("side", F.lit(0))
    queries = own.filter(is_query).filter(F.size("v") == model.dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.withColumn("codes", F.lit(None).cast("binary")).withColumn("norm", F.lit(None).cast("float")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    columns = ["block", "side", "vec_id", "v", "codes", "norm"]
    both = held.select(columns).union(queries.select(columns)).repartition(blocks, "block").sortWithinPartitions("block", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for whole in batches:
            for batch in _runs(whole, ("block", "side")):
                now, side = batch.column("block")[0].as_py(), batch.column("side")[0].as_py()
                x = _matrix(batch.column("v"), model.dim)
                ids = np.asarray(batch.column("vec_id"))
                if side == 0:
                    parts = parts if now == block else []
                    block, ready = now, None
                    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                    parts.append((ids, x, codes, np.asarray(batch.column("norm"))))
                elif now == block:
                    ready = ready or tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                    for at in range(0, len(ids), 64):
                        yield _found(ids[at : at + 64], x[at : at + 64], *ready, model, k, max(shortlist, math.ceil(share * len(ready[0]))))

    near = both.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    if not len(batch):
        return
    change = np.zeros(len(batch) - 1, bool)
    for n in names:
        change |= np.diff(np.asarray(batch.column(n))) != 0
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
    for s, e in zip(edges, edges[1:], strict=False):
        yield batch.slice(s, e - s)


def _found(query_ids, queries, ids, x, codes, norms, model: Codebooks, k: int, shortlist: int) -> pa.RecordBatch:
    score = model.lookup(_coded(queries), codes) * norms
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    short = _best(score, ids, shortlist)
    exact = np.empty(short.shape)
    for at in range(0, len(short), 8):  # a few at a time: a long shortlist of vectors is large
        part = slice(at, at + 8)
        exact[part] = (x[short[part]].astype(np.float64) * queries[part, None, :].astype(np.float64)).sum(2)
    exact[query_ids[:, None] == ids[short]] = -np.inf
    best = np.lexsort((ids[short], -exact), axis=1)[:, :k]
    rows = np.arange(len(query_ids))[:, None]
    out, value = ids[short][rows, best], exact[rows, best]
    real = np.isfinite(value).ravel()
    columns = [np.broadcast_to(query_ids[:, None], out.shape).ravel()[real], out.ravel()[real], value.ravel()[real]]
    return pa.record_batch([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])
