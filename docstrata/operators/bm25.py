"""BM25 over normalised index tables, for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import index_tokens
from ..ship import ship

#: Words that are broadcast; each takes some 50 bytes.
FEW = 1 << 17
#: Rows of queries' words, or of hits, that are broadcast; each takes some 50 bytes.
FEW_ROWS = 1 << 20
#: Cells of words by queries that a task holds (8 bytes each), and of documents by words or queries that it scores at once.
CELLS, BLOCK = 1 << 22, 1 << 21


@dataclass
class Index:
    """postings(doc_id, term, tf), terms(term, df, idf), docs(doc_id, dl), stats(n, avgdl).

    ``key`` names the columns by which postings belong to documents; postings of none are ignored.
    ``tokens(doc_id, dl, term)`` are those of an index that is fitted on the way, one row each: a search
    counts those that its queries hold, in place of all postings.
    """

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame
    key: tuple[str, ...] = ("doc_id",)
    tokens: DataFrame | None = None

    def save(self, path: str) -> None:
        """Write the tables; postings are clustered by term, so that a look-up reads few row groups."""
        self.postings.repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("terms", "docs", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index | None:
        """The saved index, or None if there is none; a damaged or partial one is an error."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        try:
            postings = read("postings")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return Index(postings, *(read(name) for name in ("terms", "docs", "stats")))


def fit(docs: DataFrame, codes: bool = False) -> Index:
    """Index of ``docs(doc_id, text)``.  A text without tokens counts as a document of length 0."""
    tokens = docs.select("doc_id", F.coalesce(index_tokens("text", codes), F.array().cast("array<string>")).alias("tokens"))
    lengths = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = terms_of(tokens, "doc_id", F.col("tokens")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.join(F.broadcast(stats), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    each = tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).filter("term is not null")
    return Index(postings, terms, lengths, stats, tokens=each)


def terms_of(rows: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``(key, term)``, one row per token.

    By the outer form: for the other one the optimizer adds a filter that evaluates the array again.
    """
    return rows.select(key, F.explode_outer(tokens).alias("term")).filter("term is not null")


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1.0)


def top(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; ties by ``tie``.  A window of bounded rank keeps k rows per partition before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_scores(weights: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of rows ``(doc_id, words, parts)`` as products with ``weights``, by word and query.

    Of each query those go out that are among the ``k`` best so far, or would be if rounded.
    """
    n_words, n_queries = weights.shape
    step = max(1, BLOCK // max(n_words, n_queries))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((k, n_queries))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                words, parts = part.column("words"), part.column("parts")
                row = np.repeat(np.arange(part.num_rows), np.diff(words.offsets.to_numpy()))
                cell = row * n_words + words.flatten().to_numpy()
                matrix = np.bincount(cell, parts.flatten().to_numpy(), part.num_rows * n_words).reshape(-1, n_words) @ weights
                best = np.partition(np.concatenate([best, matrix]), -k, axis=0)[-k:]
                doc, query = np.nonzero((matrix > 0) & (matrix >= best.min(axis=0) - 1e-8))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(query.astype(np.int32)), pa.array(matrix[doc, query])], ["doc_id", "query", "score"])

    return scores


def _scored_by_blocks(index: Index, wanted: DataFrame, words: DataFrame, queries: DataFrame, k: int, k1: float, norm: Column) -> DataFrame:
    """``(query_id, doc_id, score)``, the best ``k`` of each query at least: a document's words come together once, and blocks of documents meet all queries."""
    spark = wanted.sparkSession
    ship(spark)
    weighed = wanted.join(index.terms.join(F.broadcast(words), "term", "left_semi"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf") * (k1 + 1)).alias("weight")).collect()
    terms = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in weighed))}
    ids = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in weighed))}
    weights = np.zeros((max(1, len(terms)), max(1, len(ids))))
    for r in weighed:
        weights[terms[r.term], ids[r.query_id]] += r.weight
    key = list(index.key)
    numbers = spark.createDataFrame(list(terms.items()), "term string, word int")
    found = index.postings.join(F.broadcast(numbers), "term").groupBy(*key).agg(F.collect_list(F.struct("word", F.col("tf").cast("double").alias("tf"))).alias("found"))
    lengths = index.docs.join(F.broadcast(index.stats), how="cross").select(*key, norm.alias("norm"))
    parts = F.transform("found", lambda x: x["tf"] / (x["tf"] + F.col("norm")))
    rows = found.join(lengths, key).select("doc_id", F.col("found.word").alias("words"), parts.alias("parts"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_block_scores(weights, k), f"doc_id {kind}, query int, score double")
    names = spark.createDataFrame([(i, q) for q, i in ids.items()], f"query int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return scored.join(F.broadcast(names), "query").select("query_id", "doc_id", "score")


def search(index: Index, queries: DataFrame, k: int = 5, codes: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` for ``queries(query_id, text)``.

    A query's repeated tokens count as often as they come, unknown ones not at all, and only scores
    above zero are returned.  If the queries have few words, these are broadcast and prune postings where
    they are read; beyond, postings meet them by shuffle.  An index that is fitted on the way counts the
    queries' words only, with tokens dealt by document: hits, many for each posting, stay where their document is.
    Of any other index, too, hits aren't rows as long as a table of words by queries is small (``CELLS``): documents are scored by blocks.
    """
    tokens = terms_of(queries, "query_id", index_tokens("text", codes))
    wanted = tokens.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = wanted.select("term").distinct()
    n_words, n_rows, n_queries = wanted.agg(F.count_distinct("term"), F.count("*"), F.count_distinct("query_id") + 1).first()
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    if index.tokens is not None and n_words <= FEW and n_rows <= FEW_ROWS:
        found = index.tokens.join(F.broadcast(words), "term", "left_semi").repartition("doc_id")
        # The filter, which is always true, has both uses read the same columns, so that tokens are shuffled once.
        postings = found.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")).filter("dl > 0")
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        weighed = wanted.join(df, "term").join(F.broadcast(index.stats), how="cross").select("query_id", "term", "qtf", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
        hits = postings.join(F.broadcast(weighed), "term").withColumn("norm", norm)
    elif n_words <= FEW and n_words * n_queries <= CELLS:
        scored = _scored_by_blocks(index, wanted, words, queries, k, k1, norm)
        return top(scored.withColumn("score", F.round("score", 9)), k)
    else:
        lengths = index.docs.join(F.broadcast(index.stats), how="cross").select(*index.key, norm.alias("norm"))
        postings = index.postings.join(F.broadcast(words), "term", "left_semi") if n_words <= FEW else index.postings
        hits = wanted.join(index.terms, "term").join(postings, "term").join(lengths, list(index.key))
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score")).filter("score > 0")
    return top(scored.withColumn("score", F.round("score", 9)), k)


def with_documents(hits: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """``hits`` with the columns of ``docs(doc_id, ...)``.  At ``most`` so many hits are broadcast if they are few, and no text is shuffled."""
    return docs.join(F.broadcast(hits) if most <= FEW_ROWS else hits, "doc_id")
