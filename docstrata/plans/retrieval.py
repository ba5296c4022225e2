"""Hybrid retrieval as one plan over many questions: channels, fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_coverage
from ..operators import bm25, ranking

CHANNELS = {"vector": 0, "bm25": 1, "graph": 2}
WEIGHTS = {"bm25": 1.2, "vector": 1.0, "graph": 0.8}


def expand_abbreviations(queries: DataFrame, table: dict[str, str]) -> DataFrame:
    """Queries with abbreviations spelled out; the deterministic part of rewriting."""
    out = F.col("text")
    for short, full in table.items():
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){short}(?![\p{{L}}\p{{N}}])", full)
    return queries.withColumn("text", out)


def rewritten(queries: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """Queries as a model writes them; where it fails or says nothing, as they were."""
    new = model(F.col("text"))
    return queries.withColumn("text", F.when(F.trim(F.coalesce(new, F.lit(""))) != "", new).otherwise(F.col("text")))


def graph_channel(queries: DataFrame, mentions: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of entities one edge from those that a query names, by how many of them lead there."""
    from ..operators.graph import contained_names

    named = contained_names(queries.select(F.col("query_id").alias("doc_id"), "text"), mentions.select("name").distinct())
    seeds = named.join(mentions, "name").select(F.col("doc_id").alias("query_id"), "id")
    near = seeds.unionByName(seeds.join(edges, seeds["id"] == edges["src"]).select("query_id", F.col("dst").alias("id")))
    scored = near.join(chunks, "id").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return scored


def hybrid(channels: dict[str, DataFrame], texts: DataFrame, queries: DataFrame, top_k: int = 5, weights: dict[str, float] = WEIGHTS, score=None) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: channels fused to twice ``top_k``, then reranked.

    ``channels`` holds ranked DataFrames; a channel that is left out is one that failed.
    """
    ranked = None
    for name, found in channels.items():
        own = found.select("query_id", F.lit(name).alias("channel"), F.lit(CHANNELS[name]).alias("channel_order"), "rank", "doc_id")
        ranked = own if ranked is None else ranked.unionByName(own)
    fused = ranking.fuse(ranked, weights, top_k=2 * top_k).select("query_id", "doc_id")
    named = queries.select("query_id", F.col("text").alias("query"))
    candidates = bm25.with_documents(fused.join(named, "query_id"), texts.select("doc_id", "text"), 2 * top_k * named.count())
    score = score or (lambda query, text: F.coalesce(F.round(token_coverage(query, text), 9), F.lit(0.0)))
    return ranking.rerank(candidates, score, top_k).select("query_id", "doc_id", "score", "rank")


def bm25_channel(docs: DataFrame, queries: DataFrame, k: int, codes: bool = True) -> DataFrame:
    return bm25.search(bm25.fit(docs, codes), queries, k, codes)
