"""Personalised PageRank of many questions at once by forward push, and the merge of graph and vector channels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import work_dir
from ..ship import ship
from .ranking import fuse

#: Questions whose rounds are one table of a task: some 100 MB with a threshold of 1e-3, as links of all nodes that are pushed are bounded.
QUESTIONS = 512
MERGED = {"exact": 1.0, "push": 1.0, "vector": 1.0}


def push_links(edges: DataFrame, threshold: float, degree: DataFrame | None = None) -> DataFrame:
    """``(src, degree, to)`` of the nodes that can ever be pushed; ``to`` has a ``(dst, degree)`` for each edge.

    A residual is never over 1, so a node with ``1 / threshold`` edges or more never is: its edges
    aren't read at all, which bounds the work that a hub makes, and each list.  ``degree`` is that of ``degrees``.
    """
    degree = degrees(edges) if degree is None else degree
    into = degree.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    low = degree.filter(F.col("degree") * F.lit(threshold) < 1).withColumnRenamed("id", "src")
    to = F.struct("dst", F.coalesce("dst_degree", F.lit(0)).alias("degree"))
    return edges.join(into, "dst", "left").join(low, "src").groupBy("src", "degree").agg(F.collect_list(to).alias("to"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` of the nodes that have edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def _rounds(threshold: float, damping: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(links: pa.Table, seeds: pa.Table) -> pa.Table:
        """All rounds of a group of questions at once, from ``links(question, src, to)`` and ``seeds(question, id, degree, share)``.

        A question stops before the round that pushes a node whose links aren't here; that node is asked for.
        """
        to, n_seeds = links["to"].combine_chunks(), len(seeds)
        lengths, ends = to.value_lengths().to_numpy(zero_copy_only=False), to.flatten()
        coded = lambda *parts: pa.chunked_array(parts).combine_chunks().dictionary_encode()
        questions = coded(seeds["question"].combine_chunks(), links["question"].combine_chunks())
        ids = coded(seeds["id"].combine_chunks(), links["src"].combine_chunks(), ends.field("dst"))
        of = questions.indices.to_numpy().astype(np.int64)
        key = np.concatenate([of, np.repeat(of[n_seeds:], lengths)]) * len(ids.dictionary) + ids.indices.to_numpy()
        nodes, at = np.unique(key, return_inverse=True)
        seed, source, dst = np.split(at, [n_seeds, n_seeds + len(links)])
        question, src = nodes // len(ids.dictionary), np.repeat(source, lengths)
        n, n_questions = len(nodes), len(questions.dictionary)

        degree, here = np.zeros(n), np.zeros(n, bool)
        degree[dst], degree[seed], here[source] = ends.field("degree").to_numpy(zero_copy_only=False), seeds["degree"].to_numpy(), True
        limit = np.where(degree * threshold < 1, threshold * np.maximum(degree, 1), np.inf)
        share = seeds["share"].to_numpy()
        score, residual = np.zeros(n), np.bincount(seed, share, n)
        stopped, asked = np.zeros(n_questions, bool), np.zeros(n, bool)
        while True:
            hot = (residual > limit) & ~stopped[question]
            missing = hot & (degree > 0) & ~here
            asked |= missing
            stopped[question[missing]] = True
            hot &= ~stopped[question]
            if not hot.any():
                break
            sent = np.where(hot, damping * residual, 0.0)
            score += np.where(hot, (1 - damping) * residual, 0.0)
            residual[hot] = 0.0
            moved = hot[src]
            residual += np.bincount(dst[moved], (sent / np.maximum(degree, 1))[src[moved]], n)
            lost = np.bincount(question, np.where(degree == 0, sent, 0.0), n_questions)
            residual[seed] += lost[question[seed]] * share
        out = np.flatnonzero(asked | (~stopped[question] & ((score > 0) | (residual > 0))))
        names = [x.dictionary.take(pa.array(k)) for x, k in ((questions, question[out]), (ids, nodes[out] % len(ids.dictionary)))]
        return pa.table([*names, pa.array(score[out]), pa.array(residual[out]), pa.array(asked[out])], ["question", "id", "score", "residual", "asked"])

    return run


def forward_push(edges: DataFrame, seeds: DataFrame, threshold: float = 1e-3, damping: float = 0.85) -> DataFrame:
    """``(question, id, score, residual)``: a lower bound of each node's personalised PageRank, for all of ``seeds(question, id)``.

    In each round all nodes whose residual is over ``threshold`` times their out-degree (1 for none) keep
    the restart share and send the rest along ``edges(src, dst)``; nodes without edges send it to their
    question's seeds.  It ends when no node is left over.  The true score of a node is at least ``score``
    and at most ``score`` plus its question's sum of ``residual`` (``push_bounds``); all true scores lie
    that far off in sum, too.

    Repeated edges count as often as they are there; edges and seeds with nulls don't count, repeated
    seeds count once.  A question pushes at most ``1 / ((1 - damping) * threshold)`` edges, however
    large the graph is, so the links that it needs are brought to it by joins, and the rounds run there:
    a group of ``QUESTIONS`` is a task's table.  There is a job for each time that some question needs nodes
    that weren't over before, not one for each round.  The graph's links are partitioned once and kept;
    questions that are done aren't read again.  What was brought and found is written, so lineage is short.
    """
    spark = edges.sparkSession
    ship(spark)
    path = work_dir(spark, "push")
    edges = edges.select("src", "dst").dropna()
    degree = degrees(edges)
    degree.write.parquet(f"{path}/degree")
    degree = spark.read.schema(degree.schema).parquet(f"{path}/degree")
    links = push_links(edges, threshold, degree).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    own = seeds.select("question", "id").dropna().distinct()
    share = 1.0 / F.count("*").over(Window.partitionBy("question"))
    start = own.join(degree, "id", "left").select("question", "id", F.coalesce("degree", F.lit(0)).alias("degree"), share.alias("share"))
    start.write.parquet(f"{path}/seeds")
    start = spark.read.schema(start.schema).parquet(f"{path}/seeds")
    groups = max(1, -(-start.count() // QUESTIONS))
    group = F.pmod(F.xxhash64("question"), F.lit(groups)).alias("g")
    kind = lambda c: start.schema[c].dataType.simpleString()
    found = f"question {kind('question')}, id {kind('id')}, score double, residual double, asked boolean"

    asked, n = start.filter("degree > 0").select("question", "id"), 0
    while True:
        # The short list of nodes is what meets the graph, and is held; the graph isn't sorted.
        wanted = links.join(asked.select(F.col("id").alias("src")).distinct().hint("shuffle_hash"), "src", "left_semi")
        brought = asked.join(wanted, asked["id"] == wanted["src"]).select("question", "src", "to")
        brought.write.parquet(f"{path}/brought/n={n}")
        near, first = spark.read.schema(brought.schema).parquet(*(f"{path}/brought/n={k}" for k in range(n + 1))), start
        if n:
            live = asked.select("question").distinct()
            near, first = near.join(live, "question", "left_semi"), start.join(live, "question", "left_semi")
        near, first = (rows.select("*", group).groupBy("g") for rows in (near, first))
        near.cogroup(first).applyInArrow(_rounds(threshold, damping), found).write.partitionBy("asked").parquet(f"{path}/found/n={n}")
        rows = spark.read.schema(found + ", n int").option("basePath", f"{path}/found").parquet(f"{path}/found/n={n}")
        asked = rows.filter("asked").select("question", "id")
        n += 1
        if asked.isEmpty():
            break
    links.unpersist()
    rows = spark.read.schema(found + ", n int").parquet(f"{path}/found")
    return rows.filter("not asked").select("question", "id", "score", "residual")


def push_bounds(pushed: DataFrame) -> DataFrame:
    """``(question, bound)``: by how much any score of a question may be too low."""
    return pushed.groupBy("question").agg(F.sum("residual").alias("bound"))


def channel(found: DataFrame, name: str, order: int, top_k: int) -> DataFrame:
    """The best ``top_k`` of ``found(question, id, score)`` as a channel of ``merged``; ties go to the smaller id, equal ids count once."""
    best = found.groupBy("question", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    return ranked.select(F.col("question").alias("query_id"), F.lit(name).alias("channel"), F.lit(order).alias("channel_order"), "rank", F.col("id").alias("doc_id"))


def merged(
    exact: DataFrame, pushed: DataFrame, vector: DataFrame, top_k: int = 20, least: float = 0.65, weights: dict[str, float] | None = None, wanted: Column | None = None,
) -> DataFrame:
    """``(question, id, score, rank, first)``: three channels ``(question, id, score)`` merged by reciprocal ranks.

    Exact neighbours, pushed scores and vectors at or above ``least`` give ``top_k`` each; scores of
    different channels aren't compared.  ``wanted`` tells, of a pushed row, whether its node is
    one to retrieve.  ``first`` is the channel of least order that holds the id.  A channel without
    rows for a question leaves the others as they are.
    """
    near = pushed.filter(F.col("score") > 0) if wanted is None else pushed.filter((F.col("score") > 0) & wanted)
    ranked = channel(exact, "exact", 0, top_k).union(channel(near, "push", 1, top_k)).union(channel(vector.filter(F.col("score") >= least), "vector", 2, top_k))
    out = fuse(ranked, weights or MERGED, top_k=top_k)
    return out.select(F.col("query_id").alias("question"), F.col("doc_id").alias("id"), "score", "rank", F.col("payload_channel").alias("first"))
