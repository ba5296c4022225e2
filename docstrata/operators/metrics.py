"""Retrieval, answer, citation, grounding and abstention metrics; aggregation with intervals and gates.

A null metric isn't zero: it is either not applicable or unavailable, and is left out of means.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..ship import ship

KS = (1, 3, 5, 10)


def share(hits: Column, total: Column) -> Column:
    """A ratio that is null over nothing."""
    return hits / F.nullif(total, F.lit(0))


def retrieval_metrics(support: DataFrame, ks: Iterable[int] = KS) -> DataFrame:
    """Per question, from ``support(question_id, evidence, required, supported, rank, n_contexts, error)``.

    Recall counts supported evidence; undecided evidence stays in the denominator.  Without evidence
    all is null; after an error without contexts too, while no contexts alone give zero.  The first
    hit is that of required evidence, or of any if none is required.
    """
    hit = F.coalesce("supported", F.lit(False))
    any_required = F.max(F.col("required"))
    first = F.when(any_required, F.min(F.when(hit & F.col("required"), F.col("rank")))).otherwise(F.min(F.when(hit, F.col("rank"))))
    out = support.groupBy("question_id").agg(
        F.count("evidence").alias("n"),
        F.count(F.when(hit, 1)).alias("found"),
        share(F.count(F.when(hit & F.col("required"), 1)), F.count(F.when(F.col("required"), 1))).alias("recall_required"),
        F.max(F.col("error") & (F.col("n_contexts") == 0)).alias("failed"),
        first.alias("first_rank"),
        *(F.count(F.when(hit & (F.col("rank") <= k), 1)).alias(f"found_{k}") for k in ks),
    )
    ok = (F.col("n") > 0) & ~F.coalesce("failed", F.lit(False))
    value = lambda c: F.when(ok, c)
    return out.select(
        "question_id", value(share(F.col("found"), F.col("n"))).alias("recall"), value(F.col("recall_required")).alias("recall_required"),
        value(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        *(value(share(F.col(f"found_{k}"), F.col("n"))).alias(f"recall_{k}") for k in ks),
        *(value((F.coalesce(F.col("first_rank"), F.lit(1 << 30)) <= k).cast("double")).alias(f"hit_{k}") for k in ks),
    )


def context_precision(contexts: DataFrame) -> DataFrame:
    """Share of ``contexts(question_id, relevant)`` that support anything."""
    return contexts.groupBy("question_id").agg(F.avg(F.coalesce("relevant", F.lit(False)).cast("double")).alias("precision"))


def relevance(a_id: Column, b_id: Column, a: Column, b: Column, least: float = 0.65) -> Column:
    """Binary relevance of two texts: same id, one inside the other, or trigram overlap."""
    x, y = T.word_trigrams(a), T.word_trigrams(b)
    overlap = F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0))
    one, two = F.lower(F.trim(a)), F.lower(F.trim(b))
    inside = (one != "") & (two != "") & (F.contains(one, two) | F.contains(two, one))
    return F.coalesce(a_id == b_id, F.lit(False)) | F.coalesce(inside, F.lit(False)) | F.coalesce(overlap >= least, F.lit(False))


def ranking_metrics(ranked: DataFrame, ks: Iterable[int] = (1, 3, 5)) -> DataFrame:
    """Per question, from ``ranked(question_id, rank, relevant, n_gold)``: hit, precision, recall, MRR and nDCG.

    Precision divides by what was retrieved, recall counts no more hits than there is gold, nDCG is at most 1.
    """
    rel = F.col("relevant").cast("int")
    gain = rel / F.log2(F.col("rank") + 1)
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.sum(F.when(inside, rel).otherwise(0)).alias(f"h{k}"), F.sum(F.when(inside, 1).otherwise(0)).alias(f"n{k}"), F.sum(F.when(inside, gain).otherwise(0.0)).alias(f"g{k}")]
    out = ranked.groupBy("question_id").agg(F.max("n_gold").alias("n_gold"), F.min(F.when(rel == 1, F.col("rank"))).alias("first"), *sums)
    columns = ["question_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_gold"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        columns += [
            (F.col(f"h{k}") > 0).cast("double").alias(f"hit_{k}"),
            F.round(F.coalesce(share(F.col(f"h{k}"), F.col(f"n{k}")), F.lit(0.0)), 4).alias(f"precision_{k}"),
            F.round(F.coalesce(share(F.least(F.col(f"h{k}"), F.col("n_gold")), F.col("n_gold")), F.lit(0.0)), 4).alias(f"recall_{k}"),
            F.round(F.least(F.col(f"g{k}") / ideal, F.lit(1.0)), 4).alias(f"ndcg_{k}"),
        ]
    return out.select(*columns)


def marker_metrics(markers: DataFrame) -> DataFrame:
    """``hit_rate`` and ``hit_all`` per question over ``markers(question_id, marker, answer)``; placeholders don't count."""
    real = markers.filter(~F.startswith(F.trim("marker"), F.lit("<")))
    hit = T.contains_marker("answer", "marker")
    return real.groupBy("question_id").agg(F.avg(hit.cast("double")).alias("hit_rate"), F.min(hit).alias("hit_all"))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean: zero if both are, null if either is null."""
    return F.when((precision + recall) == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def claim_metrics(claims: DataFrame) -> DataFrame:
    """Precision over answer claims and recall over gold claims, from ``claims(question_id, side, supported)``."""
    hit = F.coalesce("supported", F.lit(False))
    of = lambda side: share(F.count(F.when(hit & (F.col("side") == side), 1)), F.count(F.when(F.col("side") == side, 1)))
    out = claims.groupBy("question_id").agg(of("answer").alias("claim_precision"), of("gold").alias("claim_recall"))
    return out.withColumn("claim_f1", f1(F.col("claim_precision"), F.col("claim_recall")))


def grounding_metrics(claims: DataFrame) -> DataFrame:
    """Per question, from ``claims(question_id, status)`` in the five classes of claims."""
    n = lambda *names: F.count(F.when(F.col("status").isin(*names), 1))
    return claims.groupBy("question_id").agg(
        share(n("supported_by_context"), F.count("*")).alias("faithfulness"),
        share(n("contradicted"), F.count("*")).alias("hallucination"),
        share(n("supported_by_gold_not_context"), F.count("*")).alias("retrieval_gap"),
        share(n("unsupported", "contradicted"), n("unsupported", "contradicted", "supported_by_gold_not_context")).alias("unsupported"),
    )


def citation_metrics(citations: DataFrame, required: DataFrame) -> DataFrame:
    """Precision over decided citations ``(question_id, correct)``; recall over required evidence ``(question_id, cited)``."""
    p = citations.groupBy("question_id").agg(F.avg(F.col("correct").cast("double")).alias("citation_precision"))
    r = required.groupBy("question_id").agg(F.avg(F.coalesce("cited", F.lit(False)).cast("double")).alias("citation_recall"))
    return p.join(r, "question_id", "full_outer")


def abstention_accuracy(answerable: Column, abstained: Column) -> Column:
    """For unanswerable questions whether the answer declined; null for others and where undecided."""
    return F.when(~answerable, abstained.cast("double"))


# ---------------------------------------------------------------- aggregation


def micro_macro(records: DataFrame) -> DataFrame:
    """``records(question_id, category, metric, value, status)`` → per metric micro and macro mean and counts.

    Micro is the mean of values, macro the mean of category means; nulls are counted by status, and a
    category without values shows as null.
    """
    status = F.when(F.col("value").isNull(), F.coalesce("status", F.lit("unavailable")))
    by = records.withColumn("status", status).groupBy("metric", "category").agg(
        F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n"),
        F.count(F.when(F.col("status") == "not_applicable", 1)).alias("na"), F.count(F.when(F.col("status") == "unavailable", 1)).alias("gone"),
    )
    return by.groupBy("metric").agg(
        (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("micro"), F.avg("mean").alias("macro"), F.sum("n").alias("n"),
        F.sum("na").alias("not_applicable"), F.sum("gone").alias("unavailable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "mean")))).alias("by_category"),
    )


def percentile_truncated(values: Column, p: float) -> Column:
    """The value at index ``floor(n p / 100)`` of the sorted values, the last at most."""
    ordered = F.array_sort(F.collect_list(values))
    at = F.least((F.size(ordered) * F.lit(p) / 100).cast("int"), F.size(ordered) - 1)
    return F.get(ordered, at)


def _resampled(own: np.ndarray, resamples: int, seed: int) -> list[float]:
    """Means of resamples, drawn as ``random.Random(seed).randrange`` does, number for number, a block at a time."""
    n = len(own)
    _, key, _ = random.Random(seed).getstate()
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], dtype=np.uint32), "pos": key[-1]}}
    shift, drawn, means = np.uint64(32 - n.bit_length()), np.empty(0, np.int64), []
    # Sums of whole numbers are exact in any order.
    whole = bool(np.isfinite(own).all() and (own == np.floor(own)).all() and np.abs(own).max() * n < 2**53)
    for _ in range(resamples):
        parts, have = [drawn], len(drawn)
        while have < n:
            raw = (source.random_raw(max(1 << 16, 2 * (n - have))) >> shift).astype(np.int64)
            parts.append(raw[raw < n])
            have += len(parts[-1])
        drawn = np.concatenate(parts)
        some, drawn = own[drawn[:n]], drawn[n:]
        means.append(float(some.sum() if whole else sum(some.tolist())) / n)
    return means


def bootstrap_intervals(values: DataFrame, resamples: int = 1000, seed: int = 20260101, level: float = 0.95) -> DataFrame:
    """Percentile intervals of the mean per metric of ``values(metric, question_id, value)``, in question order; null below two values.

    A task holds one metric's values; its resamples come one after another from one generator.
    """
    ship(values.sparkSession)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.dropna(subset=["value"]).sort_values("question_id")["value"].to_numpy(dtype=float)
        name = frame["metric"].iloc[0]
        if len(own) < 2:
            return pd.DataFrame({"metric": [name], "low": [None], "high": [None]})
        tail = (1 - level) / 2
        edges = pd.Series(sorted(_resampled(own, resamples, seed))).quantile([tail, 1 - tail])
        return pd.DataFrame({"metric": [name], "low": [edges.iloc[0]], "high": [edges.iloc[1]]})

    return values.select("metric", "question_id", "value").groupBy("metric").applyInPandas(one, "metric string, low double, high double")


def stage_latencies(stages: DataFrame) -> DataFrame:
    """Mean, extremes, percentiles and share of the total of ``stages(stage, seconds)``."""
    out = stages.groupBy("stage").agg(
        F.count("seconds").alias("n"), F.avg("seconds").alias("mean"), F.min("seconds").alias("low"), F.max("seconds").alias("high"),
        *(F.percentile("seconds", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95)), F.sum("seconds").alias("total"),
    )
    whole = out.agg(F.sum("total").alias("whole"))
    return out.join(F.broadcast(whole), how="cross").withColumn("share", F.col("total") / F.col("whole")).drop("whole")


# Quality gates, each with its bound; True where more is better.
GATES = (
    ("hit_at_3", 0.85, True), ("mrr", 0.70, True), ("ndcg_at_5", 0.75, True), ("groundedness", 0.85, True),
    ("groundedness_high_risk", 0.90, True), ("critical_contradictions", 0.0, False), ("abstention_accuracy", 0.80, True), ("rubric", 3.8, True),
)


def quality_gates(values: DataFrame) -> DataFrame:
    """``values(gate, value)`` against the gates; a gate without a value counts as 0 and so fails where more is better."""
    gates = values.sparkSession.createDataFrame(list(GATES), "gate string, bound double, more boolean")
    out = gates.join(values, "gate", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    passed = F.when(F.col("more"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return out.select("gate", "bound", "value", passed.alias("passed"))


def verdict(gates: DataFrame) -> DataFrame:
    return gates.agg(F.when(F.min("passed"), "PASS").otherwise("FAIL_CONDITIONAL").alias("verdict"))


# ---------------------------------------------------------------- heuristics without a model

# Words that a rubric and a groundedness check ignore.
STOPWORDS = (
    "là", "của", "và", "có", "được", "cho", "trong", "để", "với", "các", "những", "thì", "này", "khi", "lại", "ra", "vào", "ở",
    "nếu", "sẽ", "đã", "đang", "cần", "nên", "thường", "theo", "sau", "từ", "lên", "xuống", "như", "một", "bị", "do", "gì", "thế",
    "nào", "sao", "làm",
)


def content_words(text: Column) -> Column:
    """Distinct lower-case words of two characters or more that aren't stop words."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.filter(F.array_distinct(T.index_tokens(F.coalesce(text, F.lit("")))), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def rubric(question: Column, answer: Column, reference: Column) -> Column:
    """A relevance score from 1 to 5 by how much of the question and the reference the answer covers."""
    said = F.array_distinct(T.index_tokens(F.coalesce(answer, F.lit(""))))
    cover = lambda words: F.coalesce(F.size(F.array_intersect(words, said)) / F.nullif(F.size(words), F.lit(0)), F.lit(1.0))
    q, r = cover(content_words(question)), cover(content_words(reference))
    score = F.when((r >= 0.7) & (q >= 0.6), 5).when((r >= 0.5) & (q >= 0.5), 4).when((r >= 0.3) | (q >= 0.4), 3).when(r >= 0.15, 2).otherwise(1)
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", 1).otherwise(score)


def abstention_rubric(answer: Column, declines: Iterable[str], warns: Iterable[str]) -> Column:
    """5 where an answer to a trap declines or warns, else 1."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(T.any_of(low, [*declines]) | T.any_of(low, [*warns]), 5).otherwise(1)


def claim_grounded(claim: Column, context: Column, least: float = 0.6) -> Column:
    """Share of a claim's content words that occur anywhere in the context, as SUPPORTED or UNSUPPORTED; doses must occur."""
    words, low = content_words(claim), F.lower(F.coalesce(context, F.lit("")))
    seen = F.size(F.filter(words, lambda w: F.contains(low, w))) / F.nullif(F.size(words), F.lit(0))
    doses = T.all_matches(F.lower(claim), r"[0-9]+(?:[.,][0-9]+)?\s*(?:mg|ml|g|kg|lít|%)")
    lost = F.exists(doses, lambda d: ~F.contains(low, d))
    return F.when(lost, "CONTRADICTED").when(F.coalesce(seen, F.lit(0.0)) >= least, "SUPPORTED").otherwise("UNSUPPORTED")


def overlap_scores(question: Column, answer: Column, contexts: Column, reference: Column) -> dict[str, Column]:
    """Four scores of set overlap, scaled and capped: faithfulness, relevancy, precision and recall."""
    q, a, c, r = (T.plain_tokens(x) for x in (question, answer, contexts, reference))
    part = lambda x, y: F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0))
    capped = lambda x, by: F.least(F.lit(1.0), x * by)
    return {
        "faithfulness": capped(part(a, c), 1.5), "answer_relevancy": capped(part(q, a), 1.4),
        "context_precision": capped(part(F.array_union(q, r), c), 1.3), "context_recall": part(r, c),
    }
