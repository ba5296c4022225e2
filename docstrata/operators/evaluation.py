"""Evaluation of a system's outputs end to end: what is matched, missing or unknown, named metrics, breakdowns and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

STATES = ("matched", "missing", "unknown")


def states(items: DataFrame, outputs: DataFrame, key: str, seen: Observation | None = None) -> DataFrame:
    """Items and outputs side by side with a ``state``; one full outer join.

    ``matched`` rows have both, ``missing`` an item only, ``unknown`` an output only; a null key matches
    nothing.  ``seen`` gets the number of rows in each state while an action runs, without another pass.
    Columns other than ``key`` must have different names.
    """
    left = items.withColumn("_item", F.lit(True)).withColumnRenamed(key, "_item_key")
    right = outputs.withColumn("_output", F.lit(True)).withColumnRenamed(key, "_output_key")
    both = left.join(right, F.col("_item_key") == F.col("_output_key"), "full_outer")
    state = F.when(F.col("_item") & F.col("_output"), "matched").when(F.col("_item"), "missing").otherwise("unknown")
    out = both.withColumn(key, F.coalesce("_item_key", "_output_key")).withColumn("state", state).drop("_item", "_output", "_item_key", "_output_key")
    return out.observe(seen, *(F.count_if(F.col("state") == s).alias(s) for s in STATES)) if seen is not None else out


def named_metrics(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``(*keys, metric, value)``, a row for each metric of each row; null values stay."""
    return rows.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def report(evaluated: DataFrame, metrics: list[str], system: str = "system") -> DataFrame:
    """``(system, metric, mean, n, not_available, missing, unknown, json)``: each system's metrics over its matched rows.

    ``evaluated`` comes from ``states``.  Missing rows are counted and enter no mean, unknown ones are
    counted and ignored; a null value is not available.  ``json`` is the row as JSON with nulls kept.
    """
    count = lambda s: F.count_if(F.col("state") == s)
    long = named_metrics(evaluated, [system, "state"], metrics)
    value = F.when(F.col("state") == "matched", F.col("value"))
    out = long.groupBy(system, "metric").agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), (count("matched") - F.count(value)).alias("not_available"), count("missing").alias("missing"), count("unknown").alias("unknown"),
    )
    return out.withColumn("json", F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}))


CASE_METRICS = ("hit_at_3", "mrr", "ndcg_at_5", "groundedness", "rubric")


def breakdown(cases: DataFrame) -> DataFrame:
    """``(scope, bucket, n, hit_at_3, mrr, ndcg_at_5, groundedness, rubric, critical, n_abstention, abstention_accuracy)``: over all cases, by risk tier and by intent.

    ``cases`` has the metrics above, ``critical`` and ``is_abstention`` (booleans), ``risk`` and
    ``intent``; a null risk is medium, a null intent general.  All three come from one shuffle, by
    grouping sets.  An abstention is right if its rubric is 4 or more; without any the accuracy is 0.
    No cases give no rows.
    """
    own = cases.withColumn("risk", F.coalesce("risk", F.lit("medium"))).withColumn("intent", F.coalesce("intent", F.lit("general")))
    abstains = F.coalesce("is_abstention", F.lit(False))
    n_abstention = F.count_if(abstains)
    sets = own.groupingSets([[], ["risk"], ["intent"]], "risk", "intent").agg(
        F.grouping_id("risk", "intent").alias("level"), F.count("*").alias("n"), *(F.avg(m).alias(m) for m in CASE_METRICS),
        F.count_if(F.coalesce("critical", F.lit(False))).alias("critical"), n_abstention.alias("n_abstention"),
        F.coalesce(F.count_if(abstains & (F.col("rubric") >= 4)) / F.nullif(n_abstention, F.lit(0)), F.lit(0.0)).alias("abstention_accuracy"),
    ).filter("n > 0")
    # Bits of grouping_id stand for the columns that are summed over.
    scope = F.when(F.col("level") == 3, "overall").when(F.col("level") == 1, "risk").otherwise("intent")
    digits = {"rubric": 2}
    return sets.select(
        scope.alias("scope"), F.when(F.col("level") == 1, F.col("risk")).when(F.col("level") == 2, F.col("intent")).alias("bucket"), "n",
        *(F.round(m, digits.get(m, 4)).alias(m) for m in CASE_METRICS), "critical", "n_abstention", F.round("abstention_accuracy", 4).alias("abstention_accuracy"),
    )


def gate_values(rows: DataFrame) -> DataFrame:
    """``(gate, value)`` for ``metrics.quality_gates``, from the rows of ``breakdown``."""
    whole = F.col("scope") == "overall"
    high = (F.col("scope") == "risk") & (F.col("bucket") == "high")
    picks = {m: (whole, m) for m in ("hit_at_3", "mrr", "ndcg_at_5", "groundedness", "rubric", "abstention_accuracy")} | {"critical_contradictions": (whole, "critical"), "groundedness_high_risk": (high, "groundedness")}
    one = rows.agg(*(F.max(F.when(when, F.col(c).cast("double"))).alias(gate) for gate, (when, c) in picks.items()))
    return one.unpivot([], list(picks), "gate", "value")
