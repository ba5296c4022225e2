"""Evidence matching as joins, with three-valued support: true, false, or null for undecided."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEVELS = ("document", "article", "clause", "point")


@dataclass(frozen=True)
class Policy:
    """Routes to a decision and their limits."""

    structural: bool = True
    by_text: bool = True
    judge: bool = True
    overlap: float = 0.8
    hard_levels: tuple[str, ...] = ("document", "article")
    verify_text: bool = False
    coarse: bool = False


def levels(prefix: str = "") -> dict[str, Column]:
    """The four normalised location columns of one side."""
    return {
        "document": T.normalize_document_id(F.col(prefix + "document_id")),
        "article": T.normalize_article(F.col(prefix + "article")),
        "clause": T.normalize_clause(F.col(prefix + "clause")),
        "point": T.normalize_point(F.col(prefix + "point")),
    }


def structural(context: dict[str, Column], gold: dict[str, Column], hard: tuple[str, ...] = ("document", "article")) -> Column:
    """``struct(verdict, mismatch, missing, soft)`` of two declared locations.

    Levels are read from the outside in.  A hard level that differs is false at once; a soft one that
    differs, or one on which the context is silent, leaves the verdict open; else it is true.
    """
    differs = {k: F.coalesce(context[k] != gold[k], F.lit(False)) for k in LEVELS}
    silent = {k: gold[k].isNotNull() & context[k].isNull() for k in LEVELS}
    mismatch = F.coalesce(*(F.when(differs[k], F.lit(k)) for k in LEVELS if k in hard)) if hard else F.lit(None).cast("string")
    before = {k: F.lit(True) for k in LEVELS}  # what is read before the first hard mismatch
    for i, k in enumerate(LEVELS):
        for h in LEVELS[: i + 1]:
            if h in hard and h != k:
                before[k] = before[k] & ~differs[h]
    soft = F.array_compact(F.array(*(F.when(differs[k] & before[k], F.lit(k)) for k in LEVELS if k not in hard))) if set(LEVELS) - set(hard) else F.array().cast("array<string>")
    missing = F.array_compact(F.array(*(F.when(silent[k], F.lit(k)) for k in LEVELS)))
    missing = F.when(mismatch.isNull(), missing).otherwise(F.array().cast("array<string>"))
    verdict = F.when(mismatch.isNotNull(), F.lit(False)).when((F.size(missing) == 0) & (F.size(soft) == 0), F.lit(True))
    return F.struct(verdict.alias("verdict"), mismatch.alias("mismatch"), missing.alias("missing"), soft.alias("soft"))


def text_support(gold: Column, context: Column, overlap: float = 0.8) -> Column:
    """``struct(supported, method, score)``: containment, else token coverage; the text route never says false."""
    usable = (F.coalesce(gold, F.lit("")) != "") & (F.coalesce(context, F.lit("")) != "")
    inside = F.contains(T.normalize_for_match(context), T.normalize_for_match(gold))
    coverage = T.token_coverage(gold, context)
    return F.struct(
        F.when(usable & inside, True).when(usable & (coverage >= overlap), True).alias("supported"),
        F.when(~usable, "not_applicable").when(inside, "text_containment").when(coverage.isNull(), "not_applicable").otherwise("text_overlap").alias("method"),
        F.when(usable & inside, 1.0).when(usable, coverage).alias("score"),
    )


def support(pairs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds ``supported`` and ``method`` to context-evidence pairs.

    ``pairs`` has ``g_`` and ``c_`` columns for both sides (document_id, article, clause, point, text)
    and may have ``judged``, a judge's verdict.  A location decides first, then text, then the judge.
    """
    place = structural(levels("c_"), levels("g_"), policy.hard_levels)
    text = text_support(F.col("g_text"), F.col("c_text"), policy.overlap)
    out = pairs.withColumn("_place", place).withColumn("_text", text)
    judged = F.col("judged") if policy.judge and "judged" in pairs.columns else F.lit(None).cast("boolean")
    both = (F.coalesce("g_text", F.lit("")) != "") & (F.coalesce("c_text", F.lit("")) != "")
    by_place = F.col("_place.verdict") if policy.structural else F.lit(None).cast("boolean")
    trusted = by_place & ~(F.lit(policy.verify_text) & both)
    by_text = F.col("_text.supported") if policy.by_text else F.lit(None).cast("boolean")
    coarse = F.lit(policy.coarse) & (F.size("_place.soft") == 0)
    chain = [(by_place == False, False, F.lit("location_mismatch")), (trusted, True, F.lit("structural")), (by_text, True, F.col("_text.method")),  # noqa: E712
             (judged.isNotNull(), judged, F.lit("judge")), (coarse, True, F.lit("structural"))]
    value, method = F.lit(None).cast("boolean"), F.lit("undecided")
    for when, then, how in reversed(chain):
        value, method = F.when(when, then).otherwise(value), F.when(when, how).otherwise(method)
    return out.withColumn("supported", value).withColumn("method", method).drop("_place", "_text")


def best_support(pairs: DataFrame, keys: list[str], empty_is_null: bool = False) -> DataFrame:
    """One decision per key over its ranked contexts: the first that supports, else undecided if any is, else false.

    ``pairs`` has ``rank`` (null where there is no context) and ``supported``.
    """
    seen = F.col("rank").isNotNull()
    some, open_ = F.max(F.when(seen, F.coalesce("supported", F.lit(False)))), F.max(F.when(seen, F.col("supported").isNull()))
    none = F.lit(None).cast("boolean") if empty_is_null else F.lit(False)
    value = F.when(F.coalesce(some, F.lit(False)), True).when(F.coalesce(open_, F.lit(False)), F.lit(None)).when(F.count(F.when(seen, 1)) == 0, none).otherwise(F.lit(False))
    return pairs.groupBy(*keys).agg(value.alias("supported"), F.min(F.when(F.col("supported"), F.col("rank"))).alias("rank"))


def supported_by_gold(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A claim inside gold text (not the other way round): any true wins, else undecided."""
    return pairs.groupBy(*keys).agg(F.max(F.when(F.col("supported"), True)).alias("supported"))


def location_match(citation: dict[str, Column], gold: dict[str, Column], deepest: str = "point") -> Column:
    """Whether a citation agrees with all that the gold declares down to a level; null if it declares nothing there."""
    wanted = LEVELS[: LEVELS.index(deepest) + 1]
    any_declared = F.lit(False)
    agree = F.lit(True)
    for k in wanted:
        any_declared = any_declared | gold[k].isNotNull()
        agree = agree & (gold[k].isNull() | F.coalesce(gold[k] == citation[k], F.lit(False)))
    return F.when(any_declared, agree)


def context_for_citation(citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """The first context compatible with each citation on every level that both declare, and at least one.

    ``citations(question_id, citation, levels...)`` and ``contexts(question_id, rank, text, levels...)``
    have normalised level columns ``document``, ``article``, ``clause``, ``point``.
    """
    c, x = citations.alias("c"), contexts.alias("x")
    same, shared = F.lit(True), F.lit(False)
    for k in LEVELS:
        both = F.col(f"c.{k}").isNotNull() & F.col(f"x.{k}").isNotNull()
        same, shared = same & (~both | (F.col(f"c.{k}") == F.col(f"x.{k}"))), shared | both
    joined = c.join(x, "question_id").filter(same & shared).select("question_id", "citation", "x.rank", "x.text")
    first = Window.partitionBy("question_id", "citation").orderBy("rank")
    return joined.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def mirrors_contexts(citations: Column, contexts: Column, least: int = 3) -> Column:
    """Whether at least three citations and the contexts have equal sets of locations."""
    a, b = F.array_distinct(citations), F.array_distinct(contexts)
    return (F.size(citations) >= least) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


# Verdicts of a judge and classes of claims.
ENTAILED, CONTRADICTED, NEUTRAL = "entailed", "contradicted", "neutral"


def classify_claim(context: Column, gold: Column, contradicted: Column) -> Column:
    """The five disjoint classes of an answer's claim, by its context and gold support."""
    return (
        F.when(context, "supported_by_context")
        .when(gold, "supported_by_gold_not_context")
        .when((gold == False) & F.coalesce(contradicted, F.lit(False)), "contradicted")  # noqa: E712
        .when(gold == False, "unsupported")  # noqa: E712
        .otherwise("undecided")
    )


def rule_judge(premise: Column, hypothesis: Column, threshold: float = 0.8) -> Column:
    """A deterministic judge: entailed by containment or coverage, else undecided."""
    inside = F.contains(T.normalize_for_match(premise), T.normalize_for_match(hypothesis))
    return F.when(inside | (T.token_coverage(hypothesis, premise) >= threshold), F.lit(ENTAILED))


def judged_once(pairs: DataFrame, judge, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds ``verdict``: the judge sees each distinct normalised pair once, and only rows that need it should be passed."""
    keyed = pairs.withColumn("_p", T.normalize_text(premise)).withColumn("_h", T.normalize_text(hypothesis))
    asked = keyed.groupBy("_p", "_h").agg(F.min(premise).alias("p"), F.min(hypothesis).alias("h"))
    verdicts = asked.select("_p", "_h", judge(F.col("p"), F.col("h")).alias("verdict"))
    return keyed.join(verdicts, ["_p", "_h"]).drop("_p", "_h")
