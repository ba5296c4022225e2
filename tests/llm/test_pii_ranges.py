"""Pseudonyms of whole ranges: no two values share one, and equal numbers are linked however they are spelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.llm import pii


def test_no_two_dates_share_a_pseudonym(spark):
    """All dates of the range and beyond it, in all three notations; slashes are read day first where that gives a date."""
    days = spark.range(-400, 73_600).select(F.date_add(F.to_date(F.lit(pii.EPOCH)), F.col("id").cast("int")).alias("d")).repartition(8)
    spelled = days.select(F.explode(F.array(*(F.date_format("d", p) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")))).alias("m")).distinct()
    made = spelled.withColumn("kind", pii.kind_of(F.col("m")))
    made = made.withColumn("p", F.when(F.col("kind").isNotNull(), pii.pseudonym(F.col("m"), F.col("kind"), F.lit("k")))).filter("p is not null")
    row = made.agg(F.count("*").alias("n"), F.countDistinct("p").alias("distinct"), F.sum((pii.kind_of(F.col("p")) == F.col("kind")).cast("int")).alias("same")).first()
    assert row.n == row.distinct == row.same and row.n > 150_000


def test_a_date_whose_day_first_reading_is_out_of_range_stays(spark):
    rows = spark.createDataFrame([("04/10/2099",), ("04/22/1972",), ("13/04/1972",)], "m string")
    assert [r.k for r in rows.select(pii.kind_of(F.col("m")).alias("k")).collect()] == [None, "date_mdy", "date_dmy"]


def test_spellings_of_a_number_share_a_pseudonym(spark):
    groups = [["+353 1 234 5678", "+35312345678", "+353-1-234-5678"], ["+49 30 1234567", "+49301234567"], ["+1 212 555 0100", "+12125550100", "+1-212-555-0100"]]
    rows = spark.createDataFrame([(k, m) for k, g in enumerate(groups) for m in g], "k int, m string")
    made = rows.select("k", "m", pii.pseudonym(F.col("m"), F.lit("phone"), F.lit("key")).alias("p"))
    made = made.withColumn("back", pii.pseudonym(F.col("p"), F.lit("phone"), F.lit("key"), inverse=True)).collect()
    assert all(r.back == r.m for r in made)
    digits = {k: {"".join(c for c in r.p if c.isdigit()) for r in made if r.k == k} for k in range(3)}
    assert all(len(x) == 1 for x in digits.values())
    assert all(r.p.replace(" ", "").replace("-", "").startswith(("+353", "+49", "+1")) for r in made)
