"""A BM25 index that documents are added to, replaced in and taken from, batch by batch.

The index is a log of immutable segments.  A segment holds the postings and lengths of its batch's
documents, the ids that the batch replaces or takes away, and what the batch changes: document
frequencies by term and totals, with what it replaces taken off.  So a batch reads, of what is there,
the rows of its own documents only, and the index as a whole is the sum of the changes.

A segment's entry in the log is written last and names the batches that it covers; a folder without
an entry counts as nothing, and a batch that is run again replaces its own segment.  Compaction
writes one segment for many, which hides them by covering their batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, index_tokens
from ..functions.unicode import nfc
from ..shared import deleted, written
from .bm25 import Index, idf, terms_of

#: Ids that are broadcast: some 100 bytes each.
FEW = 1 << 18
LOG = "low long, high long, folder string"


def segments(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """The segments in force, oldest first: ``(low, high, folder)``; one that another covers is none.

    The log has a row a segment, and compaction keeps them few.
    """
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        return []
    rows = sorted({tuple(r) for r in spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log").collect()}, key=lambda r: (r[0], -r[1]))
    out: list[tuple[int, int, str]] = []
    for row in rows:
        if not out or row[1] > out[-1][1]:
            out.append(row)
    return out


def _table(spark: SparkSession, path: str, found: list[tuple[int, int, str]], name: str) -> DataFrame | None:
    """A table of all segments, with the segment's last batch as ``seq``."""
    parts = [spark.read.parquet(f"{path}/{folder}/{name}").withColumn("seq", F.lit(high).cast("long")) for _, high, folder in found]
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _latest(spark: SparkSession, path: str, found: list[tuple[int, int, str]]) -> DataFrame | None:
    """``(doc_id, seq, dl, digest)`` of the documents in force: the last batch that names an id has it, or has taken it away."""
    docs, gone = _table(spark, path, found, "docs"), _table(spark, path, found, "gone")
    if docs is None:
        return None
    named = docs.select("doc_id", "seq", "dl", "digest", F.lit(True).alias("there")).unionByName(gone.select("doc_id", "seq", F.lit(None).cast("long").alias("dl"), F.lit(None).cast("string").alias("digest"), F.lit(False).alias("there")))
    last = named.groupBy("doc_id").agg(F.max(F.struct("seq", "there", "dl", "digest")).alias("x"))
    return last.filter("x.there").select("doc_id", "x.seq", "x.dl", "x.digest")


def _put(tables: dict[str, DataFrame], path: str, low: int, high: int) -> None:
    """Write a segment, then its entry in the log."""
    folder = f"segment-{low}-{high}"
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(low, high, folder)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{folder}")


def _of(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` of a written list of ids, which is broadcast if it is counted to be short; beyond, both are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, on, how)


def append(docs: DataFrame, path: str, batch: int, gone: DataFrame | None = None, codes: bool = False) -> None:
    """Add ``docs(doc_id, text)`` as batch ``batch``, in place of older rows with their ids, and take away ``gone(doc_id)``.

    Batches come in the order of their numbers; one that is run again leaves the same index.  An id
    that is both in ``docs`` and in ``gone`` stays.  Rows without an id are left out; of rows with one
    id in a batch the one with the greatest content digest counts.  A document whose content is as it
    was isn't written again.  A text without tokens counts as a document of length 0.
    """
    spark = docs.sparkSession
    before = [s for s in segments(spark, path) if s[1] < batch]
    if any(low < batch <= high and low != high for low, high, _ in segments(spark, path)):
        raise ValueError(f"batch {batch} is in a compacted segment")
    live = _latest(spark, path, before)
    new = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    # What counts is settled by digests alone; no text is shuffled.
    of = new.groupBy("doc_id", "digest").agg(F.count("*").alias("copies")).groupBy("doc_id").agg(F.max(F.struct("digest", "copies")).alias("x"))
    of = of.select("doc_id", "x.digest", "x.copies")
    if live is not None:
        of = of.join(live.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    of = written(of, "batch")
    folder = f"{path}/segment-{batch}-{batch}"
    # Texts meet the ids before they become tokens, so that what moves, if ids are many, is a text and not each of its tokens with a digest.
    texts = _of(new, of, ["doc_id", "digest"], "inner")
    counted = terms_of(texts.select(F.struct("doc_id", "copies").alias("doc"), "text"), "doc", index_tokens("text", codes)).select("doc.doc_id", "doc.copies", "term")
    counted = counted.groupBy("doc_id", "term", "copies").agg(F.count("*").alias("tf"))
    counted.select("doc_id", "term", (F.col("tf") / F.col("copies")).cast("long").alias("tf")).write.mode("overwrite").parquet(f"{folder}/postings")
    # A length is the sum of its document's counts: texts are cut into tokens once.
    sums = spark.read.parquet(f"{folder}/postings").groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    of.join(sums, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"), "digest").write.mode("overwrite").parquet(f"{folder}/docs")
    own, postings = spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/postings")

    changes = postings.groupBy("term").agg(F.count("*").alias("df"))
    totals = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    taken = own.select("doc_id").limit(0)
    if gone is not None:
        kept = docs.select("doc_id").filter("doc_id is not null")
        taken = gone.select(F.col("doc_id").cast(dict(own.dtypes)["doc_id"]).alias("doc_id")).filter("doc_id is not null").distinct().join(kept, "doc_id", "left_anti")
    if live is not None:
        replaced = written(live.join(own.select("doc_id").unionByName(taken), "doc_id", "left_semi").select("doc_id", "seq", "dl"), "replaced")
        old = _of(_table(spark, path, before, "postings"), replaced.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi")
        changes = changes.unionByName(old.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        totals = totals.unionByName(replaced.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("length"))).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    _put({"gone": taken, "changes": changes, "totals": totals}, path, batch, batch)


def load(spark: SparkSession, path: str) -> Index | None:
    """The index as it stands, for ``bm25.search``; None if nothing was ever added."""
    found = segments(spark, path)
    live = _latest(spark, path, found)
    if live is None:
        return None
    totals = _table(spark, path, found, "totals").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    stats = totals.select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).alias("avgdl"))
    df = _table(spark, path, found, "changes").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    terms = df.join(F.broadcast(stats), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    # A posting belongs to a document by its segment, too: those that a later batch has replaced find none.
    return Index(_table(spark, path, found, "postings"), terms, live.select("doc_id", "seq", "dl"), stats, ("doc_id", "seq"))


def in_force(index: Index) -> DataFrame:
    """``(doc_id, term, tf)``: the postings that belong to documents."""
    return index.postings.join(index.docs.select(*index.key), list(index.key), "left_semi").select("doc_id", "term", "tf")


def compact(spark: SparkSession, path: str) -> None:
    """Write the segments as one, with what is in force only, clustered by term; then delete those that it covers."""
    found = segments(spark, path)
    index = load(spark, path)
    if index is None or len(found) < 2:
        return
    low, high = found[0][0], found[-1][1]
    docs = _latest(spark, path, found).select("doc_id", "dl", "digest")
    postings = in_force(index).repartition("term").sortWithinPartitions("term", "doc_id")
    totals = index.docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
    _put({"docs": docs, "postings": postings, "gone": docs.select("doc_id").limit(0), "changes": index.terms.select("term", "df"), "totals": totals}, path, low, high)
    for _, _, folder in found:
        deleted(spark, f"{path}/log/{folder}")
        deleted(spark, f"{path}/{folder}")


def build(docs: DataFrame, path: str, batch: int, gone: DataFrame | None = None, codes: bool = False) -> None:
    """The whole index job: texts are cleaned and composed (NFC), then added as a batch."""
    append(docs.select("doc_id", nfc(clean("text")).alias("text")), path, batch, gone, codes)
