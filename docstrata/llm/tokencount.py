"""Token counts with a digest cache (operator 5).

A text's key is the SHA-256 of its normalised content next to the digest of the tokenizer file, so
a cache can hold many tokenizers.  Only distinct contents that the cache lacks are encoded; their
counts are appended.

Texts stay where they are read: whether a content may come again or is in the cache shows in a
filter of fixed size, and where it doesn't, the text is encoded in place.  Of the others only the row
that stands for its content moves (and what a second filter mistakes for one), on doc_id, which no
common content can skew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import documents, shared_dir, written
from .bpe import encoder, version_digest

CACHE = "version string, digest string, n_tokens long"
#: Bits of a filter at most; a fuller one lets more rows take the longer way, no more.
BITS = 1 << 25
#: Contents with more rows than this are dealt over salts.
COMMON = 1_000


def cached_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache at ``cache``; empty if there is none yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def _marks(hashes: DataFrame, bits: int) -> DataFrame:
    """One row with one array: the bits of all ``hashes(h)``, 64 to a number."""
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(bits // 64 - 1)), F.col("h").bitwiseAND(F.lit(63)).cast("int")
    set_words = hashes.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    filled = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(set_words, "w", "left")
    ordered = F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return filled.agg(F.transform(ordered, lambda x: x["bits"]).alias("words"))


def _marked(words: DataFrame, h: Column, bits: int) -> Column:
    """Whether the bit of ``h`` is set: true of all marked hashes and, by chance, of some others."""
    word = F.get(words.scalar(), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(bits // 64 - 1)).cast("int"))
    return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, salts: int = 16) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row; null text is empty.

    ``cache`` is a folder that all executors share; without one, a new cache for this call.  Content
    is normalised no further than from null to empty: byte-level counts depend on every byte.
    Repeated rows are counted once and returned as often as they come.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    version = version_digest(tokenizer)
    digest = F.unhex(F.sha2("text", 256))
    keyed = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest)
    held = cached_counts(spark, cache).filter(F.col("version") == version).select(F.unhex("digest").alias("digest"), F.lit(True).alias("held")).distinct()
    contents = keyed.select("doc_id", "digest").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    contents = written(contents.join(held, "digest", "left"), "token-contents")
    bits = min(BITS, max(1 << 12, 1 << (8 * contents.count()).bit_length()))

    content, row = F.xxhash64("digest"), F.xxhash64("digest", "doc_id")
    again = written(_marks(contents.filter("n > 1 or held").select(content.alias("h")), bits), "marks-again")
    # Some contents that come once are marked, too; they stand for themselves.
    first = contents.filter(F.col("held").isNull() & _marked(again, content, bits)).select("digest", "doc_id")
    stands = written(_marks(first.select(row.alias("h")), bits), "marks-stands")
    common = written(_marks(contents.filter(F.col("n") > COMMON).select(content.alias("h")), bits), "marks-common")
    alone = keyed.filter(~_marked(again, content, bits)).select("digest", "text")
    moved = keyed.filter(_marked(again, content, bits) & _marked(stands, row, bits))
    first = first.select(F.col("digest").alias("want"), F.col("doc_id").alias("of"))
    misses = moved.join(first, (F.col("doc_id").eqNullSafe(F.col("of"))) & (F.col("digest") == F.col("want"))).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            counts = pa.array(encode.counts(batch.column(1)), pa.int64())
            yield pa.record_batch([batch.column(0), counts], names=["digest", "n_tokens"])

    counted = alone.mapInArrow(run, "digest binary, n_tokens long")
    counted = counted.union(misses.mapInArrow(run, "digest binary, n_tokens long").dropDuplicates(["digest"]))
    counted.select(F.lit(version).alias("version"), F.lower(F.hex("digest")).alias("digest"), "n_tokens").write.mode("append").parquet(cache)

    # The row of a common content goes to each of a few salts, and its documents to one.
    counts = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    counts = counts.groupBy(F.unhex("digest").alias("digest")).agg(F.min("n_tokens").alias("n_tokens"))
    dealt = F.when(_marked(common, content, bits), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    counts = counts.withColumn("salt", F.explode(dealt))
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    salt = F.when(_marked(common, content, bits), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0)
    out = sized.withColumn("salt", salt).join(counts, ["digest", "salt"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
