"""Sources and sinks: Markdown files, metadata, benchmark and output contracts, resumable results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_files(spark: SparkSession, path: str, recursive: bool = False, language: str = "vi", knowledge_base: str = "legal") -> DataFrame:
    """One row per ``*.md`` file, by name: whole text and file facts."""
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True, pathGlobFilter="*.md")
    name = F.col("_metadata.file_name")
    return files.select(
        name.alias("source"), name.alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.lit("markdown").alias("file_type"),
        F.lit(language).alias("language"), F.lit(knowledge_base).alias("knowledge_base"), F.col("value").alias("text"),
    ).orderBy("file_name")


METADATA = (
    "doc_id string, title string, doc_number string, doc_type string, issuing_body string, date_issued string, date_effective string, "
    "date_applicable string, date_expired string, status string, in_force boolean, in_force_as_of string, status_basis string, status_source string, "
    "status_conflict string, amends array<string>, amended_by array<string>, superseded_by array<string>, supersedes array<string>, "
    "implements array<string>, implemented_by array<string>, related_docs array<string>, source_url string, raw_files array<string>"
)


def metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata, one JSON file each, with the file's name; the first file of an id counts (see ``graph.first_metadata``)."""
    files = spark.read.schema(METADATA).json(path, multiLine=True, pathGlobFilter="*.json")
    return files.withColumn("file", F.col("_metadata.file_name"))


# ---------------------------------------------------------------- contracts

EVIDENCE = "document_id string, text string, evidence_id string, article string, clause string, point string, required boolean"
ITEM = f"id string, category string, answerable boolean, question string, gold_markers array<string>, gold_claims array<string>, gold_evidence array<struct<{EVIDENCE.replace(' string', ':string').replace(' boolean', ':boolean')}>>, source_url string, source_name string, notes string, verification_status string"
CONTEXT = "rank:int, text:string, document_id:string, article:string, clause:string, point:string, score:double, token_count:int"
CITATION = "document_id:string, article:string, clause:string, point:string, text:string, claim_index:int, claim:string"
OUTPUT = f"question_id string, system string, answer string, retrieved_contexts array<struct<{CONTEXT}>>, citations array<struct<{CITATION}>>, latency_ms double, error string, answer_claims array<string>"
# Keys of a system's own internals that gold data must not name.
FORBIDDEN = ("chunk_id", "chunk_ids", "node_id", "node_ids", "vector_id", "embedding_id", "index_id", "gold_chunk_ids", "gold_node_ids", "kg_node_id", "entity_id")


def unwrapped(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...]) -> DataFrame:
    """Rows of a JSON file that holds a list, or an object with the list under one of some keys, or a row per line."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    own = F.from_json("v", F.lit(f"array<struct<{_typed(schema)}>>"))
    wrapped = [F.from_json("v", F.lit(f"struct<{w}:array<struct<{_typed(schema)}>>>"))[w] for w in wrappers]
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, F.lit(f"struct<{_typed(schema)}>")))
    rows = F.when(F.startswith("v", F.lit("[")), own).otherwise(F.coalesce(*wrapped, lines))
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def _typed(schema: str) -> str:
    """DDL ``a int, b array<...>`` as struct fields ``a:int, b:array<...>``."""
    out, depth, field = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += c
    return ", ".join(out)


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return unique(unwrapped(spark, path, ITEM, ("items", "questions")), "id")


def load_outputs(spark: SparkSession, path: str) -> DataFrame:
    return unique(unwrapped(spark, path, OUTPUT, ("outputs", "results")), "question_id")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, with an error raised when a key that comes twice is read."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return rows.withColumn(key, checked)


def questions(items: DataFrame) -> DataFrame:
    """Exactly id and question, so that no gold reaches a system."""
    return items.select("id", "question")


def _without(field: str):
    return lambda e: F.trim(F.coalesce(e[field], F.lit(""))) == ""


def item_errors(items: DataFrame) -> DataFrame:
    """``items`` with an array of what is wrong with each: blank ids, questions or categories, evidence without text or document."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    evidence = F.coalesce("gold_evidence", F.expr("cast(array() as " + dict(items.dtypes)["gold_evidence"] + ")"))
    checks = [F.when(blank(c), F.lit(f"{c} is blank")) for c in ("id", "category", "question")]
    checks += [F.when(F.col("answerable").isNull(), F.lit("answerable is missing"))]
    checks += [F.when(F.exists(evidence, _without(c)), F.lit(f"evidence without {c}")) for c in ("text", "document_id")]
    return items.withColumn("errors", F.array_compact(F.array(*checks)))


def typed_rank(raw: Column, position: Column) -> Column:
    """A rank of one or more from its JSON text; null text takes the position, and what isn't a whole number is an error."""
    ok = raw.rlike("^[1-9][0-9]*$")
    return F.when(raw.isNull(), position).when(ok, raw.cast("int")).otherwise(F.raise_error(F.concat(F.lit("rank isn't a whole number: "), raw)))


def required_evidence(evidence: Column) -> Column:
    return F.filter(evidence, lambda e: F.coalesce(e["required"], F.lit(True)))


def coalesced_sample(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each target column from the first of its alternative names that has a value."""
    have = set(rows.columns)
    return rows.select(*(F.coalesce(*[F.nullif(F.col(a), F.lit("")) for a in names if a in have], F.lit(None).cast("string")).alias(target) for target, names in aliases.items()))


def risk_tier(text: Column, high: tuple[str, ...], medium: tuple[str, ...]) -> Column:
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))
    return F.when(has(high), "high").when(has(medium), "medium").otherwise("low")


# ---------------------------------------------------------------- resumable runs


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key isn't done."""
    return work.join(done.select(key), key, "left_anti")


def resume_faults(done: DataFrame, work: DataFrame, key: str, system: str) -> DataFrame:
    """What forbids to resume: keys that come twice, another system's rows, unknown keys."""
    twice = done.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate").alias("fault"))
    foreign = done.filter(F.col("system") != system).select(key, F.lit("foreign system").alias("fault"))
    unknown = done.join(work.select(key), key, "left_anti").select(key, F.lit("unknown").alias("fault"))
    return twice.unionByName(foreign).unionByName(unknown)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with their keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def append_results(results: DataFrame, path: str) -> None:
    """Add finished rows; a task's rows appear when it commits, so a lost executor leaves none behind."""
    results.write.mode("append").parquet(path)


def checked_counts(nodes: DataFrame, edges: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Labels whose number of nodes or edges isn't as expected."""
    counts = nodes.groupBy("label").count().unionByName(edges.groupBy("label").count())
    want = nodes.sparkSession.createDataFrame(list(expected.items()), "label string, expected long")
    return want.join(counts, "label", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("count")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def external_graph(nodes: DataFrame, schema_properties: DataFrame) -> DataFrame:
    """Node properties outside the schema's ``(label, property)``; a graph is taken only if there are none."""
    used = nodes.select("id", "label", F.explode(F.map_keys("properties")).alias("property"))
    return used.join(schema_properties, ["label", "property"], "left_anti")


def content_digests(rows: DataFrame, label: str) -> DataFrame:
    """``(label, n, digest)``: the number of a label's rows and a digest of them that no order or partitioning changes.

    The digest is the sum of the rows' MD5 halves, 60 bits of each, so rows that come twice count
    twice and swapped contents show.  Columns count by name; a null is told from any text.
    """
    others = sorted(c for c in rows.columns if c != label)
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    text = F.md5(F.concat_ws("|", *(cell(c) for c in others)))
    half = lambda at: F.sum(F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(19,0)"))
    out = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b"))
    return out.select("label", "n", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


def restore_faults(dumped: DataFrame, restored: DataFrame) -> DataFrame:
    """``(label, fault)`` where two results of ``content_digests`` differ: a label that is lost or new, another count, or other content."""
    a, b = dumped.select("label", F.struct("n", "digest").alias("a")), restored.select("label", F.struct("n", "digest").alias("b"))
    fault = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "new").when(F.col("a.n") != F.col("b.n"), "count").when(F.col("a.digest") != F.col("b.digest"), "content")
    both = a.withColumnRenamed("label", "la").join(b.withColumnRenamed("label", "lb"), F.col("la").eqNullSafe(F.col("lb")), "full_outer")
    return both.select(F.coalesce("la", "lb").alias("label"), fault.alias("fault")).filter("fault is not null")
