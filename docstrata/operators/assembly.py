"""Sub-graphs of what models extract from chunks: cleaning, one table of identities, nodes, edges and rejects in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written
from .graph import ALIASES, CONTEXTUAL, CONTRACT, ID_PREFIXES, unresolved_id

OTHERS = "Others"
OUTCOMES = ("node", "edge", "reject")
ROW = (
    "outcome string, chunk_id string, src string, src_label string, relation string, dst string, dst_label string, "
    "status string, properties map<string,string>"
)


def cleaned_entities(extracted: DataFrame, external: DataFrame, labels: DataFrame) -> DataFrame:
    """``(chunk_id, position, name, category, target)``: external entities first, then extracted ones, each name and category once a chunk.

    Both inputs are ``(chunk_id, position, name, category, target)``; ``target`` is the id that the
    source gives, or null.  Rows without a name go.  Categories that are null or not in
    ``labels(label)`` become ``Others``.  A name may come again under another category.  Rows that
    differ in their target only are all kept, since they are evidence of a conflict.  ``position``
    becomes a pair whose order is that of the rule.  All of it is done by chunk: inputs that are dealt by
    ``chunk_id`` alike stay where they are, here and in ``identities``.
    """
    columns = ("chunk_id", "position", "name", "category", "target")
    both = external.select(F.lit(0).alias("origin"), *columns).unionByName(extracted.select(F.lit(1).alias("origin"), *columns))
    known = labels.select(F.col("label").alias("category"), F.lit(True).alias("known")).dropna().distinct()
    named = both.filter(F.rlike("name", F.lit(r"(?U)\S"))).join(F.broadcast(known), "category", "left")
    category = F.when(F.col("known"), F.col("category")).otherwise(OTHERS)
    # The least pair from values of fixed width, which a hash table holds; a null position comes first.
    of = lambda origin, value: F.when(F.col("origin") == origin, value)
    least = [x for k in (0, 1) for x in (F.min(of(k, F.col("position"))).alias(f"at{k}"), F.max(of(k, F.col("position").isNull())).alias(f"none{k}"))]
    once = named.withColumn("category", category).groupBy("chunk_id", "name", "category", "target").agg(F.min("origin").alias("origin"), *least)
    at = F.when(F.col("origin") == 0, F.when(~F.col("none0"), F.col("at0"))).otherwise(F.when(~F.col("none1"), F.col("at1")))
    return once.select("chunk_id", F.struct("origin", at.alias("position")).alias("position"), "name", "category", "target")


def identities(entities: DataFrame) -> DataFrame:
    """``(chunk_id, category, key, name, id, reason)``: the one id of each name, for nodes and for both ends of edges.

    ``entities(chunk_id, position, name, category, target)``; ``key`` is the canonical id of the name.

    * Categories without ids of their own have the key as id (``name``).
    * No target: an id within the chunk (``no target``).
    * Names of one key that have different targets, or one and none: an id within the chunk (``conflict``).
    * Different keys whose first target is the same, in a category whose ids are places in a source: all of them
      have ids within the chunk (``shared``), for nothing tells another name of one thing from another thing.

    Names whose key is empty have no id and go.  The order of rows doesn't matter but through ``position``.
    """
    managed = F.col("category").isin(*ID_PREFIXES)
    # Only a name without letters and digits has an empty key; the key itself in a filter would be computed twice.
    keyed = entities.filter(F.rlike("name", F.lit(r"[\p{L}\p{N}_]"))).withColumn("key", T.canonical_id("name"))
    one = keyed.groupBy("chunk_id", "category", "key").agg(
        F.min(F.struct("position", "name", "target")).alias("first"), F.min("target").alias("least"), F.max("target").alias("most"), F.count("target").alias("given"), F.count("*").alias("n"),
    )
    target = F.col("first.target")
    sharing = F.count(target).over(Window.partitionBy("chunk_id", "category", F.coalesce(target, F.concat(F.lit("?"), F.col("key")))))
    shared = F.col("category").isin(*CONTEXTUAL) & target.isNotNull() & (sharing > 1)
    reason = (
        F.when(~managed, "name").when(F.col("given") == 0, "no target").when((F.col("least") != F.col("most")) | (F.col("given") < F.col("n")), "conflict").when(shared, "shared").otherwise("target")
    )
    local = F.when(managed, F.when(F.col("reason") == "target", F.col("least")).otherwise(unresolved_id(F.when(managed, F.col("category")).otherwise("Article"), F.col("chunk_id"), F.col("key"), canonical=True)))
    out = one.withColumn("reason", reason)
    return out.select("chunk_id", "category", "key", F.col("first.name").alias("name"), F.coalesce(local, F.col("key")).alias("id"), "reason")


def _relations(spark) -> DataFrame:
    rows = {r.lower(): r for _, r, _ in CONTRACT} | ALIASES
    return spark.createDataFrame(sorted(rows.items()), "spelled string, relation string")


def bound_triples(triples: DataFrame, named: DataFrame) -> DataFrame:
    """``triples(chunk_id, subject, predicate, object)`` with ends, relation and ``status``, against ``identities``.

    The first thing that is wrong counts: ``MALFORMED`` (a null part), ``UNKNOWN_PREDICATE``, then the subject's
    and the object's end (``UNRESOLVED_ENDPOINT``: no entity of that name; ``AMBIGUOUS_BINDING``: entities of more than one
    category), ``INVALID_ENDPOINT_TYPES``; else ``ACCEPTED``.  A relation is never turned round.  Ends are looked up by
    chunk and key in a table with one row for each, so a triple never becomes two.
    """
    spark = triples.sparkSession
    ends = named.groupBy("chunk_id", "key").agg(F.count("*").alias("n"), F.min("category").alias("label"), F.min("id").alias("id"))
    spelled = F.lower(F.trim(F.regexp_replace(F.coalesce("predicate", F.lit("")), r"(?U)\s+", " ")))
    out = triples.select("chunk_id", "subject", "predicate", "object", spelled.alias("spelled"), T.canonical_id("subject").alias("s_key"), T.canonical_id("object").alias("o_key"))
    out = out.join(F.broadcast(_relations(spark)), "spelled", "left")
    for side in ("s", "o"):
        out = out.join(ends.select("chunk_id", *(F.col(c).alias(f"{side}_{c}") for c in ("key", "n", "label", "id"))), ["chunk_id", f"{side}_key"], "left")
    contract = spark.createDataFrame(list(CONTRACT), "s_label string, relation string, o_label string").withColumn("allowed", F.lit(True))
    out = out.join(F.broadcast(contract), ["s_label", "relation", "o_label"], "left")
    status = F.when(F.col("subject").isNull() | F.col("predicate").isNull() | F.col("object").isNull(), "MALFORMED").when(F.col("relation").isNull(), "UNKNOWN_PREDICATE")
    for side in ("s", "o"):
        status = status.when(F.col(f"{side}_n").isNull(), "UNRESOLVED_ENDPOINT").when(F.col(f"{side}_n") > 1, "AMBIGUOUS_BINDING")
    status = status.when(F.col("allowed").isNull(), "INVALID_ENDPOINT_TYPES").otherwise("ACCEPTED")
    return out.select("chunk_id", "subject", "predicate", "object", "relation", "s_label", "s_id", "o_label", "o_id", status.alias("status"))


def _row(outcome: str, chunk: str, src, src_label, relation=None, dst=None, dst_label=None, status=None, properties: Column | None = None) -> list[Column]:
    cells = {"src": src, "src_label": src_label, "relation": relation, "dst": dst, "dst_label": dst_label, "status": status}
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    last = F.lit(None).cast("map<string,string>") if properties is None else properties
    return [F.lit(outcome).alias("outcome"), F.col(chunk).alias("chunk_id"), *(column(v).cast("string").alias(k) for k, v in cells.items()), last.alias("properties")]


def assembled(chunks: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Nodes, edges and rejects of all chunks as rows of one table, told apart by ``outcome``; see ``ROW`` for its columns.

    ``chunks(chunk_id, source_path, document_id, document_name, article_id, article_no, heading)``: ``article_id`` and
    ``document_name`` are null where the source doesn't tell.  ``entities`` come from
    ``cleaned_entities``; ``triples(chunk_id, subject, predicate, object)`` are as a model gave them.

    * A node for each identity, each chunk, its article (with its number) and its document; repeats stay, one a chunk,
      for ``graph.merged_nodes`` to fold.
    * An edge ``source`` from each entity's node to its chunk; one for each accepted triple, with provenance and the
      predicate as it was said, never verified; ``belongsTo`` from the chunk's article to its document, structural,
      unless an accepted triple says where the article belongs.
    * A reject for every other triple, with its parts, what is known of its ends, and the reason as ``status``.

    Empty inputs give no rows of their kind.  Triples of chunks that aren't in ``chunks`` have no provenance.
    """
    named = written(identities(entities), "identities")
    ends = written(bound_triples(triples, named), "bound")
    bound = ends.join(chunks.select("chunk_id", "source_path", "document_id", "article_id"), "chunk_id", "left")
    origin = {"sourceChunkId": "chunk_id", "sourcePath": "source_path", "sourceDocumentId": "document_id"}
    given = lambda pairs: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items())), lambda p: F.coalesce(p["value"], F.lit("")) != ""))
    said = given({k: F.col(c) for k, c in origin.items()} | {"sourceArticleId": F.col("article_id"), "originalPredicate": F.col("predicate"), "evidenceStatus": F.lit("UNVERIFIED")})
    raw = given({"rawSubject": F.col("subject"), "rawPredicate": F.col("predicate"), "rawObject": F.col("object")})
    fine = F.col("status") == "ACCEPTED"
    tagged = bound.select(
        F.when(fine, "edge").otherwise("reject").alias("outcome"), "chunk_id", F.when(fine, F.col("s_id")).alias("src"), F.col("s_label").alias("src_label"), "relation",
        F.when(fine, F.col("o_id")).alias("dst"), F.col("o_label").alias("dst_label"), "status", F.when(fine, said).otherwise(raw).alias("properties"),
    )

    title = given({"name": F.col("name"), "reason": F.col("reason")})
    node = named.select(*_row("node", "chunk_id", F.col("id"), F.col("category"), properties=title))
    source = named.select("chunk_id", "id", "category").distinct().select(*_row("edge", "chunk_id", F.col("id"), F.col("category"), "source", F.col("chunk_id"), "Chunk", "SYSTEM"))
    own = chunks.select(*_row("node", "chunk_id", F.col("chunk_id"), "Chunk", properties=given({"sourcePath": F.col("source_path")})))
    at = chunks.filter("article_id is not null")
    article = at.select(*_row("node", "chunk_id", F.col("article_id"), "Article", properties=given({"name": F.col("heading"), "articleNumber": F.col("article_no")})))
    told = ends.filter(fine & (F.col("relation") == "belongsTo")).select("chunk_id", F.col("s_id").alias("article_id")).distinct()
    held = at.filter(F.coalesce("document_name", F.lit("")) != "").join(told, ["chunk_id", "article_id"], "left_anti")
    where = given({k: F.col(c) for k, c in origin.items()} | {"evidenceStatus": F.lit("STRUCTURAL")})
    # A document's node and the edge to it are two rows of one.
    to = F.col("document")
    document = F.struct(*_row("node", "chunk_id", to, "LegalDocument", properties=given({"name": F.col("document_name")})))
    belongs = F.struct(*_row("edge", "chunk_id", F.col("article_id"), "Article", "belongsTo", to, "LegalDocument", "STRUCTURAL", where))
    both = held.withColumn("document", T.canonical_id("document_name")).select(F.inline(F.array(document, belongs)))
    out = tagged
    for part in (node, source, own, article, both):
        out = out.unionByName(part)
    return out


def write_assembled(rows: DataFrame, path: str) -> None:
    """One job that writes nodes, edges and rejects to folders of their own; a reader of one kind reads no other."""
    rows.write.partitionBy("outcome").parquet(path)
