"""Property graphs: metadata to nodes and edges, identities, relation contract, look-ups and PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .bm25 import terms_of

# Metadata fields and their property names, relation fields with name and whether reversed, inverses.
PROPERTIES = {
    "doc_number": "docNumber", "doc_type": "docType", "issuing_body": "issuingBody", "date_effective": "dateEffective",
    "date_issued": "dateIssued", "date_expired": "dateExpired", "status": "status", "source_url": "sourceUrl",
}
RELATIONS = {
    "supersedes": ("supersedes", False), "superseded_by": ("supersedes", True), "amends": ("amends", False),
    "amended_by": ("amends", True), "implements": ("implementsDoc", False), "implemented_by": ("implementsDoc", True),
}
INVERSES = {"supersedes": "supersededBy"}
LABEL = "LegalDocument"
# The relations that the schema allows, as (subject, relation, object).
CONTRACT = (
    ("LegalDocument", "supersedes", "LegalDocument"), ("LegalDocument", "supersededBy", "LegalDocument"),
    ("LegalDocument", "amends", "LegalDocument"), ("LegalDocument", "implementsDoc", "LegalDocument"),
    ("Article", "belongsTo", "LegalDocument"), ("Article", "prohibits", "ProhibitedAct"), ("Article", "imposes", "Sanction"),
    ("Article", "obliges", "Obligation"), ("Article", "defines", "LegalTerm"), ("Article", "appliesTo", "RegulatedEntity"),
    ("ProhibitedAct", "prohibitedBy", "Article"), ("ProhibitedAct", "sanctionedBy", "Sanction"), ("Sanction", "forAct", "ProhibitedAct"),
    ("Sanction", "basedOn", "Article"), ("Sanction", "enforcedBy", "Authority"), ("Obligation", "boundEntity", "RegulatedEntity"),
    ("Obligation", "basedOn", "Article"), ("LegalTerm", "definedIn", "Article"),
)
# Other names of relations.
ALIASES = {
    "thay thế": "supersedes", "bị thay thế bởi": "supersededBy", "sửa đổi bổ sung": "amends", "hướng dẫn thi hành": "implementsDoc",
    "thuộc văn bản": "belongsTo", "nghiêm cấm": "prohibits", "quy định chế tài": "imposes", "quy định nghĩa vụ": "obliges",
    "định nghĩa": "defines", "áp dụng cho": "appliesTo", "bị cấm theo": "prohibitedBy", "bị xử phạt theo": "sanctionedBy",
    "áp dụng cho hành vi": "forAct", "căn cứ pháp lý": "basedOn", "thẩm quyền xử phạt": "enforcedBy",
    "ràng buộc đối tượng": "boundEntity", "định nghĩa tại": "definedIn",
}
KEPT_LABELS = ("Chunk", "Table", "Summary", "Outline", "KnowledgeUnit", "AtomicQuery", "Doc")
# Prefixes of ids by category; those whose ids come from one place in a source; headings that state a scope.
ID_PREFIXES = {
    "Article": "article", "Authority": "authority", "Sanction": "sanction", "Obligation": "obligation", "ProhibitedAct": "prohibitedact",
    "LegalTerm": "legalterm", "RegulatedEntity": "regulatedentity",
}
CONTEXTUAL = ("Sanction", "Obligation", "ProhibitedAct", "LegalTerm", "RegulatedEntity")
SCOPE_HEADINGS = ("đối tượng áp dụng", "phạm vi điều chỉnh", "phạm vi áp dụng")
# Titles of persons, kinds of bodies, and names that don't say which body is meant.
PERSON_TITLES = (
    "bộ trưởng", "thứ trưởng", "thủ tướng", "phó thủ tướng", "chủ tịch", "phó chủ tịch", "cục trưởng", "tổng cục trưởng", "vụ trưởng",
    "giám đốc", "chánh án", "phó chánh án", "viện trưởng", "phó viện trưởng", "chánh thanh tra", "trưởng ban", "trưởng đoàn",
    "người đứng đầu", "thủ trưởng", "tổng giám đốc", "tổng thanh tra",
)
BODY_KINDS = (
    "bộ", "chính phủ", "quốc hội", "ủy ban thường vụ quốc hội", "ủy ban nhân dân", "hội đồng nhân dân", "tòa án nhân dân",
    "viện kiểm sát nhân dân", "ngân hàng nhà nước", "kiểm toán nhà nước", "văn phòng chính phủ", "thanh tra chính phủ", "chủ tịch nước",
)
GENERAL_BODIES = (
    "bộ", "cơ quan", "cơ quan nhà nước", "cơ quan có thẩm quyền", "cơ quan quản lý", "cơ quan quản lý nhà nước", "nhà nước", "chính quyền",
    "ủy ban", "ủy ban nhân dân", "hội đồng nhân dân", "tòa án nhân dân", "viện kiểm sát nhân dân", "tòa án", "viện kiểm sát", "thanh tra",
    "người có thẩm quyền", "cấp có thẩm quyền",
)


def first_metadata(metas: DataFrame) -> DataFrame:
    """The first file of each document; rows without an id and files whose name begins with an underscore don't count."""
    usable = metas.filter((F.coalesce("doc_id", F.lit("")) != "") & ~F.startswith("file", F.lit("_")))
    order = Window.partitionBy("doc_id").orderBy("file")
    return usable.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def document_name(meta: str = "") -> Column:
    """What a document is called: its kind and number where it has a Vietnamese number, else its number, else its title."""
    kind, number, title = (T.strip(F.coalesce(meta + c, F.lit(""))) for c in ("doc_type", "doc_number", "title"))
    local = number.rlike(r"\d+/(?:\d{4}/)?[\p{L}\d]+") & (kind != "")
    return F.when(local, F.concat_ws(" ", kind, number)).when(number != "", number).otherwise(title)


def _references(field: str, label: str, reverse: bool) -> Column:
    refs = F.coalesce(field, F.array().cast("array<string>"))
    return F.transform(refs, lambda r: F.struct(T.strip(r).alias("ref"), F.lit(label).alias("label"), F.lit(reverse).alias("reverse")))


def metadata_graph(metas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, name, label, properties)`` and edges ``(src, label, dst)`` of document metadata.

    References by number or document id; an unknown one makes a bare node.  Reversed fields turn
    their edge, supersession has its inverse too, loops and repeats go.
    """
    named = metas.withColumn("name", document_name())
    pairs = [F.struct(F.lit(v).alias("key"), T.strip(F.coalesce(k, F.lit(""))).alias("value")) for k, v in PROPERTIES.items()]
    basis = T.strip(F.coalesce("status_basis", F.lit(""))) if "status_basis" in metas.columns else F.lit("")
    text = T.strip(F.coalesce("title", F.lit("")))
    pairs += [F.struct(F.lit("desc").alias("key"), F.when(basis != "", F.concat_ws(". ", text, basis)).otherwise(text).alias("value"))]
    pairs += [F.struct(F.lit("semanticType").alias("key"), F.coalesce(F.nullif(T.strip("doc_type"), F.lit("")), F.lit(LABEL)).alias("value"))]
    properties = F.map_from_entries(F.filter(F.array(*pairs), lambda p: (p["value"] != "") | p["key"].isin("desc")))
    own = named.select(T.canonical_id("name").alias("id"), "name", F.lit(LABEL).alias("label"), properties.alias("properties"))

    by_id = named.select(F.col("doc_id").alias("ref"), F.col("name").alias("target"), F.lit(1).alias("o"))
    by_number = named.select(F.nullif(T.strip("doc_number"), F.lit("")).alias("ref"), F.col("name").alias("target"), F.lit(0).alias("o"))
    keys = by_id.union(by_number.filter("ref is not null")).groupBy("ref").agg(F.min_by("target", F.struct("o", "target")).alias("target"))
    listed = [_references(k, *v) for k, v in RELATIONS.items()]
    refs = named.select("name", F.explode(F.concat(*listed)).alias("r")).select("name", "r.*").filter("ref <> ''")
    refs = refs.join(keys, "ref", "left")
    other = F.coalesce("target", "ref")
    forward = refs.select(F.when(F.col("reverse"), other).otherwise(F.col("name")).alias("a"), "label", F.when(F.col("reverse"), F.col("name")).otherwise(other).alias("b"))
    inverse = forward.filter(F.col("label").isin(*INVERSES)).select(F.col("b").alias("a"), F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in INVERSES.items())).alias("label"), F.col("a").alias("b"))
    edges = forward.union(inverse).filter("a <> b").distinct().select(T.canonical_id("a").alias("src"), "label", T.canonical_id("b").alias("dst"))
    stubs = refs.filter("target is null").select(F.col("ref").alias("name")).distinct().join(named.select("name"), "name", "left_anti")
    bare = F.create_map(F.lit("docNumber"), F.col("name"), F.lit("semanticType"), F.lit(LABEL))
    return own.unionByName(stubs.select(T.canonical_id("name").alias("id"), "name", F.lit(LABEL).alias("label"), bare.alias("properties"))), edges


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of one id merged: properties of the first written win; reader nodes keep their own ids."""
    own = F.when(F.col("label").isin(*KEPT_LABELS) | has_identity(F.col("id"), F.col("label")), F.col("id")).otherwise(T.canonical_id("id"))
    flat = nodes.withColumn("id", own).select("id", "label", "position", F.explode_outer("properties").alias("key", "value"))
    first = flat.filter("key is not null").groupBy("id", "label", "key").agg(F.min_by("value", "position").alias("value"))
    packed = first.groupBy("id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties"))
    return flat.select("id", "label").distinct().join(packed, ["id", "label"], "left")


def _names(spark) -> DataFrame:
    rows = [(name.lower(), name) for name in sorted({r for _, r, _ in CONTRACT})] + list(ALIASES.items())
    return spark.createDataFrame(rows, "spelled string, relation string")


def bound_endpoints(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mentions(chunk_id, raw)`` against ``entities(chunk_id, name, label)``: label and status of each.

    No label under the canonical id is UNRESOLVED_ENDPOINT, more than one AMBIGUOUS_BINDING.
    """
    labels = _labels(entities)
    out = mentions.withColumn("key", T.canonical_id("raw")).join(labels, ["chunk_id", "key"], "left")
    label, status = _binding("key", "labels")
    return out.select("chunk_id", "raw", "key", label.alias("label"), status.alias("status"))


def _labels(entities: DataFrame) -> DataFrame:
    # Never null, or the join's filter of nulls would compute every key once more; an empty key binds nothing.
    return entities.withColumn("key", F.coalesce(T.canonical_id("name"), F.lit(""))).groupBy("chunk_id", "key").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def _binding(key: str, labels: str) -> tuple[Column, Column]:
    """Label and status of an end, from its key and the labels under it."""
    n = F.coalesce(F.size(labels), F.lit(0))
    bound = F.coalesce(key, F.lit("")) != ""
    status = F.when(~bound | (n < 1), "UNRESOLVED_ENDPOINT").when(n > 1, "AMBIGUOUS_BINDING")
    return F.when(bound & (n == 1), F.get(labels, F.lit(0))), status


def checked_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """``triples(chunk_id, subject, predicate, object)`` with relation, labels and the first thing that is wrong, if any.

    The order of checks: predicate, endpoints, contract.  A relation is never turned round.
    """
    spark = triples.sparkSession
    spelled = F.lower(F.regexp_replace(T.strip(F.coalesce("predicate", F.lit(""))), r"(?U)\s+", " "))
    out = triples.withColumn("spelled", spelled).join(F.broadcast(_names(spark)), "spelled", "left")
    # One row for each chunk and key, so triples stay as they are and each end is one join; nulls are no ends.
    labels = _labels(entities)
    for side in ("subject", "object"):
        key = F.when(F.col("chunk_id").isNotNull(), T.canonical_id(side)).alias(f"{side}_id")
        out = out.select("*", key).join(labels.select("chunk_id", F.col("key").alias(f"{side}_id"), F.col("labels").alias(f"{side}_labels")), ["chunk_id", f"{side}_id"], "left")
        label, status = _binding(f"{side}_id", f"{side}_labels")
        out = out.withColumns({f"{side}_label": label, f"{side}_status": F.when(F.col("chunk_id").isNotNull() & F.col(side).isNotNull(), status)})
    contract = spark.createDataFrame(list(CONTRACT), "subject_label string, relation string, object_label string").withColumn("allowed", F.lit(True))
    out = out.join(F.broadcast(contract), ["subject_label", "relation", "object_label"], "left")
    status = (
        F.when(F.col("relation").isNull(), "UNKNOWN_PREDICATE")
        .when(F.col("subject_status").isNotNull(), F.col("subject_status"))
        .when(F.col("object_status").isNotNull(), F.col("object_status"))
        .when(F.col("allowed").isNull(), "INVALID_ENDPOINT_TYPES")
        .otherwise("ACCEPTED")
    )
    return out.select("chunk_id", "subject", "predicate", "object", "relation", "subject_label", "object_label", "subject_id", "object_id", status.alias("status"))


def belongs_to(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the edge from ``articles(article_id, document_id)`` to their document, unless there is one already."""
    there = edges.filter("label = 'belongsTo'").select(F.col("src").alias("article_id"))
    new = articles.join(there, "article_id", "left_anti")
    return edges.unionByName(new.select(F.col("article_id").alias("src"), F.lit("belongsTo").alias("label"), F.col("document_id").alias("dst")))


def _prefix(category: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ID_PREFIXES.items() for x in pair))
    return F.try_element_at(known, F.element_at(F.split(category, r"\."), -1))


def unresolved_id(category: Column, chunk: Column, name: Column, canonical: bool = False) -> Column:
    """``<prefix>-unresolved:<digest>``, an id within one chunk only; an error for a category without ids.  A name may be canonical already."""
    prefix = F.coalesce(_prefix(category), F.raise_error(F.lit("category has no ids")).cast("string"))
    return F.concat(prefix, F.lit("-unresolved:"), T.digest(chunk, name if canonical else T.canonical_id(name)))


def has_identity(node_id: Column, label: Column) -> Column:
    """Whether an id has its label's prefix, resolved or not; false for labels without one."""
    own = F.startswith(node_id, F.concat(_prefix(label), F.lit(":"))) | F.startswith(node_id, F.concat(_prefix(label), F.lit("-unresolved:")))
    return F.coalesce(own, F.lit(False))


def authority_identity(name: Column) -> Column:
    """``struct(id, reason)``: a global id for a named body; null for titles of persons, parts of other bodies and general names."""
    text = F.trim(F.regexp_replace(T.slug(F.coalesce(name, F.lit(""))), r"\s+", " "))

    def begins(words: tuple[str, ...], s: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | (s == w) | F.startswith(s, F.lit(w + " "))
        return out

    def judged(s: Column) -> Column:
        reason = (
            F.when(s == "", F.lit("no name"))
            .when(begins(PERSON_TITLES, s), F.lit("title of a person"))
            .when(F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.lit(" thuộc ")), F.lit("part of another body"))
            .when(s.isin(*GENERAL_BODIES), F.lit("general name"))
            .when(~begins(BODY_KINDS, s), F.lit("no kind of body"))
            .otherwise(F.lit("body"))
        )
        return F.struct(F.when(reason == "body", F.concat(F.lit("authority:"), s)).alias("id"), reason.alias("reason"))

    return F.transform(F.array(text), judged)[0]


def scope_articles(headings: DataFrame) -> DataFrame:
    """``(document, article_no)`` of ``headings(document, article_no, title)`` whose one title states whom or what a text governs."""
    title = F.lower(F.regexp_replace(T.nfc(F.col("title")), "[\"'“”‘’«»]", ""))
    states = F.lit(False)
    for words in SCOPE_HEADINGS:
        states = states | F.contains(F.regexp_replace(title, r"\s+", " "), F.lit(words))
    one = headings.groupBy("document", "article_no").agg(F.count("*").alias("n"), F.max(states).alias("states"))
    return one.filter("n = 1 and states").select("document", "article_no")


def semantic_identities(mentions: DataFrame, headings: DataFrame) -> DataFrame:
    """``mentions`` with ``id`` and ``reason``; ids of nodes and of both ends of edges come from here.

    ``mentions(category, name, document, article_no, clause_no, point_no, unit, hint_clause, hint_point)`` hold the place
    and text of the one occurrence in the source, or a null ``unit`` if there is none.  The id is
    ``<prefix>:<document>:<article>[:k<clause>][:p<point>]:<digest>``; names and hints of the
    splitter aren't in it, hints that differ are reported.  A governed entity needs an article of scope.
    """
    scope = scope_articles(headings).select(F.col("document").alias("_d"), F.col("article_no").cast("string").alias("_a"), F.lit(True).alias("_scope"))
    out = mentions.join(scope, (F.col("document") == F.col("_d")) & (F.col("article_no").cast("string") == F.col("_a")), "left")
    place = ["document", F.col("article_no").cast("string"), F.concat(F.lit("k"), F.col("clause_no").cast("string")), F.concat(F.lit("p"), F.col("point_no").cast("string"))]
    material = F.concat_ws("\x1f", "category", *place, "unit")
    made = F.concat_ws(":", _prefix(F.col("category")), *place, F.substring(F.sha2(material, 256), 1, 16))
    differs = lambda hint, own: F.col(hint).isNotNull() & ~F.col(hint).cast("string").eqNullSafe(F.col(own).cast("string"))
    found = (
        F.when(~F.col("category").isin(*CONTEXTUAL), F.lit("category has no ids here"))
        .when(F.coalesce(F.col("unit"), F.lit("")) == "", F.lit("no single occurrence"))
        .when((F.col("category") == "RegulatedEntity") & F.col("_scope").isNull(), F.lit("no article of scope"))
    )
    hints = F.concat_ws(", ", F.when(differs("hint_clause", "clause_no"), F.lit("clause differs")), F.when(differs("hint_point", "point_no"), F.lit("point differs")))
    authority = authority_identity(F.col("name"))
    own = F.when(F.col("category") == "Authority", authority["id"]).when(found.isNull() & F.col("category").isNotNull(), made)
    reason = F.when(F.col("category") == "Authority", authority["reason"]).otherwise(F.coalesce(found, F.nullif(hints, F.lit("")), F.lit("occurrence")))
    return out.withColumn("id", own).withColumn("reason", F.when(F.col("category").isNull(), F.lit("category has no ids here")).otherwise(reason)).drop("_d", "_a", "_scope")


def article_id(document: Column, number: Column) -> Column:
    """``article:<document>:<number>``; an error for a number that isn't one."""
    n = number.cast("int")
    return F.when(n > 0, F.concat_ws(":", F.lit("article"), document, n.cast("string"))).otherwise(F.raise_error(F.lit("article number is not valid")))


def downgraded(identities: DataFrame) -> DataFrame:
    """``identities(chunk_id, category, name, target)``: names that share a target in one chunk are all unresolved; authorities aren't touched."""
    n = F.count("*").over(Window.partitionBy("chunk_id", "category", "target"))
    shared = (F.col("category") != "Authority") & (n > 1)
    own = F.when(shared, unresolved_id(F.col("category"), F.col("chunk_id"), F.col("name"))).otherwise(F.col("target"))
    return identities.withColumn("ambiguous", shared).withColumn("id", own)


def contained_names(texts: DataFrame, names: DataFrame, most: int = 10_000) -> DataFrame:
    """``texts(doc_id, text)`` × ``names(name)`` where the name occurs in the text.

    A vocabulary of up to ``most`` names is broadcast and tested; a larger one meets the texts by
    its rarest word first, an equi-join, and then is tested.
    """
    names = names.filter("name <> ''")
    if names.count() <= most:
        return texts.join(F.broadcast(names), F.contains("text", F.col("name")))
    words = terms_of(texts, "doc_id", F.array_distinct(T.index_tokens("text"))).withColumnRenamed("term", "w")
    # A name may begin or end inside a word of the text: its inner words are whole words there.
    inner = F.slice(T.index_tokens("name"), 2, F.greatest(F.size(T.index_tokens("name")) - 2, F.lit(0)))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    keyed = names.select("name", F.explode_outer(inner).alias("w")).join(df, "w", "left")
    rare = keyed.groupBy("name").agg(F.min_by("w", F.coalesce("df", F.lit(0))).alias("w"))
    by_word = rare.filter("w is not null").join(words, "w").join(texts, "doc_id").filter(F.contains("text", F.col("name")))
    rest = texts.join(rare.filter("w is null").select("name"), F.contains("text", F.col("name")))
    return by_word.select("doc_id", "text", "name").unionByName(rest.select("doc_id", "text", "name"))


def sole_occurrence(names: DataFrame, lines: DataFrame) -> DataFrame:
    """``names(source, name)`` that occur exactly once in ``lines(source, line_no, line)``, with their line."""
    n = T.phrase_count(T.source_phrase("line"), T.source_phrase("name"))
    hits = names.join(lines, "source").withColumn("n", n).filter("n > 0")
    return hits.groupBy("source", "name").agg(F.sum("n").alias("n"), F.min("line_no").alias("line_no")).filter("n = 1").drop("n")


def one_hop(seeds: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """Edges from ``seeds(id)``."""
    some = edges.filter(F.col("label").isin(*labels)) if labels else edges
    return seeds.join(some, seeds["id"] == some["src"]).select("src", "label", "dst")


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85, checkpoint_every: int = 5) -> DataFrame:
    """``(id, score)`` by power iteration from ``seeds(id)``; mass of nodes without out-edges goes back to the seeds.

    Edges are partitioned by source once; only scores move in each round, and lineage is cut every few.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(seeds.select("id")).distinct()
    n = seeds.select("id").distinct().count()
    restart = seeds.select("id").distinct().withColumn("restart", F.lit(1.0 / max(n, 1)))
    sinks = nodes.join(degree, nodes["id"] == degree["src"], "left").select("id", F.col("src").isNull().alias("sink"))
    score = sinks.join(restart, "id", "left").select("id", F.coalesce("restart", F.lit(0.0)).alias("restart"), "sink").withColumn("score", F.col("restart"))
    # Each node has an edge to itself without a degree, which keeps it and carries its restart share: a round reads the scores
    # in one join and for the mass of sinks, as each reading repeats the plan of all rounds since lineage was cut.
    out = edges.join(degree, "src").select("src", "dst", "degree").union(nodes.select("id", "id", F.lit(None).cast("long")))
    for k in range(rounds):
        own = F.col("degree").isNull()
        lost = score.filter("sink").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        sent = score.join(out, score["id"] == out["src"]).groupBy("dst").agg(
            F.coalesce(F.sum(F.when(~own, F.col("score") / F.col("degree"))), F.lit(0.0)).alias("kept"), F.max(F.when(own, F.col("restart"))).alias("restart"), F.max(F.when(own, F.col("sink"))).alias("sink"),
        )
        after = damping * (F.col("kept") + F.col("lost") * F.col("restart")) + (1 - damping) * F.col("restart")
        score = sent.join(F.broadcast(lost), how="cross").select(F.col("dst").alias("id"), "restart", "sink", after.alias("score"))
        if (k + 1) % checkpoint_every == 0 and edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            score = score.checkpoint()
    return score.select("id", "score")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node label and relation."""
    count = lambda df, kind: df.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))
