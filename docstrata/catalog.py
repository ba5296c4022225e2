"""Registered queries of the engine's own operators, each next to DuckDB SQL with the same rows.

All run over whole tables.  Those that need legal structure, which the tables lack, read texts that
Spark writes from every order and its lines; their SQL computes the rows from the numbers in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import replies
from .functions import text as T
from .operators import assembly, bm25, evaluation, evidence, graph, lists, metrics, push, ranking, segments, splitters
from .plans import retrieval
from .shared import work_dir
from .sources import corpus
from .streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(rows: list[tuple], columns: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


# ---------------------------------------------------------------- legal texts made of orders and their lines

LINES = """k as (select l_orderkey as o, l_partkey as p, l_suppkey as s, l_quantity::bigint as q,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as k from lineitem)"""


#: Lines of a task where they are dealt by chunk, and of a small one; each makes some four entities.
TASK_LINES, FEW_LINES = 100_000, 20_000


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` dealt by ``chunk_id``, which is the order as a string, to as many tasks as its size asks for."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()
    tasks = max(-(-n // TASK_LINES), min(spark.sparkContext.defaultParallelism, -(-n // FEW_LINES)), 1)
    return lines.select(F.col("l_orderkey").cast("string").alias("chunk_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(tasks, "chunk_id")


def order_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``(o, k, p, s, q)``: the lines of every order, numbered, with part, supplier and quantity; with ``chunk_id`` if they are ``dealt`` by it."""
    numbered = F.row_number().over(Window.partitionBy("chunk_id" if dealt else "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    named = {"o": F.col("l_orderkey"), "k": numbered, "p": F.col("l_partkey"), "s": F.col("l_suppkey"), "q": F.col("l_quantity").cast("long")}
    lines = dealt_lines(spark, sf_dir) if dealt else table(spark, sf_dir, "lineitem")
    return lines.select(*(["chunk_id"] if dealt else []), *(c.alias(n) for n, c in named.items()))


def order_texts(spark: SparkSession, sf_dir: str, head: str, line: str, between: str = "\n") -> DataFrame:
    """``(o, text)``: a text of each order, from the expressions of its head and its lines."""
    lines = order_lines(spark, sf_dir).select("o", F.struct("k", F.expr(line).alias("line")).alias("at"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["line"]), between)
    return lines.groupBy("o").agg(body.alias("body")).select("o", F.concat(F.expr(head), F.col("body")).alias("text"))


# ---------------------------------------------------------------- shared SQL

WORDS = r"[\p{L}\p{N}_]+"
MATCH = "[0-9a-zA-ZÀ-ỹà-ỹĐđ]+"
NORMAL = r"trim(regexp_replace(lower(translate(nfc_normalize(coalesce({0}, '')), '*`#_|~', '')), '\s+', ' ', 'g'))"


def normal(column: str) -> str:
    return NORMAL.replace("{0}", column)


def joined(column: str) -> str:
    """``normal`` with digit groups joined: every run of digits gets marks, so that groups need no look-around."""
    text = f"translate(nfc_normalize(coalesce({column}, '')), '*`#_|~', '')"
    marked = f"regexp_replace({text}, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
    grouped = f"regexp_replace({marked}, '(\\x01[0-9]{{1,3}}\\x02(?:[ .,\\x{{a0}}\\x{{202f}}]\\x01[0-9]{{3}}\\x02)+)', chr(3) || '\\1' || chr(4), 'g')"
    pieces = f"list_transform(regexp_split_to_array({grouped}, '[\\x03\\x04]'), lambda x, i: case when i % 2 = 0 then regexp_replace(x, '[^0-9]', '', 'g') else x end)"
    return f"trim(regexp_replace(lower(translate(array_to_string({pieces}, ''), chr(1) || chr(2), '')), '\\s+', ' ', 'g'))"


def bm25_sql(pattern: str = WORDS, k: int = 10, name: str = "bm") -> str:
    """CTEs that end in ``name(query_id, doc_id, score, rank)`` with the benchmark's passages as queries."""
    return f"""
{name}_tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{pattern}')) as term from documents),
{name}_len as (select doc_id, len(regexp_extract_all(lower(text), '{pattern}')) as dl from documents),
{name}_stats as (select count(*) as n, avg(dl) as avgdl from {name}_len),
{name}_post as (select doc_id, term, count(*) as tf from {name}_tok group by all),
{name}_terms as (select term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) as idf from {name}_post, {name}_stats group by term),
{name}_q as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '{pattern}')) as term from benchmark),
{name}_qt as (select query_id, term, count(*) as qtf from {name}_q group by all),
{name}_score as (
  select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from {name}_qt join {name}_terms using (term) join {name}_post using (term) join {name}_len using (doc_id), {name}_stats group by all),
{name} as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank
  from {name}_score where score > 0 qualify rank <= {k})"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_hits(spark: SparkSession, sf_dir: str, k: int = 10, codes: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(bm25.fit(docs, codes), passages(spark, sf_dir), k, codes)


def bm25_documents(spark: SparkSession, sf_dir: str, docs: DataFrame, k: int = 10) -> DataFrame:
    """Hits with the columns of ``docs(doc_id, ...)``."""
    return bm25.with_documents(bm25_hits(spark, sf_dir, k), docs, k * passages(spark, sf_dir).count())


# ---------------------------------------------------------------- text functions


@query("text_clean", r"""
with c as (select 'd' as kind, doc_id as id, text from documents union all select 'p', page_id, html from pages)
select kind, id, md5(trim(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(9), ' '), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), chr(10) || ' ')) as digest from c""")  # fmt: skip
def text_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return docs.union(pages).select("kind", "id", F.md5(T.clean("text")).alias("digest"))


@query("tokenizers", rf"""
select doc_id, len(regexp_extract_all(lower(text), '{WORDS}'))::int as words, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_/-]+'))::int as coded,
  len(list_distinct(regexp_extract_all(lower(text), '{WORDS}')))::int as distinct_words,
  len(list_filter(list_distinct(regexp_split_to_array(translate(lower(text), ',.?', '   '), '\s+')), lambda w: length(w) > 2))::int as plain
from documents""")  # fmt: skip
def tokenizers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = T.index_tokens("text")
    return docs.select("doc_id", F.size(words).alias("words"), F.size(T.index_tokens("text", True)).alias("coded"), F.size(F.array_distinct(words)).alias("distinct_words"), F.size(T.plain_tokens("text")).alias("plain"))


@query("normalize_text", f"select item_id, md5({normal('text')}) as digest, len(regexp_extract_all({normal('text')}, '{MATCH}'))::int as n from benchmark")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(T.normalize_text("text")).alias("digest"), F.size(T.match_tokens("text")).alias("n"))


@query("normalize_pairs", f"with {LINES} select o, k, q % 5 in (0, 1, 4) as same from k")
def normalize_pairs(spark, sf_dir):
    """Grouped numbers, marks, white space and case are one text; other numbers and decimals aren't."""
    group = "lpad(p % 1000, 3, '0'), {0}, lpad(s % 1000, 3, '0')"
    a = f"case q % 5 when 0 then concat('7.', {group.format("'.'")}, ' đồng') when 1 then concat('Điều **', p, '**') when 2 then concat('Điều ', p) when 3 then concat('12.', 1000 + p % 9000) else concat('a  b\tC', p) end"
    b = f"case q % 5 when 0 then concat('7 ', {group.format("' '")}, ' đồng') when 1 then concat('Điều ', p) when 2 then concat('Điều ', p + 1) when 3 then concat('12', 1000 + p % 9000) else concat('A B c', p) end"
    rows = order_lines(spark, sf_dir).withColumns({"a": F.expr(a), "b": F.expr(b)})
    return rows.select("o", F.col("k").cast("long").alias("k"), (T.normalize_for_match("a") == T.normalize_for_match("b")).alias("same"))


@query("token_coverage", f"""
with s as (select item_id, list_distinct(regexp_extract_all({normal('text')}, '{MATCH}')) as t from benchmark)
select a.item_id as a, b.item_id as b, round(len(list_intersect(a.t, b.t)) / nullif(len(a.t), 0)::double, 9) as coverage from s a join s b on b.item_id = a.item_id + 1""")  # fmt: skip
def token_coverage(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select("item_id", T.token_set("text").alias("t"))
    a, b = s.alias("a"), s.alias("b")
    joined = a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1)
    return joined.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(T.set_coverage(F.col("a.t"), F.col("b.t")), 9).alias("coverage"))


@query("first_occurrences", f"""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) as w, generate_subscripts(regexp_extract_all(lower(text), '{WORDS}'), 1) as i from documents),
f as (select doc_id, w, min(i) as i from t group by all)
select doc_id, md5(string_agg(w, ' ' order by i)) as digest from f group by doc_id""")  # fmt: skip
def first_occurrences(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.index_tokens("text")).alias("w"))
    return words.filter(F.size("w") > 0).select("doc_id", F.md5(F.array_join("w", " ")).alias("digest"))


@query("normalize_labels", f"with {LINES} select o, k, p || case when q % 3 = 0 then 'a' else '' end as article, k::varchar as clause, case p % 4 when 0 then 'd' when 1 then 'b' when 2 then 'c' end as point from k")
def normalize_labels(spark, sf_dir):
    """Labels of every line in one of their spellings."""
    rows = order_lines(spark, sf_dir).withColumns({
        "article": F.expr("concat(case q % 3 when 0 then 'Điều ' when 1 then ' dieu' else 'Article ' end, p, case q % 3 when 0 then 'a.' else '' end)"),
        "clause": F.expr("concat(case q % 4 when 0 then 'khoản ' when 1 then 'Clause ' when 2 then 'para. ' else '' end, k, if(q % 2 = 0, ')', ''))"),
        "point": F.expr("case p % 4 when 0 then 'Đ)' when 1 then 'điểm b' when 2 then 'litera C.' else ' ' end"),
    })
    return rows.select("o", F.col("k").cast("long").alias("k"), T.normalize_article("article").alias("article"), T.normalize_clause("clause").alias("clause"), T.normalize_point("point").alias("point"))


@query("normalize_document_ids", f"with {LINES} select o, k, case when q % 5 = 4 then null else p || '/' || 2000 + q || '/nd/cp' end as id from k")
def normalize_document_ids(spark, sf_dir):
    """Codes of every line in one of their spellings; blanks have none."""
    raw = "case q % 5 when 0 then concat(p, '/', 2000 + q, '/NĐ-CP') when 1 then concat(p, '-', 2000 + q, '-ND-CP') when 2 then concat('Nghị định số ', p, '/', 2000 + q, '/NĐ-CP') when 3 then concat('decree no. ', p, '_', 2000 + q, '_nd.cp/') else ' ' end"
    return order_lines(spark, sf_dir).select("o", F.col("k").cast("long").alias("k"), T.normalize_document_id(F.expr(raw)).alias("id"))


@query("canonical_ids", f"""with {LINES} select o, k, case q % 5 when 0 then 'luật ' || p || ' 2015 qh13' when 1 then 'nghị định ' || p || ' ' || 2000 + q || ' nđ cp'
  when 2 then 'điều ' || k || ' luật ' || p || ' 2015 qh13' when 3 then 'quyết định ' || p || ' qđ ttg' else p || ' ' || 2000 + q || ' nđ cp' end as id from k""")  # fmt: skip
def canonical_ids(spark, sf_dir):
    """Names of documents of every line in one of their spellings."""
    law, code = "concat('Luật An ninh số ', p, '/2015/QH13')", "concat(p, '/', 2000 + q, '/NĐ-CP')"
    raw = f"case q % 5 when 0 then {law} when 1 then concat('Nghị định ', {code}) when 2 then concat('Điều ', k, ' Luật ', p, '/2015/QH13') when 3 then concat('Quyết định ', if(s % 2 = 0, 'số ', ''), p, '/QĐ-TTg') else {code} end"
    return order_lines(spark, sf_dir).select("o", F.col("k").cast("long").alias("k"), T.canonical_id(F.expr(raw)).alias("id"))


@query("stable_ids", r"select doc_id, substr(sha256(coalesce(source, '') || chr(31) || doc_id), 1, 16) as digest, md5(text) as content from documents")
def stable_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.digest(F.col("source"), F.col("doc_id")).alias("digest"), T.content_id("text").alias("content"))


@query("token_counter", f"select doc_id, greatest(len(regexp_extract_all({joined('text')}, '{MATCH}')), ceil(length(text) / 4)::int)::int as n from documents")
def token_counter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").alias("n"))


@query("document_heads", f"""with {LINES} select o, k, case when q % 3 < 2 then case q % 3 when 0 then 'Nghị định ' || p || '/2023/NĐ-CP' else 'Thông tư ' || p || '-2026-TT-BKHCN' end end as title,
  case q % 3 when 0 then p || '/2023/NĐ-CP' when 1 then p || '/2026/TT-BKHCN' else p || '/2020/ND/CP' end as code, case s % 3 when 0 then 'còn hiệu lực' when 1 then 'hết hiệu lực' else 'Không rõ' end as status from k""")  # fmt: skip
def document_heads(spark, sf_dir):
    """Title, code and status of a document for every line; without a heading the file's name has the code."""
    text = "concat(case q % 3 when 0 then concat('# Nghị định ', p, '/2023/NĐ-CP\n') when 1 then concat('# Thông tư ', p, '-2026-TT-BKHCN\n') else 'văn bản\n' end, case s % 3 when 0 then 'Tình trạng: Còn hiệu lực' when 1 then 'hết hiệu lực' else '' end)"
    rows = order_lines(spark, sf_dir).withColumns({"text": F.expr(text), "file": F.expr("concat(p, '-2020-ND-CP_x.md')")})
    return rows.select("o", F.col("k").cast("long").alias("k"), T.heading_title("text").alias("title"), T.heading_code("text", "file").alias("code"), T.document_status("text").alias("status"))


@query("first_references", f"""with {LINES} select o, k, case when q % 3 = 0 then p % 9999 + 1 || '/2023/NĐ-CP' end as code, case when q % 3 = 0 then (k % 99)::varchar end as article, case when q % 3 = 1 then (s + 1)::int end as page from k""")
def first_references(spark, sf_dir):
    """The first code, article and page in a text of every line."""
    raw = "case q % 3 when 0 then concat('theo Điều ', k % 99, ' Nghị định ', p % 9999 + 1, '/2023/NĐ-CP, Điều 7') when 1 then concat('<page_number>', s + 1, '</page_number> x') else 'không' end"
    rows = order_lines(spark, sf_dir).withColumn("text", F.expr(raw))
    return rows.select("o", F.col("k").cast("long").alias("k"), T.legal_code("text").alias("code"), T.article_number("text").alias("article"), T.page_number("text").alias("page"))


@query("phrase_counts", "select item_id, doc_id, ((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text))::bigint as n from documents d join benchmark b on contains(d.text, b.text)")
def phrase_counts(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.col("text").alias("name"), "item_id")
    hits = graph.contained_names(table(spark, sf_dir, "documents").select("doc_id", "text"), names.select("name").distinct())
    return hits.join(names, "name").select("item_id", "doc_id", T.phrase_count("text", "name").alias("n"))


@query("trigram_relevance", r"""
with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w, lower(trim(text)) as t from benchmark),
g as (select item_id, t, list_distinct(case when len(w) >= 3 then list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' ')) else w end) as g from w)
select a.item_id as a, b.item_id as b, contains(a.t, b.t) or contains(b.t, a.t) or coalesce(len(list_intersect(a.g, b.g)) / nullif(least(len(a.g), len(b.g)), 0)::double >= 0.65, false) as relevant
from g a join g b on b.item_id between a.item_id + 1 and a.item_id + 3""")  # fmt: skip
def trigram_relevance(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    joined = b.alias("x").join(b.alias("y"), F.col("y.item_id").between(F.col("x.item_id") + 1, F.col("x.item_id") + 3))
    related = metrics.relevance(F.col("x.item_id"), F.col("y.item_id"), F.col("x.text"), F.col("y.text"))
    return joined.select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), related.alias("relevant"))


@query("atomic_claims", r"""
with m as (select conv_id, turn, trim(text) as whole, string_split(regexp_replace(regexp_replace(text, '[\r\n]+', chr(30), 'g'), '([.!?;])\s+', '\1' || chr(30), 'g'), chr(30)) as p from conversations where role = 'assistant'),
k as (select conv_id, turn, whole, list_filter(list_transform(p, lambda x: trim(regexp_replace(trim(x), '^(?:[-*•+]|\d+[.)])\s*', ''))), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) >= 3) as k from m)
select conv_id, turn, unnest(case when len(k) > 0 then k when whole <> '' then [whole] else []::varchar[] end) as claim from k""")  # fmt: skip
def atomic_claims(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", F.explode(T.atomic_claims("text")).alias("claim"))


# ---------------------------------------------------------------- index and retrieval


@query("bm25_fit_terms", f"""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) as term from documents),
p as (select distinct doc_id, term from t), n as (select count(*) as n from documents)
select term, count(*) as df, round(ln((any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5) + 1.0), 9) as idf from p, n group by term""")  # fmt: skip
def bm25_fit_terms(spark, sf_dir):
    index = bm25.fit(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("bm25_topk", f"with {bm25_sql()} select query_id, doc_id, round(score, 6) as score, rank from bm")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_codes_topk", f"with {bm25_sql('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_/-]+')} select query_id, doc_id, round(score, 6) as score, rank from bm")
def bm25_codes_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir, codes=True).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


DENSE = """
q as (select vec_id as query_id, embedding::double[] as q from embeddings where {0}),
dense as (select query_id, vec_id as doc_id, round(list_cosine_similarity(embedding::double[], q), 9) as score,
  row_number() over (partition by query_id order by round(list_cosine_similarity(embedding::double[], q), 9) desc, vec_id) as rank from embeddings, q qualify rank <= 10)"""


def dense_hits(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """One vector in fifty as a query, whatever the size of the table, or those of ``ids(query_id)``."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    queries = vectors.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return ranking.dense_search(vectors, queries.filter("query_id % 50 = 0") if ids is None else queries.join(ids, "query_id", "left_semi"), 10)


@query("dense_topk", f"with {DENSE.replace('{0}', 'vec_id % 50 = 0')} select query_id, doc_id, round(score, 6) as score, rank from dense")
def dense_topk(spark, sf_dir):
    return dense_hits(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def fusion_sql(weights: dict[str, float]) -> str:
    case = " ".join(f"when '{c}' then {w}" for c, w in weights.items())
    return f"""with {DENSE.strip().replace('{0}', 'vec_id in (select item_id from benchmark)')}, {bm25_sql().strip()},
    channels as (select query_id, 'vector' as channel, 0 as o, rank, doc_id from dense union all select query_id, 'bm25', 1, rank, doc_id from bm where query_id in (select vec_id from embeddings)),
    fused as (select query_id, doc_id, round(sum((case channel {case} else 1.0 end) / (60 + rank)), 12) as score, min({{'o': o, 'rank': rank}}) as seen from channels group by all)
    select query_id, doc_id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, seen, doc_id) as rank from fused qualify rank <= 10"""


def fused(spark: SparkSession, sf_dir: str, weights: dict[str, float] | None) -> DataFrame:
    """Both channels for every query that has a passage and a vector."""
    both = passages(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("query_id") == F.col("vec_id"), "left_semi").select("query_id").distinct()
    dense = dense_hits(spark, sf_dir, both).select("query_id", F.lit("vector").alias("channel"), F.lit(0).alias("channel_order"), "rank", "doc_id")
    sparse = bm25_hits(spark, sf_dir).join(both, "query_id", "left_semi")
    sparse = sparse.select("query_id", F.lit("bm25").alias("channel"), F.lit(1).alias("channel_order"), "rank", "doc_id")
    return ranking.fuse(dense.unionByName(sparse), weights).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("rrf_fuse", fusion_sql({}).replace("case channel  else 1.0 end", "1.0"))
def rrf_fuse(spark, sf_dir):
    return fused(spark, sf_dir, None)


@query("rrf_weighted", fusion_sql(retrieval.WEIGHTS))
def rrf_weighted(spark, sf_dir):
    return fused(spark, sf_dir, retrieval.WEIGHTS)


COVER = f"list_distinct(regexp_extract_all({normal('{0}')}, '{MATCH}'))"


@query("hybrid_retrieve")
def hybrid_retrieve(spark, sf_dir):
    """Two channels fused and reranked by token coverage; every passage with a vector has both."""
    docs, queries = table(spark, sf_dir, "documents").select("doc_id", "text"), passages(spark, sf_dir)
    channels = {"bm25": bm25_hits(spark, sf_dir), "vector": dense_hits(spark, sf_dir, ids=queries.select("query_id"))}
    return retrieval.hybrid(channels, docs, queries)


@query("abbreviations", f"with {LINES} select o, k, case when q % 2 = 0 then 'theo nghị định ' || p else 'AND' || p || ' (an ninh)' end as full_text from k")
def abbreviations(spark, sf_dir):
    """Abbreviations that stand alone are spelled out, those within words aren't."""
    rows = order_lines(spark, sf_dir).withColumn("text", F.expr("if(q % 2 = 0, concat('theo NĐ ', p), concat('AND', p, ' (AND)'))"))
    return retrieval.expand_abbreviations(rows, {"NĐ": "nghị định", "AND": "an ninh"}).select("o", F.col("k").cast("long").alias("k"), F.col("text").alias("full_text"))


@query("budget_contexts", f"""
with recursive {bm25_sql().strip()},
sized as (select query_id, rank, ceil(length(text) / 4)::bigint as size from bm join documents using (doc_id)),
fold(query_id, rank, used, kept) as (
  select query_id, 1::bigint, case when size <= 2000 then size else 0 end, size <= 2000 from sized where rank = 1
  union all
  select s.query_id, s.rank, f.used + case when f.used + s.size <= 2000 then s.size else 0 end, f.used + s.size <= 2000 from fold f join sized s on s.query_id = f.query_id and s.rank = f.rank + 1)
select f.query_id, f.rank, s.size from fold f join sized s on s.query_id = f.query_id and s.rank = f.rank where kept""")  # fmt: skip
def budget_contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / 4).cast("long").alias("size"))
    return ranking.within_budget(bm25_documents(spark, sf_dir, docs).select("query_id", "rank", "size"), 2000)


@query("context_dedup", """
with d as (select source as query_id, doc_id, sha256(text) as k from documents)
select query_id, doc_id, row_number() over (partition by query_id order by doc_id) as rank from (select * from d qualify row_number() over (partition by query_id, k order by doc_id) = 1)""")  # fmt: skip
def context_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.sha2("text", 256).alias("k"))
    return ranking.dedup_contexts(docs, "k", "doc_id").select("query_id", "doc_id", "rank")


@query("citation_previews", f"with {bm25_sql().strip()} select query_id, rank as number, doc_id as chunk_id, substr(text, 1, 200) as snippet from bm join documents using (doc_id)")
def citation_previews(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranking.citation_previews(bm25_documents(spark, sf_dir, docs).withColumnRenamed("doc_id", "chunk_id"))


@query("prompt_contexts", f"with {bm25_sql().strip()} select query_id, md5(string_agg('[' || rank || '] ' || coalesce(source, '') || chr(10) || text, chr(10) || chr(10) order by rank)) as digest from bm join documents using (doc_id) group by query_id")
def prompt_contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return ranking.format_context(bm25_documents(spark, sf_dir, docs)).select("query_id", F.md5("context").alias("digest"))


# ---------------------------------------------------------------- evidence and metrics

LEVELS = ("1/2020/A", "5", "2", "b")


@query("structural_truth", f"""
with {LINES} select o, k, case when 1 in (q % 3, p % 3) then false when q % 3 = 0 and p % 3 = 0 and s % 3 = 0 and k % 3 = 0 then true end as verdict,
  case when q % 3 = 1 then 'document' when p % 3 = 1 then 'article' end as mismatch from k""")  # fmt: skip
def structural_truth(spark, sf_dir):
    """Every line as a declared place of which each level is right (0), wrong (1) or silent (2)."""
    rows = order_lines(spark, sf_dir)
    for k, gold, level in zip(("document_id", "article", "clause", "point"), LEVELS, ("q", "p", "s", "k"), strict=True):
        rows = rows.withColumns({f"g_{k}": F.lit(gold), f"c_{k}": F.when(F.col(level) % 3 == 0, gold).when(F.col(level) % 3 == 1, "9")})
    place = evidence.structural(evidence.levels("c_"), evidence.levels("g_"))
    return rows.select("o", F.col("k").cast("long").alias("k"), place["verdict"].alias("verdict"), place["mismatch"].alias("mismatch"))


def support_sql(k: int = 10) -> str:
    """CTE ``support(query_id, doc_id, rank, supported)``: passages as gold, their best hits as contexts."""
    no_space = "regexp_replace({0}, '\\s+', '', 'g')"
    return f"""{bm25_sql(k=k).strip()},
    gold as (select item_id as query_id, {no_space.replace('{0}', normal('text'))} as g, {COVER.replace('{0}', 'text')} as gt from benchmark),
    ctx as (select doc_id, {no_space.replace('{0}', normal('text'))} as c, {COVER.replace('{0}', 'text')} as ct from documents where doc_id in (select doc_id from bm)),
    support as (select query_id, doc_id, rank, case when contains(c, g) or len(list_intersect(gt, ct)) / nullif(len(gt), 0)::double >= 0.8 then true end as supported from bm join gold using (query_id) join ctx using (doc_id))"""


def supported_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("c_text"))
    gold = passages(spark, sf_dir).select("query_id", F.col("text").alias("g_text"))
    pairs = bm25_documents(spark, sf_dir, docs).join(gold, "query_id")
    text = evidence.text_support(F.col("g_text"), F.col("c_text"))
    return pairs.select("query_id", "doc_id", "rank", text["supported"].alias("supported"))


@query("evidence_support", f"with {support_sql()} select query_id, doc_id, rank, supported from support")
def evidence_support(spark, sf_dir):
    return supported_hits(spark, sf_dir)


@query("evidence_best", f"with {support_sql()} select query_id, case when bool_or(supported) then true end as supported, min(case when supported then rank end) as rank from support group by query_id")
def evidence_best(spark, sf_dir):
    return evidence.best_support(supported_hits(spark, sf_dir), ["query_id"])


RETRIEVAL = ", ".join(f"(r <= {k})::int::double as recall_{k}, (r <= {k})::int::double as hit_{k}" for k in metrics.KS)


@query("retrieval_metrics", f"""with {support_sql()}, f as (select query_id, coalesce(min(case when supported then rank end), 1 << 30) as r from support group by query_id)
select query_id as question_id, (r < (1 << 30))::int::double as recall, (r < (1 << 30))::int::double as recall_required, case when r < (1 << 30) then 1.0 / r else 0 end as mrr, {RETRIEVAL} from f""")  # fmt: skip
def retrieval_metrics(spark, sf_dir):
    best = evidence.best_support(supported_hits(spark, sf_dir), ["query_id"])
    rows = best.select(F.col("query_id").alias("question_id"), F.col("query_id").alias("evidence"), F.lit(True).alias("required"), "supported", "rank", F.lit(10).alias("n_contexts"), F.lit(False).alias("error"))
    return metrics.retrieval_metrics(rows)


@query("context_precision", f"with {support_sql()} select query_id as question_id, avg(coalesce(supported, false)::int) as precision from support group by query_id")
def context_precision(spark, sf_dir):
    return metrics.context_precision(supported_hits(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("supported").alias("relevant")))


@query("ranking_metrics", f"""
with {bm25_sql().strip()}, l as (select doc_id, max(quality) as q from labels group by doc_id), total as (select count(*) as g from l where q = 1),
r as (select query_id, rank, coalesce(q, 0) as rel, 5 as g from bm left join l using (doc_id)),
s as (select query_id, min(case when rel = 1 then rank end) as f, sum(rel) filter (rank <= 3) as h3, count(*) filter (rank <= 3) as n3, sum(rel / log2(rank + 1)) filter (rank <= 3) as g3 from r group by query_id)
select query_id as question_id, round(coalesce(1.0 / f, 0), 4) as mrr, (h3 > 0)::int::double as hit_3, round(h3 / n3::double, 4) as precision_3, round(least(h3, 5) / 5.0, 4) as recall_3,
  round(least(g3 / (1 + 1 / log2(3) + 0.5), 1.0), 4) as ndcg_3 from s""")  # fmt: skip
def ranking_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    ranked = bm25_hits(spark, sf_dir).join(labels, "doc_id", "left")
    rows = ranked.select(F.col("query_id").alias("question_id"), "rank", (F.coalesce("q", F.lit(0)) == 1).alias("relevant"), F.lit(5).alias("n_gold"))
    return metrics.ranking_metrics(rows, (3,))


@query("marker_hits", f"""
with {bm25_sql(k=1).strip()}, m as (select item_id as query_id, unnest(list_concat(string_split(text, ' ')[1:3], ['<page>'])) as marker from benchmark),
j as (select query_id, contains(regexp_replace({normal('d.text')}, '\\s+', '', 'g'), regexp_replace({normal('marker')}, '\\s+', '', 'g')) and regexp_replace({normal('marker')}, '\\s+', '', 'g') <> '' as hit
  from m join bm using (query_id) join documents d using (doc_id) where not starts_with(trim(marker), '<'))
select query_id as question_id, avg(hit::int) as hit_rate, bool_and(hit) as hit_all from j group by query_id""")  # fmt: skip
def marker_hits(spark, sf_dir):
    words = F.concat(F.slice(F.split("text", " "), 1, 3), F.array(F.lit("<page>")))
    markers = passages(spark, sf_dir).select("query_id", F.explode(words).alias("marker"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer"))
    return metrics.marker_metrics(markers.join(bm25_documents(spark, sf_dir, docs, 1), "query_id").withColumnRenamed("query_id", "question_id"))


@query("claim_metrics", f"""
with {LINES}, t as (select o as q, case when q % 2 = 0 then 'answer' else 'gold' end as side, case p % 3 when 0 then true when 1 then false end as s from k),
c as (select q as question_id, sum((s is true)::int) filter (side = 'answer') / nullif(count(*) filter (side = 'answer'), 0)::double as claim_precision,
  sum((s is true)::int) filter (side = 'gold') / nullif(count(*) filter (side = 'gold'), 0)::double as claim_recall from t group by q)
select *, case when claim_precision + claim_recall = 0 then 0 else 2 * claim_precision * claim_recall / (claim_precision + claim_recall) end as claim_f1 from c""")  # fmt: skip
def claim_metrics(spark, sf_dir):
    """Lines as claims of an answer or of its gold; a third is supported, a third is not judged."""
    rows = order_lines(spark, sf_dir)
    return metrics.claim_metrics(rows.select(F.col("o").alias("question_id"), F.expr("if(q % 2 = 0, 'answer', 'gold')").alias("side"), F.expr("case p % 3 when 0 then true when 1 then false end").alias("supported")))


@query("grounding_metrics", f"""
with {LINES}, t as (select o as q, case p % 3 when 0 then true when 1 then false end as c, case s % 3 when 0 then true when 1 then false end as g, case q % 3 when 0 then true when 1 then false end as x from k),
s as (select q as question_id, case when c then 'c' when g then 'g' when g = false and coalesce(x, false) then 'x' when g = false then 'u' else '?' end as s from t)
select question_id, avg((s = 'c')::int) as faithfulness, avg((s = 'x')::int) as hallucination, avg((s = 'g')::int) as retrieval_gap,
  sum((s in ('u', 'x'))::int) / nullif(sum((s in ('u', 'x', 'g'))::int), 0)::double as unsupported from s group by question_id""")  # fmt: skip
def grounding_metrics(spark, sf_dir):
    """Lines as claims: supported by contexts, by gold, or contradicted; each true, false or not judged."""
    truth = lambda c: F.expr(f"case {c} % 3 when 0 then true when 1 then false end")
    return metrics.grounding_metrics(order_lines(spark, sf_dir).select(F.col("o").alias("question_id"), evidence.classify_claim(truth("p"), truth("s"), truth("q")).alias("status")))


@query("citation_metrics", f"""
with {LINES}, t as (select o as q, s % 2 = 0 as made, case q % 3 when 0 then true when 1 then false end as ok from k),
p as (select q, avg(ok::int) as p from t where made group by q), r as (select q, avg(coalesce(ok, false)::int) as r from t where not made group by q)
select coalesce(p.q, r.q) as question_id, p as citation_precision, r as citation_recall from p full join r on p.q = r.q""")  # fmt: skip
def citation_metrics(spark, sf_dir):
    """Lines as citations made or as evidence that should be cited."""
    rows = order_lines(spark, sf_dir).select(F.col("o").alias("question_id"), "s", F.expr("case q % 3 when 0 then true when 1 then false end").alias("ok"))
    return metrics.citation_metrics(rows.filter("s % 2 = 0").select("question_id", F.col("ok").alias("correct")), rows.filter("s % 2 <> 0").select("question_id", F.col("ok").alias("cited")))


@query("abstention", "select conv_id, turn, " + " or ".join(f"contains(n, '{c}')" for c in T.ABSTENTION_CUES).join(("case when ", " then true when n <> '' then false end")) + f" as abstains from (select conv_id, turn, {joined('text')} as n from conversations)")
def abstention(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.abstains("text").alias("abstains"))


@query("judge_usage", f"with {support_sql()} select case when supported then 'entailed' else 'undecided' end as verdict, count(*) as n from support group by 1")
def judge_usage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("premise"))
    gold = passages(spark, sf_dir).select("query_id", F.col("text").alias("hypothesis"))
    pairs = bm25_documents(spark, sf_dir, docs).join(gold, "query_id")
    judged = evidence.judged_once(pairs, evidence.rule_judge)
    return judged.groupBy(F.coalesce("verdict", F.lit("undecided")).alias("verdict")).agg(F.count("*").alias("n"))


@query("micro_macro", """
with r as (select lang as category, 'quality' as metric, quality::double as v from documents left join labels using (doc_id)),
c as (select metric, category, avg(v) as m, sum(v) as s, count(v) as n, count(*) - count(v) as g from r group by all)
select metric, round(sum(s) / nullif(sum(n), 0), 9) as micro, round(avg(m), 9) as macro, sum(n)::bigint as n, 0::bigint as not_applicable, sum(g)::bigint as unavailable from c group by metric""")  # fmt: skip
def micro_macro(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    records = rows.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("category"), F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value"), F.lit(None).cast("string").alias("status"))
    out = metrics.micro_macro(records)
    return out.select("metric", F.round("micro", 9).alias("micro"), F.round("macro", 9).alias("macro"), "n", "not_applicable", "unavailable")


@query("percentiles", """
select event_type, round(quantile_cont(value, 0.95), 6) as linear, round((list_sort(list(value) filter (value is not null)))[least(floor(count(value) * 95 / 100.0), count(value) - 1)::int + 1], 6) as truncated
from events group by event_type""")  # fmt: skip
def percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value is not null")
    return events.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.95)), 6).alias("linear"), F.round(metrics.percentile_truncated(F.col("value"), 95), 6).alias("truncated"))


@query("stage_latency", """
with s as (select event_type as stage, count(value) as n, avg(value) as mean, min(value) as low, max(value) as high, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95, sum(value) as total from events group by 1)
select stage, n, round(mean, 6) as mean, low, high, round(p50, 6) as p50, round(p90, 6) as p90, round(p95, 6) as p95, round(total / sum(total) over (), 6) as share from s""")  # fmt: skip
def stage_latency(spark, sf_dir):
    stages = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    out = metrics.stage_latencies(stages)
    return out.select("stage", "n", F.round("mean", 6).alias("mean"), "low", "high", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "share")))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("lang").alias("metric"), F.col("doc_id").alias("question_id"), F.col("quality").cast("double").alias("value"))
    return metrics.bootstrap_intervals(rows)


GATED = ("hit_at_3", "mrr", "groundedness", "critical_contradictions", "rubric")


@query("quality_gates", f"""
with {LINES}, g as (select * from {values(list(metrics.GATES), 'gate, bound, more')}), v as (select {literal(GATED)}[q % 5 + 1] as gate, avg(p % 11) / 10 as value from k group by 1)
select gate, bound::double as bound, coalesce(value, 0)::double as value, case when more then coalesce(value, 0) >= bound else coalesce(value, 0) <= bound end as passed from g left join v using (gate)""")  # fmt: skip
def quality_gates(spark, sf_dir):
    """Gates on means over all lines."""
    gate = F.get(F.array(*map(F.lit, GATED)), (F.col("q") % 5).cast("int")).alias("gate")
    return metrics.quality_gates(order_lines(spark, sf_dir).groupBy(gate).agg((F.avg(F.col("p") % 11) / 10).alias("value")))


TURNS = r"""
t as (select conv_id, turn, text, lead(text) over w as answer, lead(role) over w as r, role from conversations window w as (partition by conv_id order by turn)),
p as (select conv_id, turn, text as question, answer from t where role = 'user' and r = 'assistant')"""
PLAIN = r"list_filter(list_distinct(regexp_split_to_array(translate(lower({0}), ',.?', '   '), '\s+')), lambda w: length(w) > 2)"


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return turns.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("overlap_scores", f"""
with {TURNS.strip()}, s as (select conv_id, turn, {PLAIN.replace('{0}', 'question')} as q, {PLAIN.replace('{0}', 'answer')} as a from p)
select conv_id, turn, round(least(1.0, 1.5 * coalesce(len(list_intersect(a, q)) / nullif(len(a), 0)::double, 0)), 9) as faithfulness,
  round(least(1.0, 1.4 * coalesce(len(list_intersect(q, a)) / nullif(len(q), 0)::double, 0)), 9) as answer_relevancy from s""")  # fmt: skip
def overlap_scores(spark, sf_dir):
    s = metrics.overlap_scores(F.col("question"), F.col("answer"), F.col("question"), F.col("answer"))
    return exchanges(spark, sf_dir).select("conv_id", "turn", *(F.round(s[c], 9).alias(c) for c in ("faithfulness", "answer_relevancy")))


STOP = literal(list(metrics.STOPWORDS))
CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower({{0}}), '{WORDS}')), lambda w: length(w) > 1 and not list_contains({STOP}, w))"


@query("rubric", f"""
with {TURNS.strip()}, s as (select conv_id, turn, {CONTENT.replace('{0}', 'question')} as q, {CONTENT.replace('{0}', 'question')} as r, list_distinct(regexp_extract_all(lower(answer), '{WORDS}')) as a, answer from p),
c as (select conv_id, turn, answer, coalesce(len(list_intersect(q, a)) / nullif(len(q), 0)::double, 1.0) as q, coalesce(len(list_intersect(r, a)) / nullif(len(r), 0)::double, 1.0) as r from s)
select conv_id, turn, case when trim(answer) = '' then 1 when r >= 0.7 and q >= 0.6 then 5 when r >= 0.5 and q >= 0.5 then 4 when r >= 0.3 or q >= 0.4 then 3 when r >= 0.15 then 2 else 1 end as score from c""")  # fmt: skip
def rubric(spark, sf_dir):
    return exchanges(spark, sf_dir).select("conv_id", "turn", metrics.rubric(F.col("question"), F.col("answer"), F.col("question")).alias("score"))


@query("claim_groundedness", f"""
with {TURNS.strip()}, s as (select conv_id, turn, {CONTENT.replace('{0}', 'question')} as w, lower(answer) as c, regexp_extract_all(lower(question), '[0-9]+(?:[.,][0-9]+)?\\s*(?:mg|ml|g|kg|lít|%)') as d from p)
select conv_id, turn, case when len(list_filter(d, lambda x: not contains(c, x))) > 0 then 'CONTRADICTED' when coalesce(len(list_filter(w, lambda x: contains(c, x))) / nullif(len(w), 0)::double, 0) >= 0.6 then 'SUPPORTED' else 'UNSUPPORTED' end as status from s""")  # fmt: skip
def claim_groundedness(spark, sf_dir):
    return exchanges(spark, sf_dir).select("conv_id", "turn", metrics.claim_grounded(F.col("question"), F.col("answer")).alias("status"))


# ---------------------------------------------------------------- splitters


@query("section_chunks", f"""with {LINES} select o || '.md_c' || (k - o % 2) as chunk_id, 'Chương ' || coalesce(max(case when q % 3 = 0 then k end) over (partition by o order by k), 0) as chapter,
  'Điều ' || k || '. Phần ' || p as article, 1 as part, 1 as total_parts, o % 9999 || '/2020/NĐ-CP' as doc_code, case when o % 2 = 0 then 'còn hiệu lực' else 'Không rõ' end as status from k
  union all select distinct o || '.md_c0', 'Mở đầu / Căn cứ ban hành', 'Thông tin chung', 1, 1, o % 9999 || '/2020/NĐ-CP', 'còn hiệu lực' from k where o % 2 = 0""")  # fmt: skip
def section_chunks(spark, sf_dir):
    """Every order as a decree with an article a line and a chapter before some."""
    head = "concat('# Nghị định ', o % 9999, '/2020/NĐ-CP\n', if(o % 2 = 0, 'Tình trạng: còn hiệu lực\n', ''), '## Chương 0\n')"
    line = "concat(if(q % 3 = 0, concat('## Chương ', k, '\n'), ''), '#### Điều ', k, '. Phần ', p, '\nNội dung ', s)"
    docs = order_texts(spark, sf_dir, head, line).select(F.concat("o", F.lit(".md")).alias("source"), "text")
    return splitters.section_chunks(docs).select("chunk_id", "chapter", "article", "part", "total_parts", "doc_code", "status")


@query("section_chunks_documents", "select source, count(*) as n_chunks from documents where trim(text) <> '' group by source having count(*) > 0")
def section_chunks_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("key", F.concat_ws("/", "source", "doc_id"))
    chunks = splitters.section_chunks(docs.select(F.col("key").alias("source"), "text"), splitters.SectionOptions(limit=10_000_000))
    return chunks.groupBy(F.substring_index("source", "/", 1).alias("source")).agg(F.count("*").alias("n_chunks"))


@query("section_chunks_sized")
def section_chunks_sized(spark, sf_dir):
    """Every document in chunks of the production size, with a digest of each."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("source"), "text")
    return splitters.section_chunks(docs).select("chunk_id", "part", "total_parts", F.length("content").alias("size"), F.md5("content").alias("digest"))


@query("structural_split", f"""
with {LINES}, line as (select o, 0::bigint as k, 'lead' as kind, null::varchar as mark, length('Lời dẫn ' || o) as size from (select distinct o from k)
  union all select o, k, case when q < 25 then 'clause' else 'point' end, case when q < 25 then k::varchar else chr((97 + p % 20)::int) end, length(case when q < 25 then k || '. Khoản ' else 'a) Điểm ' end) + q % 25 from k),
c as (select *, sum(size + 1) over (partition by o) - 1 > 110 as over, greatest(count(*) filter (kind = 'clause') over (partition by o order by k), least(1, count(*) filter (kind = 'clause') over (partition by o))) as c from line),
b as (select *, case when over then c else 0 end as block from c),
d as (select *, over and sum(size + 1) over (partition by o, block) - 1 > 110 as fine from b),
u as (select *, case when fine then greatest(count(*) filter (kind = 'point') over (partition by o, block order by k), least(1, count(*) filter (kind = 'point') over (partition by o, block))) else 0 end as unit,
  max(case when over and kind = 'clause' then mark end) over (partition by o, block) as clause from d)
select o, (row_number() over (partition by o order by block, unit) - 1)::int as split_index, max(clause) as clause_no,
  max(mark) filter (fine and kind = 'point') as point_no, 5 as article_no, (sum(size + 1) - 1)::int as size from u group by o, block, unit""")  # fmt: skip
def structural_split(spark, sf_dir):
    """Every order as an article whose lines are clauses and points."""
    line = "concat(if(q < 25, concat(k, '. Khoản '), concat(char(97 + p % 20), ') Điểm ')), repeat('x', int(q % 25)))"
    docs = order_texts(spark, sf_dir, "concat('Lời dẫn ', o, '\n')", line)
    rows = docs.select(F.col("o").cast("string").alias("id"), F.lit("Chương I / Điều 5").alias("name"), F.col("text").alias("content"), F.lit("Text").alias("type"), F.col("o").cast("string").alias("source_path"))
    parts = splitters.structural_split(rows, 110)
    return parts.select(F.col("source_path").cast("long").alias("o"), "split_index", "clause_no", "point_no", "article_no", F.length("content").alias("size"))


@query("length_split_documents", "select doc_id, md5(text) as digest, true as short from documents where trim(text, chr(10) || ' ') <> ''")
def length_split_documents(spark, sf_dir):
    """Lossless: the pieces of every document join to its text, and none is over the limit."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("name"), F.col("text").alias("content"), F.lit("Text").alias("type"), F.lit("").alias("source_path"))
    parts = splitters.structural_split(rows.withColumn("name", F.concat_ws("|", "name", "id")), 1000)
    listed = parts.groupBy(F.element_at(F.split("name", "[|/]"), 2).alias("k")).agg(F.array_sort(F.collect_list(F.struct("split_index", "content"))).alias("p"), F.max(F.length("content")).alias("most"))
    return listed.select(F.trim("k").cast("long").alias("doc_id"), F.md5(F.array_join(F.transform("p", lambda x: x["content"]), "")).alias("digest"), (F.col("most") <= 1000).alias("short"))


@query("table_split", f"with {LINES} select o, ((k - 1) // 3)::int as split_index, count(*) as n_rows, sum(p) as parts from k group by all")
def table_split(spark, sf_dir):
    """Every order as a table, three rows of 20 characters a part."""
    docs = order_texts(spark, sf_dir, "'Bảng giá\n| a | b |\n|---|---|\n'", "concat('| ', lpad(p, 9, '0'), ' | 5.00 |')")
    rows = docs.select(F.col("o").cast("string").alias("id"), F.lit("Bảng").alias("name"), F.concat("text", F.lit("\nHết")).alias("content"), F.lit("Table").alias("type"), F.col("o").cast("string").alias("source_path"))
    numbers = F.regexp_extract_all("content", F.lit(r"\| (\d{9}) \|"), F.lit(1))
    parts = splitters.structural_split(rows, 33 + 3 * 21).select(F.col("source_path").cast("long").alias("o"), "split_index", numbers.alias("n"))
    return parts.select("o", "split_index", F.size("n").cast("long").alias("n_rows"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("parts"))


@query("heading_tree", f"""
with {LINES}, h as (select *, case when q % 3 = 0 then 'Mục ' || k end as section, last_value(case when q % 3 = 0 then 'Mục ' || k end ignore nulls) over (partition by o order by k) as open from k)
select 'Văn bản ' || o as name, 'Text' as type, 1 as level from (select distinct o from k) union all
select concat_ws(' / ', 'Văn bản ' || o, open, case when section is null then 'Điều ' || k end), 'Text', case when section is null then 3 else 2 end from h union all
select concat_ws(' / ', 'Văn bản ' || o, open, case when section is null then 'Điều ' || k end), 'Table', case when section is null then 3 else 2 end from h where p % 2 = 0""")  # fmt: skip
def heading_tree(spark, sf_dir):
    """Every order as a document with sections, articles and tables."""
    line = "concat(if(q % 3 = 0, concat('## Mục ', k), concat('### Điều ', k)), '\nNội dung', if(p % 2 = 0, '\n| a |\n|---|\n| 5.000 |', ''))"
    docs = order_texts(spark, sf_dir, "concat('# Văn bản ', o, '\n')", line).select(F.col("o").cast("string").alias("source"), "text")
    return splitters.heading_tree(docs).select("name", "type", "level")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines as items of lists: a line's length tells its level, whether it has a number, and which; blank lines stay."""
    item = lambda x: F.concat(F.repeat(F.lit("    "), F.pmod(F.length(x), F.lit(4))), F.when(F.length(x) % 3 == 0, "- ").otherwise(F.concat((F.length(x) % 7).cast("string"), F.lit(". "))), F.lit("x"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) == 0, "").otherwise(item(x)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.array_join(lines, "\n").alias("text"))


# The nearest item before on each of three levels; the parent is the nearest of those that are less deep.
LISTED = """l as (select doc_id as source, unnest(range(len(a)))::int as line_no, unnest(list_transform(a, lambda x: length(x))) as n from (select doc_id, string_split(text, chr(10)) as a from documents)),
i as (select *, n % 4 as level, case when n % 3 > 0 then (n % 7)::bigint end as number from l where n > 0),
w as (select *, last_value(case when level = 0 then line_no end ignore nulls) over b as l0, last_value(case when level <= 1 then line_no end ignore nulls) over b as l1,
 last_value(case when level <= 2 then line_no end ignore nulls) over b as l2 from i window b as (partition by source order by line_no rows between unbounded preceding and 1 preceding)),
t as (select source, line_no, case level when 1 then l0 when 2 then l1 when 3 then l2 end as parent, number, number is not null as ordered from w)"""


@query("list_items", f"""with recursive {LISTED}, r as (select source, line_no, 0 as depth from t where parent is null union all select t.source, t.line_no, r.depth + 1 from r join t on t.source = r.source and t.parent = r.line_no)
select source, line_no, parent, depth, ordered, number from t join r using (source, line_no)""")  # fmt: skip
def list_items(spark, sf_dir):
    """Every line of every document at its place in a tree of lists."""
    return lists.list_items(listed(spark, sf_dir)).drop("text")


@query("list_ordinals", f"""with {LISTED}, o as (select *, lag(number) over (partition by source, parent order by line_no) as last from t where ordered)
select source, line_no, number, last + 1 as expected, case when number = last then 'repeated' when number < last then 'back' else 'gap' end as fault from o where number <> last + 1""")  # fmt: skip
def list_ordinals(spark, sf_dir):
    """Numbers of the source that don't go on from the one before."""
    return lists.ordinal_faults(lists.list_items(listed(spark, sf_dir)))


@query("article_headings", f"with {LINES} select o, ((k + 1) // 2)::int as article_no, 'Điều ' || (k + 1) // 2 || '. Phần ' || p as title from k where k % 2 = 1")
def article_headings(spark, sf_dir):
    """Every number comes twice, and once before that within a form; only the first one outside counts."""
    number = "concat('Điều ', (k + 1) div 2, '. ')"
    line = f"concat(if(k % 2 = 1, concat('## Phụ lục\n### ', {number}, 'Mẫu\n'), ''), '## ', {number}, 'Phần ', p)"
    docs = order_texts(spark, sf_dir, "'# Luật\n'", line).select(F.col("o").cast("string").alias("source"), "text")
    return splitters.article_headings(docs).select(F.col("source").cast("long").alias("o"), "article_no", "title")


@query("article_units", f"""
with {LINES}, m as (select o, k, case when q % 3 = 0 then k::varchar end as clause, case when q % 3 = 1 then chr((97 + p % 20)::int) end as point from k),
g as (select *, count(clause) over (partition by o order by k) as c from m)
select o, k::int as line_no, last_value(clause ignore nulls) over (partition by o order by k) as clause_no, last_value(point ignore nulls) over (partition by o, c order by k) as point_no from g
union all select o, 0, null, null from (select distinct o from k)""")  # fmt: skip
def article_units(spark, sf_dir):
    """Every order as an article: clauses, points and lines that go on."""
    line = "concat(case q % 3 when 0 then concat(k, '. ') when 1 then concat(char(97 + p % 20), ') ') else '' end, 'nội dung')"
    rows = order_texts(spark, sf_dir, "'Lời dẫn\n'", line).select(F.col("o").cast("string").alias("source"), F.lit(1).alias("article_no"), "text")
    return splitters.article_units(rows).select(F.col("source").cast("long").alias("o"), "line_no", "clause_no", "point_no")


@query("citations", f"""
with {LINES}, c as (select o, k, case q % 4 when 0 then s % 900 + 1 || '/2020/NĐ-CP' when 2 then s % 900 + 1 || '/2019/QH14' end as d, case when q % 4 < 3 then (p % 50 + 1)::varchar end as a,
  case when q % 4 > 0 then k::varchar end as c, case q % 4 when 2 then 'b' when 3 then 'a' end as p from k),
i as (select o, k, last_value(d ignore nulls) over (partition by o order by k) as d, a, c, p from c),
f as (select o, min(k) as k, d, a, c, p from i where d is not null or a is not null group by o, d, a, c, p)
select o as answer_id, (row_number() over (partition by o order by k) - 1)::int as n, d as document_id, a as article, c as clause, p as point from f""")  # fmt: skip
def citations(spark, sf_dir):
    """Every order as an answer that cites a place a line, some without their document."""
    article, decree, law = "concat('Điều ', p % 50 + 1)", "concat('Nghị định ', s % 900 + 1, '/2020/NĐ-CP')", "concat('Luật số ', s % 900 + 1, '/2019/QH14')"
    line = f"case q % 4 when 0 then concat({article}, ' của ', {decree}) when 1 then concat('khoản ', k, ' ', {article}) when 2 then concat('điểm b khoản ', k, ', ', {article}, ' <reference id=1></reference> ', {law}) else concat('Điểm a Khoản ', k) end"
    return splitters.citations(order_texts(spark, sf_dir, "''", line, ". Nêu rõ ").select(F.col("o").alias("answer_id"), "text"))


# ---------------------------------------------------------------- graph


def metadata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of orders as laws: some replace the one before, some carry out an older law, some name themselves."""
    number = "concat({0}, '/2020/QH14')"
    listed = lambda test, item: F.expr(f"if({test}, array({item}), array())").cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(
        F.concat("o_orderkey", F.lit(".json")).alias("file"), F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("Luật "), "o_orderkey").alias("title"),
        F.expr(number.format("o_orderkey")).alias("doc_number"), F.lit("Luật").alias("doc_type"), listed("o_custkey % 3 = 0", number.format("o_orderkey - 1")).alias("supersedes"),
        listed("o_custkey % 7 = 0", number.format("o_orderkey")).alias("amends"), listed("o_custkey % 5 = 0", number.format("o_orderkey + 1")).alias("superseded_by"),
        listed("o_custkey % 4 = 0", "concat(o_custkey, '/1990/QH8')").alias("implements"),
    )
    for c in ("amended_by", "implemented_by"):
        rows = rows.withColumn(c, F.array().cast("array<string>"))
    for c in ("issuing_body", "date_effective", "date_issued", "date_expired", "status", "source_url"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return graph.metadata_graph(graph.first_metadata(rows))


LAWS = """
d as (select distinct o_orderkey as o, o_custkey as c from orders),
pair as (select o as a, o - 1 as b from d where c % 3 = 0 union select o + 1, o from d where c % 5 = 0),
law as (select n, case when n in (select o from d) then 'luật ' else '' end || n || ' 2020 qh14' as id, case when n in (select o from d) then 'Luật ' else '' end || n || '/2020/QH14' as name
  from (select a as n from pair union select b from pair union select o from d)),
edge as (select x.id as src, unnest(['supersedes', 'supersededBy']) as label, y.id as dst from pair join law x on x.n = a join law y on y.n = b),
edges as (select case when label = 'supersedes' then src else dst end as src, label, case when label = 'supersedes' then dst else src end as dst from edge
  union select 'luật ' || o || ' 2020 qh14', 'implementsDoc', c || ' 1990 qh8' from d where c % 4 = 0),
node as (select id, name from law union select c || ' 1990 qh8', c || '/1990/QH8' from d where c % 4 = 0)"""


@query("metadata_edges", f"with {LAWS} select src, label, dst from edges")
def metadata_edges(spark, sf_dir):
    return metadata(spark, sf_dir)[1]


@query("metadata_nodes", f"with {LAWS} select id, name from node")
def metadata_nodes(spark, sf_dir):
    return metadata(spark, sf_dir)[0].select("id", "name")


@query("graph_fingerprint", f"with {LAWS} select 'node' as kind, 'LegalDocument' as label, count(*) as n from node union all select 'edge', label, count(*) from edges group by label")
def graph_fingerprint(spark, sf_dir):
    return graph.fingerprint(*metadata(spark, sf_dir))


@query("relation_contract", f"""with {LINES} select o, k, case q % 7 when 2 then 'INVALID_ENDPOINT_TYPES' when 3 then 'UNKNOWN_PREDICATE' when 4 then 'UNRESOLVED_ENDPOINT' when 5 then 'AMBIGUOUS_BINDING' else 'ACCEPTED' end as status from k""")
def relation_contract(spark, sf_dir):
    """Every line as a triple within its order; spellings differ, and some break a rule."""
    lines = order_lines(spark, sf_dir).withColumn("chunk_id", F.col("o").cast("string"))
    article, fine = "concat('Điều ', k)", "concat('Phạt tiền ', k)"
    triples = lines.select(
        "o", "k", "chunk_id", F.expr(f"case when q % 7 = 1 then lower({article}) when q % 7 in (2, 5) then {fine} else {article} end").alias("subject"),
        F.expr("case q % 7 when 1 then 'Quy định  chế tài' when 3 then 'likes' when 5 then 'enforcedBy' when 6 then 'belongsTo' else 'imposes' end").alias("predicate"),
        F.expr(f"case q % 7 when 2 then {article} when 4 then concat('Ai đó ', k) when 5 then 'Cơ quan' when 6 then 'Luật X' else {fine} end").alias("object"),
    )
    both = F.explode(F.array(F.struct(F.expr(article).alias("name"), F.lit("Article").alias("label")), F.struct(F.expr(fine).alias("name"), F.lit("Sanction").alias("label"))))
    once = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(x).alias("label")) for n, x in (("Cơ quan", "Authority"), ("Cơ quan", "RegulatedEntity"), ("Luật X", "LegalDocument")))))
    entities = lines.select("chunk_id", both.alias("e")).unionByName(lines.select("chunk_id").distinct().select("chunk_id", once.alias("e"))).select("chunk_id", "e.name", "e.label")
    checked = graph.checked_triples(triples.select("chunk_id", "subject", "predicate", "object"), entities).select("chunk_id", "subject", "predicate", "object", "status")
    return triples.join(checked.distinct(), ["chunk_id", "subject", "predicate", "object"]).select("o", F.col("k").cast("long").alias("k"), "status")


@query("same_unit_ambiguity", f"with {LINES} select o, k, q % 3 > 0 and count(*) over (partition by o, q % 3, p % 3) > 1 as ambiguous from k")
def same_unit_ambiguity(spark, sf_dir):
    """Names of every order that share a target; authorities may."""
    rows = order_lines(spark, sf_dir).select("o", "k", F.col("o").cast("string").alias("chunk_id"), F.expr("case q % 3 when 0 then 'Authority' when 1 then 'Sanction' else 'LegalTerm' end").alias("category"), F.col("k").cast("string").alias("name"), F.expr("string(p % 3)").alias("target"))
    return graph.downgraded(rows).select("o", F.col("k").cast("long").alias("k"), "ambiguous")


def extracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, entities and triples of orders: an order is a chunk, its lines are what a model says of it.

    Fines have one of three names and of five places in the source, or none, so that names conflict and
    places are shared; things have no ids of their own.
    """
    lines = order_lines(spark, sf_dir, dealt=True)
    chunks = table(spark, sf_dir, "orders").select("o_orderkey").distinct().selectExpr(
        "string(o_orderkey) as chunk_id", "concat(o_orderkey, '.md') as source_path", "string(o_orderkey) as document_id", "if(o_orderkey % 3 = 0, null, concat('Văn bản ', o_orderkey)) as document_name",
        "if(o_orderkey % 5 = 0, null, concat('article:', o_orderkey, ':1')) as article_id", "1 as article_no", "'Điều 1' as heading",
    )
    fine, target = F.expr("concat('Phạt ', p % 3)"), F.expr("if(q % 4 = 0, null, concat('sanction:', s % 5))")
    own = [
        F.struct(F.expr("concat('Điều ', k)").alias("name"), F.lit("Article").alias("category"), F.expr("if(k = 1 and o % 5 > 0, concat('article:', o, ':1'), null)").alias("target")),
        F.struct(fine.alias("name"), F.lit("Sanction").alias("category"), target.alias("target")),
        F.struct(F.expr("if(q % 7 = 0, ' ', concat('Vật ', s % 4))").alias("name"), F.expr("if(q % 2 = 0, 'Thing', null)").alias("category"), F.lit(None).cast("string").alias("target")),
    ]
    told = lines.select("chunk_id", F.col("k").alias("position"), F.explode(F.array(*own)).alias("e")).select("chunk_id", "position", "e.*")
    laws = lines.filter("q % 5 = 1").selectExpr("chunk_id", "k as position", "concat('Luật ', p % 2) as name", "'LegalDocument' as category", "string(null) as target")
    labels = spark.createDataFrame([(x,) for x in ("Article", "Sanction", "LegalDocument")], "label string")
    entities = assembly.cleaned_entities(told, laws, labels)
    triples = lines.select(
        "chunk_id", F.expr("if(q % 7 = 4, null, concat('Điều ', k))").alias("subject"),
        F.expr("case q % 7 when 1 then 'likes' when 3 then 'Thuộc  văn bản' when 5 then 'enforcedBy' else 'Quy định chế tài' end").alias("predicate"),
        F.expr("case q % 7 when 3 then concat('Luật ', p % 2) when 6 then 'Ai đó' else concat('PHẠT ', p % 3) end").alias("object"),
    )
    return chunks, entities, triples


# Entities as (o, category, key, id, reason) from the numbers of the lines.
EXTRACTS = f"""{LINES}, f as (select o, 'phạt ' || p % 3 as key, case when q % 4 > 0 then 'sanction:' || s % 5 end as target, k from k),
 g as (select o, key, min(target) as least, count(distinct target) as kinds, count(target) as given, count(*) as n, arg_min(coalesce(target, ''), k) as first from f group by all),
 h as (select *, count(*) over (partition by o, first) as sharing from g),
 fines as (select o, 'Sanction' as category, key, case when given = 0 then 'no target' when kinds > 1 or given < n then 'conflict' when sharing > 1 then 'shared' else 'target' end as reason, least from h),
 e as (select o, category, key, case when reason = 'target' then least else 'sanction-unresolved:' || substr(sha256(o || chr(31) || key), 1, 16) end as id, reason from fines union all
  select o, 'Article', 'điều ' || k, case when k = 1 and o % 5 > 0 then 'article:' || o || ':1' else 'article-unresolved:' || substr(sha256(o || chr(31) || 'điều ' || k), 1, 16) end, case when k = 1 and o % 5 > 0 then 'target' else 'no target' end from k union all
  select distinct o, 'Others', 'vật ' || s % 4, 'vật ' || s % 4, 'name' from k where q % 7 > 0 union all
  select distinct o, 'LegalDocument', 'luật ' || p % 2, 'luật ' || p % 2, 'name' from k where q % 5 = 1),
 t as (select k.*, case q % 7 when 1 then 'UNKNOWN_PREDICATE' when 4 then 'MALFORMED' when 5 then 'INVALID_ENDPOINT_TYPES' when 6 then 'UNRESOLVED_ENDPOINT' when 3 then case when l.key is null then 'UNRESOLVED_ENDPOINT' else 'ACCEPTED' end else 'ACCEPTED' end as status,
  a.id as s_id, case when q % 7 = 3 then l.id else b.id end as o_id
  from k join e a on a.o = k.o and a.key = 'điều ' || k.k join e b on b.o = k.o and b.key = 'phạt ' || p % 3 left join e l on l.o = k.o and l.key = 'luật ' || p % 2),
 c as (select o_orderkey as o, case when o_orderkey % 5 > 0 then 'article:' || o_orderkey || ':1' end as a, case when o_orderkey % 3 > 0 then 'văn bản ' || o_orderkey end as d from (select distinct o_orderkey from orders)),
 held as (select * from c where a is not null and d is not null and not exists (select 1 from t where t.o = c.o and t.s_id = c.a and t.q % 7 = 3 and t.status = 'ACCEPTED'))"""


@query("extracted_identities", f"with {EXTRACTS} select o::varchar as chunk_id, category, key, id, reason from e")
def extracted_identities(spark, sf_dir):
    """The one id of every name that a chunk's extraction has, and why it is that one."""
    return assembly.identities(extracts(spark, sf_dir)[1]).select("chunk_id", "category", "key", "id", "reason")


@query("assembled_graph", f"""with {EXTRACTS}
select 'node' as outcome, o::varchar as chunk_id, id as src, category as src_label, null as relation, null as dst, null as dst_label, null as status from e union all
select 'edge', o::varchar, id, category, 'source', o::varchar, 'Chunk', 'SYSTEM' from (select distinct o, id, category from e) union all
select 'node', o::varchar, o::varchar, 'Chunk', null, null, null, null from c union all
select 'node', o::varchar, a, 'Article', null, null, null, null from c where a is not null union all
select 'node', o::varchar, d, 'LegalDocument', null, null, null, null from held union all
select 'edge', o::varchar, a, 'Article', 'belongsTo', d, 'LegalDocument', 'STRUCTURAL' from held union all
select case status when 'ACCEPTED' then 'edge' else 'reject' end, o::varchar, case status when 'ACCEPTED' then s_id end, case when q % 7 <> 4 then 'Article' end,
 case q % 7 when 1 then null when 3 then 'belongsTo' when 5 then 'enforcedBy' else 'imposes' end, case status when 'ACCEPTED' then o_id end,
 case when q % 7 = 3 then case when status = 'ACCEPTED' then 'LegalDocument' end when q % 7 <> 6 then 'Sanction' end, status from t""")  # fmt: skip
def assembled_graph(spark, sf_dir):
    """Nodes, edges and rejects of every order, with the same ids on nodes and on both ends of edges."""
    return assembly.assembled(*extracts(spark, sf_dir)).drop("properties")


@query("authority_identities", f"""
with {LINES} select o, k, case when q % 6 = 0 then 'authority:bộ công an ' || p when q % 6 = 5 then 'authority:chính phủ' end as id,
  case q % 6 when 1 then 'title of a person' when 2 then 'part of another body' when 3 then 'general name' when 4 then 'no kind of body' else 'body' end as reason from k""")  # fmt: skip
def authority_identities(spark, sf_dir):
    """Names of bodies, persons and parts of bodies, one a line."""
    name = "case q % 6 when 0 then concat('Bộ  Công an ', p) when 1 then 'Bộ trưởng Bộ Công an' when 2 then concat('Cục ', p, ' thuộc Bộ Công an') when 3 then 'Ủy ban nhân dân' when 4 then 'Thanh tra Bộ Công an' else 'Chính phủ' end"
    rows = order_lines(spark, sf_dir).withColumn("own", graph.authority_identity(F.expr(name)))
    return rows.select("o", F.col("k").cast("long").alias("k"), "own.id", "own.reason")


@query("semantic_identities", f"""
with {LINES}, r as (select o, k, case q % 4 when 0 then 'Sanction' when 1 then 'LegalTerm' when 2 then 'Obligation' else 'Article' end as category, o::varchar as document, '3' as article_no,
  case when q % 4 in (0, 3) then k::varchar end as clause_no, case when q % 4 = 1 then 'đ' end as point_no, 'phạt ' || p as unit,
  case q % 4 when 2 then 'no single occurrence' when 3 then 'category has no ids here' when 0 then case when s % 2 = 0 then 'occurrence' else 'clause differs' end else 'occurrence' end as reason from k)
select o, k, reason, case when q_ then concat_ws(':', lower(category), document, article_no, 'k' || clause_no, 'p' || point_no,
  substr(sha256(concat_ws(chr(31), category, document, article_no, 'k' || clause_no, 'p' || point_no, unit)), 1, 16)) end as id from (select *, category in ('Sanction', 'LegalTerm') as q_ from r)""")  # fmt: skip
def semantic_identities(spark, sf_dir):
    """Entities of every line at their place in the order; hints may contradict the place."""
    rows = order_lines(spark, sf_dir).select(
        F.expr("case q % 4 when 0 then 'Sanction' when 1 then 'LegalTerm' when 2 then 'Obligation' else 'Article' end").alias("category"), F.concat_ws("/", "o", "k").alias("name"),
        F.col("o").cast("string").alias("document"), F.lit("3").alias("article_no"), F.expr("if(q % 4 in (0, 3), string(k), null)").alias("clause_no"), F.expr("if(q % 4 = 1, 'đ', null)").alias("point_no"),
        F.expr("if(q % 4 = 2, null, concat('phạt ', p))").alias("unit"), F.expr("if(q % 4 = 0, string(k + s % 2), null)").alias("hint_clause"), F.lit(None).cast("string").alias("hint_point"),
    )
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document"), F.lit("3").alias("article_no"), F.lit("Xử phạt").alias("title")).distinct()
    own = graph.semantic_identities(rows, titles)
    return own.select(F.split("name", "/")[0].cast("long").alias("o"), F.split("name", "/")[1].cast("long").alias("k"), "reason", "id")


@query("dictionary_entities", "select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def dictionary_entities(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(F.col("text").alias("name"), "item_id")
    hits = graph.contained_names(table(spark, sf_dir, "documents").select("doc_id", "text"), names.select("name").distinct())
    return hits.select("doc_id", "name").join(names, "name").select("doc_id", "item_id")


GEOGRAPHY = """
e as (select 'c' || c_custkey as src, 'in' as label, 'n' || c_nationkey as dst from customer union all select 'n' || n_nationkey, 'part', 'r' || n_regionkey from nation)"""


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nations in regions as edges."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    a = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("src"), F.lit("in").alias("label"), key("n", "c_nationkey").alias("dst"))
    return a.union(table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), F.lit("part"), key("r", "n_regionkey")))


BUILDERS = "select 'c' || c_custkey as id from customer where c_mktsegment = 'BUILDING'"


def builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id)`` of the customers of one market segment, wherever they are."""
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))


@query("one_hop", f"with {GEOGRAPHY.strip()} select src, label, dst from e where src in ({BUILDERS})")
def one_hop(spark, sf_dir):
    return graph.one_hop(builders(spark, sf_dir).distinct(), geography(spark, sf_dir))


def pagerank_sql(rounds: int) -> str:
    """Power iteration, one materialised table a round."""
    steps = ",\n".join(
        f"""s{k} as materialized (select id, sum(s) as s from (select e.dst as id, 0.85 * p.s / d.k as s from s{k - 1} p join e on e.src = p.id join d on d.src = p.id
        union all select a.id, (0.85 * (select coalesce(sum(s), 0) from s{k - 1} where id not in (select src from d)) + 0.15) * a.s from s0 a) group by id)"""
        for k in range(1, rounds + 1)
    )
    return f"""with {GEOGRAPHY.strip()}, d as (select src, count(*) as k from e group by src), nodes as (select src as id from e union select dst from e), b as ({BUILDERS}),
    s0 as materialized (select id, case when id in (select id from b) then 1.0::double / (select count(*) from b) else 0.0::double end as s from nodes),
    {steps} select id, round(s, 9) as score from s{rounds}"""


@query("pagerank", pagerank_sql(10))
def pagerank(spark, sf_dir):
    edges = geography(spark, sf_dir).select("src", "dst")
    return graph.personalized_pagerank(edges, builders(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


TRADE = """e as (select 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem union all select 'p' || l_partkey, 'o' || l_orderkey from lineitem),
d as (select src, count(*) as k from e group by src)"""
PUSH = 4e-3


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their parts as edges both ways."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey) as a", "concat('p', l_partkey) as b")
    return lines.selectExpr("a as src", "b as dst").union(lines.selectExpr("b", "a"))


def trade_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order whose id is divisible by 50 is a question that names the order itself."""
    return table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").selectExpr("o_orderkey as question", "concat('o', o_orderkey) as id").distinct()


# One row of rounds after another until no residual is over its threshold; orders without lines send theirs back to themselves.
PUSHED = f"""{TRADE}, n as (select distinct o_orderkey as question, 'o' || o_orderkey as id from orders where o_orderkey % 50 = 0),
st as (select 0 as t, question, id, coalesce(k, 0) as deg, 0.0::double as p, 1.0::double as r from n left join d on src = id union all
 select t + 1, question, id, deg, sum(p), sum(r) from (
  select t, question, id, deg, p + case when r > {PUSH} * greatest(deg, 1) then 0.15 * r else 0 end as p, case when r > {PUSH} * greatest(deg, 1) then case when deg = 0 then 0.85 * r else 0 end else r end as r from st union all
  select t, question, e.dst, d.k, 0, 0.85 * r / deg from st join e on e.src = st.id join d on d.src = e.dst where r > {PUSH} * deg)
 where exists (select 1 from st where r > {PUSH} * greatest(deg, 1)) group by all),
pushed as (select question, id, p as score, r as residual from st where t = (select max(t) from st))"""


@query("graph_push", f"with recursive {PUSHED} select question, id, round(score, 9) as score, round(residual, 9) as residual from pushed")
def graph_push(spark, sf_dir):
    """Scores of all nodes near each question, with what is left of it."""
    pushed = push.forward_push(trade(spark, sf_dir), trade_questions(spark, sf_dir), PUSH)
    return pushed.select("question", "id", F.round("score", 9).alias("score"), F.round("residual", 9).alias("residual"))


@query("graph_push_bounds", f"with recursive {PUSHED} select question, round(sum(residual), 9) as bound, round(sum(score), 9) as found from pushed group by question")
def graph_push_bounds(spark, sf_dir):
    """By how much a question's scores may be too low; what is found and what is left make one."""
    pushed = push.forward_push(trade(spark, sf_dir), trade_questions(spark, sf_dir), PUSH)
    return pushed.groupBy("question").agg(F.round(F.sum("residual"), 9).alias("bound"), F.round(F.sum("score"), 9).alias("found"))


@query("graph_merged", f"""with recursive {PUSHED},
x as (select question, e.dst as id, 1.0::double as s from n join e on e.src = n.id group by all),
f as (select question, id, round(score, 9) as s from pushed where id[1] = 'p' and round(score, 9) > 0),
v as (select n.question, 'p' || b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as s from n join embeddings a on a.vec_id = n.question join embeddings b on true),
c as (select *, row_number() over (partition by o, question order by s desc, id) as r from (select 0 as o, * from x union all select 1, * from f union all select 2, question, id, s from v where s >= 0.65) qualify r <= 20),
m as (select question, id, round(sum(1.0::double / (60 + r)), 12) as score, min(o) as first, min([o, r]) as seen from c group by question, id)
select question, id, score, row_number() over (partition by question order by score desc, seen, id) as rank, case first when 0 then 'exact' when 1 then 'push' else 'vector' end as first from m qualify rank <= 20""")  # fmt: skip
def graph_merged(spark, sf_dir):
    """Parts for each question: its own, those near it in the graph, and those whose vectors are near its own."""
    edges, asked = trade(spark, sf_dir), trade_questions(spark, sf_dir)
    exact = graph.one_hop(asked, edges.withColumn("label", F.lit("part"))).join(asked, F.col("src") == asked["id"]).select("question", F.col("dst").alias("id"), F.lit(1.0).alias("score"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    own = vectors.join(asked, F.col("doc_id") == F.col("question")).select(F.col("question").alias("query_id"), F.col("v").alias("q"))
    near = ranking.dense_search(vectors, own, 20).select(F.col("query_id").alias("question"), F.concat(F.lit("p"), F.col("doc_id")).alias("id"), "score")
    pushed = push.forward_push(edges, asked, PUSH).withColumn("score", F.round("score", 9))
    return push.merged(exact, pushed, near, wanted=F.startswith("id", F.lit("p")))


@query("entity_link", """
with n as (select vec_id as q, embedding::double[] as v from embeddings), s as (select q, vec_id, round(list_cosine_similarity(v, embedding::double[]), 9) as s from n, embeddings where label <> 3)
select q as query_id, vec_id as doc_id from s where s >= 0.4 qualify row_number() over (partition by q order by s desc, vec_id) = 1""")  # fmt: skip
def entity_link(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")
    names = vectors.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    return graph_link(names, vectors.withColumn("label", F.col("label").cast("string"))).select("query_id", "doc_id")


def graph_link(names: DataFrame, vectors: DataFrame) -> DataFrame:
    return ranking.link_entities(names, vectors, 0.4, ("3",))


# ---------------------------------------------------------------- runs


@query("pending_work", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_work(spark, sf_dir):
    return corpus.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("resume_faults", "select doc_id, 'duplicate' as fault from labels group by doc_id having count(*) > 1 union all select doc_id, 'foreign system' from labels where toxic = 1 union all select doc_id, 'unknown' from labels where doc_id not in (select doc_id from documents)")
def resume_faults(spark, sf_dir):
    done = table(spark, sf_dir, "labels").withColumn("system", F.when(F.col("toxic") == 1, "other").otherwise("own"))
    return corpus.resume_faults(done, table(spark, sf_dir, "documents"), "doc_id", "own")


FAIL = "hash"


@query("failure_runs", """
with e as (select event_type as key, event_id, value < 30 as failed from events),
i as (select *, sum((not failed)::int) over (partition by key order by event_id) as island from e),
r as (select key, island, count(*) as n from i where failed group by all)
select key, max(n) as longest from r group by key""")  # fmt: skip
def failure_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", "value")
    return runs.failure_runs(events, F.coalesce(F.col("value") < 30, F.lit(False)), ("event_id",))


@query("breaker", """
with e as (select event_type as key, row_number() over (partition by event_type order by event_id) as n, coalesce(value < 60, false) as failed from events),
i as (select *, sum((not failed)::int) over (partition by key order by n) as island from e),
r as (select key, n, failed, count(*) filter (failed) over (partition by key, island order by n) as run from i)
select key, min(n)::int as call from r where failed and run >= 12 group by key""")  # fmt: skip
def breaker(spark, sf_dir):
    """The call at which each type of event would be cut off."""
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", F.coalesce(F.col("value") < 60, F.lit(False)).alias("failed"))
    return runs.breaker(calls, F.col("failed"), ("event_id",)).select("key", F.col("call").cast("int").alias("call"))


@query("event_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_tumbling(spark, sf_dir):
    return runs.tumbling(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sliding", "with s as (select time_bucket(interval 1 hour, ts) - to_hours(k) as start, event_type from events, (values (0), (1)) h(k)) select start, event_type, count(*) as n from s group by all")
def event_sliding(spark, sf_dir):
    return runs.sliding(table(spark, sf_dir, "events")).select("start", "event_type", "n")


@query("event_sessions", """
with g as (select user_id, ts, case when ts - lag(ts) over w >= interval 30 minutes or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select min(ts) as start, user_id, count(*) as n from s group by user_id, k""")  # fmt: skip
def event_sessions(spark, sf_dir):
    return runs.sessions(table(spark, sf_dir, "events")).select("start", "user_id", "n")


# ---------------------------------------------------------------- index job, evaluation, replies, dumps

KEPT_DOCS = "(select * from documents where coalesce(lang, '') <> 'fr')"


@query("index_upserts", f"with {bm25_sql().strip().replace('from documents', 'from ' + KEPT_DOCS)} select query_id, doc_id, round(score, 6) as score, rank from bm")
def index_upserts(spark, sf_dir):
    """An index in three batches: all documents, English ones first with a stale text; those again as they are; French ones taken away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    path = work_dir(spark, "index")
    segments.append(docs.withColumn("text", F.when(english, F.concat_ws(" ", "lang", "lang", F.substring("text", 1, 40))).otherwise(F.col("text"))), path, 0)
    segments.append(docs.filter(english), path, 1)
    segments.append(docs.limit(0), path, 2, gone=docs.filter("lang = 'fr'").select("doc_id"))
    hits = bm25.search(segments.load(spark, path), passages(spark, sf_dir), 10)
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as items and quality labels as a system's outputs, side by side."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    outputs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return evaluation.states(items, outputs, "id")


EVALUATED = """e as (select coalesce(v.vec_id, l.doc_id) as id, quality, toxic,
  case when v.vec_id is null then 'unknown' when l.doc_id is null then 'missing' else 'matched' end as state from embeddings v full join labels l on v.vec_id = l.doc_id)"""


@query("evaluation_states", f"with {EVALUATED} select id, state from e")
def evaluation_states(spark, sf_dir):
    return labelled_vectors(spark, sf_dir).select("id", "state")


@query("evaluation_report", f"""with {EVALUATED}, m as (select 'quality' as metric, state, quality as v from e union all select 'toxic', state, toxic from e)
select 'labels' as system, metric, round(avg(v) filter (state = 'matched'), 9) as mean, count(v) filter (state = 'matched') as n, count(*) filter (state = 'matched' and v is null) as not_available,
  count(*) filter (state = 'missing') as missing, count(*) filter (state = 'unknown') as unknown from m group by metric""")  # fmt: skip
def evaluation_report(spark, sf_dir):
    rows = evaluation.report(labelled_vectors(spark, sf_dir).withColumn("system", F.lit("labels")), ["quality", "toxic"])
    return rows.drop("json").withColumn("mean", F.round("mean", 9))


CASES = f"""cases as (
  select o.conv_id, o.turn, o.answer_relevancy as mrr, (o.answer_relevancy >= 0.3)::int::double as hit_at_3, o.faithfulness as ndcg_at_5, (g.status = 'SUPPORTED')::int::double as groundedness,
    g.status = 'CONTRADICTED' as critical, r.score::double as rubric, length(p.question) % 7 = 0 as is_abstention,
    case when contains(lower(p.question), 'the') then 'high' when contains(lower(p.question), 'e') then 'medium' else 'low' end as risk, case when o.turn < 2 then 'opening' when o.turn < 5 then 'middle' end as intent
  from ({ORACLE['overlap_scores']}) o join ({ORACLE['rubric']}) r using (conv_id, turn) join ({ORACLE['claim_groundedness']}) g using (conv_id, turn)
  join (with {TURNS.strip()} select * from p) p using (conv_id, turn)),
sets as (
  select case grouping(coalesce(risk, 'medium'), coalesce(intent, 'general')) when 3 then 'overall' when 1 then 'risk' else 'intent' end as scope, coalesce(coalesce(risk, 'medium'), coalesce(intent, 'general')) as bucket,
    count(*) as n, avg(hit_at_3) as hit_at_3, avg(mrr) as mrr, avg(ndcg_at_5) as ndcg_at_5, avg(groundedness) as groundedness, avg(rubric) as rubric, count(*) filter (critical) as critical,
    count(*) filter (is_abstention) as n_abstention, coalesce(count(*) filter (is_abstention and rubric >= 4) / nullif(count(*) filter (is_abstention), 0)::double, 0) as abstention_accuracy
  from cases group by grouping sets ((), (coalesce(risk, 'medium')), (coalesce(intent, 'general'))))"""
CASES = CASES.replace("coalesce(coalesce(risk, 'medium'), coalesce(intent, 'general'))", "case grouping(coalesce(risk, 'medium'), coalesce(intent, 'general')) when 1 then coalesce(risk, 'medium') when 2 then coalesce(intent, 'general') end")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges as evaluated cases; a question's words and place stand for its risk and intent."""
    own = exchanges(spark, sf_dir)
    s = metrics.overlap_scores(F.col("question"), F.col("answer"), F.col("question"), F.col("answer"))
    status = metrics.claim_grounded(F.col("question"), F.col("answer"))
    relevancy = F.round(s["answer_relevancy"], 9)
    return own.select(
        relevancy.alias("mrr"), (relevancy >= 0.3).cast("double").alias("hit_at_3"), F.round(s["faithfulness"], 9).alias("ndcg_at_5"), (status == "SUPPORTED").cast("double").alias("groundedness"),
        (status == "CONTRADICTED").alias("critical"), metrics.rubric(F.col("question"), F.col("answer"), F.col("question")).cast("double").alias("rubric"), (F.length("question") % 7 == 0).alias("is_abstention"),
        corpus.risk_tier(F.col("question"), ("the",), ("e",)).alias("risk"), F.when(F.col("turn") < 2, "opening").when(F.col("turn") < 5, "middle").alias("intent"),
    )


@query("case_breakdown", f"""with {CASES} select scope, bucket, n, round(hit_at_3, 4) as hit_at_3, round(mrr, 4) as mrr, round(ndcg_at_5, 4) as ndcg_at_5, round(groundedness, 4) as groundedness, round(rubric, 2) as rubric,
  critical, n_abstention, round(abstention_accuracy, 4) as abstention_accuracy from sets""")  # fmt: skip
def case_breakdown(spark, sf_dir):
    return evaluation.breakdown(cases(spark, sf_dir))


@query("case_gates", f"""with {CASES}, g as (select * from {values(list(metrics.GATES), 'gate, bound, more')}),
v as (select gate, case gate when 'hit_at_3' then round(hit_at_3, 4) when 'mrr' then round(mrr, 4) when 'ndcg_at_5' then round(ndcg_at_5, 4) when 'groundedness' then round(groundedness, 4) when 'rubric' then round(rubric, 2)
  when 'critical_contradictions' then critical when 'abstention_accuracy' then round(abstention_accuracy, 4) else (select round(groundedness, 4) from sets where scope = 'risk' and bucket = 'high') end as value from g, sets where scope = 'overall')
select gate, bound::double as bound, coalesce(value, 0)::double as value, case when more then coalesce(value, 0) >= bound else coalesce(value, 0) <= bound end as passed from g left join v using (gate)""")  # fmt: skip
def case_gates(spark, sf_dir):
    return metrics.quality_gates(evaluation.gate_values(evaluation.breakdown(cases(spark, sf_dir))))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply about every click: fenced, with talk around it, bare, or cut off, as its number has it."""
    c = table(spark, sf_dir, "clicks")
    kind, props, client = F.coalesce("kind", F.lit("")), F.coalesce("props", F.lit("null")), F.coalesce(F.col("client_id").cast("string"), F.lit(""))
    fenced = F.concat(F.lit('```json\n{"output": {"named_entities": [{"name": "'), kind, F.lit('", "category": "kind"}, {"category": "x"}, "loose"]}}\n```'))
    talk = F.concat(F.lit('Sure: {"triples": [["c'), client, F.lit('", "did", "'), kind, F.lit('"], {"subject": "'), kind, F.lit('", "predicate": "}", "object": "x"}, ["a", "b"]]} done'))
    bare = F.concat(F.lit('{"props": '), props, F.lit("}"))
    reply = F.when(F.col("click_id") % 4 == 0, fenced).when(F.col("click_id") % 4 == 1, talk).when(F.col("click_id") % 4 == 2, bare).otherwise(F.concat(F.lit('{"named_entities": [{"name": "'), kind))
    return c.select("click_id", reply.alias("reply"))


@query("model_replies", r"""
with r as (select click_id, coalesce(kind, '') as kind, coalesce(client_id::varchar, '') as client, coalesce(props, 'null') as props, click_id % 4 as form from clicks),
j as (select *, case form when 0 then '{"output": {"named_entities": [{"name": "' || kind || '", "category": "kind"}, {"category": "x"}, "loose"]}}'
  when 1 then '{"triples": [["c' || client || '", "did", "' || kind || '"], {"subject": "' || kind || '", "predicate": "}", "object": "x"}, ["a", "b"]]}' when 2 then '{"props": ' || props || '}' else '{' end as doc from r),
k as (select *, json_valid(doc) as ok, case when json_valid(doc) then doc else 'null' end as d from j)
select click_id, case when not ok then 'rejected' when form = 1 then 'recovered' else 'parsed' end as status,
  case when form = 0 then trim(json_extract_string(d, '$.output.named_entities[0].name')) end as first_name,
  case when form = 0 then (trim(json_extract_string(d, '$.output.named_entities[0].name')) = '')::int + 2 end as faulty_entities,
  case when form = 1 then (trim(json_extract_string(d, '$.triples[0][2]')) <> '')::int * 2 end as good_triples,
  json_extract_string(d, '$.props.k') as k
from k""")
def model_reply_values(spark, sf_dir):
    read = model_replies(spark, sf_dir).withColumn("x", replies.decoded("reply"))
    v, form = F.col("x.value"), F.col("click_id") % 4
    named, found = replies.entities(v), replies.triples(v)
    return read.select(
        "click_id", F.col("x.status").alias("status"), F.when(form == 0, F.coalesce(F.get(named, F.lit(0))["name"], F.lit(""))).alias("first_name"),
        F.when(form == 0, F.size(F.filter(named, lambda e: e["fault"].isNotNull()))).alias("faulty_entities"), F.when(form == 1, F.size(F.filter(found, lambda t: t["fault"].isNull()))).alias("good_triples"),
        F.try_variant_get(v, "$.props.k", "string").alias("k"),
    )


def digest_sql(label: str, columns: list[str], source: str) -> str:
    cells = " || '|' || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in sorted(columns))
    return f"select {label} as label, count(*) as n, sum(('0x' || substr(md5({cells}), 1, 15))::bigint)::varchar || '-' || sum(('0x' || substr(md5({cells}), 16, 15))::bigint)::varchar as digest from {source} group by 1"


@query("graph_digests", digest_sql("c_mktsegment", ["c_custkey", "c_name", "c_nationkey"], "customer") + " union all " + digest_sql("'placed ' || o_orderstatus", ["o_custkey", "o_orderkey"], "orders"))
def graph_digests(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name", "c_nationkey")
    edges = table(spark, sf_dir, "orders").select(F.concat(F.lit("placed "), "o_orderstatus").alias("label"), "o_custkey", "o_orderkey")
    return corpus.content_digests(nodes, "c_mktsegment").unionByName(corpus.content_digests(edges, "label"))
