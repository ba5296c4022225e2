"""The registered queries of this subpackage: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from .urlfilter import host_of


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as instruction examples under three limits; those over one are cut between turns."""
    from .packing import Limits, pack_conversations

    return pack_conversations(table(spark, sf_dir, "conversations"), tokenizer_path(), Limits(2048, 16, 1536))


def op3_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bfd import pack_best_fit

    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), "docstrata")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, with a fetch day that follows from its id (the table has none)."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))


def _list_events(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of the table: whole hosts, parent domains and paths come and go by a digest of the host."""
    hosts = captures.select(host_of(F.col("url")).alias("host")).filter("host <> ''").groupBy("host").count()
    v = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")

    def event(entry, kind: str, action: str, day, when) -> F.Column:
        made = F.struct(F.lit(kind).alias("list"), entry.alias("entry"), F.lit(action).alias("action"), F.date_add(F.to_date(F.lit("2024-01-01")), day.cast("int")).alias("day"))
        return F.when(when, made)

    host, path, every = F.col("host"), F.concat("host", F.lit("/en")), v % 4
    events = F.array(
        event(host, "hosts", "add", v % 200, every == 0),
        event(host, "hosts", "remove", v % 200 + v % 50 + 10, every == 0),
        event(host, "hosts", "add", v % 200 + 100, (every == 0) & (v % 3 == 0)),
        event(parent, "domains", "add", v % 300, every == 1),
        event(path, "paths", "add", v % 250, every == 2),
        event(path, "paths", "remove", v % 250 + 60, every == 2),
    )
    return hosts.select(F.explode(F.array_compact(events)).alias("e")).select("e.*")


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import evaluate

    captures = _captures(spark, sf_dir)
    return evaluate(captures, _list_events(captures))


OP8_SQL = r"""
with captures as (
  select page_id as capture_id, date '2024-01-01' + cast(page_id * 7919 % 366 as int) as fetched,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^[^@]*@', ''), ':[0-9]*$', ''), '\.+$', '') as host,
    regexp_extract(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^[^/?#]*(/[^?#]*)', 1) as path
  from pages),
hosts as (select distinct host, cast('0x' || substr(md5(host), 1, 4) as int) as v, string_split(host, '.') as labels from captures where host <> ''),
events as (
  select 'hosts' as list, host as entry, 'add' as action, v % 200 as day from hosts where v % 4 = 0
  union all select 'hosts', host, 'remove', v % 200 + v % 50 + 10 from hosts where v % 4 = 0
  union all select 'hosts', host, 'add', v % 200 + 100 from hosts where v % 4 = 0 and v % 3 = 0
  union all select 'domains', array_to_string(labels[greatest(len(labels) - 2, 1):], '.'), 'add', v % 300 from hosts where v % 4 = 1
  union all select 'paths', host || '/en', 'add', v % 250 from hosts where v % 4 = 2
  union all select 'paths', host || '/en', 'remove', v % 250 + 60 from hosts where v % 4 = 2),
daily as (select list, entry, date '2024-01-01' + cast(day as int) as day, max(action) as action from events group by all),
spread as (
  select capture_id, fetched, unnest(list_distinct(list_concat(
    list_transform(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(generate_series(1, len(list_filter(string_split(path, '/'), lambda p: p <> ''))),
      lambda i: host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> '')[1:i], '/'))))) as entry
  from captures where host <> ''),
latest as (
  select s.capture_id, d.list, d.entry, arg_max(d.action, d.day) as action
  from spread s join daily d on s.entry = d.entry and d.day <= s.fetched group by all),
hits as (
  select capture_id, list_sort(list_distinct(list(list))) as lists, list_sort(list_distinct(list(entry))) as entries
  from latest where action = 'add' group by capture_id)
select c.capture_id, c.host, h.entries is not null as blocked, coalesce(len(h.entries), 0)::bigint as n_entries,
  coalesce(h.lists, []::varchar[]) as lists, coalesce(h.entries, []::varchar[]) as entries
from captures c left join hits h using (capture_id)
"""


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import alignment_report

    return alignment_report(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .concurrency import open_sales

    return open_sales(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients")))


OP13_SQL = """
with ends as (select sale_id, floor(epoch(max(shipped_at)) / 60)::bigint + 10080 as e from sale_lines where sale_id is not null group by sale_id having max(shipped_at) is not null),
nations as (select client_id, min(nation_id) as nation_id from clients where client_id is not null group by client_id),
held as (
  select coalesce(n.nation_id, -1) as nation_id, floor(epoch(s.sold_at) / 60)::bigint as s, e,
    case when s.total is null or isnan(s.total) or isinf(s.total) then 0 else floor(100 * s.total + 0.5) end::bigint as cents
  from sales s left join ends using (sale_id) left join nations n using (client_id) where s.sold_at is not null),
valid as (select * from held where e is null or e > s),
each as (select nation_id, s, e, cents from valid union all select -2, s, e, cents from valid),
changes as (select nation_id, s as m, 1 as dn, cents as dc from each union all select nation_id, e, -1, -cents from each where e is not null),
moments as (select nation_id, m, sum(dn) as dn, sum(dc) as dc from changes group by all having sum(dn) <> 0 or sum(dc) <> 0),
rows as (
  select nation_id, m, lead(m) over w as next, sum(dn) over w as n_open, sum(dc) over w as open_cents from moments
  window w as (partition by nation_id order by m))
select nation_id::int as nation_id, m * 60 as from_s, next * 60 as to_s, n_open::bigint as n_open, open_cents::bigint as open_cents,
  (max(n_open) over (partition by nation_id order by m))::bigint as high_open, n_open = max(n_open) over (partition by nation_id) as is_peak
from rows
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_vector_packing": op2_vector_packing,
    "pack_conversations": pack_conversations,
    "op3_hyperminhash_dedup": op3_hyperminhash_dedup,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_token_counts": op5_token_counts,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_temporal_url_filter": op8_temporal_url_filter,
    "op9_additive_quantisation": op9_additive_quantisation,
    "op10_spaced_seed_decontamination": op10_spaced_seed_decontamination,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_peak_concurrency": op13_peak_concurrency,
}

OP3_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end as s from words),
flat as (select doc_id, unnest(s) as t from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from flat a join flat b on a.t = b.t and a.doc_id < b.doc_id group by all),
links as (
  select x, y from pairs join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
both_ways as (select x, y from links union select y, x from links),
reach(doc_id, other) as (select doc_id, doc_id from sets union select r.doc_id, e.y from reach r join both_ways e on r.other = e.x),
low as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, len(s.s)::bigint as n_shingles, l.component_id, s.doc_id = l.component_id as kept from sets s join low l using (doc_id)
"""

OP7_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(translate(text, chr(9) || chr(13) || chr(11) || chr(12), '    '), chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
words as (select doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') as w from lines),
filled as (select doc_id, line_no, w, row_number() over (order by doc_id, line_no) as place from words where len(w) > 0),
sets as (
  select doc_id, line_no, place, case when len(w) >= 5 then list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))))
    else [array_to_string(w, ' ')] end as s from filled),
classes as (select s, min(place) as place from sets group by s),
flat as (select place, len(s) as n, unnest(s) as t from classes),
pairs as (select a.place as late, a.n as n, b.n as m, count(*) as c from flat a join flat b on a.t = b.t and a.place > b.place group by a.place, b.place, a.n, b.n),
gone as (select distinct late from pairs where 4 * c >= 3 * (n + m - c)),
removed as (
  select doc_id, line_no from sets left join classes using (place) where classes.place is null
  union all select doc_id, line_no from sets join gone on place = late),
per_doc as (select doc_id, list_sort(list(line_no::int)) as removed_lines from removed group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(len(removed_lines), 0)::bigint as n_removed,
  coalesce(removed_lines, []::int[]) as removed_lines
from documents d left join per_doc using (doc_id)
"""

ORACLE: dict[str, str] = {
    "op3_hyperminhash_dedup": OP3_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_temporal_url_filter": OP8_SQL,
    "op13_peak_concurrency": OP13_SQL,
}
