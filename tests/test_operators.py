from __future__ import annotations

import hashlib
import math
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import bm25, evidence, graph, metrics, ranking, splitters


def test_bm25_by_hand(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a a zz"), (2, "??")], "query_id long, text string")
    index = bm25.fit(docs)
    got = bm25.search(index, queries, 5).collect()
    idf = math.log((4 - 1 + 0.5) / 1.5 + 1)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.25))
    assert [(r.query_id, r.doc_id, r["rank"]) for r in got] == [(1, 1, 1)]
    assert got[0].score == pytest.approx(want)
    index.save(str(tmp_path / "index"))
    assert bm25.search(bm25.Index.load(spark, str(tmp_path / "index")), queries, 5).collect() == got
    assert bm25.Index.load(spark, str(tmp_path / "none")) is None


def test_fusion_ties_weights_and_payloads(spark):
    rows = [(1, "vector", 0, 1, "x"), (1, "vector", 0, 2, "y"), (1, "bm25", 1, 1, "y"), (1, "bm25", 1, 2, "x"), (1, "bm25", 1, 3, "x"), (2, "bm25", 1, 1, "z")]
    ranked = spark.createDataFrame(rows, "query_id long, channel string, channel_order int, rank int, doc_id string")
    got = {(r.query_id, r.doc_id): (r["rank"], r.payload_channel) for r in ranking.fuse(ranked).collect()}
    assert got == {(1, "x"): (1, "vector"), (1, "y"): (2, "vector"), (2, "z"): (1, "bm25")}
    weighted = ranking.fuse(ranked, {"bm25": 2.0}, last_payload=True).filter("query_id = 1 and rank = 1").first()
    assert (weighted.doc_id, weighted.payload_channel) == ("y", "bm25")


def test_fusion_is_independent_of_row_order(spark):
    rows = [(1, c, o, r, f"d{(r * 7 + o) % 5}") for o, c in enumerate("abc") for r in range(1, 6)]
    schema = "query_id long, channel string, channel_order int, rank int, doc_id string"
    one, two = (ranking.fuse(spark.createDataFrame(x, schema)).orderBy("rank").collect() for x in (rows, rows[::-1]))
    assert one == two


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 1500), (1, 3, 400), (1, 4, 800)], "query_id long, rank int, size long")
    assert sorted(r["rank"] for r in ranking.within_budget(rows, 2000).collect()) == [1, 3]


def test_dense_in_several_passes(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(8)] + [(9, [0.0, 0.0])], "doc_id long, v array<double>")
    queries = rows.filter("doc_id < 4").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    one, two = (sorted(map(tuple, ranking.dense_search(rows, queries, 3, n).collect())) for n in (100, 1))
    assert one == two and len(one) == 12


GOLD = ("1/2020/A", "5", None, None, "evidence text here")


def support_of(spark, context, judged=None, **options):
    names = ("document_id", "article", "clause", "point", "text")
    schema = ", ".join(f"{s}_{n} string" for s in "gc" for n in names) + ", judged boolean"
    pairs = spark.createDataFrame([(*GOLD, *context, judged)], schema)
    row = evidence.support(pairs, evidence.Policy(**options)).first()
    return row.supported, row.method


def test_support_routes(spark):
    assert support_of(spark, ("1-2020-a", "Điều 5", None, None, "other")) == (True, "structural")
    assert support_of(spark, ("2/2020/A", "5", None, None, "evidence text here")) == (False, "location_mismatch")
    assert support_of(spark, (None, None, None, None, "has evidence text  HERE in it")) == (True, "text_containment")
    assert support_of(spark, (None, None, None, None, "text evidence and here")) == (True, "text_overlap")
    assert support_of(spark, (None, None, None, None, "nothing")) == (None, "undecided")
    assert support_of(spark, (None, None, None, None, "nothing"), judged=False) == (False, "judge")
    assert support_of(spark, ("1/2020/A", None, None, None, "nothing"), coarse=True) == (True, "structural")
    assert support_of(spark, ("1/2020/A", "5", None, None, "nothing"), verify_text=True) == (None, "undecided")


def test_undecided_is_not_false(spark):
    rows = [("a", 1, None), ("a", 2, True), ("b", 1, None), ("b", 2, False), ("c", 1, False), ("d", None, None)]
    pairs = spark.createDataFrame(rows, "k string, rank int, supported boolean")
    got = {r.k: (r.supported, r["rank"]) for r in evidence.best_support(pairs, ["k"]).collect()}
    assert got == {"a": (True, 2), "b": (None, None), "c": (False, None), "d": (False, None)}
    assert {r.k: r.supported for r in evidence.best_support(pairs, ["k"], empty_is_null=True).collect()}["d"] is None


def test_location_match_needs_something_declared(spark):
    frame = spark.createDataFrame([("1/2020/A", "5", None, None, "1/2020/A", None, None, None), (None,) * 8], "c_document_id string, c_article string, c_clause string, c_point string, g_document_id string, g_article string, g_clause string, g_point string")
    match = evidence.location_match(evidence.levels("c_"), evidence.levels("g_"))
    assert [r[0] for r in frame.select(match).collect()] == [True, None]


def test_context_for_citation(spark):
    levels = "document string, article string, clause string, point string"
    cited = spark.createDataFrame([("q", 1, "d", "5", None, None)], f"question_id string, citation int, {levels}")
    contexts = spark.createDataFrame([("q", 1, "t", None, "6", None, None), ("q", 2, "u", "d", None, None, None), ("q", 3, "v", "d", "5", None, None)], f"question_id string, rank int, text string, {levels}")
    assert evidence.context_for_citation(cited, contexts).first()["rank"] == 2


def test_mirror(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["c", "b", "a"]), (["a", "b"], ["a", "b"]), (["a", "b", "c"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in frame.select(evidence.mirrors_contexts(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_retrieval_metrics_nulls(spark):
    schema = "question_id string, evidence string, required boolean, supported boolean, rank int, n_contexts int, error boolean"
    rows = [("hit", "e", True, True, 2, 3, False), ("hit", "f", True, None, None, 3, False), ("none", None, None, None, None, 3, False), ("err", "e", True, False, None, 0, True), ("empty", "e", True, False, None, 0, False)]
    got = {r.question_id: r for r in metrics.retrieval_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert (got["hit"].recall, got["hit"].mrr, got["hit"].hit_1, got["hit"].hit_3, got["hit"].recall_1) == (0.5, 0.5, 0.0, 1.0, 0.0)
    assert got["none"].recall is None and got["err"].recall is None and got["err"].mrr is None
    assert (got["empty"].recall, got["empty"].mrr) == (0.0, 0.0)


def test_micro_macro_by_hand(spark):
    rows = [("1", "a", "m", 1.0, None), ("2", "a", "m", 0.0, None), ("3", "b", "m", 1.0, None), ("4", "b", "m", None, "not_applicable"), ("5", "c", "m", None, None)]
    got = metrics.micro_macro(spark.createDataFrame(rows, "question_id string, category string, metric string, value double, status string")).first()
    assert (got.micro, got.macro, got.n, got.not_applicable, got.unavailable) == (pytest.approx(2 / 3), 0.75, 3, 1, 1)
    assert got.by_category == {"a": 0.5, "b": 1.0, "c": None}


def test_bootstrap(spark):
    rows = spark.createDataFrame([("m", str(k), k % 2 / 1.0) for k in range(20)] + [("s", "1", 1.0)], "metric string, question_id string, value double")
    one, two = (metrics.bootstrap_intervals(rows).orderBy("metric").collect() for _ in range(2))
    assert one == two and one[0].low < 0.5 < one[0].high and one[1].low is None


def test_gates(spark):
    got = metrics.quality_gates(spark.createDataFrame([("mrr", 0.9)], "gate string, value double"))
    assert {r.gate for r in got.collect() if r.passed} == {"mrr", "critical_contradictions"}
    assert metrics.verdict(got).first()[0] == "FAIL_CONDITIONAL"


def pieces(spark, text, limit):
    return spark.createDataFrame([(text,)], "text string").select(splitters.length_pieces(F.col("text"), limit)).first()[0]


def test_split_is_lossless_and_within_the_limit(spark):
    for text in ("a" * 250, "x y " * 100, "one. two; three\n" * 40, "short", "\n\n\n" * 60, ""):
        parts = pieces(spark, text, 50)
        assert "".join(parts) == text and all(len(p) <= 50 for p in parts)


def test_paragraph_packing():
    assert splitters.pack_paragraphs("a\n\nb\n\n" + "c" * 10, 5, 2) == ["a\n\nb", "ccccc", "ccccc", "cccc", "c"]
    assert splitters.pack_paragraphs("abc", -3, 150)  # a limit below the overlap still ends


def test_forms_have_no_article_number(spark):
    paths = [(["Chương I", "Điều 7. X"], 7), (["Phụ lục I", "Điều 7"], None), ([], None), (["Điều 7a"], None)]
    got = spark.createDataFrame(paths, "path array<string>, want int").select("want", splitters.article_of(F.col("path")).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_sections_once_only():
    options = splitters.SectionOptions(cumulative=False)
    text = "## Chương I\n### Mục 1\nx\n### Mục 2\ny"
    assert [s[0] for s in splitters.sections(text, options)] == ["Chương I - Mục 1", "Chương I - Mục 2"]


def test_empty_headings(spark):
    rows = [("1", "A / Điều 2. Có hiệu lực", "", "Text", ""), ("2", "A / Chương II", " ", "Text", ""), ("3", "A", None, "Text", "")]
    frame = spark.createDataFrame(rows, "id string, name string, content string, type string, source_path string")
    assert [r.id for r in splitters.structural_split(frame).collect()] == ["1"]


def test_tables_stay_with_their_heading(spark):
    docs = spark.createDataFrame([("s", "# A\nt [x](u)\n| a |\n|---|\n| 5.000 |\nmore")], "source string, text string")
    got = [(r.name, r.type, r.content) for r in splitters.heading_tree(docs).collect()]
    assert ("A", "Table", "| a |\n|---|\n| 5.000 |") in got


def test_citation_lists(spark):
    text = "Điều 8 và Điều 9 Luật 59/2020/QH14; xem điểm a khoản 1."
    answers = [(1, text), (2, None), (3, ""), (4, "khoản 2"), (5, "điều 8 luật 1/2020/nđ-cp. Nêu Điều 8 Luật 1/2020/NĐ-CP, Điều 9"), (6, "Điều 1 " + "x" * 20000 + " và" * 20000 + " Điều 2")]
    got = splitters.citations(spark.createDataFrame(answers, "answer_id long, text string")).orderBy("answer_id", "n").collect()
    assert [(r.answer_id, r.article, r.document_id, r.clause, r.point) for r in got] == [
        (1, "8", None, None, None), (1, "9", "59/2020/QH14", None, None), (1, None, "59/2020/QH14", "1", "a"),
        (5, "8", "1/2020/nđ-cp", None, None), (5, "9", "1/2020/NĐ-CP", None, None), (6, "1", None, None, None), (6, "2", None, None, None),
    ]


def test_graph_pieces(spark):
    ids = spark.createDataFrame([("d", 5)], "d string, n int").select(graph.article_id(F.col("d"), F.col("n"))).first()[0]
    assert ids == "article:d:5"
    with pytest.raises(Exception, match="not valid"):
        spark.createDataFrame([("d", 0)], "d string, n int").select(graph.article_id(F.col("d"), F.col("n"))).collect()
    edges = spark.createDataFrame([("a1", "belongsTo", "d")], "src string, label string, dst string")
    articles = spark.createDataFrame([("a1", "x"), ("a2", "y")], "article_id string, document_id string")
    assert {tuple(r) for r in graph.belongs_to(articles, edges).collect()} == {("a1", "belongsTo", "d"), ("a2", "belongsTo", "y")}
    nodes = spark.createDataFrame([("Luật X", "LegalDocument", 1, {"a": "1"}), ("luật x", "LegalDocument", 2, {"a": "2", "b": "3"}), ("Chunk 1", "Chunk", 3, {})], "id string, label string, position int, properties map<string,string>")
    assert {r.id: r.properties for r in graph.merged_nodes(nodes).collect()} == {"luật x": {"a": "1", "b": "3"}, "Chunk 1": None}


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {r.id: r.score for r in graph.personalized_pagerank(edges, seeds, rounds=6).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["a"] > got["c"]


def test_large_vocabularies_find_the_same(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "brown foxes"), (3, "abc")], "doc_id long, text string")
    names = spark.createDataFrame([("quick brown fox",), ("wn fox",), ("ab",), ("",)], "name string")
    few, many = ({(r.doc_id, r.name) for r in graph.contained_names(texts, names, n).collect()} for n in (100, 1))
    assert few == many == {(1, "quick brown fox"), (1, "wn fox"), (2, "wn fox"), (3, "ab")}


def test_sole_occurrence(spark):
    names = spark.createDataFrame([("s", "dữ liệu"), ("s", "cá nhân")], "source string, name string")
    lines = spark.createDataFrame([("s", 1, "Dữ liệu cá nhân"), ("s", 2, "cá nhân")], "source string, line_no int, line string")
    assert [tuple(r) for r in graph.sole_occurrence(names, lines).collect()] == [("s", "dữ liệu", 1)]


def test_judge_sees_each_pair_once(spark):
    pairs = spark.createDataFrame([("A b", "b"), ("a  B", "B"), ("x", "y")], "premise string, hypothesis string")
    got = evidence.judged_once(pairs, evidence.rule_judge)
    assert sorted((r.premise, r.verdict or "") for r in got.collect()) == [("A b", "entailed"), ("a  B", "entailed"), ("x", "")]
    assert T.ABSTENTION_CUES


def test_overlong_lines_are_cut_after_the_last_mark_that_fits(spark):
    assert pieces(spark, "one. two; three: four five six", 20) == ["one. two; three: ", "four five six"]
    assert pieces(spark, "one; two three. four five", 12) == ["one; ", "two three. ", "four five"]
    assert pieces(spark, "alpha beta gamma", 12) == ["alpha beta ", "gamma"]
    assert pieces(spark, "x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_an_index_is_none_only_where_there_is_none(spark, tmp_path):
    index = bm25.fit(spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id long, text string"))
    assert bm25.Index.load(spark, str(tmp_path / "no")) is None
    index.save(str(tmp_path / "index"))
    assert bm25.Index.load(spark, str(tmp_path / "index")).docs.count() == 2
    shutil.rmtree(tmp_path / "index" / "terms")
    with pytest.raises(AnalysisException):
        bm25.Index.load(spark, str(tmp_path / "index"))


def test_sized_chunks_hold_every_word(spark):
    text = "\n\n".join(f"paragraph {k} " + "word " * (k % 90) for k in range(200))
    rows = splitters.section_chunks(spark.createDataFrame([("a", text)], "source string, text string")).collect()
    assert len(rows) > 10 and max(len(r.content) for r in rows) <= 1200 and [r.part for r in rows] == list(range(1, len(rows) + 1))
    held = " ".join(r.content for r in rows).split()
    assert {held[k + 1] for k, w in enumerate(held) if w == "paragraph"} == {str(k) for k in range(200)}


def test_identities_keep_their_prefixes(spark):
    """One occurrence has one id whatever its name or hints; unresolved ids differ between chunks; ids with a prefix aren't changed."""
    placed = [("Sanction", n, "d", "3", "1", None, "phạt", h, None) for n, h in (("a", "1"), ("b", "9"))] + [(None, "c", None, None, None, None, None, None, None), ("Authority", None, None, None, None, None, None, None, None)]
    rows = spark.createDataFrame(placed, "category string, name string, document string, article_no string, clause_no string, point_no string, unit string, hint_clause string, hint_point string")
    empty = spark.createDataFrame([], "document string, article_no string, title string")
    got = {r.name: (r.id, r.reason) for r in graph.semantic_identities(rows, empty).collect()}
    material = "\x1f".join(("Sanction", "d", "3", "k1", "phạt"))
    assert got["a"] == ("sanction:d:3:k1:" + hashlib.sha256(material.encode()).hexdigest()[:16], "occurrence")
    assert got["b"] == (got["a"][0], "clause differs")
    assert got["c"] == (None, "category has no ids here") and got[None] == (None, "no name")

    ids = spark.createDataFrame([("c1", "x"), ("c2", "x")], "chunk string, name string").select(graph.unresolved_id(F.lit("LegalTerm"), F.col("chunk"), F.col("name")).alias("id"))
    one, two = (r.id for r in ids.collect())
    assert one != two and one == "legalterm-unresolved:" + hashlib.sha256(b"c1\x1fx").hexdigest()[:16]
    nodes = [("sanction:d:3:K1", "Sanction"), ("KB.Sanction", "KB.Sanction"), ("legalterm-unresolved:AB", "KB.LegalTerm"), ("term:A B", "LegalTerm"), ("sanction:d", None)]
    kept = spark.createDataFrame(nodes, "id string, label string").select("id", graph.has_identity(F.col("id"), F.col("label")).alias("own"))
    assert [r.own for r in kept.collect()] == [True, False, True, False, False]
