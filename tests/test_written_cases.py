"""Hand-written cases of text, splitter and run operators, with the rows that each must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.operators import evidence, graph, metrics, splitters
from docstrata.plans import retrieval
from docstrata.streaming import runs

LAW = """# Nghị định 13/2023/NĐ-CP

Tình trạng: còn hiệu lực

Căn cứ Luật.

## Chương I
### Mục 1
#### Điều 1. Phạm vi
1. Khoản một.
a) Điểm a;
b) Điểm b.
2. Khoản hai.

### Mục 2
Điều 2. Đối tượng
Nội dung điều hai.
"""
SECTIONS = [
    (0, "Mở đầu / Căn cứ ban hành", "Thông tin chung", 1, 1), (1, "Chương I - Mục 1", "Điều 1. Phạm vi", 1, 1),
    (2, "Chương I - Mục 1 - Mục 2", "Điều 2. Đối tượng", 1, 1),
]
CLAUSES = "Lời dẫn\n" + "\n".join(f"{k}. Khoản {k} " + "x" * 60 for k in (1, 2)) + "\n3. Khoản 3\na) " + "y" * 90 + "\nb) " + "z" * 40
UNITS = [(0, "1", None), (1, "2", None), (2, "3", "a"), (3, "3", "b")]
TABLE = "Bảng giá\n| a | b |\n|---|---|\n" + "\n".join(f"| {k} | 5.000 |" for k in range(8)) + "\nHết"
TREE = [("Nghị định 13/2023/NĐ-CP", "Text", 1), ("Nghị định 13/2023/NĐ-CP / Chương I", "Text", 2), ("Nghị định 13/2023/NĐ-CP / Chương I / Mục 1", "Text", 3), ("Nghị định 13/2023/NĐ-CP / Chương I / Mục 1 / Điều 1. Phạm vi", "Text", 4), ("Nghị định 13/2023/NĐ-CP / Chương I / Mục 2", "Text", 3)]
NUMBERED = "# L\n## Điều 1. A\nx\n## Điều 3. C\n## Điều 2. B\n## Phụ lục\n### Điều 3. F\n## Điều 3. C"
BODY = "lead\n1. one\na) x\nb) y\n2. two"
ANSWERS = [
    (1, "Theo điểm b khoản 2 Điều 8 Nghị định 13/2023/NĐ-CP và Điều 9."), (2, "khoản 2 thì không rõ. Luật 59/2020/QH14 nêu ở Điều 3 khoản 1"),
    (3, "Điều 8 <reference id=1></reference> Nghị định 13/2023/NĐ-CP; Điều 8 Nghị định 13/2023/NĐ-CP"), (4, "không có"),
]
CITATIONS = [
    (1, 0, "13/2023/NĐ-CP", "8", "2", "b"), (1, 1, "13/2023/NĐ-CP", "9", None, None), (2, 0, "59/2020/QH14", None, None, None),
    (2, 1, "59/2020/QH14", "3", "1", None), (3, 0, "13/2023/NĐ-CP", "8", None, None),
]
LABELS = [
    ("Điều 53", "khoản 3)", "điểm b", "53", "3", "b"), ("53a.", "Clause 12", "Đ)", "53a", "12", "d"), ("Article 7", "3", "point c", "7", "3", "c"),
    ("", " ", "b]", None, None, "b"), ("dieu 9", "para. 4", "litera f", "9", "4", "f"), (None, None, None, None, None, None),
]
DOCUMENT_IDS = [
    ("330/2026/NĐ-CP", "330/2026/nd/cp"), ("330-2026-ND-CP", "330/2026/nd/cp"), ("Nghị định số 330/2026/NĐ-CP", "330/2026/nd/cp"),
    ("331/2026/NĐ-CP", "331/2026/nd/cp"), ("Luật 59/2020/QH14", "59/2020/qh14"), ("decree no. 5_2020", "5/2020"), (" ", None), ("///", None), (None, None),
]
CANONICAL = [
    ("Luật An ninh mạng số 116/2025/QH15", "luật 116 2025 qh15"), ("Nghị định 329/2026/NĐ-CP", "nghị định 329 2026 nđ cp"),
    ("Điều 5 Luật 116/2025/QH15", "điều 5 luật 116 2025 qh15"), ("Quyết định 127/QĐ-TTg", "quyết định 127 qđ ttg"), ("Quyết định số 127/QĐ-TTg", "quyết định 127 qđ ttg"),
    ("Bộ luật Dân sự 91/2015/QH13", "bộ luật 91 2015 qh13"), ("329/2026/NĐ-CP", "329 2026 nđ cp"), ("Dữ liệu, cá nhân!", "dữ liệu  cá nhân"), ("", ""),
]
CANONICAL = [(a, " ".join(b.split())) for a, b in CANONICAL]
REFERENCES = [("theo Điều 8 Nghị định 13/2023/NĐ-CP", "13/2023/NĐ-CP", "8", None), ("<page_number>12</page_number> x", None, None, 12), ("none", None, None, None)]
HEADS = [
    ("a.md", "# Nghị định 13/2023/NĐ-CP về dữ liệu\n\nTình trạng: Còn hiệu lực\n", "Nghị định 13/2023/NĐ-CP về dữ liệu", "13/2023/NĐ-CP", "còn hiệu lực"),
    ("b.md", "# Thông tư 05-2026-TT-BKHCN\nhết hiệu lực", "Thông tư 05-2026-TT-BKHCN", "05/2026/TT-BKHCN", "hết hiệu lực"),
    ("13-2023-ND-CP_x.md", "text only", None, "13/2023/ND/CP", "Không rõ"), ("c.md", "# Quyết định 127/QĐ-TTg", "Quyết định 127/QĐ-TTg", "127/QĐ-TTg", "Không rõ"),
]
IDENTITIES = [("c", "Sanction", "a", "t1"), ("c", "Sanction", "b", "t1"), ("c", "Sanction", "d", "t2"), ("c", "Authority", "x", "t3"), ("c", "Authority", "y", "t3")]
CALLS = [("k", i, i != 11) for i in range(24)]
PAIRS = [
    ("100.000.000 đồng", "100 000 000 đồng", True), ("30,5%", "305%", False), ("Điều **13**", "Điều 13", True), ("Điều 31", "Điều 13", False),
    ("1.000.000", "1000000", True), ("2026.01", "202601", False), ("không được", "được", False), ("1,234,567 và 12", "1234567 và 12", True),
    ("Luật", "Luật", True), ("12.3456", "123456", False), ("1.000.00", "1000.00", True), ("a  b\tc", "A B C", True),
]
CLAIMS = [
    ("q1", "answer", True), ("q1", "answer", None), ("q1", "gold", True), ("q1", "gold", False), ("q2", "answer", False), ("q2", "gold", None),
    ("q3", "answer", True), ("q4", "gold", True),
]
GROUNDS = [("q1", True, None, None), ("q1", None, True, None), ("q1", False, False, True), ("q1", None, False, None), ("q1", None, None, None), ("q2", None, None, None)]
CITED = [("q1", True, None), ("q1", False, None), ("q1", None, None), ("q2", None, True), ("q2", None, False), ("q1", None, None)]
METAS = [
    ("a.json", "A", "Luật mới", "116/2025/QH15", "Luật", ["24/2018/QH14"], ["A"], [], []), ("b.json", "B", "Luật cũ", "24/2018/QH14", "Luật", [], [], ["116/2025/QH15"], []),
    ("c.json", "C", "Nghị định", "53/2022/NĐ-CP", "Nghị định", [], [], [], ["24/2018/QH14", "99/2020/QH14"]), ("d.json", "C", "khác", "0", "Luật", [], [], [], []), ("_t.json", "T", "", "", "", [], [], [], []),
]
META_SCHEMA = "file string, doc_id string, title string, doc_number string, doc_type string, supersedes array<string>, amends array<string>, superseded_by array<string>, implements array<string>"
EDGES = [
    ("luật 116 2025 qh15", "supersedes", "luật 24 2018 qh14"), ("luật 24 2018 qh14", "supersededBy", "luật 116 2025 qh15"),
    ("nghị định 53 2022 nđ cp", "implementsDoc", "luật 24 2018 qh14"), ("nghị định 53 2022 nđ cp", "implementsDoc", "99 2020 qh14"),
]
ENTITIES = [("c", "Điều 5", "Article"), ("c", "Phạt tiền", "Sanction"), ("c", "Cơ quan", "Authority"), ("c", "Cơ quan", "RegulatedEntity"), ("c", "Luật X", "LegalDocument")]
TRIPLES = [
    ("c", "Điều 5", "imposes", "Phạt tiền", "ACCEPTED"), ("c", "điều 5", "Quy định  chế tài", "phạt tiền", "ACCEPTED"), ("c", "Phạt tiền", "imposes", "Điều 5", "INVALID_ENDPOINT_TYPES"),
    ("c", "Điều 5", "likes", "Phạt tiền", "UNKNOWN_PREDICATE"), ("c", "Điều 5", "imposes", "Ai đó", "UNRESOLVED_ENDPOINT"), ("c", "Phạt tiền", "enforcedBy", "Cơ quan", "AMBIGUOUS_BINDING"),
    ("c", "Điều 5", "source", "Luật X", "UNKNOWN_PREDICATE"), ("c", "Điều 5", "belongsTo", "Luật X", "ACCEPTED"),
]
BODIES = [
    ("Bộ Công an", "authority:bộ công an", "body"), ("Bộ trưởng Bộ Công an", None, "title of a person"), ("Chủ tịch nước", None, "title of a person"),
    ("Cục A thuộc Bộ Công an", None, "part of another body"), ("Ủy ban nhân dân", None, "general name"), ("Bộ", None, "general name"),
    ("Thanh tra Bộ Công an", None, "no kind of body"), ("  --- ", None, "no name"), ("Chính phủ", "authority:chính phủ", "body"),
]
TITLES = [("13/2023", "1", "Phạm vi điều chỉnh"), ("13/2023", "2", "Đối tượng  áp dụng"), ("13/2023", "3", "Xử phạt"), ("13/2023", "4", "Phạm vi áp dụng"), ("13/2023", "4", "Khác")]
PLACED = [
    ("Sanction", "a", "13/2023", "3", "1", None, "phạt tiền", "1", None, "occurrence"), ("Sanction", "b", "13/2023", "3", "1", None, "phạt tiền", "2", "a", "clause differs, point differs"),
    ("LegalTerm", "c", "13/2023", "3", None, "đ", "dữ liệu", None, None, "occurrence"), ("Obligation", "d", "13/2023", "3", None, None, None, None, None, "no single occurrence"),
    ("RegulatedEntity", "e", "13/2023", "2", "1", None, "tổ chức", None, None, "occurrence"), ("RegulatedEntity", "f", "13/2023", "4", "1", None, "tổ chức", None, None, "no article of scope"),
    ("Article", "g", "13/2023", "4", "1", None, "tổ chức", None, None, "category has no ids here"),
]
PLACE = "category, name, document, article_no, clause_no, point_no, unit, hint_clause, hint_point"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def want(rows):
    return sorted(map(tuple, rows), key=repr)


def test_sections(spark):
    chunks = splitters.section_chunks(frame(spark, [("a.md", LAW)], "source string, text string"))
    assert got(chunks.select("chunk_id", "chapter", "article", "part", "total_parts")) == want((f"a.md_c{n}", *r) for n, *r in SECTIONS)
    assert got(chunks.select("doc_code", "status").distinct()) == [("13/2023/NĐ-CP", "còn hiệu lực")]


CHUNK = "id string, name string, content string, type string, source_path string"


def test_structural_split(spark):
    parts = splitters.structural_split(frame(spark, [("id", "Chương I / Điều 5", CLAUSES, "Text", "a.md")], CHUNK), 110)
    assert got(parts.select("split_index", "clause_no", "point_no")) == want(UNITS)
    assert {r.name for r in parts.collect()} == {"Chương I / Điều 5 / Khoản 1", "Chương I / Điều 5 / Khoản 2", "Chương I / Điều 5 / Khoản 3 / Điểm a", "Chương I / Điều 5 / Khoản 3 / Điểm b"}


def test_repeated_labels_and_overlong_points(spark):
    text = "\n".join(["1. " + "x" * 60, "1. " + "y" * 60, "2. đầu", "a) " + "z " * 80])
    rows = [("id", "Điều 5", text, "Text", None), ("n", None, text, None, None)]
    parts = splitters.structural_split(frame(spark, rows, CHUNK), 100).orderBy("split_index").collect()
    mine = [r for r in parts if r.heading_path]
    assert [r.name for r in mine] == ["Điều 5 / Khoản 1", "Điều 5 / Khoản 1 (lần 2)", *(f"Điều 5 / Khoản 2 / Điểm a / phần {k}" for k in (1, 2, 3))]
    assert "\n".join(r.content for r in mine[:3]) + mine[3].content + mine[4].content == text and [len(r.content) for r in mine[2:]] == [7, 99, 64] and len({r.id for r in parts}) == 2 * len(mine)
    assert all(r.clause_no is None and r.point_no is None for r in parts if not r.heading_path)


def test_table_split(spark):
    parts = splitters.structural_split(frame(spark, [("id", "Bảng", TABLE, "Table", "a.md"), ("x", "Bảng", "y" * 200, "Table", "a.md")], CHUNK), 80)
    rows = F.size(F.regexp_extract_all("content", F.lit(r"\| \d \|"), F.lit(0)))
    assert got(parts.filter("content like 'Bảng%'").select("split_index", rows)) == [(0, 3), (1, 3), (2, 2)]
    assert got(parts.filter("content like 'y%'").select(F.length("content"))) == [(40,), (80,), (80,)]


def test_heading_tree(spark):
    tree = splitters.heading_tree(frame(spark, [("a.md", LAW)], "source string, text string"))
    assert got(tree.select("name", "type", "level")) == want(TREE)


def test_article_headings(spark):
    docs = frame(spark, [("a.md", NUMBERED), ("b", None), ("c", "")], "source string, text string")
    assert got(splitters.article_headings(docs).select("article_no", "title", "line_no")) == [(1, "Điều 1. A", 1), (2, "Điều 2. B", 4), (3, "Điều 3. C", 7)]


def test_article_units(spark):
    rows = frame(spark, [("a.md", 1, BODY), ("b", 1, None), ("c", 1, "\n \n")], "source string, article_no int, text string")
    assert got(splitters.article_units(rows).select("line_no", "clause_no", "point_no")) == want([(0, None, None), (1, "1", None), (2, "1", "a"), (3, "1", "b"), (4, "2", None)])


def test_citations(spark):
    cited = splitters.citations(frame(spark, ANSWERS, "answer_id long, text string"))
    assert got(cited.select("answer_id", "n", "document_id", "article", "clause", "point")) == want(CITATIONS)


def test_labels_and_ids(spark):
    labels = frame(spark, [r[:3] for r in LABELS], "a string, c string, p string")
    assert got(labels.select("a", "c", "p", T.normalize_article("a"), T.normalize_clause("c"), T.normalize_point("p"))) == want(LABELS)
    assert got(frame(spark, [r[:1] for r in DOCUMENT_IDS], "raw string").select("raw", T.normalize_document_id("raw"))) == want(DOCUMENT_IDS)
    assert got(frame(spark, [r[:1] for r in CANONICAL], "phrase string").select("phrase", T.canonical_id("phrase"))) == want(CANONICAL)


def test_references_and_heads(spark):
    refs = frame(spark, [r[:1] for r in REFERENCES], "text string")
    assert got(refs.select("text", T.legal_code("text"), T.article_number("text"), T.page_number("text"))) == want(REFERENCES)
    heads = frame(spark, [r[:2] for r in HEADS], "file string, text string")
    assert got(heads.select("file", T.heading_title("text"), T.heading_code("text", "file"), T.document_status("text"))) == want((a, *r) for a, _, *r in HEADS)


def test_shared_targets(spark):
    rows = frame(spark, IDENTITIES, "chunk_id string, category string, name string, target string")
    assert got(graph.downgraded(rows).select("name", "ambiguous")) == want([("a", True), ("b", True), ("d", False), ("x", False), ("y", False)])


def test_breaker(spark):
    calls = frame(spark, CALLS, "key string, seq int, failed boolean")
    assert got(runs.breaker(calls, F.col("failed"), ("seq",)).select("key", "call")) == [("k", 24)]


def test_pairs_and_abbreviations(spark):
    pairs = frame(spark, PAIRS, "a string, b string, expected boolean")
    assert got(pairs.select("a", "b", T.normalize_for_match("a") == T.normalize_for_match("b"))) == want(PAIRS)
    texts = retrieval.expand_abbreviations(frame(spark, [(1, "theo NĐ 13"), (2, "ANDX")], "id int, text string"), {"NĐ": "nghị định", "AND": "an ninh"})
    assert got(texts.select("id", "text")) == [(1, "theo nghị định 13"), (2, "ANDX")]


def test_question_metrics(spark):
    claims = metrics.claim_metrics(frame(spark, CLAIMS, "question_id string, side string, supported boolean"))
    assert got(claims.select("question_id", "claim_precision", "claim_recall", "claim_f1")) == want([("q1", 0.5, 0.5, 0.5), ("q2", 0.0, 0.0, 0.0), ("q3", 1.0, None, None), ("q4", None, 1.0, None)])
    rows = frame(spark, GROUNDS, "question_id string, c boolean, g boolean, x boolean")
    grounds = metrics.grounding_metrics(rows.select("question_id", evidence.classify_claim(F.col("c"), F.col("g"), F.col("x")).alias("status")))
    assert got(grounds.select("question_id", "faithfulness", "hallucination", "retrieval_gap", F.round("unsupported", 6))) == want([("q1", 0.2, 0.2, 0.2, 0.666667), ("q2", 0.0, 0.0, 0.0, None)])
    cited = frame(spark, CITED, "question_id string, correct boolean, cited boolean")
    both = metrics.citation_metrics(cited.filter("question_id = 'q1'").select("question_id", "correct"), cited.filter("question_id = 'q2'").select("question_id", "cited"))
    assert got(both.select("question_id", "citation_precision", "citation_recall")) == want([("q1", 0.5, None), ("q2", None, 0.5)])


def test_metadata_graph(spark):
    rows = frame(spark, METAS, META_SCHEMA)
    for c in ("amended_by", "implemented_by"):
        rows = rows.withColumn(c, F.array().cast("array<string>"))
    for c in ("issuing_body", "date_effective", "date_issued", "date_expired", "status", "source_url"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    nodes, edges = graph.metadata_graph(graph.first_metadata(rows))
    assert got(edges.select("src", "label", "dst")) == want(EDGES)
    assert {r.id for r in nodes.collect()} == {"luật 116 2025 qh15", "luật 24 2018 qh14", "nghị định 53 2022 nđ cp", "99 2020 qh14"}


def test_relation_contract(spark):
    triples = frame(spark, [r[:4] for r in TRIPLES], "chunk_id string, subject string, predicate string, object string")
    out = graph.checked_triples(triples, frame(spark, ENTITIES, "chunk_id string, name string, label string"))
    assert got(out.select("chunk_id", "subject", "predicate", "object", "status")) == want(TRIPLES)


def test_identities_of_bodies_and_occurrences(spark):
    bodies = frame(spark, [r[:1] for r in BODIES], "name string").withColumn("own", graph.authority_identity(F.col("name")))
    assert got(bodies.select("name", "own.id", "own.reason")) == want(BODIES)
    rows = frame(spark, [r[:-1] for r in PLACED], ", ".join(f"{c} string" for c in PLACE.split(", ")))
    own = graph.semantic_identities(rows, frame(spark, TITLES, "document string, article_no string, title string"))
    assert got(own.select("name", "reason")) == want((r[1], r[-1]) for r in PLACED)
