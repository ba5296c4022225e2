from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from docstrata.operators import segments
from docstrata.plans import retrieval, steps
from docstrata.sources import corpus
from docstrata.streaming import runs

SCHEMA = """
Doc(văn bản): EntityType
    properties:
        status(trạng thái): Text
    relations:
        amends(sửa đổi): Doc
        cites(dẫn): Article
Article(điều): EntityType
    properties:
        title(tên): Text
"""
PLAN = """Step1: what does X amend
Action1: Retrieval(s=s1:Doc[X], p=p1:amends, o=o1:Doc)
Step2: its status
Action2: Retrieval(s=o1:Doc, p=p2:status, o=o2)
Action3: Output(o2)"""


def test_plan_runs_over_the_graph(spark):
    schema = steps.parse_schema(SCHEMA)
    nodes = spark.createDataFrame([("x", "X", "Doc", {}), ("y", "Y", "Doc", {"status": "ok"})], "id string, name string, label string, properties map<string,string>")
    edges = spark.createDataFrame([("x", "amends", "y")], "src string, label string, dst string")
    assert steps.plan_faults(PLAN, schema) == []
    assert [r.value for r in steps.run_plan(PLAN, schema, nodes, edges)["o2"].collect()] == ["ok"]
    with pytest.raises(ValueError, match="isn't declared"):
        steps.run_plan(PLAN.replace("amends", "loves"), schema, nodes, edges)


def test_plan_faults():
    schema = steps.parse_schema(SCHEMA)
    assert schema.predicates("Doc") == {"status", "amends", "cites"}
    assert any("before it exists" in f for f in steps.plan_faults("Action1: Output(o9)", schema))
    assert any("unknown operator" in f for f in steps.plan_faults("Action1: Exec(x1)", schema))
    assert any("unknown deduction" in f for f in steps.plan_faults("Action1: Deduce(op=guess, content=[x])", schema))
    assert steps.schema_faults(SCHEMA) == [] and steps.schema_faults(SCHEMA.replace("dẫn): Article", "dẫn): Gone")) == ["line 7: cites leads to unknown type Gone"]
    broken = SCHEMA.replace("    properties:", "   properties:", 1) + "Odd(x): Thing\nnonsense here\n        p(q): Integer\n"
    assert [f.split(":")[0] if "line" in f else f for f in steps.schema_faults(broken)] == ["line 3", "line 12", "Odd is of unknown kind Thing"]


def test_plan_carries_types_and_bindings(spark):
    schema = steps.parse_schema(SCHEMA)
    nodes = spark.createDataFrame(
        [("x", "X", "Doc", {}), ("y", "Y", "Doc", {"status": "ok"}), ("z", "Z", "Doc", {"status": "old"}), ("a", "A1", "Article", {"title": "t"}), ("w", "W", "Doc", {})],
        "id string, name string, label string, properties map<string,string>",
    )
    edges = spark.createDataFrame([("x", "amends", "y"), ("x", "amends", "z"), ("w", "amends", "z"), ("x", "cites", "a"), ("x", "amends", "a")], "src string, label string, dst string")
    run = lambda plan: {k: sorted(r.value for r in v.collect()) for k, v in steps.run_plan(plan, schema, nodes, edges).items()}
    # An alias used again has no type of its own: that of the relation stands, and only its objects count.
    again = "Action1: Retrieval(s=s1:Doc[X],p=p1:amends,o=o1:Doc)\nAction2: Retrieval(s=o1,p=p2:status,o=o2)\nAction3: Output(o1, o2)"
    assert steps.plan_faults(again, schema) == [] and run(again) == {"o1": ["y", "z"], "o2": ["ok", "old"]}
    # An object that is bound keeps what both have in common.
    both = "Action1: Retrieval(s=s1:Doc[X],p=p1:amends,o=o1)\nAction2: Retrieval(s=s2:Doc[W],p=p2:amends,o=o1)\nAction3: Output(o1)"
    assert run(both) == {"o1": ["z"]}
    named = "Action1: Retrieval(s=s1:Doc,p=p1:amends,o=o1:Doc[Y])\nAction2: Output(s1)"
    assert run(named) == {"s1": ["x"]}
    for plan, fault in (
        ("Action1: Retrieval(s=s1[X],p=nonsense,o=o1)", "isn't declared on any type"), (again.replace("o=o1:Doc", "o=o1:Article"), "leads to Doc, not Article"),
        (again.replace("p2:status", "p2:title"), "title isn't declared on Doc"), (again.replace("s=o1,", "s=o1:Article,"), "o1 is Doc, not Article"),
        (again.replace("Output(o1, o2)", "Retrieval(s=o2,p=status,o=o3)"), "holds values"),
    ):
        assert any(fault in f for f in steps.plan_faults(plan, schema)), plan


def test_evidence_loop_ends():
    state = steps.iterate("q", lambda q, s: ("find", q), lambda t: t, lambda s, r: {"covered": ["a"], "missing": [] if s.covered else ["b"]})
    assert state.status() == "sufficient" and state.covered == ("a",)
    stuck = steps.iterate("q", lambda q, s: ("find", q), lambda t: t, lambda s, r: {"missing": ["b"]}, limit=3)
    assert stuck.status() == "insufficient"


def test_channels_may_fail(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "b d")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a b")], "query_id long, text string")
    got = retrieval.hybrid({"bm25": retrieval.bm25_channel(texts, queries, 4)}, texts, queries)
    assert [(r.doc_id, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    same = retrieval.rewritten(queries, lambda c: F.lit(" "))
    assert same.first().text == "a b"


def test_graph_channel(spark):
    queries = spark.createDataFrame([(1, "about Luật X")], "query_id long, text string")
    mentions = spark.createDataFrame([("Luật X", "x")], "name string, id string")
    edges = spark.createDataFrame([("x", "cites", "y")], "src string, label string, dst string")
    chunks = spark.createDataFrame([("y", 5), ("x", 6), ("z", 7)], "id string, doc_id long")
    assert {r.doc_id for r in retrieval.graph_channel(queries, mentions, edges, chunks).collect()} == {5, 6}


def test_markdown_and_metadata(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\nx", encoding="utf-8")
    (tmp_path / "a.md").write_text("# A", encoding="utf-8")
    (tmp_path / "n.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.md").write_text("c")
    assert [r.file_name for r in corpus.markdown_files(spark, str(tmp_path)).collect()] == ["a.md", "b.md"]
    assert corpus.markdown_files(spark, str(tmp_path), recursive=True).count() == 3
    (tmp_path / "m.json").write_text(json.dumps({"doc_id": "1", "amends": ["2"], "in_force": False}, indent=1))
    meta = corpus.metadata_files(spark, str(tmp_path)).first()
    assert (meta.doc_id, meta.amends, meta.file) == ("1", ["2"], "m.json")


def test_contracts(spark, tmp_path):
    item = {"id": "q1", "category": "c", "answerable": True, "question": "Q?", "gold_evidence": [{"document_id": "d", "text": ""}]}
    for name, payload in (("list", [item]), ("wrapped", {"items": [item]})):
        (tmp_path / name).write_text(json.dumps(payload))
        rows = corpus.load_benchmark(spark, str(tmp_path / name))
        assert rows.first().id == "q1"
        assert corpus.item_errors(rows).first().errors == ["evidence without text"]
        assert corpus.questions(rows).columns == ["id", "question"]
    (tmp_path / "twice").write_text(json.dumps([item, item]))
    with pytest.raises(Exception, match="duplicate id"):
        corpus.load_benchmark(spark, str(tmp_path / "twice")).collect()
    out = {"question_id": "q1", "system": "s", "answer": None, "retrieved_contexts": [{"rank": 1, "text": "t"}]}
    (tmp_path / "out").write_text(json.dumps({"outputs": [out]}))
    assert corpus.load_outputs(spark, str(tmp_path / "out")).first().retrieved_contexts[0].text == "t"


def test_ranks_are_strict(spark):
    rows = spark.createDataFrame([("2", 5), (None, 3)], "raw string, at int")
    assert [r[0] for r in rows.select(corpus.typed_rank(F.col("raw"), F.col("at"))).collect()] == [2, 3]
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([("true", 1)], "raw string, at int").select(corpus.typed_rank(F.col("raw"), F.col("at"))).collect()


def test_upsert_and_counts(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert sorted(map(tuple, corpus.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c")]
    nodes, edges = (spark.createDataFrame([(x,)], "label string") for x in "ne")
    assert [r.label for r in corpus.checked_counts(nodes, edges, {"n": 1, "e": 2}).collect()] == ["e"]


def test_risk_and_aliases(spark):
    frame = spark.createDataFrame([("phạt tù", "", "x")], "q string, a string, b string")
    assert frame.select(corpus.risk_tier(F.col("q"), ("phạt tù",), ("phạt",))).first()[0] == "high"
    assert corpus.coalesced_sample(frame, {"t": ("a", "b", "nope"), "u": ("gone",)}).first().asDict() == {"t": "x", "u": None}


def test_captured_errors(spark):
    def model(x):
        if x == "bad":
            raise ValueError("no")
        return x.upper()

    got = spark.createDataFrame([("a",), ("bad",)], "x string").select(runs.captured(model)("x").alias("r")).select("r.*").collect()
    assert [(r.value, r.error) for r in got] == [("A", None), (None, "ValueError: no")]


def test_retry_fallback_and_limit():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert runs.retried(flaky, sleep=waits.append)() == "ok" and waits == [1.0, 1.5]
    assert runs.fallback([lambda: 1 / 0, lambda: 5])() == 5
    now = [0.0]
    slow = runs.limited(lambda: now[0], 2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [slow(), slow()] == [0.0, 2.0]


def test_breaker_resets(spark):
    rows = [("a", k, True) for k in range(11)] + [("a", 11, False)] + [("a", k, True) for k in range(12, 23)]
    calls = spark.createDataFrame(rows, "key string, seq int, failed boolean")
    assert runs.breaker(calls, F.col("failed"), ("seq",)).count() == 0


def test_streams(spark, tmp_path, sf_dir):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    query = runs.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert spark.table("windows").count() == runs.tumbling(events).count()
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    running = runs.index_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "index"), str(tmp_path / "d"))
    running.processAllAvailable()
    spark.createDataFrame([(2, "c"), (3, "a")], docs.schema).write.mode("append").parquet(str(tmp_path / "docs"))
    running.processAllAvailable()
    running.stop()
    index = segments.load(spark, str(tmp_path / "index"))
    assert sorted(tuple(r) for r in segments.in_force(index).collect()) == [(1, "a", 1), (1, "b", 1), (2, "c", 1), (3, "a", 1)]
    assert index.stats.first().n == 3
    assert time.time() > 0
