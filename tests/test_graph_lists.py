"""Forward push against power iteration, list trees against a plain parser, identities and assembly on written cases."""

from __future__ import annotations

import random
import re

from docstrata.operators import assembly, graph, lists, push


def power(edges, seeds, damping=0.85, rounds=400):
    nodes = sorted({x for e in edges for x in e} | set(seeds))
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    restart = {n: (1 / len(seeds) if n in seeds else 0.0) for n in nodes}
    score = dict(restart)
    for _ in range(rounds):
        new = {n: (1 - damping) * restart[n] for n in nodes}
        for n in nodes:
            if out[n]:
                for b in out[n]:
                    new[b] += damping * score[n] / len(out[n])
            else:
                for s in seeds:
                    new[s] += damping * score[n] / len(seeds)
        score = new
    return score


def test_push_is_within_its_bound(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(30)}") for _ in range(90)] + [("n1", "n2")] * 3
    asked = {1: ["n1"], 2: ["n3", "n4"], 3: ["alone"], 4: ["n29"]}
    rows = [(q, s) for q, ss in asked.items() for s in ss] + [(1, "n1"), (None, "n1"), (5, None)]
    frame = spark.createDataFrame(edges + [(None, "n1"), ("n1", None)], "src string, dst string")
    for threshold in (2e-2,):
        found = push.forward_push(frame, spark.createDataFrame(rows, "question int, id string"), threshold).collect()
        assert {r.question for r in found} == set(asked)
        assert len({(r.question, r.id) for r in found}) == len(found)
        for q, seeds in asked.items():
            want, mine = power(edges, seeds), {r.id: r for r in found if r.question == q}
            bound = sum(r.residual for r in mine.values())
            assert abs(sum(r.score + r.residual for r in mine.values()) - 1) < 1e-9
            off = [want[n] - (mine[n].score if n in mine else 0.0) for n in want]
            assert min(off) > -1e-9 and abs(sum(off) - bound) < 1e-9
            degree = {n: sum(a == n for a, _ in edges) for n in want}
            assert all(r.residual <= threshold * max(degree[n], 1) for n, r in mine.items())


def test_hubs_are_never_pushed_and_empty_inputs_give_nothing(spark):
    edges = spark.createDataFrame([("h", f"x{k}") for k in range(200)] + [("a", "h"), ("h", "a")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "question int, id string")
    assert push.push_links(edges, 0.01).filter("src = 'h'").isEmpty()
    found = {r.id: (r.score, r.residual) for r in push.forward_push(edges, seeds, 0.01).collect()}
    assert found.keys() == {"a", "h"} and abs(found["h"][1] - 0.85) < 1e-12
    assert push.forward_push(edges, seeds.limit(0), 0.05).isEmpty()
    alone = push.forward_push(edges.limit(0), seeds, 0.05).collect()
    assert [r.id for r in alone] == ["a"] and alone[0].score >= 0.95


def test_merge_keeps_each_channel_and_its_threshold(spark):
    make = lambda rows: spark.createDataFrame(rows, "question int, id string, score double")
    exact, near = make([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0)]), make([(1, "b", 0.9), (1, "c", 0.4), (1, "z", 0.0)])
    vector = make([(1, "c", 0.65), (1, "d", 0.64), (2, "e", 0.9)])
    rows = [tuple(r) for r in push.merged(exact, near, vector).orderBy("question", "rank").collect()]
    assert [(q, i, rank, first) for q, i, _, rank, first in rows] == [(1, "b", 1, "exact"), (1, "c", 2, "push"), (1, "a", 3, "exact"), (2, "e", 1, "vector")]
    assert abs(rows[0][2] - (1 / 62 + 1 / 61)) < 1e-9


def plain_items(text):
    stack, out, before = [], [], ""
    for at, line in enumerate(text.split("\n")):
        m = re.match(r"^([ \t]*)(?:(\d{1,18})[.)]|([*+-]))[ \t]+(\S.*)$", line)
        indent = len(re.match(r"[ \t]*", line)[0].replace("\t", "    "))
        if m:
            while stack and stack[-1][0] >= indent:
                stack.pop()
            out.append((at, stack[-1][1] if stack else None, len(stack), m[2] is not None, int(m[2]) if m[2] else None, m[4]))
            stack.append((indent, at))
        elif re.match(r"#{1,6}[ \t]", line) or (line.strip() and indent == 0 and at and not before.strip()):
            stack = []
        before = line
    return out


def test_lists_against_a_plain_parser(spark):
    rng = random.Random(2)
    parts = ["{}. a", "{}) b c", "- d", "* e", "+ f", "", "text", "# head", "-none", "{}.none"]
    texts = {k: "\n".join(" " * rng.choice((0, 0, 2, 4, 8)) + rng.choice(parts).format(rng.randrange(9)) for _ in range(rng.randrange(1, 60))) for k in range(60)}
    texts[60] = "\n".join(f"{' ' * (k % 9)}{k}. x" for k in range(3 * lists.BLOCK + 5))
    texts[61] = "\t1. tab\n\t\t- two\n    2. four"
    rows = list(texts.items()) + [(62, None), (63, "")]
    found = lists.list_items(spark.createDataFrame(rows, "source int, text string")).collect()
    got = {k: sorted(tuple(r)[1:] for r in found if r.source == k) for k, _ in rows}
    for k, text in rows:
        # A last line end makes no line, which changes no item.
        assert got[k] == plain_items(text or ""), k


def test_ordinals_are_kept_and_told(spark):
    text = "3. a\n4. b\n    1. c\n    1. d\n- e\n7. f\n2. g\n3. h"
    items = lists.list_items(spark.createDataFrame([(1, text)], "source int, text string"))
    assert [r.number for r in items.orderBy("line_no").collect()] == [3, 4, 1, 1, None, 7, 2, 3]
    faults = [tuple(r)[1:] for r in lists.ordinal_faults(items).orderBy("line_no").collect()]
    assert faults == [(3, 1, 2, "repeated"), (5, 7, 5, "gap"), (6, 2, 8, "back")]
    assert [r.line for r in lists.rendered_items(items).orderBy("line_no").collect()][2:5] == ["    1. c", "    1. d", "* e"]


ENTITY = "chunk_id string, position int, name string, category string, target string"


def test_external_entities_come_first_and_categories_are_known(spark):
    told = spark.createDataFrame([("c", 1, "A", "X", None), ("c", 2, "B", None, None), ("c", 3, " ", "Sanction", None), ("c", 4, None, "Sanction", None), ("c", 5, "A", "Sanction", None)], ENTITY)
    outside = spark.createDataFrame([("c", 9, "A", "Sanction", None)], ENTITY)
    out = assembly.cleaned_entities(told, outside, spark.createDataFrame([("Sanction",), (None,)], "label string"))
    assert [(r.name, r.category) for r in out.orderBy("position").collect()] == [("A", "Sanction"), ("A", "Others"), ("B", "Others")]


def test_identities_of_conflicts_and_shared_places(spark):
    rows = [
        ("c", 1, "One", "Sanction", "s:1"), ("c", 2, "ONE", "Sanction", "s:1"), ("c", 3, "Two", "Sanction", "s:2"), ("c", 4, "two", "Sanction", "s:3"), ("c", 5, "Three", "Sanction", "s:2"),
        ("c", 6, "Four", "Sanction", "s:4"), ("c", 7, "four.", "Sanction", None), ("c", 8, "Ministry", "Authority", "a:1"), ("c", 9, "The Ministry", "Authority", "a:1"), ("c", 10, "Thing", "Others", None),
        ("c", 11, "!!", "Sanction", "s:9"), ("c", 12, "Five", "Sanction", None), ("d", 1, "Three", "Sanction", "s:2"),
    ]
    found = {(r.chunk_id, r.key): r for r in assembly.identities(spark.createDataFrame(rows, ENTITY)).collect()}
    assert {k[1]: r.reason for k, r in found.items() if k[0] == "c"} == {
        "one": "target", "two": "conflict", "three": "shared", "four": "conflict", "ministry": "target", "the ministry": "target", "thing": "name", "five": "no target",
    }
    assert found["c", "one"].id == "s:1" and found["d", "three"].id == "s:2" and found["c", "the ministry"].id == "a:1"
    assert all(found["c", k].id.startswith("sanction-unresolved:") for k in ("two", "three", "four", "five"))
    assert len({r.id for k, r in found.items() if k[0] == "c"}) == 7


def test_assembly_of_one_chunk(spark, tmp_path):
    chunks = spark.createDataFrame([("c", "x.md", "x", "Luật X", "article:x:1", 1, "Điều 1"), ("e", "y.md", "y", None, None, None, None)], "chunk_id string, source_path string, document_id string, document_name string, article_id string, article_no int, heading string")
    entities = spark.createDataFrame([("c", 1, "Điều 1", "Article", "article:x:1"), ("c", 2, "Phạt", "Sanction", None), ("c", 3, "Bộ Y", "Authority", "authority:bộ y"), ("c", 4, "bộ y", "LegalTerm", None)], ENTITY)
    triples = [("Điều 1", "IMPOSES", "phạt"), ("Điều 1", None, "phạt"), ("Điều 1", "source", "phạt"), ("phạt", "imposes", "Điều 1"), ("Điều 1", "imposes", "Bộ Y"), ("Điều 1", "imposes", "Ai")]
    rows = assembly.assembled(chunks, entities, spark.createDataFrame([("c", *t) for t in triples], "chunk_id string, subject string, predicate string, object string"))
    assert rows.schema.simpleString() == spark.createDataFrame([], assembly.ROW).schema.simpleString()
    path = str(tmp_path / "graph")
    assembly.write_assembled(rows, path)
    back = spark.read.parquet(path)
    assert sorted(r.status for r in back.filter("outcome = 'reject'").collect()) == ["AMBIGUOUS_BINDING", "INVALID_ENDPOINT_TYPES", "MALFORMED", "UNKNOWN_PREDICATE", "UNRESOLVED_ENDPOINT"]
    edges = back.filter("outcome = 'edge'").collect()
    nodes = {(r.src, r.src_label) for r in back.filter("outcome = 'node'").collect()}
    assert all((e.src, e.src_label) in nodes and (e.dst, e.dst_label) in nodes for e in edges)
    told = {e.relation: e for e in edges if e.status != "SYSTEM"}
    assert told.keys() == {"imposes", "belongsTo"} and told["belongsTo"].dst == "luật x"
    assert told["imposes"].properties["originalPredicate"] == "IMPOSES" and told["imposes"].properties["evidenceStatus"] == "UNVERIFIED"
    assert told["imposes"].properties["sourceArticleId"] == "article:x:1"
    merged = graph.merged_nodes(back.filter("outcome = 'node'").selectExpr("src as id", "src_label as label", "1 as position", "properties"))
    assert merged.count() == len(nodes)
    none = assembly.assembled(chunks.limit(0), entities.limit(0), spark.createDataFrame([], "chunk_id string, subject string, predicate string, object string"))
    assert none.isEmpty()
