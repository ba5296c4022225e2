"""Line dedup's tables: shuffles that go with their write, and ids with several texts."""

from __future__ import annotations

from docstrata.llm import _spark, linededup


def test_shuffles_go_with_their_write(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def count() -> int:
        return blocks.getAllBlocks().mkString("\n").count("shuffle_")

    before = count()
    out = _spark.written(spark.range(2000).repartition(7, "id"), "seven")
    assert count() <= before
    assert out.count() == 2000
    assert spark.conf.get(_spark.CLEANUP) == "false"


def test_lines_of_an_id_with_several_texts(spark):
    base = " ".join(f"x{i}" for i in range(40))
    near = base.replace("x39", "y")
    rows = [(1, f"{base}\nfirst one of these lines here"), (1, "other words on this line here\nfirst one of these lines here"), (2, near), (3, base)]
    got = {r.doc_id: r.removed_lines for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_removed}
    assert got == {2: [0], 3: [0]}
