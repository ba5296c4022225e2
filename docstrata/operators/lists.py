"""Ordered and unordered lists of Markdown texts as trees that keep the numbers of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .splitters import let

# Marks of list items, with their indentation (1), number (2) or bullet (3) and text (4); four blanks are a level.
ITEM = r"(?U)^([ \t]*)(?:(\d{1,18})[.)]|([*+-]))[ \t]+(\S.*)$"
BLOCK = 512

_OPEN = "array<struct<indent:int,at:int>>"
_OUT = "array<struct<line_no:int,parent:int,depth:int>>"


def _indent(blanks: Column) -> Column:
    """Columns of a line's blanks; a tab counts as four."""
    return F.length(F.replace(blanks, F.lit("\t"), F.lit("    ")))


def _kinds(lines: Column) -> Column:
    """``struct(at, kind, indent)`` of each line: 0 blank, 1 item, 2 text, 3 heading; ``blank`` tells whether a blank line is before it."""

    def kind(x: Column, i: Column) -> Column:
        what = F.when(x.rlike(r"(?U)^\s*$"), 0).when(x.rlike(ITEM), 1).when(x.rlike(r"^#{1,6}[ \t]"), 3).otherwise(2)
        return F.struct(i.alias("at"), what.alias("kind"), _indent(F.regexp_extract(x, r"^[ \t]*", 0)).alias("indent"), ((i > 0) & F.get(lines, i - 1).rlike(r"(?U)^\s*$")).alias("blank"))

    return F.transform(lines, kind)


def _nested(lines: Column) -> Column:
    """Parents and depths of the items of one text's lines: the nearest item before with a smaller indent, as long as no list has ended between.

    A fold with a stack of open items; results are gathered by blocks of lines, so the cost is linear
    in the text but for a share of ``1 / BLOCK``.
    """
    n = F.size(lines)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(lines, b * BLOCK + 1, BLOCK))

    def line(s: Column, x: Column) -> Column:
        ends = (x["kind"] == 3) | ((x["kind"] == 2) & x["blank"] & (x["indent"] == 0))
        left = F.filter(s["open"], lambda o: o["indent"] < x["indent"])
        item = F.struct(x["at"].alias("line_no"), F.get(left, F.size(left) - 1)["at"].alias("parent"), F.size(left).alias("depth"))
        opened = F.concat(left, F.array(F.struct(x["indent"].alias("indent"), x["at"].alias("at"))))
        return F.struct(
            F.when(x["kind"] == 1, opened).when(ends, F.array().cast(_OPEN)).otherwise(s["open"]).alias("open"),
            F.when(x["kind"] == 1, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"),
        )

    def block(s: Column, xs: Column) -> Column:
        start = F.struct(s["open"].alias("open"), F.array().cast(_OUT).alias("out"))
        return let(F.aggregate(xs, start, line), lambda r: F.struct(r["open"].alias("open"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    start = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(f"array<{_OUT}>").alias("out"))
    return F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"]))


def list_items(docs: DataFrame) -> DataFrame:
    """``(source, line_no, parent, depth, ordered, number, text)`` of every list item of ``docs(source, text)``.

    Lines count from 0.  ``parent`` is the line of the item that it is under, null at the top.
    ``number`` is the source's own, never counted anew; bullets have none.  A heading ends all lists,
    and so does text at the margin after a blank line; other text goes on with its item.  Null and
    empty texts have no items.  Everything happens within a row, without a shuffle.
    """
    lines = docs.select("source", F.transform(F.array(T.split_lines("text")), lambda x: F.struct(x.alias("lines"), _kinds(x).alias("kinds")))[0].alias("t"))
    found = lines.filter(F.exists("t.kinds", lambda x: x["kind"] == 1)).select("source", F.col("t.lines").alias("lines"), F.explode(_nested(F.col("t.kinds"))).alias("i"))
    one = found.select("source", "i.*", F.get("lines", "i.line_no").alias("line"))
    number = F.nullif(F.regexp_extract("line", ITEM, 2), F.lit("")).cast("long")
    return one.select("source", "line_no", "parent", "depth", number.isNotNull().alias("ordered"), number.alias("number"), F.regexp_extract("line", ITEM, 4).alias("text"))


def rendered_items(items: DataFrame) -> DataFrame:
    """``items`` with ``line``: four blanks a level, the source's number or a star, and the text."""
    mark = F.when(F.col("ordered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("* ")
    return items.withColumn("line", F.concat(F.repeat(F.lit("    "), F.col("depth")), mark, F.col("text")))


def ordinal_faults(items: DataFrame) -> DataFrame:
    """``(source, line_no, number, expected, fault)`` of numbered items that don't go on from the one before under the same parent.

    ``repeated``, ``back`` (smaller, as where a list starts anew) or ``gap``.  They are reported and stay as they are.
    Bullets between don't count; items at the top of a text are one list.
    """
    order = Window.partitionBy("source", "parent").orderBy("line_no")
    after = items.filter("ordered").withColumn("last", F.lag("number").over(order)).filter("last is not null and number <> last + 1")
    fault = F.when(F.col("number") == F.col("last"), "repeated").when(F.col("number") < F.col("last"), "back").otherwise("gap")
    return after.select("source", "line_no", "number", (F.col("last") + 1).alias("expected"), fault.alias("fault"))
