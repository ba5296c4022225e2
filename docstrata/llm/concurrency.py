"""Peak concurrency sweep (operator 13): how many intervals are open at every moment, per group.

Starts and ends are summed by (group, minute) first, which bounds a group's rows by its minutes,
however many intervals it has.  A chunk is 1,024 minutes of one group.  Each chunk has a lazy
range-add segment tree over its change moments: an interval adds to the moments from its start on
and takes away from those from its end on, and what is open when the chunk begins is added to the
whole range.  Tags stay on the nodes that a range covers; a moment's value is the sum of the tags
above it, and maxima of the open count go up, so that a prefix query gives the highest so far and
the root the chunk's peak.

What a chunk starts with follows from the sums of those before it.  These are added up level by
level, 1,024 siblings at a time, so no group, however long, goes through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from ._spark import dropped, written

#: Bits of a minute within its chunk, and of a node among its siblings.
BITS = 10
#: Levels of siblings above the chunks: the last one has all years that timestamps can have.
LEVELS = 3
EVERY = -2
UNKNOWN = -1


def minutes(df: DataFrame, column: str) -> Column:
    """Whole minutes since 1970, rounded down; a timestamp without a zone is UTC, whatever the session's zone is."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.unix_date(F.col(column).cast("date")).cast("long") * 1440 + F.hour(column) * 60 + F.minute(column)
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(60_000_000)).cast("long")


class RangeTree:
    """Segment trees of one size, a row each, with lazy range adds: counts, cents and the maximum of the counts below a node."""

    def __init__(self, trees: int, leaves: int):
        self.size = 1 << max(leaves - 1, 0).bit_length()
        self.n, self.cents = (np.zeros((trees, 2 * self.size), np.int64) for _ in range(2))
        self.most = np.zeros((trees, 2 * self.size), np.int64)

    def add(self, tree: np.ndarray, first: np.ndarray, n: np.ndarray, cents: np.ndarray) -> None:
        """Add to the leaves from ``first`` on: tags on the nodes that such a range is made of."""
        at, end = first + self.size, 2 * self.size
        while len(at):
            tag = at & 1 == 1  # a right child stands for its whole range; what is left begins with its neighbour
            np.add.at(self.n, (tree[tag], at[tag]), n[tag])
            np.add.at(self.cents, (tree[tag], at[tag]), cents[tag])
            at = at + tag
            go = at < end  # else the level has no more nodes
            tree, at, n, cents, end = tree[go], at[go] >> 1, n[go], cents[go], end >> 1

    def settle(self, leaves: np.ndarray) -> None:
        """Maxima from the leaves up; leaves from ``leaves`` on in each tree are none."""
        low = np.iinfo(np.int64).min // 2
        self.most[:, self.size :] = np.where(np.arange(self.size) < leaves[:, None], self.n[:, self.size :], low)
        level = self.size
        while level > 1:
            below = np.maximum(self.most[:, level : 2 * level : 2], self.most[:, level + 1 : 2 * level : 2])
            level >>= 1
            self.most[:, level : 2 * level] = below + self.n[:, level : 2 * level]

    def points(self, tree: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and cents at leaves: all tags above each."""
        at, n, cents = leaf + self.size, np.zeros(len(leaf), np.int64), np.zeros(len(leaf), np.int64)
        while len(at) and at[0] >= 1:
            n += self.n[tree, at]
            cents += self.cents[tree, at]
            at = at >> 1
        return n, cents

    def highest(self, tree: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Largest count among the leaves up to each one."""
        at = leaf + self.size
        out = self.most[tree, at].copy()
        while len(at) and at[0] > 1:
            left = np.where(at & 1 == 1, self.most[tree, at - 1], out)
            out = np.maximum(out, left) + self.n[tree, at >> 1]
            at = at >> 1
        return out

    def peak(self) -> np.ndarray:
        return self.most[:, 1]


def _trees(batch: pa.RecordBatch, base: bool):
    """The trees of a batch of chunks, and each moment's tree and leaf."""
    minute = batch.column("minute")
    sizes = np.diff(minute.offsets.to_numpy())
    tree = np.repeat(np.arange(len(sizes)), sizes)
    leaf = np.arange(len(tree)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    trees = RangeTree(len(sizes), int(sizes.max()))
    trees.add(tree, leaf, *(batch.column(c).flatten().to_numpy() for c in ("dn", "dcents")))
    if base:
        at = np.arange(len(sizes))
        trees.add(at, np.zeros(len(sizes), np.int64), *(batch.column(c).to_numpy() for c in ("base_n", "base_cents")))
    trees.settle(sizes)
    return trees, tree, leaf, sizes


_BATCH = 512


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, _BATCH):
        yield pa.RecordBatch.from_struct_array(pa.concat_arrays([batch.slice(k, _BATCH).to_struct_array()]))


PEAKS = "group_id int, chunk long, n long, cents long, top long, first long"


def _peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's sums, its peak above what it starts with, and its first moment."""
    for batch in batches:
        for part in _parts(batch):
            trees, tree, leaf, sizes = _trees(part, False)
            ends = np.cumsum(sizes)
            n, cents = trees.points(np.arange(len(sizes)), sizes - 1)
            first = part.column("minute").flatten().to_numpy()[ends - sizes]
            yield pa.record_batch([part.column("group_id"), part.column("chunk"), *(pa.array(x, pa.int64()) for x in (n, cents, trees.peak(), first))], names=[x.split(" ")[0] for x in PEAKS.split(", ")])


ROWS = "group_id int, from_s long, to_s long, n_open long, open_cents long, high_open long, is_peak boolean"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            trees, tree, leaf, sizes = _trees(part, True)
            n, cents = trees.points(tree, leaf)
            before, peak = (part.column(c).to_numpy() for c in ("high_before", "peak"))
            minute = part.column("minute").flatten().to_numpy()
            following = np.append(minute[1:], 0)
            ends = np.cumsum(sizes) - 1
            later = part.column("next_first").to_numpy(zero_copy_only=False)
            last = np.isnan(later.astype(np.float64))
            none = np.zeros(len(minute), bool)
            none[ends[last]] = True
            following[ends] = np.where(last, 0, np.nan_to_num(later.astype(np.float64))).astype(np.int64)
            group = part.column("group_id").to_numpy()[tree]
            yield pa.record_batch(
                [pa.array(group, pa.int32()), pa.array(minute * 60), pa.array(following * 60, mask=none), pa.array(n), pa.array(cents), pa.array(np.maximum(before[tree], trees.highest(tree, leaf))), pa.array(n == peak[tree])],
                names=[x.split(" ")[0] for x in ROWS.split(", ")],
            )


def _carried(nodes: DataFrame, levels: int) -> DataFrame:
    """For each node what those before it in its group sum up to, the highest count so far, the next node's first moment and the group's peak.

    ``nodes(group_id, chunk, n, cents, top, first)``; each window has the siblings of one parent.
    """
    parent = F.shiftright("chunk", BITS)
    w = Window.partitionBy("group_id", parent if levels else F.lit(0)).orderBy("chunk")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = nodes.select("*", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"before_{c}") for c in ("n", "cents")), F.lead("first").over(w).alias("sibling"))
    inside = inside.withColumn("reach", F.col("before_n") + F.col("top"))
    inside = inside.withColumn("high", F.max("reach").over(so_far))
    if not levels:
        whole = inside.withColumn("peak", F.max("reach").over(Window.partitionBy("group_id", F.lit(0))))
        return whole.select("group_id", "chunk", F.col("before_n").alias("base_n"), F.col("before_cents").alias("base_cents"), F.coalesce("high", F.lit(0)).alias("high_before"), F.col("sibling").alias("next_first"), "peak")
    above = inside.groupBy("group_id", parent.alias("chunk")).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("reach").alias("top"), F.min("first").alias("first"))
    above = _carried(above, levels - 1).select(F.col("group_id").alias("of_group"), F.col("chunk").alias("of"), "base_n", "base_cents", "high_before", "next_first", "peak")
    both = inside.join(above, (F.col("group_id") == F.col("of_group")) & (parent == F.col("of")))
    return both.select(
        "group_id", "chunk", (F.col("base_n") + F.col("before_n")).alias("base_n"), (F.col("base_cents") + F.col("before_cents")).alias("base_cents"),
        F.greatest("high_before", F.col("base_n") + F.col("high")).alias("high_before"), F.coalesce("sibling", "next_first").alias("next_first"), "peak",
    )


def sweep(changes: DataFrame) -> DataFrame:
    """``(group_id, from_s, to_s, n_open, open_cents, high_open, is_peak)``, a row for each group and moment at which either value changes.

    ``changes(group_id int, minute long, dn long, dcents long)``: what opens and closes; rows may come
    in any number and order.  ``to_s`` is the group's next moment, null for its last; ``high_open`` its
    largest count so far and ``is_peak`` whether it has its largest of all.  No rows give no rows.
    """
    ship(changes.sparkSession)
    moments = changes.groupBy("group_id", "minute").agg(F.sum("dn").alias("dn"), F.sum("dcents").alias("dcents")).filter("dn <> 0 or dcents <> 0")
    listed = F.array_sort(F.collect_list(F.struct("minute", "dn", "dcents")))  # 1,024 minutes at most
    chunks = moments.groupBy("group_id", F.shiftright("minute", BITS).alias("chunk")).agg(listed.alias("x"))
    chunks = written(chunks.select("group_id", "chunk", *(F.col(f"x.{c}").alias(c) for c in ("minute", "dn", "dcents"))), "chunks")
    carried = _carried(chunks.mapInArrow(_peaks, PEAKS), LEVELS)
    out = chunks.join(carried, ["group_id", "chunk"])
    return out.mapInArrow(_rows, ROWS)


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 7) -> DataFrame:
    """The sweep of open sales by their clients' nation, -1 where there is none, and of all as -2.

    A sale is open from ``sold_at`` until ``days`` after the last ``shipped_at`` of its lines, forever
    if there is none.  Every row of ``sales`` counts, so a repeated one counts again.  A sale without
    ``sold_at``, or that doesn't end after its start, is left out.  Lines without a sale or time, and
    totals that are null, NaN or infinite, add nothing.  A client_id with several rows has the least
    of their nations.  Only the columns named here are read.
    """
    shipped = lines.select(F.col("sale_id").alias("of_sale"), minutes(lines, "shipped_at").alias("shipped")).filter("of_sale is not null and shipped is not null")
    ends = shipped.groupBy("of_sale").agg((F.max("shipped") + days * 1440).alias("ends"))
    total = F.col("total").cast("double")
    real = total.isNotNull() & ~F.isnan(total) & (F.abs(total) != float("inf"))
    cents = F.when(real, F.floor(total * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    sold = sales.select("sale_id", "client_id", minutes(sales, "sold_at").alias("starts"), cents.alias("cents")).filter("starts is not null")
    held = sold.join(ends, sold["sale_id"] == ends["of_sale"], "left").filter("ends is null or ends > starts")
    # A client's changes come together before the nations do: a hot client has a row a minute at most.
    one = F.lit(1).cast("long")
    change = F.array(
        F.struct(F.col("starts").alias("minute"), one.alias("dn"), F.col("cents").alias("dcents")),
        F.struct(F.col("ends").alias("minute"), (-one).alias("dn"), (-F.col("cents")).alias("dcents")),
    )
    by_client = held.select("client_id", F.explode(change).alias("x")).filter("x.minute is not null")
    by_client = by_client.groupBy("client_id", F.col("x.minute").alias("minute")).agg(F.sum("x.dn").alias("dn"), F.sum("x.dcents").alias("dcents"))
    nations = clients.filter("client_id is not null").groupBy(F.col("client_id").alias("of_client")).agg(F.min(F.col("nation_id").cast("int")).alias("nation_id"))
    known = by_client.join(nations, by_client["client_id"] == nations["of_client"], "left")
    both = F.array(F.coalesce("nation_id", F.lit(UNKNOWN)), F.lit(EVERY))
    out = sweep(known.select(F.explode(both).alias("group_id"), "minute", "dn", "dcents"))
    return out.withColumnRenamed("group_id", "nation_id")
