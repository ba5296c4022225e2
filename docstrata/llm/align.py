"""Alignment of two tokenizers over the same bytes (operator 11).

Byte-level BPE (A) and a merge-type piece vocabulary (B) both tile a space and the text.  B's tokens
are a static interval index, sorted by start and by end at once; every A token stabs it with two
bisections, which give the run of B tokens that it overlaps.  Where no B token lies in the runs of
two neighbouring A tokens, no token spans the gap between them, and a group ends there.

A text is cut where both tokenizers cut it anyhow, so nothing overlaps across chunks; each worker
aligns the distinct chunks of an Arrow batch and keeps them in a table of bounded size.  How many
documents hold a linked pair of ids is counted by blocks: a block is one Arrow batch of texts and
names its distinct pairs once, its documents refer to them by number.  So counts are shuffled by
(block, pair), where a pair that every document has stands once a block, and come back to the block.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import documents, written
from .bpe import ChunkEncoder, chunk_spans, encoder
from .pieces import ChunkTable, PieceModel, piece_model, spaced


class Intervals:
    """Disjoint intervals in order, for stabbing: both their starts and their ends are sorted."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def overlaps(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the intervals that share a point with each [start, end)."""
        return np.searchsorted(self.ends, starts, side="right"), np.searchsorted(self.starts, ends, side="left")


def _tiles(width: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(width[ids])
    return ends - width[ids], ends


class Pair:
    """Both tokenizers, and the alignment of chunks."""

    def __init__(self, a_path: str, b_path: str):
        a = encoder(a_path)
        if not isinstance(a, ChunkEncoder):
            raise ValueError("the first tokenizer must be byte-level BPE")
        self.a: ChunkEncoder = a
        self.b: PieceModel = piece_model(b_path)

    def _a_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all chunks, and how many each has.  Chunks that white space begins and doesn't end are still chunks when joined."""
        joins = np.array([len(c) > 1 and c[0] in " \n" and c[-1] > " " and c[-1] != "\x7f" and not c[-1].isspace() for c in chunks], bool)
        size = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        first, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        ids = np.asarray(self.a.fast.encode_ordinary("".join([chunks[k] for k in first.tolist()])), np.int64)
        alone = [self.a.fast.encode_ordinary(chunks[k]) for k in rest.tolist()]
        count = np.zeros(len(chunks), np.int64)
        count[first] = np.diff(np.searchsorted(np.cumsum(self.a.width[ids]), np.cumsum(size[first])) + 1, prepend=0)
        count[rest] = [len(x) for x in alone]
        at = np.cumsum(count) - count
        out = np.zeros(count.sum(), np.int64)
        out[_ranges(at[first], count[first])] = ids
        out[_ranges(at[rest], count[rest])] = [i for x in alone for i in x]
        return out, count

    def chunks(self, chunks: list[str]) -> Aligned:
        a, a_count = self._a_ids(chunks)
        b_ids = self.b.many_ids(chunks)
        self.b.verified(chunks, b_ids)
        b_count = np.fromiter(map(len, b_ids), np.int64, len(chunks))
        b = np.fromiter((i for x in b_ids for i in x), np.int64, b_count.sum())
        # Chunks that the tokens of both spell: their lengths differ for any other.
        size = np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks))
        good = (_sums(self.a.width[a], a_count) == size) & (_sums(self.b.width[b], b_count) == size)
        a, b = a[np.repeat(good, a_count)], b[np.repeat(good, b_count)]
        a_count, b_count = a_count * good, b_count * good
        low, high = Intervals(*_tiles(self.b.width, b)).overlaps(*_tiles(self.a.width, a))
        run = high - low  # a link for each overlap
        links = np.repeat(a, run) << 32 | b[_ranges(low, run)]
        # The gap after an A token ends a group if no B token spans it.
        last = np.flatnonzero(np.append(high[:-1] <= low[1:], True)) if len(a) else np.zeros(0, np.int64)
        a_end, b_end = np.append(0, np.cumsum(a_count)), np.append(0, np.cumsum(b_count))
        groups = np.searchsorted(last + 1, a_end, side="right")
        return Aligned(good, a, b, a_end, b_end, last + 1, high[last], groups, links, np.append(0, np.cumsum(run))[a_end])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` for each of the counts, one after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    stop = np.cumsum(count)
    return total[stop] - total[stop - count]


class Aligned(NamedTuple):
    """The alignment of many chunks, laid end to end; ``good`` are those that both tokenizers spell, the others have nothing."""

    good: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray  # each chunk's first token, and the end
    b_end: np.ndarray
    a_stop: np.ndarray  # where each group ends in both
    b_stop: np.ndarray
    groups: np.ndarray  # each chunk's first group, and the end
    links: np.ndarray  # A id << 32 | B id
    link_end: np.ndarray


@functools.lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _entries(pair: Pair, chunks: list[str]) -> list[tuple[int, int, int, bytes, bytes] | None]:
    """For each chunk how many tokens and groups it has, its groups as ``a1,a2|b1;a3|b2`` and its links; None if they don't spell it."""
    x = pair.chunks(chunks)
    a, b = list(map(str, x.a.tolist())), list(map(str, x.b.tolist()))
    spelled, i, j = [], 0, 0
    for p, q in zip(x.a_stop.tolist(), x.b_stop.tolist(), strict=True):
        spelled.append(f"{a[i]}|{b[j]}" if p - i == 1 and q - j == 1 else ",".join(a[i:p]) + "|" + ",".join(b[j:q]))
        i, j = p, q
    links, ends = x.links.tobytes(), (x.link_end * 8).tolist()
    groups, n_a, n_b = x.groups.tolist(), np.diff(x.a_end).tolist(), np.diff(x.b_end).tolist()
    return [
        (n_a[k], n_b[k], groups[k + 1] - groups[k], ";".join(spelled[groups[k] : groups[k + 1]]).encode(), links[ends[k] : ends[k + 1]]) if good else None
        for k, good in enumerate(x.good.tolist())
    ]


def _lists(pair: Pair, chunks: list[str]) -> list[tuple[list[int], list[int], list[tuple[int, int]]] | None]:
    """For each chunk the ids of both and the ends of its groups in both."""
    x = pair.chunks(chunks)
    a, b, a_end, b_end, groups = (y.tolist() for y in (x.a, x.b, x.a_end, x.b_end, x.groups))
    stops = list(zip(x.a_stop.tolist(), x.b_stop.tolist(), strict=True))
    return [
        (a[a_end[k] : a_end[k + 1]], b[b_end[k] : b_end[k + 1]], [(p - a_end[k], q - b_end[k]) for p, q in stops[groups[k] : groups[k + 1]]]) if good else None
        for k, good in enumerate(x.good.tolist())
    ]


@functools.lru_cache(maxsize=4)
def _table(a_path: str, b_path: str, made) -> ChunkTable:
    return ChunkTable(functools.partial(made, _pair(a_path, b_path)))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[x for x in range(33, 127) if not chr(x).isalnum()]] = True


def common_spans(raw: np.ndarray, offsets: np.ndarray, never: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that both tokenizers encode on their own: A's, cut between a letter and a mark, too, where B's merges never cross."""
    starts, _, _ = chunk_spans(raw, offsets)
    before, here = raw[:-1], raw[1:]
    marks = np.flatnonzero(_LETTER[before] & _MARK[here] & never.ravel()[(before.astype(np.uint16) << 8) | here]) + 1
    starts = np.union1d(starts, marks)
    return starts, np.append(starts[1:], len(raw)) if len(raw) else starts, np.searchsorted(starts, offsets)


def _found(a_path: str, b_path: str, made, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """The table's entries, the entry of each chunk, and each row's first chunk."""
    table = _table(a_path, b_path, made)
    raw, offsets = _text.buffer_of(spaced(column))
    starts, ends, rows = common_spans(raw, offsets, _pair(a_path, b_path).b.never)
    found = table.found(raw, starts, ends)
    return table.entries, found, rows


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: int, b_end: int>>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, a_ids, b_ids, groups)`` for every row: the ids of both tokenizers, and where each group ends in both lists.

    Texts that are null or empty, and those whose tokens don't spell them (a literal U+2581 reads as
    a space), have empty lists.  Repeated rows and null doc_ids are kept as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, found, rows = _found(a_path, b_path, _lists, batch.column(1))
            out: list[list] = [[], [], []]
            for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                a, b, ends = [], [], []
                parts = [entries[k] for k in found[i:j].tolist()]
                for ids, pieces, stops in [] if None in parts else parts:
                    ends += [{"a_end": len(a) + x, "b_end": len(b) + y} for x, y in stops]
                    a += ids
                    b += pieces
                for column, value in zip(out, (a, b, ends), strict=True):
                    column.append(value)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))]
            yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "a_ids", "b_ids", "groups"])

    return documents(docs).mapInArrow(run, ALIGNED)


BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, which array<int>, times array<int>"


def _ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def _counts(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights."""
    by = np.argsort(keys, kind="stable")
    keys, weights = keys[by], weights[by]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(weights, new) if len(new) else weights


def _block(a_path: str, b_path: str, doc_ids: pa.Array, texts: pa.Array, number: int) -> pa.RecordBatch:
    """A row for each document, and one with the block's pairs and how many of its documents hold each."""
    entries, found, rows = _found(a_path, b_path, _entries, texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(rows))
    used, which = np.unique(found, return_inverse=True)
    held = [entries[k] for k in used.tolist()]
    sizes = np.array([(0, 0, 0, 0) if e is None else (*e[:3], len(e[4]) // 8) for e in held], np.int64).reshape(-1, 4)
    # A text with a chunk that isn't spelled has no tokens.
    bad = np.zeros(n, bool)
    bad[row[np.array([e is None for e in held], bool)[which]]] = True
    stay = ~bad[row]
    totals = [np.bincount(row[stay], sizes[which[stay], k], n).astype(np.int64) for k in range(4)]
    words = [b"" if e is None else e[3] for e in held]
    digests = []
    for k, (i, j) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        digests.append("" if bad[k] or i == j else hashlib.sha256(b";".join([words[x] for x in which[i:j].tolist()])).hexdigest())
    # Distinct chunks of each document, then their links.
    keys, times = np.unique(row[stay] * max(len(held), 1) + which[stay], return_counts=True)
    owner, chunk = np.divmod(keys, max(len(held), 1))
    links = np.frombuffer(b"".join([e[4] for e in held if e is not None]), np.int64)
    pairs, link_pair = np.unique(links, return_inverse=True)
    first = np.cumsum(sizes[:, 3]) - sizes[:, 3]
    run = sizes[chunk, 3]
    keys, times = _counts(np.repeat(owner, run) * max(len(pairs), 1) + link_pair[_ranges(first[chunk], run)], np.repeat(times, run))
    owner, pair = np.divmod(keys, max(len(pairs), 1))
    per_doc = np.bincount(owner, minlength=n)
    in_docs = np.bincount(pair, minlength=len(pairs))
    real = np.flatnonzero(in_docs)  # pairs that only texts without tokens would have are none
    renumbered = np.cumsum(in_docs > 0) - 1
    none = np.zeros(1, np.int64)
    columns = [
        pa.array(np.full(n + 1, number), pa.int64()), pa.concat_arrays([doc_ids.cast(pa.int64()), pa.nulls(1, pa.int64())]),
        *(pa.array(np.append(x, 0), pa.int64()) for x in totals), pa.array([*digests, None], pa.string()),
        _ragged(pairs[real], np.append(np.zeros(n, np.int64), len(real)), pa.int64()),
        _ragged(renumbered[pair], np.append(per_doc, none), pa.int32()), _ragged(np.append(times, in_docs[real]), np.append(per_doc, len(real)), pa.int32()),
    ]
    return pa.record_batch(columns, names=[x.split(" ")[0] for x in BLOCKS.split(", ")])


def _scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block, with what the counts of its pairs sum up to."""
    counts, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
    at = right["place"].to_numpy()
    counts[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy()
    which, times = (left[c].combine_chunks() for c in ("which", "times"))
    sizes = np.diff(which.offsets.to_numpy())
    row = np.repeat(np.arange(left.num_rows), sizes)
    place, weight = which.flatten().to_numpy(), times.flatten().to_numpy()
    sums = [np.zeros(left.num_rows, np.int64) for _ in range(2)]
    np.add.at(sums[0], row, weight * best[place])
    np.add.at(sums[1], row, weight * counts[place])
    out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
    return out.append_column("groups_sha256", left["groups_sha256"])


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def blocks_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows for documents, with the places of their pairs, and one row for each block with its pairs; written, so that block numbers hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches):
            if batch.num_rows:
                yield _block(a_path, b_path, batch.column(0), batch.column(1), base + k)

    return written(documents(docs).mapInArrow(run, BLOCKS), "blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, count, best)``: how many documents hold each pair, and whether none of its A id's pairs is in more."""
    listed = blocks.filter("groups_sha256 is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # as many rows as B has ids at most
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row.

    ``count_sum`` adds up, over the links of a document, how many documents hold the link's pair of
    ids; ``n_best`` counts the links whose pair no other pair of the same A id exceeds, ties included.
    A text without tokens (as in ``aligned``) has zeros and an empty digest.  Every row counts as a
    document of its own, repeated or not, and keeps its doc_id, null or not.
    """
    blocks = blocks_of(docs, a_path, b_path)
    listed = blocks.filter("groups_sha256 is null").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    back = listed.join(pair_counts(blocks), "pair").select("of_block", "place", "count", "best")
    of = blocks.filter("groups_sha256 is not null").drop("pairs")
    return of.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_scored, REPORT)
