"""Benchmark decontamination by spaced seeds (operator 10).

After Ma, Tromp & Li, "PatternHunter" (2002): fixed masks pick some of the tokens of a window and
ignore the others, so a window still matches if only ignored tokens were substituted.  Hashes of
all masked windows of the benchmark meet those of every document; around each hit the two texts are
compared token by token on the hit's diagonal, and any long enough window with few substitutions
decides.

The benchmark is read in chunks of a bounded number of tokens.  Each chunk is a broadcast table; a
larger benchmark makes several passes over the corpus.  No single table grows with the benchmark,
but the passes do, and so does their sum, since the broadcasts of all chunks live until the job
ends.  Only the documents with an overlap leave a pass; they are gathered by doc_id and digest of
the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import documents, prepared

#: 1 is a token that must agree, 0 one that may differ.  Each has six that must agree.
MASKS = ("111111", "1101011001", "1110010101001", "101100100111")
#: Items of fewer tokens get masks by their length.
SHORT = 15
CHUNK_TOKENS = 250_000
_PREFILTER = 1 << 22
_HITS = 1 << 20

# Letters, digits and bytes of non-ASCII characters are token bytes; ASCII capitals are lowered.
_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    folded = _FOLD[raw]
    starts, ends, rows = _text.word_spans(folded, offsets)
    return _text.hash_spans(folded, starts, ends), rows


def _mask_picks(size: int, share: float) -> list[tuple[int, ...]]:
    """The masks of an item of ``size`` tokens.

    Short items, which only count as a whole, have masks of their own: with ``lost`` substitutions
    allowed, two more blocks than that, and a mask for every choice of ``lost`` blocks to ignore.
    One of them always agrees.
    """
    if size >= SHORT:
        return [tuple(k for k, c in enumerate(m) if c == "1") for m in MASKS]
    lost = int((1 - share) * size + 1e-9)
    blocks = np.array_split(range(size), min(size, lost + 2)) if lost else [range(size)]
    return [tuple(int(k) for b in kept for k in b) for kept in combinations(blocks, len(blocks) - lost)]


class Seeds:
    """Masked window hashes of one chunk of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], share: float = 0.8):
        self.items = items
        tables: dict[tuple[int, ...], list[np.ndarray]] = {}
        for k, (_, tokens) in enumerate(items):
            for picks in _mask_picks(len(tokens), share):
                at = np.arange(len(tokens) - picks[-1] if len(tokens) >= SHORT else 1)
                rows = np.stack([_text.combine(tokens, at, picks, 99), np.full(len(at), k, np.uint64), at.astype(np.uint64)])
                tables.setdefault(picks, []).append(rows)
        self.tables = {}
        for picks, parts in tables.items():
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            maybe = np.zeros(_PREFILTER, bool)
            maybe[(rows[0] & np.uint64(_PREFILTER - 1)).astype(np.int64)] = True
            self.tables[picks] = (rows[0], rows[1].astype(np.int64), rows[2].astype(np.int64), maybe)

    def hits(self, tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distinct (row, item, diagonal) with a hit, sorted by row."""
        out = []
        row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for picks, (keys, items, places, maybe) in self.tables.items():
            span = picks[-1]
            at = np.arange(max(0, len(tokens) - span))
            at = at[row_of[at] == row_of[at + span]] if len(at) else at
            made = _text.combine(tokens, at, picks, 99)
            some = maybe[(made & np.uint64(_PREFILTER - 1)).astype(np.int64)]
            at, made = at[some], made[some]
            low, high = np.searchsorted(keys, made, "left"), np.searchsorted(keys, made, "right")
            n = high - low
            # A run of one repeated word meets all places of such a run: a bounded number of hits at a time.
            edge = 0
            total = np.cumsum(n)
            while edge < len(n) and total[-1]:
                stop = max(edge + 1, int(np.searchsorted(total, (total[edge - 1] if edge else 0) + _HITS, "right")))
                some, edge = slice(edge, stop), stop
                m = n[some]
                if m.sum():
                    entry = np.repeat(low[some], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    where = np.repeat(at[some], m)
                    row = row_of[where]
                    out.append(_distinct(row, items[entry], where - rows[row] - places[entry]))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def _distinct(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Distinct (row, item, diagonal)."""
    low = int(diagonal.min())
    wide, tall = int(diagonal.max()) - low + 1, int(item.max()) + 1
    if (int(row.max()) + 1) * tall * wide >= 1 << 62:
        return np.unique(np.stack([row, item, diagonal], axis=1), axis=0)
    key = np.unique((row * tall + item) * wide + (diagonal - low))
    pair = key // wide
    return np.stack([pair // tall, pair % tall, key % wide + low], axis=1)


def best_window(same: np.ndarray, share: float, least: int) -> int:
    """Most matched tokens of any window of ``least`` tokens or more of which at least ``share`` match; 0 if there is none.

    Prefix sums of match - share: a window qualifies if they don't fall over it.  For each end the
    earliest such start, where the running minimum gets as low, gives the most matches.
    """
    if len(same) < least:
        return 0
    total = np.concatenate([[0.0], np.cumsum(same - share)])
    low = np.minimum.accumulate(total)
    start = np.searchsorted(-low, -total[least:] - 1e-9)
    stop = np.arange(least, len(total))
    good = stop - start >= least
    matched = np.concatenate([[0], np.cumsum(same)])
    return int((matched[stop] - matched[start])[good].max(initial=0))


def _overlaps(tokens: np.ndarray, rows: np.ndarray, seeds: Seeds, share: float, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, matched tokens) of each verified overlap."""
    for row, item, diagonal in seeds.hits(tokens, rows).tolist():
        own, test = tokens[rows[row] : rows[row + 1]], seeds.items[item][1]
        start, stop = max(0, -diagonal), min(len(test), len(own) - diagonal)
        matched = best_window(test[start:stop] == own[start + diagonal : stop + diagonal], share, min(least, len(test)))
        if matched:
            yield row, item, matched


def _chunks(benchmark: DataFrame, budget: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        tokens, _ = _tokens(*_text.buffer_of(pa.array([row[1]], pa.string())))
        if len(tokens):
            held.append((row[0], tokens))
            size += len(tokens)
        if size >= budget:
            yield held
            held, size = [], 0
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, least: int = 16, budget: int = CHUNK_TOKENS) -> DataFrame:
    """``(doc_id, contaminated, n_items, overlap_tokens, item_ids)`` for every row of ``docs``.

    A document is contaminated by an item if some run of at least ``least`` tokens (or the whole of
    a shorter item) agrees in at least ``share`` of its tokens.  ``overlap_tokens`` is the largest
    number of tokens that agree.  Null or empty texts and items overlap with nothing; an item that
    is there twice counts under each of its ids.  Repeated rows are judged each on their own.
    """
    context = docs.sparkSession.sparkContext
    own, schema = documents(docs), "doc_id long, mark string, overlap_tokens int, item_ids array<long>"
    chunks = [context.broadcast(items) for items in _chunks(benchmark, budget)]
    if len(chunks) == 1:
        out = own.withColumn("mark", F.lit(None).cast("string")).select("doc_id", "text", "mark").mapInArrow(_judge(chunks[0], share, least), schema)
    else:  # repeated rows have the same finds in every pass, so their doc_id and text say whose these are
        own = own.withColumn("mark", F.md5("text"))
        parts = [own.mapInArrow(_judge(c, share, least), schema).filter("overlap_tokens > 0") for c in chunks]
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
        found = found.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.max("overlap_tokens").alias("overlap_tokens"), ids)
        out = own.select("doc_id", "mark").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
        out = out.withColumn("overlap_tokens", F.coalesce("overlap_tokens", F.lit(0))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<long>")))
    n = F.size("item_ids")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "overlap_tokens", "item_ids")


def _judge(shared, share: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(shared.value, share)
        for batch in batches:
            most, found = _scan(batch.column(1), seeds, share, least)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(most, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "mark", "overlap_tokens", "item_ids"])

    return run


def _scan(column: pa.Array, seeds: Seeds, share: float, least: int) -> tuple[list[int], list[list[int]]]:
    raw, offsets = _text.buffer_of(column)
    most, found = [0] * len(column), [set() for _ in range(len(column))]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (2 << 20), side="right")) - 1)
        tokens, rows = _tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for row, item, matched in _overlaps(tokens, rows, seeds, share, least):
            most[i + row] = max(most[i + row], matched)
            found[i + row].add(seeds.items[item][0])
        i = j
    return most, [sorted(x, key=lambda v: (v is None, v)) for x in found]


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, least: int = 16, budget: int = CHUNK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    prepared(docs.sparkSession)
    kept = docs
    for items in _chunks(benchmark, budget):
        pure = _pure(docs.sparkSession.sparkContext.broadcast(items), share, least)
        kept = kept.filter(pure(F.col("text").cast("string")))
    return kept


def _pure(shared, share: float, least: int):
    @F.arrow_udf("boolean")
    def pure(text: pa.Array) -> pa.Array:
        most, _ = _scan(text, _seeds_of(shared, share), share, least)
        return pa.array([m == 0 for m in most], pa.bool_())

    return pure


def _seeds_of(shared, share: float) -> Seeds:
    """The seeds of a broadcast, made once per task."""
    if getattr(shared, "_seeds", None) is None:
        shared._seeds = Seeds(shared.value, share)
    return shared._seeds
