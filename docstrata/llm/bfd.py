"""Best-fit-decreasing packing with a segment tree over capacities (operator 6).

Blocks of pieces, longest first, each go to the open sequence with the least room that suffices.  A
segment tree over room sizes answers that search in log(length) steps.  Overlong documents are split
losslessly: full-length pieces fill sequences of their own, the rest is packed.  The result is a
matrix row of ids per sequence (padded), cumulative segment lengths and position ids that start
again at each segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import documents
from .bpe import encoder
from .packing import _sequence_base


class CapacityTree:
    """Counts of open bins by room left; finds the smallest room of at least a size."""

    def __init__(self, length: int):
        self.width = 1 << (length + 1 - 1).bit_length() if length else 1
        self.width = max(self.width, 1 << length.bit_length())
        self.tree = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _bump(self, room: int, by: int) -> None:
        k = room + self.width
        while k:
            self.tree[k] += by
            k >>= 1

    def push(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._bump(room, 1)

    def pop(self, size: int) -> tuple[int, int] | None:
        """Room and bin of the best fit for ``size``, taken out; None if none has room."""
        k, tree = size + self.width, self.tree
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):  # up to the first right neighbour that has bins
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k <<= 1
                k += not tree[k]
        room = k - self.width
        self._bump(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> tuple[list[int], int]:
    """Bin of each size (all at most ``length``) and the number of bins."""
    tree, place, bins = CapacityTree(length), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.pop(sizes[k])
        room, b = found if found else (length, bins)
        bins += found is None
        place[k] = b
        tree.push(room - sizes[k], b)
    return place, bins


SCHEMA = (
    "sequence_id long, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, n_tokens int, "
    "input_ids array<int>, position_ids array<int>"
)


def pack_best_fit(
    docs: DataFrame, tokenizer: str, length: int = 1024, pad: int = 0, terminator: int = 0, block: int = 4096, digest: bool = False
) -> DataFrame:
    """One row per sequence, for ``docs`` with doc_id and text (null text: empty, just the terminator).

    ``block`` pieces are packed together, so memory is bounded by block x length ids.  With
    ``digest`` the two matrices are replaced by their CRC-32 over unsigned little-endian 32-bit ids.
    Repeated rows are packed again; empty tables give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = encoder(tokenizer), _sequence_base(), 0
        waiting: list[tuple] = []

        def emit(groups: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for group in groups:
                sizes = [len(x[2]) for x in group]
                ids, places = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
                total = sum(sizes)
                ids[:total] = np.concatenate([x[2] for x in group])
                places[:total] = np.concatenate([np.arange(s) for s in sizes])
                row = (base + made, [x[0] for x in group], [x[1] for x in group], np.cumsum([0, *sizes]).tolist(), total)
                rows.append((*row, zlib.crc32(ids), zlib.crc32(places)) if digest else (*row, ids.astype(np.int32), places.astype(np.int32)))
                made += 1
            last = pa.int64() if digest else pa.list_(pa.int32())
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), last, last]
            names = ["sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", *_last(digest)]
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def packed() -> pa.RecordBatch:
            place, bins = best_fit_decreasing([len(x[2]) for x in waiting], length)
            groups: list[list[tuple]] = [[] for _ in range(bins)]
            for b, x in zip(place, waiting, strict=True):
                groups[b].append(x)
            waiting.clear()
            return emit(groups)

        for batch in batches:
            full: list[list[tuple]] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1)), strict=True):
                ids = np.append(own, np.int32(terminator)).astype("<u4")
                cut = len(ids) // length * length
                full += [[(doc_id, k, ids[k : k + length])] for k in range(0, cut, length)]
                if cut < len(ids):
                    waiting.append((doc_id, cut, ids[cut:].copy()))
                if len(full) >= 512:
                    yield emit(full)
                    full = []
                if len(waiting) >= block:
                    yield packed()
            if full:
                yield emit(full)
        if waiting:
            yield packed()

    kind = SCHEMA if not digest else SCHEMA.replace("input_ids array<int>, position_ids array<int>", "ids_crc32 long, positions_crc32 long")
    return documents(docs).mapInArrow(run, kind)


def _last(digest: bool) -> list[str]:
    return ["ids_crc32", "positions_crc32"] if digest else ["input_ids", "position_ids"]


def write_packed(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Write the packed matrices as Parquet: whole files appear only when their task has ended."""
    pack_best_fit(docs, tokenizer, **options).write.mode("overwrite").parquet(path)
