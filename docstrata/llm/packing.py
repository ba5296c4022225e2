"""Vector bin packing of examples into fixed-length training sequences (operator 2).

Each example asks for tokens, one segment and its loss-bearing tokens; a sequence holds limited
amounts of all three.  The dot-product heuristic (Panigrahy et al., "Heuristics for Vector Bin
Packing", 2011) keeps one sequence open and, of the examples in a bounded pool that fit, takes the
one whose demand has the largest dot product with what is left, both as shares of the limits.

Partitions pack on their own: no shuffle, no state between tasks, and a lost task is just run again.
A partition leaves at most one sequence short (and those that other limits closed).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import documents, prepared, written
from .bpe import encoder

_PARTITION_SHIFT = 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 1024
    loss_tokens: int = 1024


class Packer:
    """Places examples given by (key, tokens, loss tokens); ``cuttable`` examples may be cut anywhere.

    An example is a run of tokens of which the first ``loss`` bear loss.  ``add`` takes examples,
    ``flush`` ends the last sequence; both yield placements ``(key, start, length, sequence, offset)``.
    An example over a limit is cut if cuttable, else refused: it has no sequence.  Empty examples take no place.
    """

    def __init__(self, limits: Limits, cuttable: bool = True, pool: int = 512):
        self.limits, self.cuttable, self.pool = limits, cuttable, pool
        self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.need = np.zeros((pool + 8, 3), float)
        self.item: list[tuple] = [()] * len(self.need)
        self.n = self.sequences = 0
        self._open()

    def _number(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _open(self) -> None:
        self.left, self.offset, self.sequence = self.full.copy(), 0, self._number()

    def _put(self, key, start: int, tokens: int, loss: int) -> None:
        self.need[self.n] = tokens, 1, loss
        self.item[self.n] = (key, start)
        self.n += 1

    def _take(self, k: int) -> tuple:
        """Item ``k`` of the pool, whose place the last item takes."""
        (key, start), (tokens, _, loss) = self.item[k], self.need[k]
        self.n -= 1
        self.item[k], self.need[k] = self.item[self.n], self.need[self.n]
        self.item[self.n] = ()
        return key, start, int(tokens), int(loss)

    def _place(self, key, start: int, tokens: int, loss: int) -> tuple:
        out = (key, start, tokens, self.sequence, self.offset)
        self.offset += tokens
        self.left -= (tokens, 1, loss)
        return out

    def _step(self) -> Iterator[tuple]:
        """One placement, or the end of the open sequence."""
        need = self.need[: self.n]
        fits = (need <= self.left).all(axis=1)
        if fits.any():
            gain = np.where(fits, need @ (self.left / self.full / self.full), -1.0)
            yield self._place(*self._take(int(gain.argmax())))
        elif self.cuttable and self.left.min() >= 1:
            key, start, tokens, loss = self._take(int(need[:, 0].argmax()))
            part = int(min(self.left[0], self.left[2] if loss > self.left[2] else tokens, tokens))
            yield self._place(key, start, part, min(loss, part))
            self._put(key, start + part, tokens - part, loss - min(loss, part))
        else:
            self._open()
        if self.left[0] < 1:
            self._open()

    def add(self, key, tokens: int, loss: int) -> Iterator[tuple]:
        start, whole = 0, min(self.limits.tokens, self.limits.loss_tokens)
        if tokens > self.limits.tokens or loss > self.limits.loss_tokens:
            if not self.cuttable:
                yield key, 0, tokens, None, None  # refused
                return
            while tokens > whole:  # a sequence of its own for each full length
                yield key, start, whole, self._number(), 0
                start, tokens, loss = start + whole, tokens - whole, loss - min(loss, whole)
        if tokens > 0:
            self._put(key, start, tokens, loss)
        while self.n > self.pool:
            yield from self._step()

    def flush(self) -> Iterator[tuple]:
        while self.n:
            yield from self._step()
        if self.offset:
            self._open()


def _sequence_base() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << _PARTITION_SHIFT


def pack_documents(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), terminator: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: its ids by ``tokenizer``, then ``terminator``, cut and packed.

    ``docs`` needs doc_id and text; other columns are left alone.  Null text is empty, so every row
    has one id at least; a row that is there twice is packed twice.  All ids of the text bear loss,
    the terminator doesn't.  Empty tables give no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = encoder(tokenizer), Packer(limits), _sequence_base()
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
            + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
        )
        rows: list[tuple] = []

        def taken(placements) -> None:
            for (doc_id, total, skipped, ids), start, length, sequence, offset in placements:
                part = ids[start - skipped : start - skipped + length]
                row = (doc_id, start, length, zlib.crc32(part), total, base + sequence, offset)
                rows.append((*row, part) if with_ids else row)

        def out() -> pa.RecordBatch:
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)]
            rows.clear()
            return pa.record_batch(columns, schema=schema)

        whole = min(limits.tokens, limits.loss_tokens)
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1)), strict=True):
                ids = np.empty(len(own) + 1, "<u4")
                ids[:-1], ids[-1] = own, terminator
                total, skipped = len(ids), 0
                loss = total - 1
                key = (doc_id, total, skipped, ids)
                if total > whole:  # keep no more of a long document than may wait in the pool
                    placed = list(packer.add(key, total, loss))
                    for k in range(packer.n):
                        if packer.item[k][0] is key:
                            start = packer.item[k][1]
                            packer.item[k] = ((doc_id, total, start, ids[start:].copy()), start)
                    taken(placed)
                else:
                    taken(packer.add(key, total, loss))
                if len(rows) >= 4096:
                    yield out()
        taken(packer.flush())
        if rows:
            yield out()

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return documents(docs).mapInArrow(run, kind + (", ids array<int>" if with_ids else ""))


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Whole instruction examples ``(example_id, n_tokens, n_loss_tokens)`` → ``(example_id, sequence_id, offset, refused)``.

    Null or no tokens: the example takes no place and has no row.  Over a limit: refused, without a
    place.  Repeated rows are packed each; an empty table gives no rows.
    """
    schema = pa.schema([("example_id", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("refused", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits, cuttable=False), _sequence_base()

        def out(placements) -> pa.RecordBatch:
            rows = [(key, None if sequence is None else base + sequence, offset, sequence is None) for key, _, _, sequence, offset in placements]
            return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([] for _ in schema), schema, strict=True)], schema=schema)

        for batch in batches:
            yield out([x for key, tokens, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in packer.add(key, tokens or 0, loss or 0)])
        yield out(packer.flush())

    some = examples.selectExpr("cast(example_id as long) example_id", "cast(n_tokens as long) n_tokens", "cast(n_loss_tokens as long) n_loss_tokens")
    return some.mapInArrow(run, "example_id long, sequence_id long, offset long, refused boolean")


#: Turns that stay together where a conversation is over a limit.
TURNS = 8
PART = "example_id long, turn long, n_turns long, start long, n_tokens long, n_loss_tokens long"


def _turn_counts(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``(example_id, turn, n_tokens, n_loss_tokens)`` of every turn with tokens; what assistants say bears loss."""
    prepared(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = encoder(tokenizer).counts(batch.column(3))
            loss = np.where(batch.column(2).to_numpy(zero_copy_only=False).astype(bool), n, 0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), pa.array(loss)], names=["example_id", "turn", "n_tokens", "n_loss_tokens"])

    spoken = turns.select(
        F.col("conv_id").cast("long").alias("example_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("bears"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("example_id is not null and text <> ''")
    return spoken.mapInArrow(run, "example_id long, turn long, n_tokens long, n_loss_tokens long")


def conversation_parts(turns: DataFrame, tokenizer: str, limits: Limits) -> DataFrame:
    """Conversations ``(conv_id, turn, role, text)`` as examples that all keep to the limits: ``(example_id, turn, n_turns, start, n_tokens, n_loss_tokens)``.

    A conversation that keeps to them is one example.  Another one is cut between turns, into runs of
    ``TURNS`` turn numbers; a run that is still over a limit gives its turns one by one, and a turn that
    is over one is cut within, from ``start`` on.  An example starts with ``turn``.  Every token is in one
    example, and only what an assistant says bears loss.  Rows without a conv_id or text take no part;
    a null turn counts as one before all others; repeated rows count again.
    """
    size = [F.sum(c).alias(c) for c in ("n_tokens", "n_loss_tokens")]
    over = (F.col("n_tokens") > limits.tokens) | (F.col("n_loss_tokens") > limits.loss_tokens)
    counted = written(_turn_counts(turns, tokenizer).withColumn("run", F.floor(F.coalesce("turn", F.lit(-1)) / TURNS)), "turns")
    runs = counted.groupBy("example_id", "run").agg(F.min("turn").alias("turn"), F.count("*").alias("n_turns"), *size)
    whole = runs.groupBy("example_id").agg(F.min("turn").alias("turn"), F.sum("n_turns").alias("n_turns"), *size)
    long = whole.filter(over).select(F.col("example_id").alias("of"))
    runs = runs.join(long, runs["example_id"] == long["of"], "left_semi")
    dense = runs.filter(over).select(F.col("example_id").alias("of"), F.col("run").alias("of_run"))
    single = counted.join(dense, (counted["example_id"] == dense["of"]) & (counted["run"] == dense["of_run"]), "left_semi").withColumn("n_turns", F.lit(1).cast("long"))
    most = F.when(F.col("n_loss_tokens") > 0, min(limits.tokens, limits.loss_tokens)).otherwise(limits.tokens)
    cut = single.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, most.cast("long"))).alias("start"), most.alias("most"))
    part = F.least(F.col("most"), F.col("n_tokens") - F.col("start")).cast("long")
    cut = cut.select("example_id", "turn", "n_turns", "start", part.alias("n_tokens"), F.when(F.col("n_loss_tokens") > 0, part).otherwise(F.lit(0)).cast("long").alias("n_loss_tokens"))
    names = [x.split(" ")[0] for x in PART.split(", ")]
    uncut = [x.filter(~over).withColumn("start", F.lit(0).cast("long")).select(names) for x in (whole, runs)]
    return uncut[0].unionByName(uncut[1]).unionByName(cut)


def pack_conversations(turns: DataFrame, tokenizer: str, limits: Limits) -> DataFrame:
    """``conversation_parts``, each with its ``sequence_id`` and ``offset`` there; none is refused."""
    names = [x.split(" ")[0] for x in PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits, cuttable=False), _sequence_base()

        def out(placements) -> pa.RecordBatch:
            rows = [(*key, base + sequence, offset) for key, _, _, sequence, offset in placements]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 8)], names=[*names, "sequence_id", "offset"])

        for batch in batches:
            yield out([x for key in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in packer.add(key, key[4], key[5])])
        yield out(packer.flush())

    return conversation_parts(turns, tokenizer, limits).mapInArrow(run, PART + ", sequence_id long, offset long")
