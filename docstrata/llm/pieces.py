"""SentencePiece encoding and decoding for merge-type vocabularies (operator 12).

A text is a space and then its characters, white space as U+2581.  Neighbouring symbols whose
joined piece is in the vocabulary stand in an agenda, best score first and leftmost among equals;
the first one is merged, and the merged symbol meets its new neighbours.  Characters that no piece
has become byte pieces.

A merge never crosses two neighbouring characters that no piece has side by side, as a letter and
the space, mark or line break after it, so these cut a text into chunks that encode on their own.
Each worker keeps the ids of the chunks that it has met, in a table of bounded size; the distinct new chunks of every
Arrow batch are encoded by the agenda and held against the ``sentencepiece`` library.  The agendas
of a batch's short chunks are arrays, from which every round takes each chunk's first offer; a long
chunk has a heap of its own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import _text
from ._spark import documents

SPACE = "▁"
#: Chunks that a worker keeps, but for those of the batch at hand.
KEPT = 1 << 19
#: Characters of a chunk whose agenda is a heap.
LONG = 48
#: Chunks whose agendas are worked off together.
TOGETHER = 4096
_NONE = np.int64(1) << 62
_SLOTS = 1 << 19


class PieceModel:
    """The pieces of a ``.model`` file, its agenda and its decoder.

    Unigram models, normalising ones and those with user-defined or unused pieces are refused: the
    agenda alone doesn't give their ids.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        odd = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        if train.model_type != proto.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not plain or odd:
            raise ValueError("a merge-type vocabulary with byte fallback and without normalisation is needed")
        self.library = SentencePieceProcessor(model_file=path)
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.order = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_id = [0] * 256
        self.spelled: list[bytes] = []  # what an id stands for
        self.raw = [-1] * len(model.pieces)  # the byte that an id is, or -1
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.raw[i] = int(p.piece[1:-1], 16)
                self.byte_id[self.raw[i]] = i
                self.spelled.append(bytes([self.raw[i]]))
            else:
                named = {kinds.CONTROL: "", kinds.UNKNOWN: train.unk_surface}.get(p.type, p.piece.replace(SPACE, " "))
                self.spelled.append(named.encode())
        #: Bytes of a text that an id covers.
        self.width = np.array([len(x) for x in self.spelled], np.int64)
        self.decimal = [str(i).encode() for i in range(len(self.spelled))]
        #: Neighbouring characters that some piece has; a merge never crosses any others.
        self.inside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE for x in self.inside) or any("\n" in p for p in self.id_of):
            raise ValueError("a vocabulary whose pieces end at spaces and line breaks is needed")
        #: Pairs of ASCII characters between which a text can be cut.
        self.never = np.zeros((256, 256), bool)
        for x in range(128):
            for y in range(128):
                self.never[x, y] = (chr(x) + chr(y)).replace(" ", SPACE) not in self.inside
        self._tabulate()

    def _tabulate(self) -> None:
        """Symbols as numbers: ids, and behind them the characters that stand only inside pieces; offers by pairs of symbols."""
        alone = sorted({c for p in self.id_of for c in p} - self.id_of.keys())
        number = self.id_of | {c: len(self.spelled) + k for k, c in enumerate(alone)}
        self.symbol = np.full(0x110000 + 1, -1, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.symbol[32] = self.symbol[ord(SPACE)]
        rank = {o: k for k, o in enumerate(sorted(set(self.order.values())))}
        pairs = [(number[p[:k]] << 32 | number[p[k:]], rank[self.order[p]] << 32 | i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        codes, offers = np.array(pairs, np.int64).reshape(-1, 2).T
        # Open addressing: a pair stands in the first free slot from its digest on.
        self.pair_code, self.pair_offer = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NONE, np.int64)
        for code, offer, at in zip(codes.tolist(), offers.tolist(), self._slot(codes).tolist(), strict=True):
            while self.pair_code[at] >= 0:
                at = (at + 1) % _SLOTS
            self.pair_code[at], self.pair_offer[at] = code, offer

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 19)).astype(np.int64)

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and joined id of each pair, in one number, or ``_NONE``."""
        out = np.full(len(left), _NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        codes = left[todo].astype(np.int64) << 32 | right[todo]
        at = self._slot(codes)
        while len(todo):
            held = self.pair_code[at]
            hit = held == codes
            out[todo[hit]] = self.pair_offer[at[hit]]
            on = np.flatnonzero((held >= 0) & ~hit)
            todo, codes, at = todo[on], codes[on], (at[on] + 1) & (_SLOTS - 1)
        return out

    def _merged_together(self, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The symbols that are left of many chunks, which start at ``first``; -2 where one has gone."""
        n = len(symbol)
        symbol = np.append(symbol, -1)  # beyond the end
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.append(first[1:], n) - 1] = n
        before[first] = n
        offer = self._offers(symbol[:-1], symbol[after])
        chunk_of, begins, place = np.arange(len(first)), first, np.arange(n)
        while len(begins):
            # The first offer of each chunk: best rank, then leftmost, which is the first to hold it.
            here = offer[place]
            rank = here >> 32
            best = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(place)))
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & (here != _NONE))
            if not len(at):
                break
            owner = np.searchsorted(begins, at, side="right") - 1
            i = place[at[np.concatenate([[True], owner[1:] != owner[:-1]])]]
            j = after[i]
            symbol[i], symbol[j] = (offer[i] & 0xFFFFFFFF).astype(np.int32), -2
            offer[j] = _NONE
            k = after[j]
            after[i] = k
            inner = k < n
            before[k[inner]] = i[inner]
            offer[i] = self._offers(symbol[i], symbol[k])
            p, q = before[i], i
            p, q = p[p < n], q[p < n]
            offer[p] = self._offers(symbol[p], symbol[q])
            # What has no offers left, and symbols that have gone, leave the agenda.
            live = np.repeat(best < _NONE >> 32, sizes) & (symbol[place] != -2)
            keep = np.flatnonzero(live)
            owner = np.repeat(chunk_of, sizes)[keep]
            place = place[keep]
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(keep) else keep
            chunk_of = owner[begins]
        return symbol[:-1]

    def many_ids(self, chunks: list[str]) -> list[list[int]]:
        """``chunk_ids`` of each chunk, none of which is empty."""
        if len(chunks) > TOGETHER:
            return [x for k in range(0, len(chunks), TOGETHER) for x in self.many_ids(chunks[k : k + TOGETHER])]
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        out: list[list[int]] = [[]] * len(chunks)
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self.chunk_ids(chunks[k])
        short = np.flatnonzero(size <= LONG)
        if not len(short):
            return out
        points = np.frombuffer("".join([chunks[k] for k in short.tolist()]).encode("utf-32-le"), np.uint32)
        stop = np.cumsum(size[short])
        left = self._merged_together(self.symbol[points], stop - size[short])
        kept = np.flatnonzero(left != -2)
        ids, at = left[kept], np.searchsorted(kept, np.concatenate([[0], stop]))
        lone = (ids < 0) | (ids >= len(self.spelled))  # characters that are no pieces
        odd = set((np.searchsorted(at, np.flatnonzero(lone), side="right") - 1).tolist())
        flat, points = ids.tolist(), points[kept]
        for row, (k, a, b) in enumerate(zip(short.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)):
            out[k] = flat[a:b]
            if row in odd:
                out[k] = [i for x in range(a, b) for i in ([self.byte_id[y] for y in chr(points[x]).encode()] if lone[x] else flat[x : x + 1])]
        return out

    def _merged(self, text: str) -> list[str]:
        """The symbols that are left when no pair of neighbours is a piece."""
        n = len(text)
        symbol = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = symbol[i] + symbol[j]
            if (order := self.order.get(joined)) is not None:
                heapq.heappush(agenda, (order, i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            # An offer lapses when one of its symbols has grown or has gone.
            if not symbol[i] or after[i] != j or len(symbol[i]) + len(symbol[j]) != len(joined):
                continue
            symbol[i], symbol[j] = joined, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbol if s]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk as it stands, its spaces as U+2581; nothing is put before it."""
        text = chunk.replace(" ", SPACE)
        cuts = [0, *(k + 1 for k in range(len(text) - 1) if text[k : k + 2] not in self.inside), len(text)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            for s in self._merged(text[a:b]):
                i = self.id_of.get(s)
                out += [i] if i is not None else [self.byte_id[x] for x in s.encode()]
        return out

    def verified(self, chunks: list[str], ids: list[list[int]]) -> None:
        """Hold the agenda's ids against the library, which puts a space before each text: behind a line break it has no effect."""
        lead = len(self.library.encode("\n"))
        theirs = self.library.encode(["\n" + c for c in chunks], num_threads=1)
        if wrong := [c for c, mine, other in zip(chunks, ids, theirs, strict=True) if mine != other[lead:]]:
            raise AssertionError(f"the agenda and the library differ: {wrong[0][:80]!r}")

    def decoded(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids' text with the space before it; a raw byte that is part of no character gives U+FFFD."""
        out = b"".join(map(self.spelled.__getitem__, ids))
        if out.isascii():
            return out
        try:
            out.decode()
        except UnicodeDecodeError:  # a piece is made of whole characters, so it is a run of raw bytes that isn't
            runs = itertools.groupby(ids, lambda i: self.raw[i] >= 0)
            return b"".join(_characters(b"".join(map(self.spelled.__getitem__, run))) if raw else b"".join(map(self.spelled.__getitem__, run)) for raw, run in runs)
        return out

    def text_of(self, ids: list[int]) -> str:
        """The decoder of the library: one leading space, which encoding has put there, goes."""
        seen = next((k for k, i in enumerate(ids) if self.spelled[i] != b""), len(ids))
        text = self.decoded(ids).decode()
        return text[1:] if seen < len(ids) and ids[seen] in self._pieces and text.startswith(" ") else text

    @functools.cached_property
    def _pieces(self) -> set[int]:
        return set(self.id_of.values())


def _characters(run: bytes) -> bytes:
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                run[k : k + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(run[k : k + size])
            k += len(out[-1])
            break
        else:
            out.append("�".encode())
            k += 1
    return b"".join(out)


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def spaced(column: pa.Array) -> pa.Array:
    """A space before every text that isn't empty; null counts as empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(text), 0), none, pc.binary_join_element_wise(none, text, space))


def piece_spans(raw: np.ndarray, offsets: np.ndarray, never: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that no merge crosses, and each row's first chunk."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n, bool)
    cut[1:] = never.ravel()[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
    # Behind a character of several bytes: a line break, and a space unless that is U+2581, which reads as a space.
    wide = np.flatnonzero((raw[:-1] >= 128) & ((raw[1:] == 32) | (raw[1:] == 10))) + 1
    blank = (raw[wide] == 32) & (raw[wide - 1] == 0x81) & (raw[np.maximum(wide - 2, 0)] == 0x96) & (raw[np.maximum(wide - 3, 0)] == 0xE2)
    cut[wide[~blank]] = True
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class ChunkTable:
    """What a worker knows of the chunks it has met: ``made`` gives an entry for each distinct new one.

    When there are more than ``KEPT``, the half that was met most often stays.
    """

    def __init__(self, made):
        self.made = made
        self.index: dict[int, int] = {}
        self.entries: list = []
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT // 2])
        keys = np.fromiter(self.index, np.int64, len(self.index))[stay]  # in the order of the entries
        self.entries = [self.entries[k] for k in stay.tolist()]
        self.index = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.uses = self.uses[stay] >> 1

    def found(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry's number for each chunk; numbers hold until the next call."""
        if len(self.index) > KEPT:
            self._shrink()
        keys = _text.hash_spans(raw, starts, ends).view(np.int64)
        out = np.fromiter(map(self.index.get, keys.tolist(), itertools.repeat(-1)), np.int64, len(keys))
        lost = np.flatnonzero(out < 0)
        if len(lost):
            fresh, first, which = np.unique(keys[lost], return_index=True, return_inverse=True)
            where, view = lost[first], memoryview(raw)
            chunks = [str(view[a:b], "utf-8") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            out[lost] = len(self.entries) + which
            self.index.update(zip(fresh.tolist(), range(len(self.entries), len(self.entries) + len(fresh)), strict=True))
            self.entries += self.made(chunks)
            self.uses = np.append(self.uses, np.zeros(len(fresh), np.int64))
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out


def _chunk_lists(model: PieceModel, chunks: list[str]) -> list[list[int]]:
    ids = model.many_ids(chunks)
    model.verified(chunks, ids)
    return ids


def _chunk_digests(model: PieceModel, chunks: list[str]) -> list[tuple[int, bytes, bytes]]:
    """Count, ids as decimals and decoded bytes of each chunk."""
    return [(len(x), b",".join(map(model.decimal.__getitem__, x)), model.decoded(x)) for x in _chunk_lists(model, chunks)]


@functools.lru_cache(maxsize=4)
def _table(path: str, made) -> ChunkTable:
    return ChunkTable(functools.partial(made, piece_model(path)))


def _rows(path: str, made, column: pa.Array) -> Iterator[list]:
    """What ``made`` gives for each text's chunks, in order."""
    model, table = piece_model(path), _table(path, made)
    raw, offsets = _text.buffer_of(spaced(column))
    starts, ends, rows = piece_spans(raw, offsets, model.never)
    found = table.found(raw, starts, ends).tolist()
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        yield [table.entries[k] for k in found[a:b]]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row, without begin or end ids.

    A null or empty text has no ids.  Repeated rows and null doc_ids are kept as they come; columns
    other than ``doc_id`` and ``text`` aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[i for chunk in row for i in chunk] for row in _rows(model, _chunk_lists, batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``(doc_id, text)`` for every row of ``(doc_id, ids)``; null ids give null, ids that the vocabulary lacks fail."""
    from ..ship import ship

    ship(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            texts = [None if ids is None else pieces.text_of(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(coded["doc_id"].cast("long").alias("doc_id"), coded["ids"].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row: digests of the ids, joined by commas, and of the text that they decode to.

    A null or empty text has no ids and decodes to the empty text.  Rows are as in ``encode``; a very
    long text is encoded chunk by chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids, texts = [], [], []
            for row in _rows(model, _chunk_digests, batch.column(1)):
                counts.append(sum([e[0] for e in row]))
                ids.append(hashlib.sha256(b",".join([e[1] for e in row])).hexdigest())
                texts.append(hashlib.sha256(b"".join([e[2] for e in row])[1:]).hexdigest())  # the space before the text goes
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
