"""Token ids of public tokenizers, batch by batch.

Byte-level BPE splits text at the start of every run of white space that follows something else:
the split pattern never looks across such a point, so the ids of a text are the ids of its chunks,
one after the other.  Each chunk is hashed with numpy, and only chunks that this process has not
met are encoded; a bounded table keeps the rest.  Chunks that may hold a special string go through
``tokenizers`` itself.  Other kinds of tokenizer encode whole texts with their own library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa

from . import _text

_SLOTS = 1 << 21
_LIMIT = _SLOTS // 2


def version_digest(path: str) -> str:
    """Digest of the tokenizer file: two files with equal content count alike."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def chunk_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that byte-level BPE encodes independently, and each row's first chunk."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = (raw == 32) | (raw == 10)
    before = np.zeros(n, np.uint8)
    before[1:] = raw[:-1]
    cut = space & (before > 32) & (before != 127)
    # The byte before may end a multi-byte white space: U+0085, U+00A0, or one that starts with E1-E3.
    at = np.flatnonzero(cut & (before >= 128))
    second, third = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    unsafe = (second == 0xC2) | ((second >= 128) & (second < 192) & (third >= 0xE1) & (third <= 0xE3))
    cut[at[unsafe]] = False
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class ChunkEncoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        # Byte-level vocabularies spell bytes as printable characters: those of Latin-1 that print
        # stand for themselves, the others follow from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = set(self.special)
        ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(x) for x in ranks]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.used = 0
        self.first = np.zeros(_LIMIT + 1, np.int64)
        self.count = np.zeros(_LIMIT, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.flat_used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        at = (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.slot[at[todo]]
            hit = (held >= 0) & (self.keys[at[todo]] == keys[todo])
            out[todo[hit]] = held[hit]
            todo = todo[(held >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & (_SLOTS - 1)
        return out

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        at = (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slot[at[todo]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slot[at[put]], self.keys[at[put]] = entries[put], keys[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (_SLOTS - 1)

    def _encode(self, piece: str) -> list[int]:
        if any(s in piece for s in self.special):
            return self.whole.encode(piece, add_special_tokens=False).ids
        return self.fast.encode_ordinary(piece)

    def _encode_all(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of distinct chunks, and in it their counts and ids.

        Those with white space before and none behind are encoded in one call: joined, they are still
        chunks, and the lengths of the tokens tell them apart.
        """
        size = ends - starts
        last = raw[ends - 1]
        second, third = raw[np.maximum(ends - 2, 0)], raw[np.maximum(ends - 3, 0)]
        odd = (last >= 128) & ((second == 0xC2) | ((second >= 128) & (second < 192) & (third >= 0xE1) & (third <= 0xE3)))
        joins = ((raw[starts] == 32) | (raw[starts] == 10)) & (size > 1) & (last > 32) & (last != 127) & ~odd
        view = memoryview(raw)
        first, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        text = b"".join([view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]).decode()
        if any(s in text for s in self.special):
            first, rest, text = first[:0], np.arange(len(starts)), ""
        ids = np.asarray(self.fast.encode_ordinary(text), np.int32)
        at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size[first])) + 1
        alone = [self._encode(str(view[a:b], "utf-8")) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        counts = np.concatenate([np.diff(at, prepend=0), np.fromiter(map(len, alone), np.int64, len(alone))])
        flat = np.concatenate([ids, np.fromiter((i for x in alone for i in x), np.int32)])
        return np.concatenate([first, rest]), counts.astype(np.int32), flat

    def entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = _text.hash_spans(raw, starts, ends)
        found = self._find(keys)
        lost = np.flatnonzero(found < 0)
        if not len(lost):
            return found
        fresh, where = np.unique(keys[lost], return_index=True)
        if self.used + len(fresh) > _LIMIT:
            self._clear()
            if len(keys) > _LIMIT // 2:
                raise OverflowError("batch too large for the chunk table")
            return self.entries(raw, starts, ends)
        order, counts, flat = self._encode_all(raw, starts[lost[where]], ends[lost[where]])
        fresh = fresh[order]
        while self.flat_used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.flat_used : self.flat_used + len(flat)] = flat
        new = slice(self.used, self.used + len(fresh))
        self.count[new] = counts
        self.first[new] = self.flat_used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.flat_used += len(flat)
        self._insert(fresh, np.arange(self.used, self.used + len(fresh), dtype=np.int32))
        self.used += len(fresh)
        return self._find(keys)

    def blocks(self, column: pa.Array):
        """Runs of rows with few enough chunks for the table: (first row, last row, raw, starts, ends, rows)."""
        raw, offsets = _text.buffer_of(column)
        i, step = 0, _LIMIT // 4
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
            part = raw[offsets[i] : offsets[j]]
            yield i, j, part, *chunk_spans(part, offsets[i : j + 1] - offsets[i])
            i = j

    def _parts(self, part, starts, ends, rows):
        """Groups of chunks that fit the table at once (a long text can have many)."""
        step = _LIMIT // 4
        for k in range(0, len(starts), step):
            yield self.entries(part, starts[k : k + step], ends[k : k + step])

    def counts(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for i, j, part, starts, ends, rows in self.blocks(column):
            sizes = [self.count[e].astype(np.int64) for e in self._parts(part, starts, ends, rows)]
            total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
            out[i:j] = total[rows[1:]] - total[rows[:-1]]
        return out

    def ids(self, column: pa.Array):
        """One int32 array of ids per row, in order."""
        for i, j, part, starts, ends, rows in self.blocks(column):
            sizes, runs = [np.zeros(1, np.int64)], []
            for e in self._parts(part, starts, ends, rows):
                n = self.count[e].astype(np.int64)
                stop = np.cumsum(n)
                at = np.arange(stop[-1]) + np.repeat(self.first[e] - (stop - n), n)
                runs.append(self.flat[at])
                sizes.append(n)
            flat = np.concatenate(runs) if runs else np.zeros(0, np.int32)
            at = np.cumsum(np.concatenate(sizes))[rows]
            for k in range(j - i):
                yield flat[at[k] : at[k + 1]]


class LibraryEncoder:
    """Whole texts by the library that the file belongs to."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            self.encode = lambda texts: [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]

    def ids(self, column: pa.Array):
        for k in range(0, len(column), 64):
            texts = [x or "" for x in column[k : k + 64].to_pylist()]
            yield from (np.asarray(x, np.int32) for x in self.encode(texts))

    def counts(self, column: pa.Array) -> np.ndarray:
        return np.fromiter(map(len, self.ids(column)), np.int64, len(column))


def _byte_level(path: str) -> bool:
    """Whether chunks give the whole: byte-level BPE with its usual pattern, nothing before and nothing dropped."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = spec.get("normalizer") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("ignore_merges")
    if not plain or odd or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
        return False
    vocab = model["vocab"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ranks = [vocab[a + b] for a, b in pairs]
    return all(a < b for a, b in zip(ranks, ranks[1:], strict=False))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder | LibraryEncoder:
    return ChunkEncoder(path) if _byte_level(path) else LibraryEncoder(path)
