"""Near-duplicate groups by HyperMinHash (operator 3).

After Yu & Weber, "HyperMinHash: MinHash in LogLog space".  Each document's shingles fall into
buckets; a register keeps, of the smallest hash in its bucket, the leading-zero count and the first
mantissa bits, in two bytes.

1. Documents with equal shingle sets form a class, known by a digest of the set; a class counts once.
2. Bands of seven compressed registers are the candidate keys.  An empty register borrows that
   of the filled bucket which comes first in the empty one's own random order of buckets, and the
   borrower keeps the lender's number, so sets of any size agree in a register with probability
   about J, and sets that share a few shingles among many share no band.
3. Classes that share keys form clusters (components of candidate edges: ids only, no texts).
4. A cluster of bounded size meets in one task.  Registers give a collision-corrected Jaccard
   estimate; pairs clearly below the threshold go, the rest are verified on full shingle sets, unless
   links have already joined the two.  Only links that join two parts leave the task, so nothing grows
   with the square of a group.
5. A cluster beyond the bound is split: its classes meet by shared key, and those of a key beyond the
   bound in all pairs of parts of bounded size.  That loses no pair that shares a key.
6. Components of verified links give each document its smallest reachable doc_id.

Shingles are 64-bit hashes, and so are digests.  With 90 bands of seven, two sets at Jaccard 0.75
share no key with probability 3e-6.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import documents, dropped, written
from .components import components

BANDS, WIDTH = 90, 7
REGISTERS = BANDS * WIDTH
MANTISSA = 10
#: What one task gathers at most: so many classes, with so many shingles in all (8 bytes each).
MEMBERS, SHINGLES = 4096, 1 << 22
#: Up to so many classes with partners, of three longs each (about 100 MB), are broadcast to fetch their texts; beyond, the texts are shuffled.
FEW = 1 << 21


def _doc_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    raw, offsets = _text.buffer_of(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (2 << 20), side="right")) - 1)
        part = _text.lower_ascii(raw[offsets[i] : offsets[j]])
        starts, ends, rows = _text.word_spans(part, offsets[i : j + 1] - offsets[i])
        made, at = _text.shingles(_text.hash_spans(part, starts, ends), rows)
        for k in range(j - i):
            yield np.unique(made[at[k] : at[k + 1]])
        i = j


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: 0 for an empty bucket, else (leading zeros + 1, inverted mantissa); larger is smaller a hash."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = _text.mix(hashes, 3) % np.uint64(REGISTERS)
    part, power = np.frexp((_text.mix(hashes, 4) >> np.uint64(11)).astype(np.float64))
    zeros = np.minimum(53 - power, 52)
    mantissa = np.where(part > 0, ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    code = (zeros.astype(np.int64) + 1) << MANTISSA | ((1 << MANTISSA) - 1 - mantissa)
    key = np.sort(bucket.astype(np.int64) << 20 | code)
    last = np.flatnonzero(np.append(key[1:] >> 20 != key[:-1] >> 20, True))
    out[key[last] >> 20] = key[last] & 0xFFFF
    return out


def _chance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chance that the minima of a bucket with ``x`` and one with ``y`` other elements fall into one cell (leading zeros, mantissa).

    The minimum of a bucket with ``x`` elements exceeds ``u`` with probability ``exp(-x u)``.
    """
    zeros = np.arange(0, 40)
    cells = 1 << MANTISSA
    # Within an octave all cells have one width; a few sample cells stand for the rest.
    sample = (np.arange(16) + 0.5) / 16
    low = (2.0 ** -(zeros + 1.0))[:, None] * (1 + sample)[None, :]
    wide = ((2.0 ** -(zeros + 1.0)) / cells)[:, None] * np.ones(16)[None, :]
    in_cell = lambda v: np.exp(-v[:, None, None] * low) * -np.expm1(-v[:, None, None] * wide)
    return np.einsum("iab,jab->ij", in_cell(x), in_cell(y)) * cells / 16


@functools.cache
def _chance_table() -> np.ndarray:
    """Chances for set sizes in steps of a quarter octave."""
    sizes = 2.0 ** (np.arange(161) / 4) / REGISTERS
    return _chance(sizes, sizes)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance for disjoint sets of ``n`` and ``m`` elements."""
    at = lambda v: np.clip(np.round(np.log2(np.maximum(v, 1)) * 4), 0, 160).astype(np.int64)
    return _chance_table()[at(n), at(m)]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows and the number of registers they rest on."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    chance = expected_collisions(n, m) * REGISTERS
    return np.maximum(same - chance, 0) / np.maximum(used, 1), used


def passes(a, b, n, m, threshold: float) -> np.ndarray:
    """Pairs that aren't five standard deviations below the threshold.

    Registers sample the union; what they don't leave out has no sampling error.
    """
    value, used = estimate(a, b, n, m)
    union = np.maximum((np.asarray(n) + m) / (1 + threshold), 1)
    spread = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1) * np.clip(1 - used / union, 0.05, 1))
    return (value >= threshold - 5 * spread - 0.01) | (used < 32)


@functools.cache
def _lenders() -> np.ndarray:
    """For each bucket its own random order of all buckets, as ranks."""
    return np.argsort(np.argsort(_text.mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64), 11).reshape(REGISTERS, REGISTERS), axis=1), axis=1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a document's registers, of which at least one is filled."""
    lender = np.arange(REGISTERS)
    filled, empty = np.flatnonzero(regs), np.flatnonzero(regs == 0)
    if len(empty):
        lender[empty] = filled[_lenders()[np.ix_(empty, filled)].argmin(axis=1)]
    values = (lender.astype(np.uint64) << np.uint64(16)) | regs[lender]
    at = np.arange(BANDS) * WIDTH
    return _text.mix(_text.combine(_text.mix(values, 5), at, tuple(range(WIDTH)), 3) + np.arange(BANDS, dtype=np.uint64), 6)


def digest(hashes: np.ndarray) -> int:
    return int(_text.mix(_text.mix(hashes, 1).sum(dtype=np.uint64)[None] + np.uint64(len(hashes)), 2).astype(np.int64)[0])


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, digest, keys)``: set size, digest of the set, band keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, keys = [], [], []
            for h in _doc_shingles(batch.column(1)):
                sizes.append(len(h))
                marks.append(digest(h))
                keys.append(band_keys(registers(h)).astype(np.int64) if len(h) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest long, keys array<long>")


def _split(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``(id, g1, g2, g3)``: the groups in which classes of clusters beyond the bound meet: a key with two parts of it.

    ``rows(key, id)`` are shared keys, ``large(id, n)`` the classes and the sizes of their sets.
    """
    wide = rows.join(large, "id")
    sizes = wide.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).filter("classes > 1")
    parts = F.ceil(F.greatest(F.col("classes") / (MEMBERS // 2), F.col("shingles") / (SHINGLES // 2))).cast("int")
    sizes = sizes.select("key", F.when(_fits(), 1).otherwise(parts).alias("parts"))
    split = wide.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return split.select("id", F.col("key").alias("g1"), F.least("own", "other").alias("g2"), F.greatest("own", "other").alias("g3"))


def _fits() -> F.Column:
    return (F.col("classes") <= MEMBERS) & (F.col("shingles") <= SHINGLES)


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(id, cluster, set, regs)`` for the documents that stand for classes, ``chosen(doc_id, id, cluster)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            at, sets, regs, size = [], [], [], 0
            for k, h in enumerate(_doc_shingles(batch.column(0))):
                if digest(h) == ids[k]:  # a doc_id may have other texts, too
                    at.append(k)
                    sets.append(h.tobytes())
                    regs.append(registers(h).astype("<u2").tobytes())
                    size += len(h)
                if at and (size > 1 << 20 or k == len(batch) - 1):
                    rows = pa.array(at)
                    yield pa.record_batch([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())], names=["id", "cluster", "set", "regs"])
                    at, sets, regs, size = [], [], [], 0

    few = chosen.count() <= FEW
    held = docs.join(F.broadcast(chosen) if few else chosen, "doc_id").select("text", "id", "cluster")
    return held.mapInArrow(run, "id long, cluster long, set binary, regs binary")


def joining_links(sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets (by position) that join all that any links join: a spanning forest."""
    n = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(n)])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    has = np.zeros(offsets[-1], bool)
    part = np.arange(len(sets))
    found = []
    for i in range(len(sets) - 1):
        other = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        other = other[np.minimum(n[other], n[i]) * 100 >= np.maximum(n[other], n[i]) * percent]
        if len(other):
            other = other[passes(np.broadcast_to(regs[i], (len(other), REGISTERS)), regs[other], np.full(len(other), n[i]), n[other], percent / 100)]
        if not len(other):
            continue
        own = shingle[offsets[i] : offsets[i + 1]]
        has[own] = True
        for at in range(0, len(other), 256):
            some = other[at : at + 256]
            some = some[part[some] != part[i]]
            if not len(some):
                continue
            ends = np.cumsum(n[some])
            spots = np.arange(ends[-1]) + np.repeat(offsets[some] - (ends - n[some]), n[some])
            common = np.add.reduceat(has[shingle[spots]].astype(np.int64), ends - n[some])
            linked = some[common * 100 >= (n[some] + n[i] - common) * percent]
            while len(linked):
                found.append((i, int(linked[0])))
                part[part == part[linked[0]]] = part[i]
                linked = linked[part[linked] != part[i]]
        has[own] = False
    return found


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` inside the groups of ``rows(g1, g2, g3, id, set, regs)``."""

    def solved(ids: list[int], sets: list[bytes], regs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            pairs = joining_links([np.frombuffer(s, "<u8") for s in sets], np.frombuffer(b"".join(regs), "<u2").reshape(-1, REGISTERS), percent)
            if pairs:
                a, b = zip(*((ids[i], ids[j]) for i, j in pairs), strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "g3", "id")), strict=True)
            sets, regs = batch.column("set"), batch.column("regs")
            for k, (*now, i) in enumerate(keys):
                if now != group:
                    yield from solved(*held)
                    group, held = now, ([], [], [])
                if not held[0] or held[0][-1] != i:  # repeated rows come one after the other
                    for to, value in zip(held, (i, sets[k].as_py(), regs[k].as_py()), strict=True):
                        to.append(value)
        yield from solved(*held)

    placed = rows.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "id")
    return placed.select("g1", "g2", "g3", "id", "set", "regs").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row with doc_id and text.

    Two documents are linked if 100 |A and B| >= ``percent`` |A or B| over their sets of 5-word
    shingles.  Null or empty text: no shingles, linked with nothing, its own component.  Rows with
    one doc_id count as one document, linked by any of their texts: all are kept or none.  Null
    doc_id: linked with nothing, with component null and kept true.
    """
    own = documents(docs)
    marks = written(signatures(own), "signatures")
    full = marks.filter("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")

    # Keys of one class find nothing: only shared ones are kept.
    keys = full.select(F.explode_outer("keys").alias("key"), F.col("digest").alias("id"))
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key", "low")
    rows = written(keys.join(shared.hint("merge"), "key").distinct(), "shared-keys")
    clusters = components(rows.select(F.col("id").alias("a"), F.col("low").alias("b")))
    members = clusters.withColumnRenamed("component", "cluster").join(classes.withColumnRenamed("digest", "id"), "id")
    members = written(members.select("id", "cluster", "n", "rep"), "members")
    small = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).filter(_fits())
    marked = members.join(small.select("cluster", F.col("cluster").alias("own")), "cluster", "left")
    chosen = written(marked.select(F.col("rep").alias("doc_id"), "id", F.col("own").alias("cluster"), "n"), "chosen")
    met = _sets(own, chosen.select("doc_id", "id", "cluster"))
    whole = F.array(F.struct(F.col("cluster").alias("g1"), F.lit(-1).alias("g2"), F.lit(-1).alias("g3")))
    large = chosen.filter("cluster is null")
    if not large.isEmpty():
        groups = _split(rows.select("key", "id"), large.select("id", "n")).groupBy("id").agg(F.collect_list(F.struct("g1", "g2", "g3")).alias("split"))
        met, whole = met.join(groups, "id", "left"), F.when(F.col("cluster").isNull(), F.col("split")).otherwise(whole)
    met = met.select("id", "set", "regs", F.explode(whole).alias("g")).select("g.*", "id", "set", "regs")
    links = written(_links(met, percent), "links")
    dropped(rows, members, chosen)

    # A doc_id with several texts joins their classes.
    twice = full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id", "a")
    both = full.select("doc_id", F.col("digest").alias("b")).join(twice, "doc_id").select("a", "b")
    joined = components(links.union(both)).withColumnRenamed("id", "digest")
    named = classes.join(joined, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = named.join(lowest, "component").select("digest", "component_id")
    of_doc = full.select("doc_id", "digest").distinct().join(of_class, "digest").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = marks.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = written(out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))), "near-duplicates")
    dropped(marks, classes, links)
    return out
