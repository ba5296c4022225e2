"""Quality classifier by positive-unlabelled learning (operator 1).

After Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017).  Trusted
positives and unlabelled web text give the risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``
under the logistic loss; where the bracket goes negative, its gradient is reversed.  The class prior
is estimated from labelled training rows if they hold both classes, else from the positives alone
(Elkan & Noto, 2008).

The model sees the text only: shares of byte-class pairs and repetition of words and lines, from the
whole text.  It is fitted on a bounded sample (``bound`` positives, ``bound`` unlabelled rows) and
broadcast with the scoring function; scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import prepared

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 1, 2, 3, 4, 5
for _k, _c in enumerate(".,!?#*%$&|=:;-_/<>()\"'"):
    _CLASS[ord(_c)] = 6 + _k
_CLASSES = 29
for _b in (*range(10), *range(11, 32), 127, *(b for b in range(33, 127) if not chr(b).isalnum() and not _CLASS[b])):
    _CLASS[_b] = 28
_PAIRS = _CLASSES * _CLASSES
_EXTRA = 9
WIDTH = _PAIRS + _EXTRA


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: share of distinct keys, of the commonest key, and of keys equal to the one before."""
    n = np.diff(rows)
    distinct, top, same = (np.zeros(len(n)) for _ in range(3))
    for k in np.flatnonzero(n):
        own = keys[rows[k] : rows[k + 1]]
        held = np.sort(own)
        edge = np.flatnonzero(np.append(held[1:] != held[:-1], True))
        distinct[k], top[k] = len(edge) / n[k], np.diff(edge, prepend=-1).max() / n[k]
        same[k] = (own[1:] == own[:-1]).mean() if n[k] > 1 else 0
    return distinct, top, same


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; empty and null texts have all zeros."""
    return np.concatenate([np.zeros((0, WIDTH), np.float32), *_blocks(column)])


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Features of some rows at a time: a megabyte of text, or one longer text."""
    raw, offsets = _text.buffer_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, min(i + 1024, int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1))
        out = np.zeros((j - i, WIDTH), np.float32)
        _fill(out, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield out
        i = j


def _fill(out: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    size, kind = np.diff(offsets), _CLASS[raw]
    pair = kind[:-1].astype(np.int64) * _CLASSES + kind[1:] if len(kind) > 1 else np.zeros(0, np.int64)
    for k in np.flatnonzero(size > 1):
        counts = np.bincount(pair[offsets[k] : offsets[k + 1] - 1], minlength=_PAIRS)
        out[k, :_PAIRS] = np.sqrt(counts / (size[k] - 1))
    lower = _text.lower_ascii(raw)
    starts, ends, rows = _text.word_spans(lower, offsets)
    words, n = _text.hash_spans(lower, starts, ends), np.diff(rows)
    some = n > 0
    out[:, _PAIRS : _PAIRS + 3] = np.stack(_repeats(words, rows), axis=1)
    pairs, at = _text.shingles(words, rows, 2)
    out[:, _PAIRS + 3 : _PAIRS + 6] = np.stack(_repeats(pairs, at), axis=1)
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    mean = (length[rows[1:]] - length[rows[:-1]]) / np.maximum(n, 1)
    out[some, _PAIRS + 6], out[some, _PAIRS + 7] = np.log1p(n[some]) / 10, np.log1p(mean[some])
    out[some, _PAIRS + 8] = 1


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30)))


def elkan_noto_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in ``unlabelled``, from the mean output that held-back positives get for "is labelled"."""
    x = np.concatenate([positive[::2], unlabelled[::2]])
    y = np.concatenate([np.ones(len(positive[::2])), np.zeros(len(unlabelled[::2]))])
    mean, scale = x.mean(0), x.std(0) + 0.02
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w + b, -30, 30)))
        g = (p - y) / len(y)
        w -= 0.5 * ((x - mean) / scale).T @ g + 1e-4 * w
        b -= 0.5 * g.sum()
    out = lambda v: 1 / (1 + np.exp(-np.clip((v - mean) / scale @ w + b, -30, 30)))
    c = out(positive[1::2]).mean() if len(positive) > 1 else 0.5
    odds = out(unlabelled[1::2]) / np.maximum(1 - out(unlabelled[1::2]), 1e-6)
    return float(np.clip((odds * (1 - c) / max(c, 1e-6)).mean(), 0.05, 0.98)) if len(unlabelled) > 1 else 0.5


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Model:
    """Minimise the non-negative risk by Adam over mini-batches.  Both matrices are standardised in place."""
    p, u = positive, unlabelled
    n = len(p) + len(u)
    mean = (p.sum(0) + u.sum(0)) / n
    for v in (p, u):
        v -= mean
    scale = np.sqrt((np.einsum("ij,ij->j", p, p) + np.einsum("ij,ij->j", u, u)) / n) + np.float32(0.02)
    for v in (p, u):
        v /= scale
    rng = np.random.default_rng(seed)
    theta = [rng.normal(0, 0.05, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    moment, square, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)
    steps = max(4, min(40, (len(p) + len(u)) // 512))
    for epoch in range(epochs):
        orders = [np.array_split(rng.permutation(len(v)), steps) for v in (p, u)]
        for i, j in zip(*orders, strict=True):
            if not len(i) or not len(j):
                continue
            x = np.concatenate([p[i], u[j]])
            h = np.tanh(x @ theta[0] + theta[1])
            z = h @ theta[2] + theta[3]
            zp, zu = z[: len(i)], z[len(i) :]
            negative = softplus(zu).mean() - prior * softplus(zp).mean()
            g_minus = np.concatenate([-prior * sigmoid(zp) / len(i), sigmoid(zu) / len(j)])
            g = -g_minus if negative < 0 else g_minus
            if negative >= 0:
                g = g + np.concatenate([-prior * sigmoid(-zp) / len(i), np.zeros(len(j))])
            gh = g[:, None] * theta[2] * (1 - h * h)
            grads = [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]
            step += 1
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
            for t, d, m, s in zip(theta, grads, moment, square, strict=True):
                d = d + 1e-3 * t * (t.ndim == 2)
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(prior, mean.astype(np.float32), scale.astype(np.float32), theta[0].astype(np.float32), theta[1].astype(np.float32), theta[2].astype(np.float32), float(theta[3][0]))


def held_out(doc_id) -> F.Column:
    """Rows whose label is never learned."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _features_udf():
    @F.arrow_udf("array<float>")
    def made(text: pa.Array) -> pa.Array:
        x = features(text)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * WIDTH, x.ravel())

    return made


def _gathered(rows: DataFrame, most: int) -> np.ndarray:
    """Features of the rows; ``most`` holds only if single ids are there very often, as ids are drawn, not rows."""
    made = _features_udf()
    got = rows.select(made(F.col("text").cast("string")).alias("x")).limit(most).toArrow().column("x").combine_chunks()
    return np.array(got.values, np.float32).reshape(-1, WIDTH) if len(got) else np.zeros((0, WIDTH), np.float32)


def train(docs: DataFrame, labels: DataFrame, bound: int = 8000) -> Model | None:
    """A model from at most about ``bound`` labelled positives and ``bound`` unlabelled rows; None without positives.

    The sample follows from hashes of doc_id, so it is the same whatever the partitions.  Held-out
    rows take no part.
    """
    prepared(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(~held_out("doc_id") & F.col("quality").isin(0, 1))
    sizes = known.groupBy("quality").count().collect()
    count = {r["quality"]: r["count"] for r in sizes}
    if not count.get(1):
        return None
    draw = lambda n: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20)) < int(min(1.0, bound / max(n, 1)) * (1 << 20))
    some = known.filter("quality = 1").filter(draw(count[1])).select(F.col("doc_id").alias("_known")).distinct()
    # At most about ``bound`` ids: a broadcast of bounded size.
    positive = _gathered(docs.join(F.broadcast(some), docs["doc_id"].cast("long") == some["_known"], "left_semi"), 2 * bound)
    web = docs.filter(~held_out("doc_id"))
    unlabelled = _gathered(web.filter(F.coalesce(draw(docs.count()), F.lit(False))), 2 * bound)
    if not len(positive) or not len(unlabelled):
        return None
    if min(count.get(0, 0), count[1]) >= 20:
        prior = count[1] / (count[0] + count[1])
    else:
        prior = elkan_noto_prior(positive, unlabelled)
    return fit(positive, unlabelled, min(max(prior, 0.02), 0.98))


def scorer(model: Model | None):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(text), 0.5))
        return pa.array(np.concatenate([np.zeros(0), *(model.score(x).astype(float) for x in _blocks(text))]))

    return score


def scored(docs: DataFrame, labels: DataFrame, bound: int = 8000, threshold: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Null text counts as empty, which has a score like any text.  A null doc_id isn't held out.
    Repeated rows are scored each.  Without any trusted positive all scores are 0.5.
    """
    score = scorer(train(docs, labels, bound))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, bound: int = 8000, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    return docs.filter(scorer(train(docs, labels, bound))(F.col("text").cast("string")) >= threshold)
