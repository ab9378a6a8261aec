"""Toxicity scores by non-negative positive-unlabelled learning (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import hash_cut, hash_order, pieces, table, with_fields, without

BITS = 18
# Bounds of the training sample: rows of either kind, those of the smallest hash.
MOST_POSITIVE = 4000
MOST_UNLABELLED = 8000
# Longest training text in code points; longer ones stay out of the sample, never out of the scores.
LONGEST = 20000
# A feature takes part if it is in so many sample texts and its share among the positives differs by so many standard errors.
LEAST_TEXTS = 5
LEAST_Z = 5.0
# Bytes of texts that are scored together.
PIECE = 1 << 18
STEPS = 1000
RATE = 0.05
DECAY = 1e-4

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Bytes that belong to a word: digits, letters, and all of other scripts.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE, dtype=np.uint64)
    back = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


class Hasher:
    """Hashed features of a text: its words, and the first 4 and 6 bytes of each."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.up, self.down = _powers(1 << 12)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the features and log(1 + count) of each; a text without words has none."""
        raw = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(2 * len(raw) + 2)
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = _IN_WORD[raw]
        edges = np.diff(inside)
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(start):
            return np.empty(0, dtype=np.int64), np.empty(0)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)], out=total[1:])
        ends = [end, *(start[end - start > k] + k for k in (4, 6))]
        starts = [start, *(start[end - start > k] for k in (4, 6))]
        s, e = np.concatenate(starts), np.concatenate(ends)
        kind = np.repeat(np.arange(1, 4, dtype=np.uint64), [len(x) for x in starts])
        h = (total[e] - total[s]) * self.down[s] + kind * _BASE
        h = ((h ^ (h >> np.uint64(29))) * _MIX) >> self.shift
        index, count = np.unique(h.astype(np.int64), return_counts=True)
        return index, np.log1p(count)


def _text_scores(raw: bytes, ends: np.ndarray, weights: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Sum of weights[feature] * log(1 + count) of each text; they stand one behind the other in ``raw``, up to ``ends``.

    The features are those of ``hasher``; only those with a weight are counted.
    """
    raw = np.frombuffer(raw.lower(), dtype=np.uint8)
    if len(raw) >= len(hasher.up):
        hasher.up, hasher.down = _powers(2 * len(raw) + 2)
    inside = _IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(raw))]  # a word also ends with its text
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw + np.uint64(1)) * hasher.up[: len(raw)], out=total[1:])
    of_text = np.searchsorted(ends, start, side="right")
    found = []
    for kind, size in zip(np.arange(1, 4, dtype=np.uint64) * _BASE, (None, 4, 6), strict=True):
        long = slice(None) if size is None else end - start > size
        s, e = start[long], end[long] if size is None else start[long] + size
        h = (total[e] - total[s]) * hasher.down[s] + kind
        h = (((h ^ (h >> np.uint64(29))) * _MIX) >> hasher.shift).astype(np.int64)
        known = weights[h] != 0
        found.append(of_text[long][known] * len(weights) + h[known])
    cell, count = np.unique(np.concatenate(found), return_counts=True)
    return np.bincount(cell // len(weights), weights[cell % len(weights)] * np.log1p(count), minlength=len(ends))


def _screened(positive: list, unlabelled: list, size: int) -> np.ndarray:
    """Features whose share of texts differs between the positives and the unlabelled texts."""
    def texts(sample):
        return np.bincount(np.concatenate([i for i, _ in sample]), minlength=size)

    p, u = texts(positive), texts(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    share = (p + u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share) * (1 / n_p + 1 / n_u), 1e-12))
    return np.flatnonzero((p + u >= LEAST_TEXTS) & (np.abs(p / n_p - u / n_u) > LEAST_Z * error))


def fit(positive: list, unlabelled: list, prior: float, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier from confirmed positives and unlabelled texts.

    Both are lists of (indices, values). The risk is prior * R+(positive) + max(0, R-(unlabelled) - prior *
    R-(positive)) with the logistic loss. Where the second part is below zero, the step goes up its gradient instead,
    so that the estimated risk of the negatives cannot fall below zero by overfitting. Adam over the whole sample.
    """
    weights, bias = np.zeros(1 << bits), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    keep = _screened(positive, unlabelled, 1 << bits)
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[keep] = np.arange(len(keep))
    n_p, n_u = len(positive), len(unlabelled)
    # Only the screened features of each text go on.
    cells = [(place[i][place[i] >= 0], v[place[i] >= 0]) for i, v in positive + unlabelled]
    row = np.repeat(np.arange(n_p + n_u), [len(i) for i, _ in cells])
    column = np.concatenate([i for i, _ in cells])
    value = np.concatenate([v for _, v in cells]).astype(np.float64)
    x = np.zeros(len(keep) + 1)
    x[-1] = bias
    first, second = np.zeros_like(x), np.zeros_like(x)
    slope = np.empty(n_p + n_u)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, x[column] * value, minlength=n_p + n_u) + x[-1]
        toxic = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z)  # of calling a text clean
        if loss[n_p:].mean() - prior * loss[:n_p].mean() >= 0:
            slope[:n_p] = -prior / n_p
            slope[n_p:] = toxic[n_p:] / n_u
        else:
            slope[:n_p] = prior * toxic[:n_p] / n_p
            slope[n_p:] = -toxic[n_p:] / n_u
        gradient = np.append(np.bincount(column, slope[row] * value, minlength=len(keep)) + DECAY * x[:-1], slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[keep] = x[:-1]
    return weights, float(x[-1])


def in_fold(key: Column, folds: int = 5) -> Column:
    """True for the rows held out of learning: crc32 of the key as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _sampled(docs: DataFrame, keys: DataFrame, most: int) -> list:
    """Features of the texts of at most ``most`` keys (doc_id), those of the smallest hash."""
    short = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST)
    cut = hash_cut(keys.select("doc_id"), "doc_id", keys.count(), most)
    known = short.select("doc_id").join(cut, "doc_id", "left_semi").distinct()
    chosen = known.orderBy(hash_order("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            rows = [hasher(t) for t in batch["text"]]
            yield pd.DataFrame({"i": [i.astype(np.int32) for i, _ in rows], "v": [v.astype(np.float32) for _, v in rows]})

    # At most ``most`` ids: the bound of this broadcast and of what comes to the driver.
    texts = short.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")
    got = texts.mapInPandas(features, "i array<int>, v array<float>").toArrow()
    return [
        (i.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False))
        for i, v in zip(got["i"], got["v"], strict=True)
    ]


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text).

    Only rows outside the held-out fold are used. The sample is bounded by MOST_POSITIVE and MOST_UNLABELLED texts of
    at most LONGEST code points; the class prior is the toxic share of all labels outside the fold. Null labels and
    texts are left out. Without toxic labels every text gets the same low score.
    """
    known = labels.filter("toxic is not null").filter(~in_fold(F.col("doc_id")))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()  # one row
    prior = min(max(counts["toxic"] / counts["n"] if counts["n"] else 0.0, 1e-3), 0.5)
    free = docs.filter(~in_fold(F.col("doc_id")))
    positive = _sampled(free, known.filter("toxic = 1").select("doc_id"), MOST_POSITIVE)
    unlabelled = _sampled(free, free.select("doc_id"), MOST_UNLABELLED)
    return fit(positive, unlabelled, prior)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The columns of ``docs`` (text needed) and score, from 0 to 1, of each whole text.

    Null and empty texts have the score of a text without known words. Texts are scored row by row where they are read;
    nothing is shuffled. A column named score is replaced. The weights are one array of fixed size.
    """
    weights, bias = model
    rest = without(docs, ["score"])
    schema, names = with_fields(rest, "score double"), [c.lower() for c in rest.columns]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(names.index("text"))
            z = np.concatenate([np.empty(0), *(_text_scores(raw, ends, weights, hasher) for raw, ends in pieces(texts, PIECE))])
            score = 1 / (1 + np.exp(-np.clip(bias + z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return rest.mapInArrow(scored, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scores = score_toxicity(docs, model)
    return scores.select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op10_toxicity": (op10_toxicity, None)}
