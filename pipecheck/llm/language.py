"""Language of each document as a mixture of the languages seen in training (operator 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipecheck.llm.common import table, with_fields, without
from pipecheck.llm.toxicity import in_fold

BITS = 14
SMOOTHING = 0.5
ROUNDS = 25
# A further language must raise the log-likelihood by this times the log of the number of n-grams.
PENALTY = 2.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def ngrams(text: str) -> np.ndarray:
    """Hashed trigrams of a text's code points, a space before and behind."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x1000003) + c[1:-1]) * np.uint64(0x1000003) + c[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def fit_languages(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and n-gram probabilities of the languages of ``docs`` (text, lang), over all rows with both.

    Each task adds up the n-grams of its rows and sends one count per n-gram and language, at most 2^BITS rows for
    each language; the sums are as large, whatever the input. They come to the driver as the model.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                own = sums.get(lang)
                if own is None:
                    own = sums[lang] = np.zeros(1 << BITS, dtype=np.int64)
                own += np.bincount(ngrams(text), minlength=1 << BITS)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "gram": seen.astype(np.int32), "n": own[seen]})

    given = docs.select("text", "lang").filter("text is not null and lang is not null")
    sums = given.mapInPandas(counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    counts = np.zeros((len(names), 1 << BITS))
    counts[np.searchsorted(names, sums["lang"]) if names else [], sums["gram"]] = sums["n"]
    counts += SMOOTHING
    return list(names), counts / counts.sum(axis=1, keepdims=True)


def proportions(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation, and their log-likelihood.

    ``p`` has the probability of each n-gram in each language, ``n`` how often each occurs.
    """
    share = np.full(len(p), 1 / len(p))
    mixed = share @ p
    for _ in range(ROUNDS if len(p) > 1 else 0):
        new = share * (p @ (n / mixed)) / n.sum()
        still = np.abs(new - share).max() < 1e-3
        share = new
        mixed = share @ p
        if still:
            break
    return share, float(n @ np.log(mixed))


def languages_of(text: str | None, names: list[str], probabilities: np.ndarray) -> list[tuple[str, float]]:
    """Languages of a text with their proportions, largest first.

    All languages are fitted first. Then the set grows by descending proportion as long as the log-likelihood, less PENALTY
    times the log of the number of n-grams for each language, grows too.
    """
    if not names or text is None or not _LETTER.search(text):
        return [(UNKNOWN, 0.0)]
    counts = np.bincount(ngrams(text), minlength=1 << BITS)
    grams = np.flatnonzero(counts)
    n, p = counts[grams], probabilities[:, grams]
    order = np.argsort(-proportions(p, n)[0], kind="stable")
    cost = PENALTY * np.log(n.sum() + 1)
    best = None
    for size in range(1, len(names) + 1):
        chosen = order[:size]
        share, likelihood = proportions(p[chosen], n)
        if best and likelihood - cost * size <= best[0]:
            break
        best = (likelihood - cost * size, chosen, share)
    _, chosen, share = best
    return sorted(((names[i], float(s)) for i, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def label_languages(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The columns of ``docs`` (text needed) and lang_pred, score, langs, shares.

    ``langs`` is the selected set with its ``shares``, largest first; lang_pred and score are its first. Null texts and texts without a letter are ``und`` with
    score 0, as are all texts if nothing was learnt. Rows are handled one by one where they are read. Clashing
    columns are replaced.
    """
    names, probabilities = model
    rest = without(docs, ["lang_pred", "score", "langs", "shares"])
    schema = with_fields(rest, "lang_pred string, score double, langs array<string>, shares array<double>")

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [languages_of(t, names, probabilities) for t in batch["text"]]
            yield batch.assign(
                lang_pred=[f[0][0] for f in found],
                score=[min(f[0][1], 1.0) for f in found],
                langs=[[x for x, _ in f] for f in found],
                shares=[[s for _, s in f] for f in found],
            )

    return rest.mapInPandas(labelled, schema)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~in_fold(F.col("doc_id"))))
    found = label_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": (op7_language, None)}
