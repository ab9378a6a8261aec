"""Toxicity and language: learnt models, held against rows that they have not seen."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from helpers import documents

from pipecheck.llm import language, toxicity
from pipecheck.llm.common import pieces


def held_out(n):
    return zlib.crc32(str(n).encode()) % 5 == 0


def toxic_corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "su") for b in ("ra", "ne", "vo", "di", "pul", "en")]
    texts, toxic = [], []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        bad = k % 7 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                own.insert(rng.randrange(len(own)), rng.choice(["Grump", "oaf!", "dunce"]))
        texts.append(" ".join(own))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_held_out(spark):
    texts, toxic = toxic_corpus()
    docs = documents(spark, [*texts, None, "", "\U0001f600 !!", "oaf dunce " * 30000])
    labels = spark.createDataFrame([(k, t) for k, t in enumerate(toxic) if k % 2] + [(9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs.withColumn("toxic", F.lit("x")), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), model).collect()}
    out = [k for k in range(len(texts)) if held_out(k)]
    assert sum((got[k] >= 0.5) == toxic[k] for k in out) / len(out) > 0.97
    assert got[len(texts)] == got[len(texts) + 1] < 0.5 < got[len(texts) + 3] and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_labels_or_rows(spark):
    docs = documents(spark, ["a b", "c d"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, none)
    assert all(r["score"] < 0.5 for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), none)).count() == 0


def test_features_against_plain_python():
    hasher = toxicity.Hasher()
    for text in ("Ab ab, cd-ab", "x" * 9000 + " y", "état ÉTAT etat", "a"):
        index, value = hasher(text)
        again = toxicity.Hasher()(text + " ")
        assert (again[0] == index).all() and np.allclose(again[1], value)
    one, two = dict(zip(*hasher("aa bb"), strict=True)), dict(zip(*hasher("bb aa aa"), strict=True))
    assert one.keys() == two.keys() and sorted(np.round(np.expm1(list(two.values())))) == [1, 2]
    assert set(hasher("words")[0]) & set(hasher("wordy")[0])  # the first four bytes agree
    assert len(hasher("")[0]) == len(hasher("  ..")[0]) == 0


def test_negative_risk_never_drives_scores_apart():
    p = [(np.array([1]), np.array([1.0]))] * 30
    u = p[:3] + [(np.array([2]), np.array([1.0]))] * 27
    weights, bias = toxicity.fit(p, u, 0.1)
    assert np.isfinite(weights).all() and bias < 0


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "oi", "que"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    langs = [("aa", "bb", "cc")[k % 3] for k in range(300)]
    texts = [prose(rng, lang, rng.randrange(8, 60)) for lang in langs]
    mixed = prose(rng, "aa", 60) + " " + prose(rng, "bb", 40)
    docs = documents(spark, [*texts, mixed, None, "", "12 34", "\n"], lang=[*langs, None, "aa", None, "bb", None])
    model = language.fit_languages(docs.filter(~toxicity.in_fold(F.col("doc_id"))))
    assert model[0] == ["aa", "bb", "cc"] and np.allclose(model[1].sum(axis=1), 1)
    got = {r["doc_id"]: r for r in language.label_languages(docs.withColumn("langs", F.lit(1)), model).collect()}
    out = [k for k in range(300) if held_out(k)]
    assert sum(got[k]["lang_pred"] == langs[k] for k in out) / len(out) > 0.97
    assert list(got[300]["langs"]) == ["aa", "bb"] and 0.4 < got[300]["score"] < 0.8
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (301, 302, 303, 304)] == [("und", 0.0)] * 4


def test_proportions_against_plain_em():
    rng = np.random.default_rng(2)
    p, n = rng.random((3, 40)), rng.integers(1, 9, 40)
    share, likelihood = language.proportions(p, n)
    want = np.full(3, 1 / 3)
    for _ in range(language.ROUNDS):
        post = want[:, None] * p
        post /= post.sum(axis=0)
        want = (post * n).sum(axis=1) / n.sum()
    assert np.allclose(share, want, atol=0.02) and np.isclose(likelihood, n @ np.log(share @ p))


def test_languages_without_training_rows(spark):
    docs = documents(spark, ["words", None], lang=None)
    model = language.fit_languages(docs)
    assert {r["lang_pred"] for r in language.label_languages(docs, model).collect()} == {"und"}
    assert language.label_languages(docs.limit(0), model).count() == 0


def test_scores_of_many_texts_at_once():
    weights = np.random.default_rng(1).normal(size=1 << toxicity.BITS)
    weights[::3] = 0
    texts = ["Ab ab, cd-ab", None, "x" * 9000 + " y", "", "état ÉTAT etat", "a", "a", " ..", "abcd abcde abcdefgh", "the end"]
    hasher = toxicity.Hasher()
    plain = [weights[i] @ v for i, v in (hasher(t or "") for t in texts)]
    for size in (1, 40, 1 << 18):
        parts = pieces(pa.array(texts), size)
        got = np.concatenate([toxicity._text_scores(raw, ends, weights, toxicity.Hasher()) for raw, ends in parts])
        assert np.allclose(got, plain, rtol=0, atol=1e-9)
