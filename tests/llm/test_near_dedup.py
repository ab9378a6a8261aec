import random

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from pipecheck.llm import near_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) >= 2 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                u, v = find(i), find(j)
                part[max(u, v)] = min(u, v)
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    common = [f"the{k}" for k in range(12)]
    texts = []
    for _ in range(60):
        base = [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(rng.choice([2, 4, 8, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    # A chain: each differs from the next by a few words, the ends by many.
    chain = [f"c{k}" for k in range(200)]
    for k in range(20):
        chain[k * 9] = f"n{k}"
        texts.append("\t".join(chain))
    texts += [None, "", " \t", "one", "One", "one two", "one two three", "É a b c d", "é a b c d", "a b"]
    rng.shuffle(texts)
    return texts


def star(seed, size=400):
    """Copies of one text that each change other words: most resemble the text alone, not each other."""
    rng = random.Random(seed)
    base = [f"g{x}" for x in range(300)]
    texts = [" ".join(base)]
    for k in range(size):
        own = list(base)
        for at in rng.sample(range(0, 300, 2), 15):
            own[at] = f"own{k}x{at}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("texts", [corpus(1), star(2)], ids=["mixed", "star"])
def test_against_brute_force(spark, texts):
    docs = documents(spark, texts).withColumn("n", F.lit("x")).withColumn("tree", F.lit(1))
    assert found(near_dedup.near_copies(docs)) == brute(texts)


def test_many_tasks(spark):
    texts = corpus(3)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(near_dedup.near_copies(documents(spark, texts))) == brute(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nulls_repeats_text_ids_and_no_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "x"], doc_id=[7, 7, None, 9])
    want = [(7, 7, True), (7, 7, True), (None, None, False), (9, 9, True)]
    got = near_dedup.near_copies(docs).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    assert {r["component_id"] for r in near_dedup.near_copies(named).collect()} == {"n7", "n9", None}
    assert near_dedup.near_copies(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50000)}" for _ in range(200000)]
    near = [w if rng.random() < 0.97 else "new" for w in words]
    other = [f"v{rng.randrange(50000)}" for _ in range(200000)]
    assert [r[1] for _, r in sorted(found(near_dedup.near_copies(documents(spark, [" ".join(t) for t in (words, near, other)]))).items())] == [0, 0, 2]


def test_signatures_estimate_similarity():
    signer, rng = near_dedup.Signer(), np.random.default_rng(3)
    for n, share in ((40, 0.5), (300, 0.8), (5000, 0.8), (5000, 0.2)):
        agreed, bits = [], []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            shared = round(2 * n * share / (1 + share))
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared : 2 * n - shared])
            agreed.append((signer.least(a) == signer.least(b)).mean())
            (_, x), (_, y) = signer.signature(a), signer.signature(b)
            bits.append(near_dedup._agreement(*(np.array([v]) for v in (*x, *y)))[0] / near_dedup.SKETCH)
        true = shared / (2 * n - shared)
        assert abs(np.mean(agreed) - true) < 0.03 and abs(np.mean(bits) - (0.5 + true / 2)) < 0.03
