import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from helpers import documents

from pipecheck.llm import ngram_join
from pipecheck.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


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
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 5, 8, 40, 120, 300]))]
        if rng.random() < 0.4:
            base[:0] = passage
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    # A chain: each differs from the next by a few words, the ends by many.
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):
        chain[k * 15] = f"n{k}"
        texts.append("\t".join(chain))
    # A group of near copies, each with its own change.
    for k in range(60):
        near = [f"g{x}" for x in range(150)]
        near[(k * 7) % 150] = f"own{k}"
        texts.append(" ".join(near))
    texts += [None, "", " \t", "one", "One", "one two three four", "one two three four five", "É a b c d", "é a b c d", "a b c"]
    rng.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        got = ngram_join.similar_groups(documents(spark, texts).withColumn("n", F.lit("x")).withColumn("prefix", F.lit(1)))
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(texts)


def test_nulls_repeats_and_no_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "x"], doc_id=[7, 7, None, 9])
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.similar_groups(docs).collect()), key=repr)
    assert got == sorted([(7, 7), (7, 7), (None, None), (9, 9)], key=repr)
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


def test_prefix_length():
    for n in range(1, 200):
        least = -(-n * 80 // 100)
        assert ngram_join.prefix_length(n) == n - least + 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20), (None, 1), *((100 + k, 101 + k) for k in range(40)), *((500, 501 + k) for k in range(30))]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((8, 9, 10), 8), **dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(500, 531), 500)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_of_many_texts_at_once(monkeypatch):
    texts = [*corpus(3), "x" * 100 + " y z", "x" * 101 + " y z", "q" * 64, "abcdefgh", "abcdefghi", "a\x0bb\x0cC d\re\tF", "a\x1cb", "e\u2003f", None]
    plain = [shingles(t) for t in texts]
    for piece in (1, 50, 1 << 20):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        sets = ngram_join.shingle_sets(pa.array(["left out", *texts]).slice(1))
        assert [len(s) for s in sets] == [len(s) for s in plain]
        assert all((s[1:] > s[:-1]).all() for s in sets)
        # Equal n-grams, and only these, have equal hashes.
        assert len(set().union(*(s.tolist() for s in sets))) == len(frozenset().union(*plain))
        for a, b in ((0, 5), (10, 11), (-3, -2)):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])
    assert ngram_join.shingle_sets(pa.array([], pa.string())) == []
