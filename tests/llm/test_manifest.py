import random
import zlib
from hashlib import sha256

import pytest
from helpers import documents
from pyspark.sql import functions as F

from pipecheck.llm import manifest
from pipecheck.llm.ranks import placed


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(encoded, (doc_id, source, lang, n_chars, text)))


def grow(nodes, fanout):
    """All levels, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels, place, fanout):
    out = []
    for nodes in levels[:-1]:
        first = place - place % fanout
        run = nodes[first : first + fanout]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= fanout
    return out


def brute(rows, fanout=2):
    """Sorted (doc_id, leaf, subroot, root, path) of rows (doc_id, text, lang, source, n_chars)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    order = sorted(langs, key=lambda v: b"" if v is None else b":" + v.encode())
    trees = {v: grow([k[2] for k, _ in sorted(langs[v], key=lambda p: p[0])], fanout) for v in order}
    top = grow([trees[v][-1][0] for v in order], fanout)
    out = []
    for n, v in enumerate(order):
        for place, (key, r) in enumerate(sorted(langs[v], key=lambda p: p[0])):
            out.append((r[0], key[2], trees[v][-1][0], top[-1][0], way(trees[v], place, fanout) + way(top, n, fanout)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout, levels", [(2, 3), (2, 10), (3, 2)])
def test_against_brute_force(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    texts = [rng.choice([None, "", "x", "é\n", "w" * 4000]) for _ in range(150)]
    langs = [rng.choice(["en"] * 6 + ["de", "É", "zz", None, ""]) for _ in texts]
    docs = documents(spark, texts, lang=langs, doc_id=rng.sample(range(-50, 1000), 150), source=[rng.choice([None, "a:", "a"]) for _ in texts])
    rows = [tuple(r) for r in docs.collect()]
    got = manifest.merkle_manifest(docs.withColumn("place", F.lit("x")).withColumn("G", F.lit(1)), fanout, levels)
    assert found(got) == brute(rows, fanout)


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_small_trees(spark, n):
    docs = documents(spark, ["t"] * n)
    assert found(manifest.merkle_manifest(docs, levels=1)) == brute([tuple(r) for r in docs.collect()])


def test_nulls_and_repeated_rows(spark):
    docs = documents(spark, ["a", "b", None, "a", "b"], doc_id=[7, 7, None, 7, None], lang=[None, None, None, None, "x"])
    assert found(manifest.merkle_manifest(docs)) == brute([tuple(r) for r in docs.collect()])


def test_query_finds_what_was_changed(spark, tmp_path):
    docs = documents(spark, [f"t {n}" for n in range(60)], lang=["en", "de", "fr"] * 20).withColumn(
        "n_chars", F.when(F.col("doc_id") % 4 > 0, F.col("n_chars"))
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in manifest.op13_merkle(spark, str(tmp_path)).collect()}
    for doc_id, own, subroot, root, path in brute([tuple(r) for r in docs.collect()]):
        r = rows[doc_id]
        assert (r["leaf"], r["subroot"], r["root"]) == (own, subroot, root)
        assert r["proof_sha256"] == h(*(a + b for a, b in path))
        broken = zlib.crc32(str(doc_id).encode()) % 7 == 0 and doc_id % 4 > 0
        assert r["verified"] is not broken and (r["folded_root"] == root) is not broken
    assert {r["verified"] for r in rows.values()} == {True, False}


def test_places(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), rng.randrange(30), k) for k in range(500)]
    got = placed(spark.createDataFrame(rows, "g string, v int, k int"), "g", [F.col("v")], "places").collect()
    for g in "ab":
        own = sorted((r["place"], r["v"], r["size"]) for r in got if r["g"] == g)
        assert [p for p, _, _ in own] == list(range(len(own))) and {s for _, _, s in own} == {len(own)}
        assert [v for _, v, _ in own] == sorted(v for _, v, _ in own)
