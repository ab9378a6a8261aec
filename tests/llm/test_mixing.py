import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from helpers import documents, spark_rows, sql_rows

from pipecheck.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share all by weight, again and again, until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(most * sizes[s] for s in stopped)
        share = {s: Fraction(w[s] * rest, sum(w[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: float(share.get(s, most * sizes[s])) for s in order}
        stopped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 5000}, {"a": 7, None: 90}, {"a": 0, "b": 0}, {"x": 3},
    {f"s{i:02d}": (i * 37) % 11 * (1 + i % 5) ** 3 for i in range(30)},
])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows, (5, 2, 1), 3).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)


def corpus(spark):
    texts = [("w " * (1 + n * n % 50)) for n in range(400)] + [None, "", " \t\n", "a\u00a0b c"]
    sources = [("big" if n % 3 else f"s{n % 4}") for n in range(403)] + [None]
    return documents(spark, texts, source=sources)


def test_against_sql_and_limits(spark):
    docs = corpus(spark)
    got = mixing.mix_sources(docs.withColumn("Size", F.lit("clash")))
    assert got.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    rows = spark_rows(got.select("doc_id", "size", "source_size", "target", "taken"))
    assert rows == sql_rows(mixing.SQL, {"documents": docs})
    for source in ("big", "s0", "s3"):
        own = [r for r in got.filter(F.col("source") == source).collect()]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * max(r["size"] for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in own)
    assert {r["doc_id"]: r["size"] for r in got.collect() if r["doc_id"] >= 400} == {400: 0, 401: 0, 402: 0, 403: 2}


def test_reruns_agree(spark):
    docs = corpus(spark)
    assert spark_rows(mixing.mix_sources(docs)) == spark_rows(mixing.mix_sources(docs.repartition(7)))


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = documents(spark, ["a b c", "a b c", "d e", None], doc_id=[1, 1, None, None], source=["x", "x", None, None])
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 4 and len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_number_of_words(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a\n", " a  b\t", "a\u00a0b c", "é è", "\u2003", "a\x1cb", "x " * 500]
    got = documents(spark, texts).select("doc_id", mixing.n_words(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == [len((t or "").encode().split()) for t in texts]
    # A regular expression that lists all words of a text costs half as much again.
    assert "regexp" not in documents(spark, texts).select(mixing.n_words(F.col("text")))._jdf.queryExecution().toString().lower()
