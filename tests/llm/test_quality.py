import random
import re

from pyspark.sql import functions as F
from helpers import documents, spark_rows, sql_rows

from pipecheck.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def brute_facts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a b c d e a b c d e", "x x x x x", "x x x x x x", "a b c d", "#* $%& <|>\nsame\nsame\n same", "word " * 3000]
    for _ in range(60):
        line = [" ".join(rng.choice("ab cd e é f# g".split()) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 8))]
        out.append("\n".join(line))
    return out


def test_facts_against_brute_force():
    for text in texts():
        assert quality.text_facts(text)[:5] == brute_facts(text)


def corpus(spark):
    rng = random.Random(6)
    notice = "All rights to this page are with those who made it and nobody else"
    rows, hosts = texts(), []
    for n in range(160):
        own = " ".join(f"w{rng.randrange(9000)}" for _ in range(30 if n % 2 else 6))
        rows.append(f"{own}\n  {notice.upper() if n % 3 else notice}")
    hosts = [None if n % 11 == 0 else ("big" if n % 4 else "small") for n in range(len(rows))]
    return documents(spark, rows, source=hosts)


def test_against_sql(spark):
    docs = corpus(spark)
    got = quality.quality(docs.withColumnRenamed("source", "host").withColumn("first", F.lit(1)))
    assert spark_rows(got.drop("host", "n_lost")) == sql_rows(quality.SQL, {"documents": docs})
    lost = got.filter("n_lost > 0 and not base_failed")
    assert lost.filter("kept").count() and lost.filter("not kept").count()
    assert {r["host"] for r in lost.collect()} == {"big"}  # the others have too few


def test_nulls_repeats_and_no_rows(spark):
    line = "a line that is long enough to pass all of the base rules here"
    docs = documents(spark, [line] * 4, doc_id=[1, 1, 2, None], source=None).withColumnRenamed("source", "host")
    got = sorted(((r["doc_id"], r["n_lost"], r["kept"]) for r in quality.quality(docs, most_documents=1).collect()), key=repr)
    assert got == sorted([(1, 0, True), (1, 0, True), (2, 14, False), (None, 0, True)], key=repr)
    assert quality.quality(docs.limit(0)).count() == 0
