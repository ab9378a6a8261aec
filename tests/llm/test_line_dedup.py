import hashlib

from helpers import by_id, documents, spark_rows, sql_rows

from pipecheck.llm import line_dedup
from pipecheck.session import written
from pyspark.sql import functions as F

TEXTS = [
    "A line that many have\nown words of zero\nshort",
    "  a LINE that many have\t\nshort\nown words of one",
    "own words of two\nA line that many have\nA line that many have\nshort",
    None,
    "",
    "\n\n",
    "\u00c9tat de la ligne\nx",
    "\u00e9tat de la ligne\nx",
]


def test_edge_cases(spark):
    docs = documents(spark, TEXTS).withColumn("N_LINES", F.lit("clash")).withColumn("extra", F.lit(1))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c != "N_LINES"), "n_lines", "n_dropped"]
    texts = by_id(got, "text", "n_lines", "n_dropped")
    assert texts[0] == (TEXTS[0], 3, 0)
    assert texts[1] == ("short\nown words of one", 3, 1)
    assert texts[2] == ("own words of two\nshort", 4, 2)
    assert texts[3] == texts[4] == ("", 1, 0)
    assert texts[5] == ("\n\n", 3, 0)
    assert texts[7] == (TEXTS[7], 2, 0)  # only A-Z is lower-cased


def test_against_sql(spark):
    docs = documents(spark, [*TEXTS, *TEXTS[:3]])
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    assert spark_rows(got) == sql_rows(line_dedup.SQL, {"documents": docs})


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = documents(spark, ["the same long line", "the same long line", "the same long line"], doc_id=[1, 1, None])
    assert sorted(r["text"] for r in line_dedup.dedup_lines(docs).collect()) == ["the same long line"] * 3
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_more_documents_asked_for(spark):
    docs = documents(spark, TEXTS[:3])
    assert by_id(line_dedup.dedup_lines(docs, min_docs=4), "n_dropped") == {0: 0, 1: 0, 2: 0}


def test_long_text(spark):
    line = "word " * 20000
    got = by_id(line_dedup.dedup_lines(documents(spark, [line, line + "\nlast"])), "text")
    assert got == {0: line, 1: "last"} and hashlib.sha256(got[1].encode()).hexdigest()


def test_lines_are_hashed_once(spark, monkeypatch):
    held = []
    monkeypatch.setattr(line_dedup, "written", lambda df, name: held.append(name) or written(df, name))
    found = line_dedup.dedup_lines(documents(spark, TEXTS))
    assert held == ["line-keys"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 0
