"""Term sets, overlaps, case results and means."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipecheck.functions import terms as TS
from pipecheck.operators import scoring
from queries import inputs as I

# Cases are benchmark items, numbered from 0; every document is a report on one of them.
CASES = "(SELECT count(*) FROM benchmark)"


def _cases(spark, sf_dir) -> int:
    return I.table(spark, sf_dir, "benchmark").count()


def term_sets(spark, sf_dir):
    documents = I.texts(spark, sf_dir, "documents", "doc_id")
    terms = documents.select("doc_id", TS.term_set(F.col("text")).alias("terms"))
    digest = F.md5(F.array_join(F.array_sort("terms"), " "))
    return terms.select("doc_id", digest.alias("digest"), F.size("terms").cast("bigint").alias("n_terms"))


def _pairs(spark, sf_dir):
    documents = I.texts(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("text").alias("predicted"), (F.col("doc_id") % _cases(spark, sf_dir)).alias("item_id"))
    items = I.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("expected"))
    joined = documents.join(items, "item_id")
    return joined.withColumns({"have": TS.term_set(F.col("predicted")), "want": TS.term_set(F.col("expected"))})


def term_overlap(spark, sf_dir):
    have, want = F.col("have"), F.col("want")
    return _pairs(spark, sf_dir).select(
        "doc_id", "item_id", F.round(TS.overlap_ratio(have, want), 6).alias("ratio"),
        F.round(TS.precision(have, want), 6).alias("precision"),
        ((F.length("predicted") > 0) & TS.terms_match(have, want)).alias("matches"),
    )


def term_diff(spark, sf_dir):
    have, want = F.col("have"), F.col("want")
    return _pairs(spark, sf_dir).select(
        "doc_id", "item_id", F.array_join(TS.matched_terms(have, want), " ").alias("matched"),
        F.array_join(TS.missing_terms(have, want), " ").alias("missing"),
    )


def overlap_documents_benchmark(spark, sf_dir):
    documents = I.texts(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    items = I.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return scoring.match_all(documents, items, "doc_id", "item_id")


def _case_id(number: F.Column) -> F.Column:
    return F.concat(F.lit("case_"), number.cast("string"))


def _reports(spark, sf_dir):
    """Documents as reports of four models; labels tell how their repair ran."""
    doc = F.col("doc_id")
    return I.texts(spark, sf_dir, "documents", "doc_id").select(
        _case_id(doc % _cases(spark, sf_dir)).alias("case_id"),
        F.concat(F.lit("model_"), (doc % 4).cast("string"), F.lit("_"), doc.cast("string")).alias("model"),
        F.when(doc % 19 == 0, "max_steps_reached").otherwise("success").alias("status"),
        F.col("text").alias("root_cause"),
        F.when(doc % 23 == 0, "").otherwise("INSERT INTO t SELECT 1").alias("fixed_sql"),
        F.when(doc % 3 == 0, "").otherwise("SELECT COUNT(*) FROM own").alias("verification_query"),
        (doc % 15 + 1).alias("steps_taken"),
        (F.col("n_chars") / 8).alias("time_seconds"),
        F.when(doc % 29 == 0, "model did not answer").alias("error"),
    )


def _expected(spark, sf_dir):
    item = F.col("item_id")
    return I.table(spark, sf_dir, "benchmark").select(
        _case_id(item).alias("case_id"),
        F.concat(F.lit("Case "), item.cast("string")).alias("case_name"),
        F.col("text").alias("root_cause"),
        F.when(item % 2 == 0, "SELECT COUNT(*) FROM expected").alias("verification_query"),
        F.when(item % 4 == 0, F.lit(2)).cast("bigint").alias("expected_row_count_min"),
    )


def _checks(spark, sf_dir):
    doc = F.col("doc_id")
    return I.table(spark, sf_dir, "labels").select(
        _case_id(doc % _cases(spark, sf_dir)).alias("case_id"),
        F.concat(F.lit("model_"), (doc % 4).cast("string"), F.lit("_"), doc.cast("string")).alias("model"),
        F.when(F.col("toxic") == 1, "cast failed").alias("fix_error"),
        F.when(doc % 31 == 0, "no such table").alias("check_error"),
        (F.col("quality") * (doc % 3 + 1)).cast("bigint").alias("cnt"),
    )


def case_results(spark, sf_dir):
    results = scoring.case_results(_reports(spark, sf_dir), _expected(spark, sf_dir), _checks(spark, sf_dir))
    return scoring.case_labels(results)


def _model_means(results):
    models = results.withColumn("model", F.substring("model", 1, 7))
    means = scoring.eval_means(models, "model")
    rounded = {c: F.round(c, 6) for c in ("diagnosis_accuracy", "fix_accuracy", "mean_steps", "mean_time")}
    return means.withColumns(rounded)


def eval_means(spark, sf_dir):
    return _model_means(case_results(spark, sf_dir))


def case_filter(spark, sf_dir):
    """Means of the cases whose id starts with a prefix."""
    chosen = scoring.filter_cases(case_results(spark, sf_dir), "case_1", "case_id")
    return _model_means(chosen)


def cases_to_choose(spark, sf_dir):
    """What a caller can choose from: all case ids, as no case begins with the prefix."""
    return scoring.available_cases(case_results(spark, sf_dir).select("case_id"), "no_such", "case_id")


def no_cases(spark, sf_dir):
    """A prefix that no case has gives zeros, not NULLs."""
    return scoring.eval_means(scoring.filter_cases(case_results(spark, sf_dir), "no_such", "case_id"))


def iteration_delta(spark, sf_dir):
    """Orders as results: a model per priority, an iteration per year."""
    orders = I.table(spark, sf_dir, "orders")
    results = orders.select(
        F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("iteration"),
        (F.col("o_custkey") % 3 > 0).alias("root_cause_match"), (F.col("o_orderstatus") == "F").alias("fix_valid"),
        F.lit(1).alias("steps_taken"), F.col("o_totalprice").alias("time_seconds"),
    )
    means = scoring.eval_means(results, "model", "iteration")
    deltas = scoring.iteration_delta(means)
    return deltas.select("model", "iteration", "n_cases", F.round("diagnosis_delta", 6).alias("diagnosis_delta"), F.round("fix_delta", 6).alias("fix_delta"))


STOP = ", ".join(f"'{w}'" for w in TS.STOP_WORDS)


def _terms_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda w: length(w) > 1 AND NOT list_contains([{STOP}], w)))"


PAIRS = f"""p AS (SELECT doc_id, item_id, {_terms_sql('d.text')} AS have, {_terms_sql('b.text')} AS want, d.text AS predicted
  FROM documents d JOIN benchmark b ON d.doc_id % {CASES} = b.item_id)"""

RESULTS = f"""
e AS (SELECT concat('case_', item_id) AS case_id, concat('Case ', item_id) AS case_name, {_terms_sql('text')} AS want,
  CASE WHEN item_id % 2 = 0 THEN 'SELECT COUNT(*) FROM expected' END AS expected_query, CASE WHEN item_id % 4 = 0 THEN 2 END AS min_rows
  FROM benchmark),
r AS (SELECT doc_id, concat('case_', doc_id % {CASES}) AS case_id, concat('model_', doc_id % 4, '_', doc_id) AS model,
  {_terms_sql('text')} AS have, doc_id % 19 <> 0 AND doc_id % 23 <> 0 AS has_fix,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'SELECT COUNT(*) FROM own' END AS own_query, doc_id % 15 + 1 AS steps, n_chars / 8 AS secs FROM documents),
j AS (SELECT r.*, e.case_name, want, min_rows, coalesce(own_query, expected_query, '') AS check_query,
  CASE WHEN r.doc_id % 29 = 0 THEN 'model did not answer' WHEN e.case_id IS NULL THEN 'no expected fix' ELSE '' END AS error,
  l.doc_id IS NOT NULL AND l.toxic = 1 AS broken, l.doc_id IS NOT NULL AND l.doc_id % 31 = 0 AS bad_check,
  CAST(l.quality * (l.doc_id % 3 + 1) AS BIGINT) AS cnt
  FROM r LEFT JOIN e USING (case_id) LEFT JOIN labels l ON l.doc_id = r.doc_id),
res AS (SELECT case_id, model, case_name,
  coalesce(error = '' AND len(want) > 0 AND len(list_intersect(have, want)) / len(want) >= 0.5, false) AS root_cause_match,
  coalesce(error = '' AND has_fix AND NOT broken AND (check_query = '' OR
    (NOT bad_check AND coalesce(cnt > 0 AND (min_rows IS NULL OR cnt >= min_rows), false))), false) AS fix_valid,
  CASE WHEN error = '' THEN steps ELSE 0 END AS steps_taken, secs AS time_seconds, check_query, error FROM j)"""


def _means_sql(where: str) -> str:
    return f"""WITH {RESULTS} SELECT substr(model, 1, 7) AS model, round(avg(CAST(root_cause_match AS INT)), 6) AS diagnosis_accuracy,
        round(avg(CAST(fix_valid AS INT)), 6) AS fix_accuracy, round(avg(steps_taken), 6) AS mean_steps, round(avg(time_seconds), 6) AS mean_time,
        count(*) FILTER (root_cause_match) AS n_cause, count(*) FILTER (fix_valid) AS n_fix, count(*) AS n_cases
        FROM res WHERE {where} GROUP BY 1"""


QUERIES = {
    "term_sets": (
        term_sets,
        f"""WITH t AS (SELECT doc_id, {_terms_sql('text')} AS terms FROM documents)
            SELECT doc_id, md5(coalesce(array_to_string(list_sort(terms), ' '), '')) AS digest, len(terms) AS n_terms FROM t""",
    ),
    "term_overlap": (
        term_overlap,
        f"""WITH {PAIRS} SELECT doc_id, item_id, round(len(list_intersect(have, want)) / len(want), 6) AS ratio,
            CASE WHEN len(have) > 0 THEN round(len(list_intersect(have, want)) / len(have), 6) ELSE 0 END AS precision,
            length(predicted) > 0 AND len(list_intersect(have, want)) / len(want) >= 0.5 AS matches FROM p""",
    ),
    "term_diff": (
        term_diff,
        f"""WITH {PAIRS} SELECT doc_id, item_id, coalesce(array_to_string(list_sort(list_filter(want, lambda w: list_contains(have, w))), ' '), '') AS matched,
            coalesce(array_to_string(list_sort(list_filter(want, lambda w: NOT list_contains(have, w))), ' '), '') AS missing FROM p""",
    ),
    "overlap_documents_benchmark": (
        overlap_documents_benchmark,
        f"""WITH d AS (SELECT doc_id, unnest({_terms_sql('text')}) AS term FROM documents),
            b AS (SELECT item_id, {_terms_sql('text')} AS want FROM benchmark), bt AS (SELECT item_id, len(want) AS n, unnest(want) AS term FROM b)
            SELECT doc_id, item_id, round(count(*) / any_value(n), 6) AS ratio FROM d JOIN bt USING (term)
            GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.5""",
    ),
    "case_results": (
        case_results,
        f"""WITH {RESULTS} SELECT *, CASE WHEN error <> '' THEN 'ERR' WHEN root_cause_match THEN 'PASS' ELSE 'FAIL' END AS root_cause_label,
            CASE WHEN error <> '' THEN 'ERR' WHEN fix_valid THEN 'PASS' ELSE 'FAIL' END AS fix_label FROM res""",
    ),
    "eval_means": (eval_means, _means_sql("true")),
    "case_filter": (case_filter, _means_sql("starts_with(case_id, 'case_1')")),
    "cases_to_choose": (cases_to_choose, f"WITH {RESULTS} SELECT DISTINCT case_id FROM res"),
    "no_cases": (
        no_cases,
        """SELECT 0.0::DOUBLE AS diagnosis_accuracy, 0.0::DOUBLE AS fix_accuracy, 0.0::DOUBLE AS mean_steps, 0.0::DOUBLE AS mean_time,
           0::BIGINT AS n_cause, 0::BIGINT AS n_fix, 0::BIGINT AS n_cases""",
    ),
    "iteration_delta": (
        iteration_delta,
        """WITH m AS (SELECT o_orderpriority AS model, CAST(year(o_orderdate) AS INTEGER) AS iteration, avg(CAST(o_custkey % 3 > 0 AS INT)) AS d,
           avg(CAST(o_orderstatus = 'F' AS INT)) AS f, count(*) AS n_cases FROM orders GROUP BY 1, 2)
           SELECT model, iteration, n_cases, round(d - lag(d) OVER w, 6) AS diagnosis_delta, round(f - lag(f) OVER w, 6) AS fix_delta
           FROM m WINDOW w AS (PARTITION BY model ORDER BY iteration)""",
    ),
}
