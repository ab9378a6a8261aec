"""Score reports against expected fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipecheck.functions.columns import each
from pipecheck.functions.terms import term_set, terms_match
from pipecheck.operators.reports import SUCCESS
from pipecheck.operators.verify import count_holds
from pipecheck.session import written

# Share of terms that makes a match, and labels of a result.
THRESHOLD = 0.5
PASS, FAIL, ERR = "PASS", "FAIL", "ERR"


def filter_cases(cases: DataFrame, prefix: str = "", id_column: str = "id") -> DataFrame:
    """Cases whose id starts with the prefix; all without one."""
    return cases.filter(F.startswith(F.col(id_column), F.lit(prefix))) if prefix else cases


def available_cases(cases: DataFrame, prefix: str = "", id_column: str = "id") -> DataFrame:
    """All different case ids if the prefix meets none of them, to be listed for the caller; no rows if it meets any."""
    ids = cases.select(id_column).filter(F.col(id_column).isNotNull()).distinct()
    hit = filter_cases(ids, prefix, id_column).limit(1).select(F.lit(True).alias("hit"))
    return ids.join(hit, F.col("hit"), "left_anti")


def match_all(
    predicted: DataFrame,
    expected: DataFrame,
    predicted_id: str,
    expected_id: str,
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All pairs of a predicted and an expected text that overlap enough.

    A text with at least m of the n expected terms has one of any n - m + 1 of
    them. So only the n - m + 1 rarest terms of each expected text look for
    partners, and the ratio is worked out for the pairs found: exact, without
    comparing all pairs and without a join on common terms.

    The words are written to the shared folder, as three steps read them.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    want = expected.select(expected_id, term_set(F.col(text)).alias("want"))
    # Rounded down a little: one term too many in the prefix is never wrong.
    needed = F.ceil(F.size("want") * F.lit(threshold) - F.lit(1e-9))
    wanted = each(want.withColumn("n_prefix", F.size("want") - needed + 1), "want", "term")
    # Texts are split once; only words that some expected text has are kept.
    vocabulary = wanted.select("term").distinct()
    split = each(predicted.select(predicted_id, term_set(F.col(text)).alias("have")), "have", "term")
    words = written(split.select(predicted_id, "term").join(vocabulary, "term", "left_semi"), "words")

    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy(expected_id).orderBy("n", "term")
    prefix = (
        wanted.join(frequency, "term", "left")
        .na.fill(0, ["n"])
        .withColumn("rank", F.row_number().over(rarest))
        .filter((F.col("rank") <= F.col("n_prefix")) & (F.col("n") > 0))
        .select(expected_id, "term")
    )
    pairs = words.join(prefix, "term").select(predicted_id, expected_id).distinct()
    # At most the words of one text each.
    have = words.groupBy(predicted_id).agg(F.collect_set("term").alias("have"))
    shared = F.size(F.array_intersect("want", "have"))
    scored = pairs.join(have, predicted_id).join(want, expected_id).select(
        predicted_id, expected_id, (shared / F.size("want")).alias("ratio")
    )
    return scored.filter(F.col("ratio") >= F.lit(threshold)).withColumn("ratio", F.round("ratio", 6))


def case_results(
    reports: DataFrame, expected: DataFrame, checks: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """One result row per report.

    ``reports(case_id, model, status, root_cause, fixed_sql, verification_query,
    steps_taken, time_seconds, error)``, ``expected(case_id, case_name,
    root_cause, verification_query, expected_row_count_min)`` and
    ``checks(case_id, model, fix_error, check_error, cnt)``: what running the
    repair and its check query gave. A report with an error keeps its text.
    """
    known = expected.select(
        "case_id",
        "case_name",
        term_set(F.col("root_cause")).alias("want"),
        F.col("root_cause").isNotNull().alias("known"),
        F.col("verification_query").alias("expected_query"),
        "expected_row_count_min",
    )
    # Term sets are made once per text, before the joins.
    scored = reports.withColumn("have", term_set(F.col("root_cause"))).withColumn(
        "root_cause", F.length("root_cause") > 0
    )
    joined = scored.join(known, "case_id", "left").join(checks, ["case_id", "model"], "left")
    error = (
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error"))
        .when(F.col("known").isNull(), F.lit("no expected fix"))
        .otherwise(F.lit(""))
    )
    own = F.nullif(F.col("verification_query"), F.lit(""))
    query = F.coalesce(own, F.col("expected_query"), F.lit(""))
    counted = count_holds(F.col("cnt"), F.col("expected_row_count_min"))
    checked = F.col("check_error").isNull() & F.coalesce(counted, F.lit(False))
    ran = (F.col("status") == SUCCESS) & (F.col("fixed_sql") != "") & F.col("fix_error").isNull()
    fine = F.col("error") == ""
    matched = terms_match(F.col("have"), F.col("want"), threshold)
    return (
        joined.withColumn("error", error)
        .withColumn("check_query", query)
        .withColumn(
            "root_cause_match", F.coalesce(fine & F.col("root_cause") & matched, F.lit(False))
        )
        .withColumn(
            "fix_valid",
            F.coalesce(fine & ran & ((F.col("check_query") == "") | checked), F.lit(False)),
        )
        .withColumn("steps_taken", F.when(fine, F.col("steps_taken")).otherwise(F.lit(0)))
        .select(
            "case_id", "model", "case_name", "root_cause_match", "fix_valid",
            "steps_taken", "time_seconds", "check_query", "error",
        )
    )


def case_labels(results: DataFrame) -> DataFrame:
    """PASS, FAIL or ERR for the cause and for the fix of each result."""

    def label(name: str):
        return F.when(F.col("error") != "", ERR).when(F.col(name), PASS).otherwise(FAIL)

    return results.withColumns(
        {"root_cause_label": label("root_cause_match"), "fix_label": label("fix_valid")}
    )


def eval_means(results: DataFrame, *by: str) -> DataFrame:
    """Accuracies, means and pass counts, in total or per model; 0 without cases."""

    def mean(column):
        return F.coalesce(F.avg(column), F.lit(0.0))

    return results.groupBy(*by).agg(
        mean(F.col("root_cause_match").cast("int")).alias("diagnosis_accuracy"),
        mean(F.col("fix_valid").cast("int")).alias("fix_accuracy"),
        mean(F.col("steps_taken")).alias("mean_steps"),
        mean(F.col("time_seconds")).alias("mean_time"),
        F.count_if(F.col("root_cause_match")).alias("n_cause"),
        F.count_if(F.col("fix_valid")).alias("n_fix"),
        F.count(F.lit(1)).alias("n_cases"),
    )


def iteration_delta(means: DataFrame) -> DataFrame:
    """Change of both accuracies from one iteration of a model to its next."""
    order = Window.partitionBy("model").orderBy("iteration")
    return means.withColumns(
        {
            "diagnosis_delta": F.col("diagnosis_accuracy") - F.lag("diagnosis_accuracy").over(order),
            "fix_delta": F.col("fix_accuracy") - F.lag("fix_accuracy").over(order),
        }
    )
