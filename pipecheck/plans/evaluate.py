"""From answers and expected fixes to results and accuracies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from pipecheck.operators.reports import parse_reports
from pipecheck.operators.scoring import case_labels, case_results, eval_means, filter_cases


class Evaluation(NamedTuple):
    results: DataFrame
    means: DataFrame


def evaluate(
    answers: DataFrame, expected: DataFrame, checks: DataFrame, case_prefix: str = ""
) -> Evaluation:
    """Parse every answer, score it against its case, and average per model.

    ``answers(case_id, model, text, steps_taken, time_seconds, error)``.
    """
    chosen = filter_cases(answers, case_prefix, "case_id")
    results = case_labels(case_results(parse_reports(chosen), expected, checks))
    return Evaluation(results, eval_means(results, "model"))
