"""Diagnosis reports and tool calls from tables of free-text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.functions import text as X
from pipecheck.functions.columns import named

# States of a report.
SUCCESS = "success"
MAX_STEPS = "max_steps_reached"
FAILED = "error"

# Standard JSON only: a call in single quotes is not a call.
STRICT_JSON = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "corrupt"}

FIELDS = ("root_cause", "fix_type", "fix_description", "fixed_sql", "verification_query")


def parse_reports(answers: DataFrame, text: str = "text") -> DataFrame:
    """Report fields of every answer, with fallbacks for loosely written ones.

    Columns are added step by step, so no pattern runs twice on a text.
    """
    content = F.col(text)
    labelled = answers.withColumns(
        {
            "root_cause": X.field(content, X.ROOT_CAUSE),
            "fix_type": X.field(content, X.FIX_TYPE),
            "fix_description": X.field(content, X.FIX_DESCRIPTION),
            "fixed_sql": X.sql_block(content, X.FIXED_SQL),
            "verification_query": X.sql_block(content, X.VERIFICATION_QUERY),
        }
    )

    def or_else(name: str, fallback: Column) -> Column:
        return F.when(F.col(name) == "", fallback).otherwise(F.col(name))

    filled = labelled.withColumns(
        {
            "root_cause": or_else("root_cause", X.flexible_field(content)),
            "fix_type": or_else("fix_type", F.lit(X.DEFAULT_FIX_TYPE)),
            "fixed_sql": or_else("fixed_sql", X.unlabelled_sql(content)),
        }
    )
    no_check = (F.col("verification_query") == "") & (F.col("fixed_sql") != "")
    checked = filled.withColumn(
        "verification_query",
        F.when(no_check, X.unlabelled_check(content, F.col("fixed_sql"))).otherwise(
            F.col("verification_query")
        ),
    )
    # An answer with neither a cause nor SQL is its own cause, cut for display.
    unread = (F.col("root_cause") == "") & (F.col("fixed_sql") == "")
    final = {name: F.when(unread, F.lit("")).otherwise(F.col(name)) for name in FIELDS}
    final["root_cause"] = F.when(unread, F.substring(text, 1, X.CAUSE_PREVIEW)).otherwise(
        F.col("root_cause")
    )
    return checked.withColumns({"status": F.lit(SUCCESS), **final})


def _with_call(answers: DataFrame, json_text: Column, name: Column, arguments: Column) -> DataFrame:
    """Add ``tool`` and ``arguments`` of a JSON object, NULL when there is no whole one.

    What follows the object does not matter; an object that is cut off counts as none.
    Arguments that are no object themselves stay, as text under the key ``value``.
    ``name`` and ``arguments`` are columns over ``_json``.
    """
    schema = "tool string, args string, name string, arguments string, corrupt string"
    rest = [named(c) for c in answers.columns if c not in ("tool", "arguments")]
    # A row of its own, behind which Spark does not look: so each text is parsed once, however often its parts are used.
    parsed = answers.select(*rest, F.inline(F.array(F.struct(F.from_json(json_text, schema, STRICT_JSON).alias("_json")))))
    whole = F.col("_json").isNotNull() & F.col("_json.corrupt").isNull()
    none = F.expr("cast(map() as map<string,string>)")
    as_map = F.from_json(arguments, "map<string,string>", {"allowSingleQuotes": "false"})
    as_text = F.when(arguments.isNotNull(), F.create_map(F.lit("value"), arguments))
    held = F.when(F.ltrim(arguments).startswith("{"), as_map).otherwise(as_text)
    found = F.struct(F.when(whole, F.coalesce(name, F.lit(""))).alias("tool"), F.when(whole, F.coalesce(held, none)).alias("arguments"))
    return parsed.select(*rest, F.inline(F.array(found)))


def labelled_calls(answers: DataFrame, text: str = "text") -> DataFrame:
    """First ``TOOL_CALL: {...}`` of every answer, and the reasoning before it.

    An answer without a call is all reasoning.
    """
    called = _with_call(answers, X.labelled_json(F.col(text)), F.col("_json.tool"), F.col("_json.args"))
    before = F.when(F.col("tool").isNotNull(), X.text_before_call(F.col(text)))
    return called.withColumn("reasoning", before.otherwise(F.col(text)))


def bare_calls(answers: DataFrame, text: str = "text") -> DataFrame:
    """Answers that are nothing but a call in JSON; a call needs a name."""
    called = _with_call(answers, X.bare_json(F.col(text)), F.col("_json.name"), F.col("_json.arguments"))
    named = F.col("tool") != ""
    return called.withColumns(
        {
            "arguments": F.when(named, F.col("arguments")),
            "reasoning": F.when(named, F.lit("")).otherwise(F.col(text)),
            "tool": F.when(named, F.col("tool")),
        }
    )


def tool_calls(answers: DataFrame, text: str = "text") -> DataFrame:
    """Calls of either form in one pass: labelled where the label is, bare elsewhere.

    An answer that is NULL has neither a call nor reasoning and keeps its row.
    """
    labelled = F.coalesce(F.contains(F.col(text), F.lit(X.TOOL_LABEL)), F.lit(False))
    marked = answers.withColumn("_labelled", labelled)
    form = F.col("_labelled")
    json_text = F.when(form, X.labelled_json(F.col(text))).otherwise(X.bare_json(F.col(text)))

    def either(of_labelled: str, of_bare: str) -> Column:
        return F.when(form, F.col(of_labelled)).otherwise(F.col(of_bare))

    called = _with_call(marked, json_text, either("_json.tool", "_json.name"), either("_json.args", "_json.arguments"))
    # A bare call needs a name, a labelled one does not.
    call = F.col("tool").isNotNull() & (form | (F.col("tool") != ""))
    before = F.when(form, X.text_before_call(F.col(text))).otherwise(F.lit(""))
    return called.withColumns(
        {
            "arguments": F.when(call, F.col("arguments")),
            "reasoning": F.when(call, before).otherwise(F.col(text)),
            "tool": F.when(call, F.col("tool")),
        }
    ).drop("_labelled")
