"""Fields, SQL blocks and tool calls in free-text answers, as Column functions.

Patterns run in Java with ``d`` (only a newline ends a line) and ``U`` (Unicode
classes), which is how the answers' own tooling reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that is cut at both ends of a value.
WHITE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Labels, defaults and fences of a diagnosis report.
ROOT_CAUSE = "ROOT_CAUSE"
FIX_TYPE = "FIX_TYPE"
FIX_DESCRIPTION = "FIX_DESCRIPTION"
FIXED_SQL = "FIXED_SQL"
VERIFICATION_QUERY = "VERIFICATION_QUERY"
CAUSE_LABELS = (
    r"\*\*Root\s*Cause\*\*",
    r"Root\s*Cause",
    r"The\s+root\s+cause\s+is",
    r"Issue",
    r"Problem",
)
DEFAULT_FIX_TYPE = "sql_modification"
CAUSE_PREVIEW = 200
FENCES = ("```", "~~~")
TOOL_LABEL = "TOOL_CALL:"

# Patterns of report parts.
LABEL_VALUE = r"\s*(.+?)(?:\n|$)"
BLOCK_TO_NEXT_LABEL = r":\s*\n(.*?)(?=\n[A-Z_]+:|$)"
FENCE_OPEN = r"(?:sql|SQL)?\s*\n(.*?)"
LEADING_FENCE = r"^(?:```|~~~)\w*\s*\n?"
TRAILING_FENCE = r"\n?(?:```|~~~)\s*$"
FENCE_LINE = r"^[^\S\n]*(?:```|~~~)[^\S\n]*$\n?"
INSERT_WORDS = r"\bINSERT\s+INTO\b"
BARE_INSERT = (
    r"(INSERT\s+INTO\s+\w+\s*\([^)]+\)\s*\n\s*SELECT\s+.+?)"
    r"(?=\n\n|\nROOT_CAUSE|\nFIX_|\nVERIFICATION|\z)"
)
COUNT_QUERY = r"(SELECT\s+COUNT\s*\(.*?\)\s+FROM\s+\w+.*?)(?:\n\n|\z)"

def strip(text: Column) -> Column:
    """Cut white space at both ends."""
    return F.trim(text, F.lit(WHITE))


def _first(*candidates: Column) -> Column:
    """First non-empty text, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def field(text: Column, label: str) -> Column:
    """Value of ``LABEL: value``, first hit, any case, else empty."""
    return strip(F.regexp_extract(text, f"(?idU){label}:{LABEL_VALUE}", 1))


def flexible_field(text: Column, labels: Sequence[str] = CAUSE_LABELS) -> Column:
    """As ``field`` over label patterns in order; trailing asterisks are dropped."""

    def one(label: str) -> Column:
        value = strip(F.regexp_extract(text, rf"(?idU){label}\s*[:]{LABEL_VALUE}", 1))
        return strip(F.rtrim(value, F.lit("*")))

    return _first(*[one(label) for label in labels])


def strip_fences(sql: Column) -> Column:
    """Remove code fences at both ends and lines that hold only a fence."""
    opened = F.regexp_replace(sql, f"(?dU){LEADING_FENCE}", "")
    closed = F.regexp_replace(opened, f"(?dU){TRAILING_FENCE}", "")
    return strip(F.regexp_replace(closed, f"(?mdU){FENCE_LINE}", ""))


def sql_block(text: Column, label: str) -> Column:
    """SQL after a label: up to the next label, else in a fence after the label."""
    plain = f"(?isdU){label}{BLOCK_TO_NEXT_LABEL}"
    fenced = [
        strip(F.regexp_extract(text, f"(?isdU){label}:.*?{fence}{FENCE_OPEN}{fence}", 1))
        for fence in FENCES
    ]
    # A long text without the label is not worth four lazy scans.
    present = F.contains(F.upper(text), F.lit(label))
    block = F.when(
        text.rlike(plain), strip_fences(strip(F.regexp_extract(text, plain, 1)))
    ).otherwise(_first(*fenced))
    return F.when(present, block).otherwise(F.lit(""))


def unlabelled_sql(text: Column) -> Column:
    """First fenced block with INSERT INTO, else a bare INSERT ... SELECT."""

    def fenced(fence: str) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(f"(?sdU){fence}{FENCE_OPEN}{fence}"), F.lit(1))
        inserts = F.filter(
            F.transform(blocks, strip), lambda b: b.rlike(f"(?iU){INSERT_WORDS}")
        )
        return F.get(inserts, F.lit(0))

    bare = strip_fences(strip(F.regexp_extract(text, f"(?isdU){BARE_INSERT}", 1)))
    return F.when(
        F.contains(F.upper(text), F.lit("INSERT")), _first(*map(fenced, FENCES), bare)
    ).otherwise(F.lit(""))


def unlabelled_check(text: Column, fixed_sql: Column) -> Column:
    """First SELECT COUNT(...) after the repair SQL."""
    first_line = F.substring_index(fixed_sql, "\n", 1)
    whole = F.position(fixed_sql, text)
    start = F.when(whole > 0, whole).otherwise(F.position(first_line, text))
    after = F.substr(text, start + F.length(first_line))
    query = strip_fences(strip(F.regexp_extract(after, f"(?isdU){COUNT_QUERY}", 1)))
    return F.when(start > 0, query).otherwise(F.lit(""))


def labelled_json(text: Column) -> Column:
    """Text from the first brace after ``TOOL_CALL:`` on, NULL without one."""
    label = F.position(F.lit(TOOL_LABEL), text)
    rest = F.substr(text, label + F.lit(len(TOOL_LABEL)))
    brace = F.position(F.lit("{"), rest)
    return F.when((label > 0) & (brace > 0), F.substr(rest, brace))


def bare_json(text: Column) -> Column:
    """An answer that is only JSON, fenced or not, NULL for any other."""
    body = strip(text)
    fenced = F.substring_index(F.regexp_replace(body, r"(?dU)^```\w*\n?", ""), "```", 1)
    unfenced = F.when(F.startswith(body, F.lit("```")), strip(fenced)).otherwise(body)
    return F.when(F.startswith(unfenced, F.lit("{")), unfenced)


def text_before_call(text: Column) -> Column:
    """Reasoning before the first tool call."""
    return strip(F.substring_index(text, TOOL_LABEL, 1))
