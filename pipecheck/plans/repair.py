"""From a source and a destination schema to an aligned frame."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named
from pipecheck.operators.align import absent_columns, align_to_schema, extra_columns, rename_candidates
from pipecheck.operators.quality import clean_cast, loses_value
from pipecheck.operators.schema import mismatched
from pipecheck.operators.verify import LOST

# Fixed value: what stands in a text column that the source lacks.
DEFAULT_TEXT = "UNKNOWN"


class Repair(NamedTuple):
    """The changes a repair makes: source to destination names, constants, cleaned columns.

    ``unresolved`` lists absent columns that need a decision; ``repaired`` refuses them.
    """

    renames: dict[str, str]
    defaults: dict[str, object]
    cleaned: list[str]
    unresolved: list[str] = []


def propose_repair(
    source: DataFrame, dest: T.StructType, defaults: Mapping[str, object] | None = None
) -> Repair:
    """Renames without a tie, defaults for what is left, clean casts for dirty text.

    Only rows about columns come to the driver. A text column gets its default only if the source
    has no column left over that might hold its values. Any other absent column (a tie, left-over
    columns, another type) is unresolved until the caller gives a default or a rename.
    """
    given = dict(defaults or {})
    absent = [f for f in absent_columns(source, dest) if f.name not in given]
    renames: dict[str, str] = {}
    if absent:
        sure = rename_candidates(source, dest).filter(
            (F.col("rank") == 1) & ~F.col("tie") & F.col("all_cast")
        )
        found = sure.select("dest_column", "source_column", "shared_parts").collect()
        for row in sorted(found, key=lambda r: (-r.shared_parts, r.dest_column)):
            if row.dest_column not in given and row.source_column not in renames:
                renames[row.source_column] = row.dest_column
    left_over = {f.name for f in extra_columns(source, dest)} - set(renames)
    unresolved = []
    for f in absent:
        if f.name in renames.values():
            continue
        if left_over or not isinstance(f.dataType, T.StringType):
            unresolved.append(f.name)
        else:
            given[f.name] = DEFAULT_TEXT
    cleaned = [
        s.name
        for s, d in mismatched(source, dest)
        if isinstance(s.dataType, T.StringType) and isinstance(d.dataType, T.NumericType)
    ]
    return Repair(renames, given, cleaned, unresolved)


def repaired(source: DataFrame, dest: T.StructType, repair: Repair) -> DataFrame:
    """The source in the shape of the destination, with the changes made.

    If text is cleaned, the column LOST counts each row's values that the casts lose;
    ``apply_repair`` adds it up and leaves it out of the destination.
    """
    values = {c: clean_cast(named(c), dest[c].dataType) for c in repair.cleaned}
    shape = dest
    if values:
        lost = [loses_value(named(c), dest[c].dataType).cast("bigint") for c in repair.cleaned]
        values[LOST] = sum(lost[1:], lost[0])
        shape = T.StructType([*dest.fields, T.StructField(LOST, T.LongType())])
    return align_to_schema(source, shape, repair.renames, repair.defaults, values)
