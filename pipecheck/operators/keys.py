"""Join keys in different formats: find, measure and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipecheck.functions.columns import named
from pipecheck.functions.shapes import key_prefix, key_shape, strip_prefix, text_key
from pipecheck.operators.samples import SHOWN_VALUES
from pipecheck.operators.schema import sample_values

# The join condition and the FROM table in SQL text.
JOIN_ON = r"JOIN\s+(\w+)\s+(?:AS\s+)?(\w+)\s+ON\s+(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"
NOT_AN_ALIAS = "JOIN|INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|WHERE|ON|GROUP|ORDER|LIMIT|UNION"
FROM_TABLE = rf"FROM\s+(\w+)\s+(?:AS\s+)?(?!(?:{NOT_AN_ALIAS})\b)(\w+)"

SIDES = ("left", "right")

# The rows of a hot key are dealt over so many tasks.
SALTS = 64


def sql_join_keys(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Tables and columns of the first plain join condition; rows without one drop out."""

    def join_part(i: int) -> Column:
        return F.regexp_extract(sql, f"(?iU){JOIN_ON}", i)

    def from_part(i: int) -> Column:
        return F.regexp_extract(sql, f"(?iU){FROM_TABLE}", i)

    def table(alias: str) -> Column:
        alias = F.col(alias)
        return (
            F.when(alias == F.col("join_alias"), F.col("join_table"))
            .when(alias == F.col("from_alias"), F.col("from_table"))
            .otherwise(alias)
        )

    parts = {
        "join_table": join_part(1),
        "join_alias": join_part(2),
        "left_alias": join_part(3),
        "left_column": join_part(4),
        "right_alias": join_part(5),
        "right_column": join_part(6),
        "from_table": from_part(1),
        "from_alias": from_part(2),
    }
    found = df.withColumns(parts).filter(F.col("left_column") != "")
    named_tables = found.withColumns(
        {"left_table": table("left_alias"), "right_table": table("right_alias")}
    )
    return named_tables.drop("join_table", "join_alias", "from_table", "from_alias")


def sample_join_keys(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, shown: int = SHOWN_VALUES
) -> DataFrame:
    """Distinct samples of both join columns, one under the other."""
    frames = [
        sample_values(df, key, shown).select(F.lit(side).alias("side"), "*")
        for side, df, key in zip(SIDES, (left, right), (left_key, right_key))
    ]
    return frames[0].unionByName(frames[1])


def _both_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    frames = [
        df.select(F.lit(side).alias("side"), named(key).cast("string").alias("key"))
        for side, df, key in zip(SIDES, (left, right), (left_key, right_key))
    ]
    return frames[0].unionByName(frames[1])


def key_shapes(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Histogram of key shapes per side; NULL keys have a NULL shape."""
    keys = _both_keys(left, left_key, right, right_key)
    return keys.groupBy("side", key_shape(F.col("key")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def key_prefixes(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Prefixes before the number of a key, per side; a prefix on one side only is the fault."""
    keys = _both_keys(left, left_key, right, right_key).filter(F.col("key").rlike("[0-9]$"))
    counted = keys.groupBy(key_prefix(F.col("key")).alias("prefix")).agg(
        F.count_if(F.col("side") == "left").alias("n_left"),
        F.count_if(F.col("side") == "right").alias("n_right"),
    )
    one_sided = (F.col("n_left") == 0) | (F.col("n_right") == 0)
    return counted.withColumn("one_sided", one_sided)


def plain_key(df: DataFrame, key: str, prefix: str) -> Column:
    """Key as a number: text keys lose the prefix, whole numbers are only cast.

    A number with a fraction, or beyond a bigint, is no key and becomes NULL.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, T.StringType):
        return strip_prefix(named(key), prefix)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = named(key).try_cast("bigint")
        return F.when(whole.cast(kind) == named(key), whole)
    return named(key).cast("bigint")


def common_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str, prefix: str) -> tuple[Column, Column]:
    """Both keys in one form: numbers where a side is numeric, else texts without the prefix."""
    both_text = all(isinstance(df.schema[k].dataType, T.StringType) for df, k in ((left, left_key), (right, right_key)))
    if both_text:
        return text_key(named(left_key), prefix), text_key(named(right_key), prefix)
    return plain_key(left, left_key, prefix), plain_key(right, right_key, prefix)


def match_rate(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, prefix: str
) -> DataFrame:
    """Share of left rows and keys that find a partner, as is and without the prefix.

    Both sides are counted per key in one aggregation instead of a join, so a key
    with a large share of the rows is combined before the shuffle.
    """

    def forms(df: DataFrame, key: str, on_left: int) -> DataFrame:
        pair = F.array(
            F.struct(F.lit("raw").alias("form"), named(key).cast("string").alias("key")),
            F.struct(
                F.lit("repaired").alias("form"), plain_key(df, key, prefix).cast("string").alias("key")
            ),
        )
        sides = [F.lit(v).cast("bigint").alias(n) for n, v in (("l", on_left), ("r", 1 - on_left))]
        return df.select(F.inline(pair), *sides)

    keys = forms(left, left_key, 1).unionByName(forms(right, right_key, 0))
    per_key = keys.groupBy("form", "key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    has_left = F.col("l") > 0
    matched = F.col("key").isNotNull() & has_left & (F.col("r") > 0)
    totals = per_key.groupBy("form").agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum(F.when(matched, F.col("l"))), F.lit(0)).alias("matched_rows"),
        F.count_if(has_left & F.col("key").isNotNull()).alias("left_keys"),
        F.count_if(matched).alias("matched_keys"),
    )
    rate = F.when(F.col("left_rows") > 0, F.col("matched_rows") / F.col("left_rows"))
    return totals.withColumn("match_rate", F.round(F.coalesce(rate, F.lit(0.0)), 6))


def lost_keys(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """How many keys are NULL and how many have no number after the prefix is cut."""
    value, plain = named(key), plain_key(df, key, prefix)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(value.isNull()).alias("n_null"),
        F.count_if(value.isNotNull() & plain.isNull()).alias("n_unparsable"),
    )


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys with more than ``share`` of all rows: fewer than ``1 / share`` of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.filter(F.col(key).isNotNull() & (F.col("n") > total * F.lit(share))).select(key)


def repaired_join(
    left: DataFrame,
    left_key: str,
    right: DataFrame,
    right_key: str,
    prefix: str,
    hot_share: float | None = None,
) -> DataFrame:
    """Inner join on keys without their prefix; rows without a key have no partner.

    Two text keys meet as text, so keys with letters have partners too; where a side is numeric, only
    numbers meet. The key is derived under the join, so it stays an equi-join: Spark broadcasts
    a small side by its size and splits skewed partitions at run time. Where
    adaptive execution is off, ``hot_share`` (above 0, at most 1) looks for keys above that share of the
    left rows. Their left rows are dealt over SALTS tasks and their partners repeated for each.
    """
    common = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    if common:
        raise ValueError(f"both sides have {sorted(common)}")
    if hot_share is not None and not 0.0001 <= hot_share <= 1:
        raise ValueError("hot_share must be between 0.0001 and 1")
    own, other = common_keys(left, left_key, right, right_key, prefix)
    keyed_left = left.withColumn("_key", own)
    keyed_right = right.withColumn("_key", other).drop(right_key)
    # Fewer than 1 / hot_share values.
    hot = [row._key for row in hot_keys(keyed_left.select("_key"), "_key", hot_share).collect()] if hot_share else []
    if not hot:
        return keyed_left.join(keyed_right, "_key").drop("_key")
    is_hot = F.col("_key").isin(hot)
    salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted_left = keyed_left.withColumn("_salt", salt.cast("int"))
    salted_right = keyed_right.withColumn("_salt", F.explode(salts))
    return salted_left.join(salted_right, ["_key", "_salt"]).drop("_key", "_salt")
