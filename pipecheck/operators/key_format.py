"""Search for the form in which two join keys meet."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipecheck.functions.columns import named, rows_of
from pipecheck.operators.value_match import MARGIN, SKETCH_BITS, plain_text

# What may be cut from a key, in the order in which it is done.
STEPS = ("case", "separators", "prefix", "suffix", "zeros")

FOUND = "steps string, n_steps bigint, left_keys bigint, matched_keys bigint, left_rows bigint, matched_rows bigint, match_rate double"


def lattice() -> list[tuple[str, ...]]:
    """All sets of steps, the fewest first: each is above those that do less."""
    return [chosen for n in range(len(STEPS) + 1) for chosen in combinations(STEPS, n)]


def normalised(key: Column, steps: tuple[str, ...]) -> Column:
    """A key text after some steps; null if nothing is left.

    case: lower case; separators: no white space, ``-``, ``_``, ``.``, ``/``, ``:``; prefix and suffix: nothing before the first and behind the last
    digit, where there is a digit; zeros: no zeros in front of a number.
    """
    if "case" in steps:
        key = F.lower(key)
    if "separators" in steps:
        key = F.regexp_replace(key, r"[\s\-_./:]+", "")
    if "prefix" in steps:
        key = F.regexp_replace(key, "^[^0-9]+(?=[0-9])", "")
    if "suffix" in steps:
        key = F.regexp_replace(key, "(?<=[0-9])[^0-9]+$", "")
    if "zeros" in steps:
        key = F.regexp_replace(key, "(^|[^0-9])0+(?=[0-9])", "$1")
    return F.nullif(key, F.lit(""))


def _key(df: DataFrame, key: str) -> Column:
    return plain_text(named(key), df.schema[key].dataType)


def format_scores(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """steps, n_steps, share of every set of steps: the estimated share of left keys that find a partner.

    Every set has a sketch of the keys that it leaves, all made in one pass over each table; their intersections need no join. The
    share is of the keys before any step, so steps that make different keys equal lose by it.
    """
    sets = lattice()

    def sketches(df: DataFrame, key: str, name: str) -> DataFrame:
        texts = [normalised(F.col("key"), s) for s in sets]
        keyed = df.select(_key(df, key).alias("key"))
        return keyed.agg(F.lit(1).alias("one"), *(F.theta_sketch_agg(t, F.lit(SKETCH_BITS)).alias(f"{name}{i}") for i, t in enumerate(texts)))

    met = sketches(left, left_key, "l").join(sketches(right, right_key, "r"), "one")
    total = F.nullif(F.theta_sketch_estimate("l0"), F.lit(0))
    rows = [
        F.struct(F.lit("+".join(s)), F.lit(len(s)), F.theta_sketch_estimate(F.theta_intersection(f"l{i}", f"r{i}")) / total) for i, s in enumerate(sets)
    ]
    return rows_of(met, rows, "steps string, n_steps bigint, share double")


def key_format(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """The sets of steps that bring most keys together, counted exactly, the best first by ``rank``.

    Sets within the sketches' error of the best are candidates, but for those that do no better by their sketches than a part of
    their steps. They are counted in one aggregation per key, so a key with most of the rows is combined before the shuffle. More matched keys win, then fewer steps. A key that a step makes equal to another
    counts once. Null keys match nothing.
    """
    scores = format_scores(left, left_key, right, right_key).filter("share is not null").collect()  # one row per set of steps
    best = max((r.share for r in scores), default=0.0)
    share = {frozenset(r.steps.split("+")) if r.steps else frozenset(): r.share for r in scores if r.share >= best - 2 * MARGIN and r.share > 0}
    chosen = [s for s in lattice() if frozenset(s) in share and not any(t < frozenset(s) and share[t] >= share[frozenset(s)] for t in share)]
    if not chosen:
        return rows_of(left, [], FOUND).withColumn("rank", F.lit(1).cast("bigint"))

    def sided(df: DataFrame, key: str, here: int) -> DataFrame:
        forms = [F.struct(F.lit(n).alias("form"), normalised(F.col("own"), s).alias("key")) for n, s in enumerate(chosen)]
        marks = [F.lit(v).cast("bigint").alias(c) for c, v in (("l", here), ("r", 1 - here))]
        return df.select(_key(df, key).alias("own")).select(F.inline(F.array(*forms)), *marks)

    per_key = sided(left, left_key, 1).unionByName(sided(right, right_key, 0)).groupBy("form", "key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    met = F.col("key").isNotNull() & (F.col("l") > 0) & (F.col("r") > 0)
    names = F.array(*(F.struct(F.lit("+".join(s)).alias("steps"), F.lit(len(s)).cast("bigint").alias("n_steps")) for s in chosen))
    counted = per_key.groupBy("form").agg(
        F.count_if((F.col("l") > 0) & F.col("key").isNotNull()).alias("left_keys"), F.count_if(met).alias("matched_keys"),
        F.sum("l").alias("left_rows"), F.coalesce(F.sum(F.when(met, F.col("l"))), F.lit(0)).alias("matched_rows"),
    )
    rate = F.round(F.coalesce(F.col("matched_rows") / F.nullif(F.col("left_rows"), F.lit(0)), F.lit(0.0)), 6)
    found = counted.withColumn("of", F.get(names, F.col("form"))).select("of.*", "left_keys", "matched_keys", "left_rows", "matched_rows", rate.alias("match_rate"))
    # One row per set of steps.
    return found.withColumn("rank", F.expr("row_number() OVER (ORDER BY matched_keys DESC, n_steps, steps)").cast("bigint"))


def format_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, steps: tuple[str, ...]) -> DataFrame:
    """Inner join on keys after the given steps, an equi-join on derived keys. The right key column is dropped."""
    common = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    if common:
        raise ValueError(f"both sides have {sorted(common)}")
    keyed_left = left.withColumn("_key", normalised(_key(left, left_key), steps))
    keyed_right = right.withColumn("_key", normalised(_key(right, right_key), steps)).drop(right_key)
    return keyed_left.join(keyed_right, "_key").drop("_key")
