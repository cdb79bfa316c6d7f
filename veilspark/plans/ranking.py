"""Exact ranks and order statistics without pulling a group into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from .skew import lookup_join
from .storage import LIMITS, Stored, materialise, store


#: Accuracy of the sketch: its ranks are off by at most one in so many.
SKETCH = 1000


def _sorted_blocks(df: DataFrame, group: list[str], keys: list, weight: str):
    """Sort globally; return the rows tagged with their block, and the blocks' offsets.

    A block is one range partition of the sort. A group spans at most as many blocks as
    there are shuffle partitions, so the windows over blocks are short.
    """
    rows = materialise(df.orderBy(*group, *keys).withColumn("_block", F.spark_partition_id()))
    along = Window.partitionBy(*group).orderBy("_block")
    blocks = (
        rows.groupBy(*group, "_block")
        .agg(F.sum(weight).alias("_held"), F.count("*").alias("_width"))
        .withColumn("_before", F.sum("_held").over(along) - F.col("_held"))
        .withColumn("_total", F.sum("_held").over(Window.partitionBy(*group)))
        .withColumn("_members", F.sum("_width").over(Window.partitionBy(*group)))
    )
    return rows, blocks


def global_index(table: Stored, keys: list, out: str) -> DataFrame:
    """Add ``out`` = 0-based position of each row in the order of ``keys`` (unique)."""
    if table.rows <= LIMITS.window_rows:
        place = F.row_number().over(Window.orderBy(*keys)).cast("bigint") - 1
        return table.df.withColumn(out, place)
    rows, blocks = _sorted_blocks(table.df.withColumn("_one", F.lit(1)), [], keys, "_one")
    inside = Window.partitionBy("_block").orderBy(*keys)
    return (
        rows.join(F.broadcast(blocks.select("_block", "_before")), "_block")
        .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_block", "_before", "_one")
    )


def at_ranks(
    df: DataFrame,
    rows: int,
    group: list[str],
    keys: list[str],
    weight: str,
    targets: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Per group, the keys at which the running weight first reaches each target.

    ``df`` reads a stored table of ``rows`` rows, with unique non-null ``keys`` per
    group; a target maps the group's total weight to a rank counted from 1. Groups that
    are small everywhere are ranked by a plain window; otherwise only the sorted block
    around each target is. ``_members`` tells the number of rows per group.
    """
    if rows > LIMITS.window_rows:
        widest = df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    else:
        widest = rows
    if widest <= LIMITS.window_rows:
        along, whole = Window.partitionBy(*group).orderBy(*keys), Window.partitionBy(*group)
        ranked = df.withColumn("_total", F.sum(weight).over(whole))
        ranked = ranked.withColumn("_members", F.count("*").over(whole))
        ranked = ranked.withColumn("_running", F.sum(weight).over(along))
    else:
        sorted_rows, blocks = _sorted_blocks(df, group, keys, weight)
        wanted = F.lit(False)
        for target in targets.values():
            rank = target(F.col("_total"))
            wanted = wanted | (
                (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_held"))
            )
        hits = blocks.where(wanted).drop("_held")
        along = Window.partitionBy(*group, "_block").orderBy(*keys)
        ranked = lookup_join(
            sorted_rows, hits, [*group, "_block"], "_width", [*group, *keys], "inner", null_safe=True
        ).withColumn("_running", F.col("_before") + F.sum(weight).over(along))
    picked = []
    for name, target in targets.items():
        rank = target(F.col("_total"))
        here = (F.col("_running") >= rank) & (F.col("_running") - F.col(weight) < rank)
        picked.append(F.max(F.when(here, F.struct(*keys))).alias(name))
    return ranked.groupBy(*group).agg(F.max("_members").alias("_members"), *picked)


def lower_middle(total: Column) -> Column:
    return F.floor((total + 1) / 2)


def upper_middle(total: Column) -> Column:
    return F.floor(total / 2) + 1


def _around_middle(rows: DataFrame, counted: Stored, group: list[str]) -> Stored:
    """The counted values near each group's middle; those before and after are one row each.

    A mergeable sketch gives two values with the middle between them, in one pass; the second pass
    sums the weights on either side.
    """
    shares = [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH]
    ends = rows.groupBy(*group).agg(F.percentile_approx("_value", shares, SKETCH).alias("_ends"))
    sizes = counted.df.groupBy(*group).agg(F.count("*").alias("_values"))
    same = [F.col(f"_of_{i}").eqNullSafe(F.col(c)) for i, c in enumerate(group)]
    renamed = sizes.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(group)})
    ends = ends.join(renamed, same).drop(*[f"_of_{i}" for i in range(len(group))])
    known = lookup_join(counted.df, ends, group, "_values", ["_value"], null_safe=True)
    value, low, high = F.col("_value"), F.col("_ends")[0], F.col("_ends")[1]
    zone = F.when(value < low, -1).when(value > high, 1).otherwise(0)
    return store(
        known.withColumn("_zone", zone)
        .groupBy(*group, "_zone", F.when(F.col("_zone") == 0, value).alias("_value"))
        .agg(F.sum("_weight").alias("_weight"))
    )


def group_medians(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Exact interpolated median of a numeric column per group, nulls ignored.

    Many values are first narrowed to those around the middle. Should a group's middle not be among
    them, its values are ranked whole.
    """
    rows = df.where(quoted(column).isNotNull()).select(*group, quoted(column).cast("double").alias("_value"))
    counted = store(rows.groupBy(*group, "_value").agg(F.count("*").alias("_weight")))
    targets = {"_low": lower_middle, "_high": upper_middle}

    def medians(middle: DataFrame) -> DataFrame:
        low, high = F.col("_low._value"), F.col("_high._value")
        median = F.when(low == high, low).otherwise((low + high) / 2)
        return middle.select(*group, median.alias("median"))

    if counted.rows <= LIMITS.window_rows:
        return medians(at_ranks(counted.df, counted.rows, group, ["_value"], "_weight", targets))
    near = _around_middle(rows, counted, group)
    middle = at_ranks(near.df, near.rows, group, ["_zone", "_value"], "_weight", targets)
    hit = (F.col("_low._zone") == 0) & (F.col("_high._zone") == 0)
    missed = store(middle.where(~hit).select(*group, F.col("_members").alias("_held")), "_held")
    found = medians(middle.where(hit))
    if not missed.rows:
        return found
    same = [F.col(f"_right_{c}").eqNullSafe(F.col(c)) for c in group]
    wanted = missed.df.drop("_held").withColumnsRenamed({c: f"_right_{c}" for c in group})
    rest = counted.df.join(wanted, same, "left_semi")
    return found.unionAll(medians(at_ranks(rest, counted.rows, group, ["_value"], "_weight", targets)))
