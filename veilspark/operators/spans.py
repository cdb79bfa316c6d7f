"""Spans and halves of given partitions (column ``partition_id``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..plans.ranking import at_ranks, group_medians, upper_middle
from ..plans.skew import lookup_join
from ..plans.storage import store
from ..spec import PrivacySpec, nan_to_null


def _span(spec: PrivacySpec, c: str):
    if spec.is_categorical(c):
        return F.count_distinct(F.struct(quoted(c))).cast("double")
    return F.coalesce((F.max(quoted(c)) - F.min(quoted(c))).cast("double"), F.lit(0.0))


def spans(
    df: DataFrame,
    spec: PrivacySpec,
    partition: str = "partition_id",
    scale: dict[str, float] | None = None,
) -> DataFrame:
    """``(partition_id, column, span)``: distinct values incl. null, or max - min.

    With ``scale`` (a span per column) the result is relative to it; a zero scale gives 0.
    """
    df = nan_to_null(df)
    wide = df.groupBy(quoted(partition)).agg(*[_span(spec, c).alias(f"_{i}") for i, c in enumerate(spec.features)])
    entries = []
    for i, c in enumerate(spec.features):
        value = F.col(f"_{i}")
        if scale is not None:
            value = value / F.lit(float(scale[c])) if scale[c] else F.lit(0.0)
        entries.append(F.struct(F.lit(c).alias("column"), value.alias("span")))
    return wide.select(quoted(partition), F.inline(F.array(*entries)))


def full_spans(df: DataFrame, spec: PrivacySpec) -> dict[str, float]:
    """Spans of the whole table, one number per feature."""
    row = nan_to_null(df).agg(*[_span(spec, c).alias(c) for c in spec.features]).first()
    return {c: row[c] for c in spec.features}


def split_side(
    df: DataFrame, spec: PrivacySpec, column: str, partition: str = "partition_id", out: str = "side"
) -> DataFrame:
    """Add the half (``left`` or ``right``) of its partition each row would go to.

    Numbers below the partition's median go left, the others and nulls right. Of a
    categorical column's distinct values, in order of first appearance, the first half
    (rounded down) goes left. A null partition is one like the others.
    """
    columns, key = df.columns, "_partition"
    df = nan_to_null(df).withColumn(key, F.struct(quoted(partition)))
    return _sides(df, spec, column, key, out).select(*map(quoted, [*columns, out]))


def _sides(df: DataFrame, spec: PrivacySpec, column: str, partition: str, out: str) -> DataFrame:
    side = lambda left: F.when(F.coalesce(left, F.lit(False)), "left").otherwise("right")
    if not spec.is_categorical(column):
        held = df.groupBy(partition).agg(F.count("*").alias("_held"))
        medians = held.join(group_medians(df, [partition], column), partition)
        joined = lookup_join(df, medians, [partition], "_held", [spec.order_by])
        return joined.withColumn(out, side(quoted(column) < F.col("median"))).drop("median")
    values = store(
        df.groupBy(partition, quoted(column).alias("_value")).agg(
            F.min(quoted(spec.order_by)).alias("_first"), F.count("*").alias("_held"), F.lit(1).alias("_one")
        )
    )
    pivots = at_ranks(
        values.df, values.rows, [partition], ["_first"], "_one", {"_pivot": upper_middle}
    )
    sides = lookup_join(values.df, pivots, [partition], "_members", ["_first"]).select(
        partition, "_value", "_held", (F.col("_first") < F.col("_pivot._first")).alias("_left")
    )
    keyed = df.withColumn("_value", quoted(column))
    joined = lookup_join(
        keyed, sides, [partition, "_value"], "_held", [spec.order_by], null_safe=True
    )
    return joined.withColumn(out, side(F.col("_left"))).drop("_value", "_left")
