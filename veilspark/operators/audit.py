"""Measures of equivalence classes: size, diversity, distance from the whole table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..plans.ranking import global_index
from ..plans.skew import lookup_join
from ..plans.storage import LIMITS, materialise, store
from ..spec import PrivacySpec, nan_to_null


def diversity(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Distinct values of a column per group, null counted as one value."""
    return (
        nan_to_null(df)
        .groupBy(*map(quoted, groups))
        .agg(F.count_distinct(F.struct(quoted(column))).alias("diversity"))
    )


def global_frequencies(df: DataFrame, sensitive: str) -> DataFrame:
    """Share of each non-null value in all rows, rows with null included, as (value, q)."""
    df = nan_to_null(df)
    counts = df.groupBy(quoted(sensitive).alias("value")).agg(F.count("*").alias("_held"))
    rows = df.agg(F.count("*")).scalar()
    return counts.where("value is not null").select("value", (F.col("_held") / rows).alias("q"))


def ranked_frequencies(counts: DataFrame, value: str, held: str) -> tuple[DataFrame, int | None, float]:
    """``counts`` plus ``q``, ``rank`` and ``next_q``; its number of rows if these and their bytes are
    small, else None; the top share.

    ``counts`` has one row per value, null included. Ranks count from 0 by descending
    share; ``next_q`` is the share of the value ranked next, 0 for the last.
    """
    present = F.col(value).isNotNull()
    counts = store(counts, weight=held, top=F.max(F.when(present, F.col(held))))
    total = counts.size["total"]
    shares = counts.df.where(present).withColumn("q", F.col(held) / F.lit(total))
    order = [F.desc("q"), F.asc(value)]
    top_q = counts.size["top"] / total if total else 0.0
    known = counts.rows if counts.small else None
    if counts.rows <= LIMITS.window_rows:
        along = Window.orderBy(*order)
        ranked = shares.withColumns(
            {
                "rank": F.row_number().over(along).cast("bigint") - 1,
                "next_q": F.lead("q", 1, 0.0).over(along),
            }
        )
        return ranked, known, top_q
    ranked = materialise(global_index(replace(counts, df=shares), order, "rank"))
    following = ranked.select((F.col("rank") - 1).alias("rank"), F.col("q").alias("next_q"))
    joined = ranked.join(following, "rank", "left")
    return joined.withColumn("next_q", F.coalesce("next_q", F.lit(0.0))), known, top_q


def largest_distance(
    counts: DataFrame, groups: list[str], total: Column, top_q: float, values: str = "all"
) -> DataFrame:
    """Per group, the largest ``|p - q|`` over all values of the table.

    ``counts`` has one row per group and value with ``held``, ``q``, ``rank``, ``next_q``
    (null for the null value) and whatever ``total`` needs. A value the group lacks has
    distance q, so only the most frequent missing one counts: it is the first value, or
    follows a present value in rank. Both are found by equality on (group, rank), so no
    group's values are brought together.
    """
    present = counts.where(F.col("rank").isNotNull())
    own = counts.groupBy(*groups).agg(
        F.max(F.abs(F.col("held") / total - F.col("q"))).alias("_own"),
        F.min("rank").alias("_first"),
    )
    if values == "present":
        return own.select(*groups, F.coalesce("_own", F.lit(0.0)).alias("distance"))
    successor = present.select(*groups, (F.col("rank") + 1).alias("rank"), "next_q")
    gaps = (
        successor.join(present.select(*groups, "rank"), [*groups, "rank"], "left_anti")
        .groupBy(*groups)
        .agg(F.max("next_q").alias("_gap"))
    )
    missing_first = F.when(F.coalesce("_first", F.lit(-1)) != 0, F.lit(top_q))
    distance = F.coalesce(F.greatest("_own", "_gap", missing_first), F.lit(0.0))
    return own.join(gaps, groups, "left").select(*groups, distance.alias("distance"))


def t_distance(
    df: DataFrame, groups: list[str], sensitive: str, values: str = "all"
) -> DataFrame:
    """Distance of each group's sensitive distribution from the whole table's.

    The largest absolute difference of shares, over all values of the table or, with
    ``values='present'``, over those the group holds. Null is a group value of its own.
    """
    if values not in ("all", "present"):
        raise ValueError("values is 'all' or 'present'")
    # As a struct, the group is never null itself, so joins by it find null group values.
    group = F.struct(*map(quoted, groups))
    keyed = nan_to_null(df).select(group.alias("_group"), quoted(sensitive).alias("_value"))
    cells = materialise(keyed.groupBy("_group", "_value").agg(F.count("*").alias("held")))
    return cell_distance(cells, ["_group"], values).select("_group.*", "distance")


def cell_distance(cells: DataFrame, groups: list[str], values: str = "all") -> DataFrame:
    """t_distance of materialised counts ``(groups, _value, held)``."""
    ranked, values_held, top_q = ranked_frequencies(
        cells.groupBy("_value").agg(F.sum("held").alias("_all"), F.count("*").alias("_cells")),
        "_value",
        "_all",
    )
    totals = cells.groupBy(*groups).agg(F.sum("held").alias("_total"), F.count("*").alias("_cells"))
    counts = lookup_join(cells, totals, groups, "_cells", ["_value"])
    shares = ranked.select("_value", "q", "rank", "next_q", "_cells")
    counts = lookup_join(counts, shares, ["_value"], "_cells", groups, rows=values_held)
    return largest_distance(counts, groups, F.col("_total"), top_q, values)


def audit_classes(
    df: DataFrame, spec: PrivacySpec, quasi_identifiers: list[str] | None = None, values: str = "all"
) -> DataFrame:
    """Every equivalence class with its size, diversity and distance, and whether it is
    k-anonymous, l-diverse and t-close. Null is a class value of its own.

    One shuffle reduces the rows to (class, sensitive value) counts; the measures are
    taken from those.
    """
    qi = list(quasi_identifiers or spec.features)
    df = nan_to_null(df)
    keys = [f"_is_null_{i}" for i in range(len(qi))] + [f"_text_{i}" for i in range(len(qi))]
    keyed = df.withColumns(
        {f"_is_null_{i}": quoted(c).isNull() for i, c in enumerate(qi)}
        | {f"_text_{i}": F.coalesce(quoted(c).cast("string"), F.lit("")) for i, c in enumerate(qi)}
    )
    cells = materialise(
        keyed.groupBy(*keys, quoted(spec.sensitive).alias("_value")).agg(
            F.count("*").alias("held"), *[F.first(quoted(c)).alias(c) for c in qi]
        )
    )
    classes = cells.groupBy(*keys).agg(
        F.sum("held").alias("size"),
        F.count("*").alias("diversity"),
        *[F.first(quoted(c)).alias(c) for c in qi],
    )
    distances = cell_distance(cells.drop(*qi), keys, values)
    audited = classes.join(distances, keys)
    l = spec.l if spec.l is not None else 1
    p = spec.p if spec.p is not None else 1.0
    return audited.select(
        *map(quoted, qi),
        "size",
        "diversity",
        "distance",
        (F.col("size") >= spec.k).alias("k_anonymous"),
        (F.col("diversity") >= l).alias("l_diverse"),
        (F.col("distance") <= p).alias("t_close"),
    )


def violations(audit: DataFrame) -> DataFrame:
    """One row: rows, classes, and classes that fail each criterion."""
    return audit.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("rows"),
        F.count("*").alias("classes"),
        F.count_if(~F.col("k_anonymous")).alias("k_violations"),
        F.count_if(~F.col("l_diverse")).alias("l_violations"),
        F.count_if(~F.col("t_close")).alias("t_violations"),
    )
