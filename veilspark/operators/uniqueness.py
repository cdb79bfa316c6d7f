"""How identifying columns and column combinations are."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..plans.storage import Scratch, Stored, partition_count, store
from ..spec import nan_to_null


#: Combinations that one job counts. More are counted size by size, in jobs of so many.
SETS = 1024
#: Fingerprints that one task of such a job makes; with many rows a job counts fewer combinations.
TASK_PRINTS = 1 << 23


def _approx_distinct(*columns: str):
    return F.approx_count_distinct(F.xxhash64(*[F.col(c).isNull() for c in columns], *columns))


def _numbered(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns under names that need no quoting."""
    names = [f"_c{i}" for i in range(len(columns))]
    return nan_to_null(df.select(*[quoted(c).alias(n) for c, n in zip(columns, names)])), names


def uniqueness(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column, 100 * distinct values (null is one) / rows, as ``(name, percent)``."""
    columns = list(columns or df.columns)
    df, names = _numbered(df, columns)
    distinct = [
        (_approx_distinct(c) if approx else F.count_distinct(F.struct(c))).alias(f"_d{i}")
        for i, c in enumerate(names)
    ]
    counted = df.agg(F.count("*").alias("_rows"), *distinct)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.try_divide(100.0 * F.col(f"_d{i}"), "_rows").alias("percent"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select(F.inline(pairs))


def combination_uniqueness(
    df: DataFrame, columns: list[str], max_size: int | None = None, approx: bool = False
) -> DataFrame:
    """100 * distinct rows / rows of every combination of columns, up to ``max_size``.

    Rows are first reduced to distinct tuples of all columns, so that the expansion to
    grouping sets multiplies those only. If there are more combinations than one job counts, the
    lattice is walked by size, and a combination that holds a fully unique one is fully unique
    without being counted. ``position`` orders by size, then by columns.
    """
    df, plain = _numbered(df, columns)
    sizes = range(1, (max_size or len(columns)) + 1)
    wanted = [c for size in sizes for c in combinations(range(len(columns)), size)]
    named = [(i, ", ".join(columns[k] for k in c)) for i, c in enumerate(wanted)]
    if approx:
        sketches = [_approx_distinct(*[plain[k] for k in c]).alias(f"_d{i}") for i, c in enumerate(wanted)]
        counted = df.agg(F.count("*").alias("_rows"), *sketches)
        entries = [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("columns"),
                F.try_divide(100.0 * F.col(f"_d{i}"), "_rows").alias("percent"),
            )
            for i, name in named
        ]
        return counted.select(F.inline(F.array(*entries)))
    tuples = df.groupBy(*plain).agg(F.count("*").alias("_held"))
    if len(wanted) <= SETS:
        return _set_shares(tuples, plain, wanted, named)
    return _walked(tuples, plain, wanted, named)


def _prints(columns: list[str]) -> list[Column]:
    """Two hashes of 64 bits that stand for a value, null included, each of its own."""
    return [
        F.struct(
            F.xxhash64(F.col(c).isNull(), F.col(c)).alias("a"),
            F.xxhash64(F.lit(1), F.col(c).isNull(), F.lit(2), F.col(c)).alias("b"),
        ).alias(c)
        for c in columns
    ]


def _counted(tuples: Stored, plain: list[str], rows: int, sets: dict[int, tuple[int, ...]]) -> dict[int, float]:
    """Distinct tuples of the sets in percent, counted by fingerprints of 128 bits."""
    entries = [
        F.struct(
            F.lit(i).alias("_set"),
            F.xxhash64(*[F.col(f"{plain[k]}.a") for k in wanted]).alias("_a"),
            F.xxhash64(F.lit(3), *[F.col(f"{plain[k]}.b") for k in wanted]).alias("_b"),
        )
        for i, wanted in sets.items()
    ]
    found = tuples.df.select(F.inline(F.array(*entries))).distinct().groupBy("_set").count()
    return {r["_set"]: 100.0 * r["count"] / rows for r in found.collect()}


def _walked(
    tuples: DataFrame, plain: list[str], wanted: list[tuple[int, ...]], named: list[tuple[int, str]]
) -> DataFrame:
    """The sets' shares, size by size. The driver holds a number per combination, as many as it
    was asked for; a set above one that is fully unique is not counted."""
    shares: dict[int, float] = {}
    with Scratch():
        held = store(tuples.select(*_prints(plain), "_held"), "_held")
        rows = held.size["total"]
        step = max(1, min(SETS, TASK_PRINTS * partition_count(held.df) // max(1, held.rows)))
        unique: set[tuple[int, ...]] = set()
        for size in sorted({len(w) for w in wanted}) if rows else ():
            open_sets = {}
            for i, w in enumerate(wanted):
                if len(w) == size:
                    if any(w[:k] + w[k + 1 :] in unique for k in range(size)):
                        unique.add(w)
                        shares[i] = 100.0
                    else:
                        open_sets[i] = w
            numbers = list(open_sets)
            for at in range(0, len(numbers), step):
                shares |= _counted(held, plain, rows, {i: wanted[i] for i in numbers[at : at + step]})
            unique |= {w for i, w in open_sets.items() if shares[i] == 100.0}
    spark = tuples.sparkSession
    found = [(i, name, shares[i]) for i, name in named if i in shares]
    return spark.createDataFrame(found, "position int, columns string, percent double")


def _set_shares(
    tuples: DataFrame, columns: list[str], wanted: list[tuple[int, ...]], named: list[tuple[int, str]]
) -> DataFrame:
    sets = [[F.col(columns[k]) for k in w] for w in wanted]
    groups = tuples.groupingSets(sets, *columns).agg(
        F.grouping_id().alias("_set"), F.sum("_held").alias("_held")
    )
    counted = groups.groupBy("_set").agg(
        F.count("*").alias("_distinct"), F.sum("_held").alias("_rows")
    )
    full = (1 << len(columns)) - 1
    names = F.create_map(
        *[
            x
            for w, (i, name) in zip(wanted, named)
            for x in (
                F.lit(full - sum(1 << (len(columns) - 1 - k) for k in w)).cast("bigint"),
                F.struct(F.lit(i).alias("position"), F.lit(name).alias("columns")),
            )
        ]
    )
    return counted.select(
        names[F.col("_set")].alias("_name"), (100.0 * F.col("_distinct") / F.col("_rows")).alias("percent")
    ).select("_name.position", "_name.columns", "percent")
