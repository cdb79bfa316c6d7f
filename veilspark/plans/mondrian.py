"""Greedy strict Mondrian partitioning as a level-by-level DataFrame job.

Sibling partitions never interact, so all open partitions of a level are split at once.
A partition's id is its path of 0 (left) and 1 (right) steps. One job counts every value of
every feature and scores all splits of a level; a cell then finds its half from its partition's
pivot, in place, and is written once per level. A partition whose cells fit one task is
finished there.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.audit import largest_distance, ranked_frequencies
from ..spec import PrivacySpec
from .cells import categorical_positions, feature_names
from .local import finish_partition
from .ranking import at_ranks, upper_middle
from .skew import lookup_join
from .storage import LIMITS, Scratch, Stored, materialise, partition_count, stacked, store

#: Cells and bytes of text that one task finishes.
LOCAL_CELLS = 50_000
LOCAL_BYTES = 64 << 20
SERIAL_CELLS = 10_000


@dataclass(frozen=True)
class Rules:
    """What the tasks need to know: the model's parameters, column kinds, full spans."""

    model: str
    k: int
    l: int | None
    p: float | None
    categorical: tuple[int, ...]
    features: int
    scale: tuple[float, ...]
    top_q: float = 0.0
    values: str = "all"


def _span_columns(rules_categorical, names):
    out = []
    for i, c in enumerate(names):
        if i in rules_categorical:
            out.append(F.count_distinct(F.struct(c)).cast("double").alias(f"_span{i}"))
        else:
            out.append(F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias(f"_span{i}"))
    return out


def _text_bytes(categorical: tuple[int, ...], names: list[str]):
    """Bytes of a cell's texts."""
    total = F.coalesce(F.octet_length("_s"), F.lit(0)).cast("bigint")
    for i in categorical:
        total = total + F.coalesce(F.octet_length(names[i]), F.lit(0))
    return total


def _values(cells: DataFrame, rules: Rules, names: list[str]) -> DataFrame:
    """Per partition, feature and value: rows, cells, bytes of these, and the first position."""
    entries = []
    for i, c in enumerate(names):
        text = i in rules.categorical
        entries.append(
            F.struct(
                F.lit(i).alias("_f"),
                (F.lit(None).cast("double") if text else F.col(c)).alias("_number"),
                (F.col(c) if text else F.lit(None).cast("string")).alias("_text"),
            )
        )
    exploded = cells.select(
        "_pid", "_n", "_o", _text_bytes(rules.categorical, names).alias("_b"), F.inline(F.array(*entries))
    )
    return exploded.groupBy("_pid", "_f", "_number", "_text").agg(
        F.sum("_n").alias("_rows"),
        F.count("*").alias("_held"),
        F.sum("_b").alias("_bytes"),
        F.min("_o").alias("_first"),
    )


SUMS = {"rows": "_rows", "cells": "_held", "bytes": "_bytes"}


def _by_text(rules: Rules) -> Column:
    return F.col("_f").isin(*rules.categorical) if rules.categorical else F.lit(False)


def _span_of(rules: Rules, over=None) -> Column:
    """Distinct values of a text feature, else the difference of the extremes."""
    found = [F.count("*"), F.max("_number"), F.min("_number")]
    held, high, low = [c.over(over) for c in found] if over is not None else found
    by_text = _by_text(rules) if over is not None else F.first(_by_text(rules))
    return F.when(by_text, held.cast("double")).otherwise(F.coalesce(high - low, F.lit(0.0)))


def _splits(values: DataFrame, rules: Rules) -> DataFrame:
    """Per partition and feature: its span, its pivot, and what lies before the pivot.

    For groups that fit a window. The pivot is the value at which the running weight passes the
    middle, so the sums up to it are those of the left half. A feature without a value has no row.
    """
    group = Window.partitionBy("_pid", "_f")
    along = group.orderBy(F.asc_nulls_last("_number"), "_first")
    weight = F.when(_by_text(rules), F.lit(1)).when(F.col("_number").isNull(), 0).otherwise(F.col("_rows"))
    weighed = values.withColumn("_weight", weight)
    ranked = weighed.select(
        "_pid",
        "_f",
        "_number",
        F.when(_by_text(rules), F.col("_first")).alias("_seen"),
        "_weight",
        F.sum("_weight").over(along).alias("_running"),
        upper_middle(F.sum("_weight").over(group)).alias("_target"),
        _span_of(rules, group).alias("_span"),
        *[(F.sum(c).over(along) - F.col(c)).alias(f"_left_{n}") for n, c in SUMS.items()],
        *[F.sum(c).over(group).alias(f"_all_{n}") for n, c in SUMS.items()],
    )
    here = (F.col("_running") >= F.col("_target")) & (F.col("_running") - F.col("_weight") < F.col("_target"))
    return ranked.where(here).drop("_weight", "_running", "_target")


def _splits_at_size(values: DataFrame, rules: Rules, pids: int) -> DataFrame:
    """The same where a group may be larger than a window should be."""
    table = store(values)
    group, by_text = ["_pid", "_f"], _by_text(rules)
    ranked = table.df.where(by_text | F.col("_number").isNotNull()).select(
        *group,
        "_number",
        F.when(by_text, F.col("_first")).alias("_seen"),
        F.when(by_text, F.lit(1)).otherwise(F.col("_rows")).alias("_weight"),
    )
    pivots = at_ranks(ranked, table.rows, group, ["_number", "_seen"], "_weight", {"_pivot": upper_middle})
    held = table.df.groupBy(*group).agg(F.count("*").alias("_values"))
    pivots = pivots.drop("_members").join(held, group)
    most = pids * rules.features
    sides = lookup_join(table.df, pivots, group, "_values", ["_first"], "inner", rows=most)
    left = F.when(by_text, F.col("_first") < F.col("_pivot._seen")).otherwise(
        F.col("_number") < F.col("_pivot._number")
    )
    left = F.coalesce(left, F.lit(False))
    return (
        sides.groupBy(*group, "_pivot")
        .agg(
            _span_of(rules).alias("_span"),
            *[F.sum(F.when(left, F.col(c)).otherwise(0)).alias(f"_left_{n}") for n, c in SUMS.items()],
            *[F.sum(c).alias(f"_all_{n}") for n, c in SUMS.items()],
        )
        .select("*", "_pivot._number", "_pivot._seen")
        .drop("_pivot")
    )


def _candidates(cells: DataFrame, rows: int, rules: Rules, names: list[str], pids: int) -> Stored:
    """Per partition its size and the splits with k rows in both halves, widest feature first."""
    values = _values(cells, rules, names)
    fits = rows <= LIMITS.window_rows
    splits = _splits(values, rules) if fits else _splits_at_size(values, rules, pids)
    scaled = F.lit(0.0)
    for i, full in enumerate(rules.scale):
        if full:
            scaled = F.when(F.col("_f") == i, F.col("_span") / F.lit(full)).otherwise(scaled)
    split = F.struct(
        (-scaled).alias("less"),
        F.col("_f").alias("f"),
        F.col("_number").alias("number"),
        F.col("_seen").alias("seen"),
        *[F.col(f"_left_{n}").alias(f"left_{n}") for n in SUMS],
    )
    half = F.least(F.col("_left_rows"), F.col("_all_rows") - F.col("_left_rows"))
    listed = F.array_sort(F.collect_list(F.when(half >= rules.k, split)))
    found = splits.groupBy("_pid").agg(
        *[F.max(f"_all_{n}").alias(f"_{n}") for n in SUMS], listed.alias("_splits")
    )
    texts = {
        f"text{j}": F.count_if(
            F.coalesce(F.get("_splits", j)["f"].isin(*rules.categorical), F.lit(False))
            if rules.categorical
            else F.lit(False)
        )
        for j in range(rules.features)
    }
    sizes = {f"open{j}": F.count_if(F.size("_splits") > j) for j in range(rules.features + 1)}
    return store(found, **texts, **sizes)


def _text_sides(cells: DataFrame, rules: Rules, names: list[str]) -> Stored:
    """Per partition that splits by a text feature: its values and whether they are in the left half."""
    text, wanted = F.lit(None).cast("string"), F.lit(False)
    for i in rules.categorical:
        here = F.col("_split.f") == i
        text, wanted = F.when(here, F.col(names[i])).otherwise(text), wanted | here
    values = (
        cells.where(wanted)
        .groupBy("_pid", text.alias("_text"))
        .agg(F.min("_o").alias("_first"), F.first("_split.seen").alias("_seen"), F.count("*").alias("_held"))
    )
    left = (F.col("_first") < F.col("_seen")).alias("_text_left")
    return store(values.select("_pid", "_text", F.lit(True).alias("_by_text"), "_held", left), "_held")


def _sided(cells: DataFrame, sides: DataFrame | Stored | None, rules: Rules, names: list[str]) -> DataFrame:
    """Add ``_left``: by number in place, by text from the sides of the values."""
    left, text = F.lit(False), F.lit(None).cast("string")
    for i, c in enumerate(names):
        here = F.col("_split.f") == i
        if i in rules.categorical:
            text = F.when(here, F.col(c)).otherwise(text)
        else:
            left = F.when(here, F.coalesce(F.col(c) < F.col("_split.number"), F.lit(False))).otherwise(left)
    if sides is None:
        return cells.withColumn("_left", left)
    by_text = F.col("_split.f").isin(*rules.categorical)
    keyed = cells.withColumns({"_left": left, "_text": text, "_by_text": by_text})
    joined = lookup_join(keyed, sides, ["_pid", "_text", "_by_text"], "_held", ["_o", "_s"], null_safe=True)
    return joined.withColumn("_left", F.coalesce("_text_left", "_left")).drop("_text", "_by_text", "_text_left")


def _fitting(cells: DataFrame, rules: Rules) -> DataFrame:
    """Per partition, whether both halves satisfy the l or t condition."""
    keys = ["_pid", "_left"]
    if rules.model == "l":
        fits = cells.groupBy(*keys).agg((F.count_distinct(F.struct("_s")) >= rules.l).alias("_fits"))
    else:
        half = F.when(F.col("_left"), F.col("_split.left_rows")).otherwise(F.col("_rows") - F.col("_split.left_rows"))
        counts = materialise(
            cells.groupBy(*keys, F.col("_s").alias("_value")).agg(
                F.sum("_n").alias("held"),
                F.first(half).alias("_half"),
                F.first("q").alias("q"),
                F.first("rank").alias("rank"),
                F.first("next_q").alias("next_q"),
            )
        )
        distances = largest_distance(counts, keys, F.col("_half"), rules.top_q, rules.values)
        fits = distances.select(*keys, (F.col("distance") <= rules.p).alias("_fits"))
    return fits.groupBy("_pid").agg(F.min("_fits").alias("_fits"))


def _chosen(cells: DataFrame, found: Stored, rules: Rules, names: list[str]):
    """Per partition the split it takes (null if it has none), and the sides of its text values.

    Under the k model that is the first candidate. Else the candidates are tried in turn by all
    partitions that are still open; the cells are only read for that.
    """
    if rules.model == "k":
        chosen = found.df.withColumn("_split", F.get("_splits", 0))
        tagged = _tagged(cells, chosen, found).where("_split is not null")
        return chosen, _text_sides(tagged, rules, names) if found.size["text0"] else None
    untried, passed, sides = found.df.where(F.size("_splits") > 0), [], []
    for at in range(rules.features):
        if not found.size[f"open{at}"]:
            break
        tried = untried.withColumn("_split", F.get("_splits", at))
        tagged = _tagged(cells, tried, found).where("_split is not null")
        own = _text_sides(tagged, rules, names) if found.size[f"text{at}"] else None
        verdict = store(_fitting(_sided(tagged, own, rules, names), rules), fit=F.count_if("_fits"))
        fit, unfit = (verdict.df.where(c).select("_pid", F.lit(at).alias("_at")) for c in ("_fits", "not _fits"))
        passed.append(fit)
        if own is not None:
            sides.append(own.df.join(fit, "_pid", "left_semi"))
        if verdict.size["fit"] == verdict.rows:
            break
        untried = found.df.where(F.size("_splits") > at + 1).join(unfit, "_pid", "left_semi")
    if not passed:
        return found.df.withColumn("_split", F.get("_splits", rules.features)), None
    chosen = found.df.join(reduce(DataFrame.unionAll, passed), "_pid", "left")
    chosen = chosen.withColumn("_split", F.get("_splits", "_at"))
    return chosen, reduce(DataFrame.unionAll, sides) if sides else None


def _tagged(cells: DataFrame, found: DataFrame, size: Stored) -> DataFrame:
    """The cells with their partition's row, which is sent to all of them if it is small."""
    rows = size.rows if size.small else None
    held = found.select("_pid", "_split", "_rows", "_cells", "_bytes", F.col("_cells").alias("_weight"))
    return lookup_join(cells, held, ["_pid"], "_weight", ["_o", "_s"], rows=rows)


def _fate(rules: Rules, local_cells: int, rows: Column, cells: Column, bytes_: Column) -> Column:
    return (
        F.when(rows < 2 * rules.k, "done")
        .when((cells <= local_cells) & (bytes_ <= LOCAL_BYTES), "local")
        .otherwise("split")
    )


def _half_of(n: str) -> Column:
    return F.when(F.col("_left"), F.col(f"_split.left_{n}")).otherwise(
        F.col(f"_{n}") - F.col(f"_split.left_{n}")
    )


def _split_level(cells: DataFrame, rows: int, rules: Rules, names: list[str], local_cells: int, pids: int) -> Stored:
    """The cells of a level's partitions, moved to their halves and tagged with the ``_fate`` of these:
    ``done``, to be finished ``local``ly, or to ``split`` again. Written once."""
    state = [c for c in cells.columns if c != "_fate"]
    with Scratch() as scratch:
        found = _candidates(cells, rows, rules, names, pids)
        chosen, sides = _chosen(cells, found, rules, names)
        sided = _sided(_tagged(cells, chosen, found), sides, rules, names)
        fate = _fate(rules, local_cells, *[_half_of(n) for n in SUMS])
        step = F.when(F.col("_left"), "0").otherwise("1")
        moved = F.col("_split").isNotNull()
        result = sided.withColumns(
            {
                "_fate": F.when(moved, fate).otherwise("done"),
                "_pid": F.when(moved, F.concat("_pid", step)).otherwise(F.col("_pid")),
            }
        ).select(*state, "_fate")
        sums = {f: F.count_if(F.col("_fate") == f) for f in ("done", "local", "split")}
        return scratch.keep(store(result, **sums))


def partition_cells(
    cells: DataFrame,
    spec: PrivacySpec,
    model: str,
    local_cells: int = LOCAL_CELLS,
    values: str = "all",
) -> DataFrame:
    """Stored cells with the path ``_pid`` of their finished partition.

    Partitions of at most ``local_cells`` cells are finished inside one task; 0 splits
    everything by distributed levels. A partition below 2k rows has no valid split.
    """
    names = feature_names(spec)
    categorical = tuple(categorical_positions(spec))
    spans = _span_columns(categorical, names)
    top_q = 0.0
    if model == "t":
        cells, top_q = _with_shares(materialise(cells), names)
    start = store(cells.withColumn("_pid", F.lit("")))
    columns = [*names, "_s", "_n", "_o", "_pid"]
    if not start.rows:
        return start.df.select(*columns)
    full = start.df.agg(*spans).first()
    rules = Rules(
        model, spec.k, spec.l, spec.p, categorical, len(names), tuple(full), top_q, values
    )
    width, state = partition_count(start.df), start.df.columns
    if start.rows <= local_cells and start.size["bytes"] <= LOCAL_BYTES:
        return materialise(_finish_locally(start.df, rules, names, 1, start.rows)).select(*columns)
    done, local, local_rows, groups, pids = [], [], 0, 0, 1
    open_cells, rows, before = start.df, start.rows, start
    while rows:
        level = _split_level(open_cells, rows, rules, names, local_cells, pids)
        if before.rows == rows:  # all its cells were moved on
            before.drop()
        if level.size["done"]:
            done.append(level.df.where("_fate = 'done'").select(*state))
        if level.size["local"]:
            local.append(level.df.where("_fate = 'local'").select(*state))
            local_rows += level.size["local"]
            groups += -(-level.size["local"] // max(1, local_cells))
        open_cells, rows, before = level.df.where("_fate = 'split'").select(*state), level.size["split"], level
        pids = min(2 * pids, max(1, rows))
    if local:
        finished = _finish_locally(stacked(local, width), rules, names, groups, local_rows)
        done.append(materialise(finished))
    return stacked([d.select(*columns) for d in done], width)


def _with_shares(cells: DataFrame, names: list[str]) -> tuple[DataFrame, float]:
    """Add each cell's sensitive value's share, rank and next share; and the top share."""
    counts = cells.groupBy("_s").agg(F.sum("_n").alias("_all"), F.count("*").alias("_cells"))
    ranked, values, top_q = ranked_frequencies(counts, "_s", "_all")
    shares = ranked.select("_s", "q", "rank", "next_q", "_cells")
    return lookup_join(cells, shares, ["_s"], "_cells", ["_o", *names], rows=values), top_q


def _finish_locally(cells: DataFrame, rules: Rules, names: list[str], groups: int, rows: int) -> DataFrame:
    """Finish bounded partitions, one task group each, spread over all cores.

    Fewer groups than would keep the cores busy are first split in one task each until
    there are enough of them.
    """
    spark = cells.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores, groups // 16)
    plain = SimpleNamespace(**asdict(rules))

    def step(stop_at):
        return lambda group: finish_partition(group, plain, names, stop_at)

    def grouped(df):
        return df.repartition(tasks, "_pid").groupBy("_pid")

    if groups < 2 * cores and rows > SERIAL_CELLS:
        cells = grouped(cells).applyInPandas(step(rows // (8 * cores)), cells.schema)
    return grouped(cells).applyInPandas(step(0), cells.schema)
