"""Partition a table under a privacy model and generalise its features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, quoted
from ..plans.cells import build_cells, cell_values, feature_names
from ..plans.mondrian import LOCAL_CELLS, partition_cells
from ..plans.skew import lookup_join
from ..plans.storage import LIMITS, store
from ..spec import PrivacySpec, nan_to_null

# How a joined list of values is separated and shows a missing one.
SEPARATOR = "|"
MISSING_IN_LIST = "nan"
NUMERIC_FORMS = ("int_mean", "mean", "range")
#: Bytes of joined lists that the rows of one task hold; a file then stores each list about once.
LISTS_BYTES = 512 << 10
#: Bytes of joined lists that are broadcast.
LISTS_SENT = 64 << 20


def _numeric_form(c: str, weight: Column, form: str) -> Column:
    if form == "range":
        low, high = F.min(c), F.max(c)
        return F.concat(low.cast("string"), F.lit(" - "), high.cast("string"))
    mean = F.try_divide(
        F.sum(F.col(c) * weight), F.sum(F.when(F.col(c).isNotNull(), weight)).cast("double")
    )
    return mean.cast("bigint") if form == "int_mean" else mean


def _summaries(
    df: DataFrame, partition: str, names: list[str], texts: set[str], order: str, weight: str, form: str
) -> DataFrame:
    """One row per partition: every feature's common value, and the weight it covers.

    A text feature is first reduced to one row per distinct value, so only the values a
    partition's list consists of are brought together.
    """
    if form not in NUMERIC_FORMS:
        raise ValueError(f"numeric form is one of {NUMERIC_FORMS}")
    numbers = [n for n in names if n not in texts]
    result = df.groupBy(partition).agg(
        F.sum(weight).alias("_covered"),
        F.count("*").alias("_entries"),
        *[_numeric_form(n, F.col(weight), form).alias(n) for n in numbers],
    )
    listed = [n for n in names if n in texts]
    if listed:
        pairs = [F.struct(F.lit(n).alias("_name"), F.col(n).alias("_value")) for n in listed]
        values = (
            df.select(partition, order, F.inline(F.array(*pairs)))
            .groupBy(partition, "_name", "_value")
            .agg(F.min(order).alias("_first"))
        )
        entry = F.struct("_first", F.coalesce("_value", F.lit(MISSING_IN_LIST)).alias("_value"))
        lists = [
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.when(F.col("_name") == n, entry))),
                    lambda e: e["_value"],
                ),
                SEPARATOR,
            ).alias(n)
            for n in listed
        ]
        result = result.join(values.groupBy(partition).agg(*lists), partition)
    return result


def _first_partitions(summaries: DataFrame, partition: str, limit: int | None) -> DataFrame:
    """The partitions finished first: nearer the root, then left before right."""
    if limit is None:
        return summaries
    path = F.col(partition)
    return summaries.orderBy(F.length(path).asc_nulls_last(), path).limit(limit)


def partition(
    df: DataFrame,
    spec: PrivacySpec,
    model: str,
    local_cells: int = LOCAL_CELLS,
    values: str = "all",
) -> DataFrame:
    """Add ``partition_id``, the path of the finished partition of each row."""
    spec.check_model(model)
    df = nan_to_null(df)
    cells = partition_cells(build_cells(df, spec), spec, model, local_cells, values)
    names = feature_names(spec)
    tuples = cells.groupBy(*names).agg(
        F.sum("_n").alias("_n"), F.first("_pid").alias("partition_id")
    )
    keyed = df.withColumns(cell_values(df, spec))
    joined = lookup_join(keyed, tuples, names, "_n", [spec.order_by], null_safe=True)
    return joined.drop(*names)


def generalise_partitions(
    df: DataFrame,
    spec: PrivacySpec,
    partition: str = "partition_id",
    numeric: str = "int_mean",
    max_partitions: int | None = None,
) -> DataFrame:
    """Rewrite the features of every partition to one common value.

    Categorical: the distinct values in order of first appearance, joined. Numeric:
    integer-truncated mean, mean, or range. Other columns and all rows are kept, unless
    ``max_partitions`` asks for the first partitions only. A null partition is one like the
    others, and the last. Rows with a joined list are sorted by partition before they get it, so equal
    lists stand together wherever they are written; a large partition is spread over several tasks.
    """
    columns, key = df.columns, partition
    df = nan_to_null(df).withColumn("_partition", F.struct(quoted(partition).alias("path")))
    partition = "_partition"
    texts, names = {c for c in spec.features if spec.is_categorical(c)}, feature_names(spec)
    listed = {n for n, c in zip(names, spec.features) if c in texts}
    source = df.select(
        partition,
        quoted(spec.order_by).alias("_o"),
        F.lit(1).alias("_weight"),
        *[
            (as_text(quoted(c), df.schema[c].dataType) if c in texts else quoted(c).cast("double")).alias(n)
            for n, c in zip(names, spec.features)
        ],
    )
    found = _summaries(source, partition, names, listed, "_o", "_weight", numeric)
    found = _first_partitions(found, f"{partition}.path", max_partitions).drop("_entries")
    found = found.withColumnsRenamed(dict(zip(names, spec.features)))
    kept = df.drop(*[c for c in spec.features if c != key])
    how = "left" if max_partitions is None else "inner"
    rows = None
    if listed:
        found = store(found, "_covered")
        parts = max(
            int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.size["bytes"] // LISTS_BYTES + 1
        )
        # Larger tables of lists come by a shuffle on the partition.
        if found.rows <= LIMITS.broadcast_rows and found.size["bytes"] <= LISTS_SENT:
            rows = found.rows
            along = [partition, quoted(spec.order_by)]
            kept = kept.repartitionByRange(parts, *along).sortWithinPartitions(*along)
            # The optimizer drops a sort below a join, unless a step that is not deterministic stands between.
            kept = kept.where(F.spark_partition_id() >= 0)
    joined = lookup_join(kept, found, [partition], "_covered", [spec.order_by], how, rows=rows)
    return joined.select(*map(quoted, columns))


def anonymise(
    df: DataFrame,
    spec: PrivacySpec,
    model: str,
    numeric: str = "int_mean",
    max_partitions: int | None = None,
    local_cells: int = LOCAL_CELLS,
    values: str = "all",
    keep_partition_id: bool = False,
    common_values: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The table with features generalised so that every partition satisfies the model:
    ``k`` rows, and for ``l`` also l distinct sensitive values, or for ``t`` a sensitive
    distribution within p of the whole table's.

    Partitioning and generalising work on cells; the rows are joined once at the end.
    ``common_values`` may change the table of the partitions' common values (``partition_id`` and the
    features) before it is joined to the rows.
    """
    spec.check_model(model)
    df = nan_to_null(df)
    names = feature_names(spec)
    texts = {n for n, c in zip(names, spec.features) if spec.is_categorical(c)}
    cells = partition_cells(build_cells(df, spec), spec, model, local_cells, values)
    found = _summaries(cells, "_pid", names, texts, "_o", "_n", numeric).drop("_covered")
    found = _first_partitions(found, "_pid", max_partitions)
    if common_values is not None:
        own = dict(zip(names, spec.features)) | {"_pid": "partition_id"}
        changed = common_values(store(found).df.withColumnsRenamed(own))
        found = changed.withColumnsRenamed({c: n for n, c in own.items()})
    common = found.withColumnsRenamed({n: f"_g{n}" for n in names})
    tuples = cells.groupBy(*names).agg(F.sum("_n").alias("_n"), F.first("_pid").alias("_pid"))
    how = "left" if max_partitions is None else "inner"
    mapping = lookup_join(tuples, common, ["_pid"], "_entries", names, how)
    keyed = df.withColumns(cell_values(df, spec)).drop(*spec.features)
    joined = lookup_join(keyed, mapping, names, "_n", [spec.order_by], how, null_safe=True)
    renamed = {f"_g{n}": c for n, c in zip(names, spec.features)}
    result = joined.drop(*names).withColumnsRenamed(renamed | {"_pid": "partition_id"})
    return result.select(*map(quoted, [*df.columns, *(["partition_id"] if keep_partition_id else [])]))
