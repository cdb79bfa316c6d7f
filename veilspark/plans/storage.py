"""Stable intermediate results and proven sizes."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted


@dataclass
class Limits:
    """Size bounds that choose between a small-side plan and a distributed one."""

    broadcast_rows: int = 500_000
    broadcast_bytes: int = 16 << 20
    window_rows: int = 1_000_000
    heavy_rows: int = 1_000_000
    heavy_keys: int = 10_000
    pattern_terms: int = 20_000
    part_rows: int = 1 << 16


LIMITS = Limits()


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only on a local master."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="veilspark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@dataclass
class Stored:
    """A table written to the scratch folder, with what was measured while writing it."""

    df: DataFrame
    path: str
    size: dict

    @property
    def rows(self) -> int:
        return self.size["rows"]

    @property
    def small(self) -> bool:
        return self.rows <= LIMITS.broadcast_rows and self.size["bytes"] <= LIMITS.broadcast_bytes

    def drop(self) -> None:
        spark = self.df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class _Open(threading.local):
    def __init__(self):
        self.scopes: list[list[Stored]] = []


_open = _Open()


class Scratch:
    """Tables stored inside the ``with`` block are deleted at its end, unless kept.

    The shuffle files behind them go when the driver next collects its garbage, which a ``free``
    block asks for at its end.
    """

    def __init__(self, free: bool = False):
        self.free = free

    def __enter__(self) -> Scratch:
        self.tables: list[Stored] = []
        _open.scopes.append(self.tables)
        return self

    def keep(self, table: Stored) -> Stored:
        self.tables.remove(table)
        if len(_open.scopes) > 1:
            _open.scopes[-2].append(table)
        return table

    def __exit__(self, *_) -> None:
        _open.scopes.pop()
        for table in self.tables:
            table.drop()
        if self.free and self.tables:
            gc.collect()
            self.tables[0].df.sparkSession._jvm.System.gc()


def _row_bytes(df: DataFrame) -> Column:
    width = F.lit(8 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(quoted(name)), F.lit(0))
    return width


def _metrics(df: DataFrame, weight: str | None, extra: dict[str, Column]) -> list[Column]:
    found = [F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes")]
    if weight:
        found += [F.sum(weight).alias("total"), F.max(weight).alias("most")]
    return found + [c.alias(n) for n, c in extra.items()]


def store(df: DataFrame, weight: str | None = None, **extra: Column) -> Stored:
    """Write once to the shared checkpoint folder, measure on the way, and read back.

    Gives a short lineage that survives lost executors, the same rows on every read,
    true sizes for the optimizer, and column pruning for the steps that follow.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *_metrics(df, weight, extra)).write.parquet(path, compression="zstd")
    size = {k: v or 0 for k, v in seen.get.items()}
    table = Stored(spark.read.schema(df.schema).parquet(path), path, size)
    if _open.scopes:
        _open.scopes[-1].append(table)
    return table


def materialise(df: DataFrame) -> DataFrame:
    return store(df).df


def fits_broadcast(df: DataFrame) -> bool:
    """True if a table is proven small enough to send to every executor."""
    some = df.limit(LIMITS.broadcast_rows + 1)
    size = some.agg(*_metrics(df, None, {})).first()
    return size.rows <= LIMITS.broadcast_rows and (size.bytes or 0) <= LIMITS.broadcast_bytes


def partition_count(df: DataFrame) -> int:
    """Number of partitions of a stored table."""
    return max(1, df.rdd.getNumPartitions())


def few_parts(df: DataFrame, rows: int, each: int | None = None) -> DataFrame:
    """The table in no more partitions than ``rows``, a proven bound on its rows, fill with ``each``
    rows (for narrow ones ``part_rows``), but one per core at least.

    A shuffle deals a small table to as many tasks as a large one, and each writes a file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, cores, -(-rows // (each or LIMITS.part_rows))))


def stacked(parts: list[DataFrame], width: int) -> DataFrame:
    """Union of tables in at most ``width`` partitions, without a shuffle.

    A plain union adds up its inputs' partitions, which would multiply level by level.
    """
    return reduce(DataFrame.unionAll, parts).coalesce(width)
