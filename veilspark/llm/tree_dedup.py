"""Exact duplicates by merging sorted digest runs in binomial rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Stored, store
from .common import name, row_of, squeezed, whole

#: Runs that one merge joins; a power of two.
FAN_BITS = 4
KEY = ["digest", "check"]


@dataclass
class Runs:
    """One level of the tree: per run, its distinct digests in order."""

    table: Stored
    shift: int

    def lifted(self) -> DataFrame:
        return self.table.df.withColumn("run", F.shiftright("run", FAN_BITS))


def _merged(rows: DataFrame) -> DataFrame:
    """Multiway merge: a run keeps each digest once, with the best row and the rows behind it."""
    return (
        rows.groupBy("run", *KEY)
        .agg(F.min("best").alias("best"), F.sum("members").alias("members"))
        .sortWithinPartitions("run", *KEY)
    )


def decide(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, digest; and ``row`` if ``carry``.

    Texts are equal when they are the same without white space; null is the empty text, and
    empty texts equal each other. Of equal texts stays the row with the most code points, then
    the smallest key; a null key comes last, and of rows that repeat wholly one stays. Other
    columns, whatever their names, are not looked at. An empty table gives no rows.

    The partitions of the input are the runs. A round merges the runs whose numbers agree up to
    their last bits, so a digest that a third of the rows hold costs one row per run in the
    first round and less in each later one. The answer returns the same way from level to
    level, and last to the rows by (run, digest): no key gathers more rows than a run has.
    A digest is SHA-256; a row is taken for equal only if a second hash and the length agree.
    """
    raw = whole(name(text))
    plain = docs.select(
        name(key).alias("key"),
        F.length(raw).alias("points"),
        squeezed(raw).alias("norm"),
        *([row_of(docs).alias("row")] if carry else []),
    )
    base = store(
        plain.select(
            "key",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.struct(F.xxhash64("norm").alias("hash"), F.length("norm").alias("length")).alias("check"),
            F.spark_partition_id().cast("bigint").alias("run"),
            F.struct(
                (-F.col("points")).alias("order"),
                F.col("key").isNull().alias("no_key"),
                "key",
                F.monotonically_increasing_id().alias("number"),
            ).alias("best"),
            *(["row"] if carry else []),
        ),
        last=F.max(F.spark_partition_id()),
    )
    rows = base.df
    levels = [Runs(store(_merged(rows.withColumn("members", F.lit(1).cast("bigint")))), 0)]
    runs = int(base.size["last"]) + 1
    while runs > 1:
        levels.append(Runs(store(_merged(levels[-1].lifted())), levels[-1].shift + FAN_BITS))
        runs = (runs - 1 >> FAN_BITS) + 1
    answer = levels[-1].table.df
    for below in reversed(levels[:-1]):
        parent = answer.withColumnRenamed("run", "above").select(
            "above", *KEY, "best", "members"
        )
        child = below.table.df.select("run", *KEY, F.shiftright("run", FAN_BITS).alias("above"))
        answer = child.join(parent, ["above", *KEY]).drop("above")
    final = answer.select("run", *KEY, F.col("best").alias("winner"), "members")
    return rows.join(final, ["run", *KEY]).select(
        "key",
        F.col("winner.key").alias("keep_id"),
        F.col("members").alias("group_size"),
        (F.col("winner.number") == F.col("best.number")).alias("kept"),
        "digest",
        *(["row"] if carry else []),
    )


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    return decide(docs, text, key, carry=True).where("kept").select("row.*")
