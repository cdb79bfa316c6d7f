"""Bounded heaps of tasks, merged in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heaps merged at a time, so a group never holds more than this times its heap's size.
FAN = 64
#: Bytes of broadcast rows that one job carries.
BLOCK_BYTES = 16 << 20


def merge_heaps(heaps: DataFrame, by: str, order: list[Column], k: int, runs: int) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, with their ``rank`` from 1.

    ``run`` tells from which of the ``runs`` heaps a row comes. A round merges ``FAN`` of them;
    the last round has one group per ``by`` left.
    """
    while True:
        runs = math.ceil(runs / FAN)
        heaps = heaps.withColumn("run", F.floor(F.col("run") / FAN).cast("bigint"))
        along = Window.partitionBy(by, "run").orderBy(*order)
        heaps = heaps.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k)
        if runs <= 1:
            return heaps.drop("run")


def row_blocks(rows: DataFrame, number: str, weight: Column, most: int | None = None) -> Iterator[pa.Table]:
    """The rows of a stored table in blocks of at most about ``most`` bytes, one at a time.

    Rows are dealt by a hash of their number, so no value can fill a block; the blocks' bytes are
    measured, and a row that is larger than a block comes alone or with few others.
    """
    most = most or BLOCK_BYTES
    whole = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")).first()
    if not whole.n:
        return
    blocks = math.ceil(whole.bytes / most)
    place = F.xxhash64(number)
    while 1 < blocks < whole.n:
        held = rows.groupBy(F.pmod(place, F.lit(blocks)).alias("b")).agg(F.sum(weight).alias("bytes"))
        if held.agg(F.max("bytes")).first()[0] <= most:
            break
        blocks = min(2 * blocks, whole.n)
    for b in range(blocks):
        block = (rows if blocks == 1 else rows.where(F.pmod(place, F.lit(blocks)) == b)).toArrow()
        if block.num_rows:
            yield block
