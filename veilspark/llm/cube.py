"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import global_index
from ..plans.skew import lookup_join
from ..plans.storage import Stored, store
from .common import NOT_SPACE, name, row_of, whole

#: Units that one task moves at a time.
BLOCK_UNITS = 2_000
#: Units of a block that its flight leaves to the next round, for the landing to choose among.
LEFT_OPEN = 16
MOST_COPIES = 3
TINY = 1e-9


def _step(pi: list, sizes: list, trio: list, balance_count: bool, draw: float) -> None:
    """Move the probabilities of a few units along the null space of their constraints.

    The move keeps the expected tokens (and the expected number of documents), and takes at
    least one probability to 0 or 1. Its direction is drawn so that expectations hold.
    """
    if len(trio) == 3:
        a, b, c = (sizes[i] for i in trio)
        way = [b - c, c - a, a - b] if balance_count else [1.0, -1.0, 0.0]
        if not any(way):
            way = [1.0, -1.0, 0.0]
    elif balance_count and sizes[trio[0]] != sizes[trio[1]]:
        return
    elif sizes[trio[0]] or sizes[trio[1]]:
        way = [float(sizes[trio[1]]), float(-sizes[trio[0]])]
    else:
        way = [1.0, -1.0]
    up = down = float("inf")
    for i, w in zip(trio, way):
        if w > 0:
            up, down = min(up, (1 - pi[i]) / w), min(down, pi[i] / w)
        elif w < 0:
            up, down = min(up, pi[i] / -w), min(down, (1 - pi[i]) / -w)
    move = up if draw * (up + down) < down else -down
    for i, w in zip(trio, way):
        value = pi[i] + move * w
        pi[i] = 0.0 if value < TINY else 1.0 if value > 1 - TINY else value


def flight(pi: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but two at most, which share no null space."""
    values, weights = pi.astype(float).tolist(), sizes.astype(float).tolist()
    draws = np.random.Generator(np.random.PCG64(seed))
    open_units: list[int] = []
    for i in range(len(values)):
        if not 0 < values[i] < 1:
            continue
        open_units.append(i)
        if len(open_units) == 3:
            _step(values, weights, open_units, True, draws.random())
            open_units = [u for u in open_units if 0 < values[u] < 1]
    if len(open_units) == 2 and weights[open_units[0]] == weights[open_units[1]]:
        _step(values, weights, open_units, True, draws.random())
    return np.array(values)


def land(pi: np.ndarray, sizes: np.ndarray, seed: int, moves: int = 64) -> np.ndarray:
    """Settle the small problem that the flight leaves, so that the words come out near.

    The constraint on documents is dropped, then the last unit is drawn. What that costs in
    words is made up by exchanging a taken unit for one left out whose size differs by about
    as much, or where there is none by taking or leaving one.
    """
    values, weights = flight(pi, sizes, seed), sizes.astype(float)
    draws = np.random.Generator(np.random.PCG64(seed + 1))
    open_units = np.flatnonzero((values > 0) & (values < 1)).tolist()
    if len(open_units) == 2:
        moved = values.tolist()
        _step(moved, weights.tolist(), open_units, False, draws.random())
        values = np.array(moved)
    for u in np.flatnonzero((values > 0) & (values < 1)):
        values[u] = float(draws.random() < values[u])
    wanted = float((pi * weights).sum())
    for _ in range(moves):
        error = float((values * weights).sum()) - wanted
        taken, left = np.flatnonzero(values == 1), np.flatnonzero(values == 0)
        best, change = abs(error), None
        if len(taken) and len(left):
            ordered = left[np.argsort(weights[left], kind="stable")]
            near = np.searchsorted(weights[ordered], weights[taken] - error)
            for shift in (-1, 0):
                other = ordered[np.clip(near + shift, 0, len(ordered) - 1)]
                rest = np.abs(error - weights[taken] + weights[other])
                at = int(rest.argmin())
                if rest[at] < best:
                    best, change = float(rest[at]), [int(taken[at]), int(other[at])]
        flips = np.abs(error + np.where(values == 1, -weights, weights))
        if len(flips) and flips.min() < (best / 2 if change else best):
            best, change = float(flips.min()), [int(flips.argmin())]
        if change is None:
            break
        values[change] = 1 - values[change]
    return values


def _fly(landing: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "number"], kind="stable")
        seed = (int(rows["order"].iloc[0]) ^ len(rows)) & ((1 << 62) - 1)
        pi, sizes = rows["pi"].to_numpy(), rows["size"].to_numpy()
        if landing:
            moved = land(pi, sizes, seed)
        else:
            rest = max(0, len(rows) - LEFT_OPEN)
            moved = np.append(flight(pi[:rest], sizes[:rest], seed), pi[rest:])
        return rows.assign(pi=moved)[["source", "order", "number", "size", "pi"]]

    return run


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(NOT_SPACE)).cast("bigint")


def targets(sources: Stored) -> DataFrame:
    """Per source its target: weights 1, 2, 3 in the order of names share the total, and a
    target above ``MOST_COPIES`` times its source stops there, the excess reshared by weight.

    The level of a word per unit of weight rises until no more source is above its bound; each
    round is one aggregate over the sources.
    """
    ranked = global_index(sources, [F.col("name").isNull(), F.col("name")], "place")
    weighed = store(ranked.withColumn("weight", F.col("place") % 3 + 1)).df
    bound = MOST_COPIES * F.col("source_size")
    level, total = 0.0, None
    while True:
        above = F.col("weight") * F.lit(level) > bound
        row = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, bound)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("free"),
        ).first()
        total = row["total"] or 0
        raised = (total - (row["fixed"] or 0)) / row["free"] if row["free"] else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), bound.cast("double"))
    return weighed.withColumn("target", target)


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: key, size, source_size, target, copies; and ``row`` if ``carry``.

    A row is a document of ``size`` words; null texts have none, and a null source is a source
    of its own, last in order. The documents of a source share its target by one ratio: each is
    taken floor(ratio) times, and once more for a balanced sample with the rest as probability.
    Repeated rows are documents of their own. An empty table gives no rows; sources without
    words have target 0. Other columns are only carried. Reruns agree: every draw is seeded by
    what the rows hold.

    The sample is drawn by the cube method. Blocks of a source, dealt by hash, move their
    probabilities through the null space of two constraints, words and documents; a few units of
    a block stay open, and these are dealt to blocks again until a source is one block. Then the
    landing settles the last. A hot source is only more blocks.
    """
    label = F.concat(
        F.when(F.col("name").isNull(), "n").otherwise("s"), F.coalesce("name", F.lit(""))
    )
    rows = docs.select(
        name(key).alias("key"),
        name(source).cast("string").alias("name"),
        word_count(name(text)).alias("size"),
        F.monotonically_increasing_id().alias("number"),
        *([row_of(docs).alias("row")] if carry else []),
    )
    return _mixed(store(rows.withColumn("source", label)).df)


def _mixed(rows: DataFrame) -> DataFrame:
    sources = store(
        rows.groupBy("source", "name").agg(
            F.sum("size").alias("source_size"), F.count("*").alias("members")
        )
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sources).withColumn("ratio", ratio).select(
        "source",
        "source_size",
        "target",
        "members",
        F.floor("ratio").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("pi"),
        F.ceil(F.col("members") / BLOCK_UNITS).alias("blocks"),
    )
    plan = store(plan.withColumn("held", F.col("members")), "held")
    joined = lookup_join(rows, plan, ["source"], "held", ["number"])
    units = joined.where((F.col("pi") > 0) & (F.col("pi") < 1)).select(
        "source", "number", "size", "pi", "blocks", F.xxhash64("key", "size").alias("order")
    )
    schema = "source string, order long, number long, size long, pi double"
    settled: list[DataFrame] = []
    most = plan.df.agg(F.max("blocks")).first()[0] or 1
    while most > 1:
        block = F.pmod(F.xxhash64("order", F.lit(most)), F.col("blocks"))
        flown = units.withColumn("block", block).groupBy("source", "block").applyInPandas(_fly(False), schema)
        moved = store(flown).df
        still = (F.col("pi") > 0) & (F.col("pi") < 1)
        settled.append(moved.where(~still))
        most = -(-(LEFT_OPEN + 2) * most // BLOCK_UNITS)
        units = moved.where(still).withColumn("blocks", F.lit(most))
    landed = units.groupBy("source").applyInPandas(_fly(True), schema)
    drawn = landed
    for part in settled:
        drawn = drawn.unionByName(part)
    chosen = drawn.where("pi >= 0.5").select("number", F.lit(1).alias("extra"))
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("bigint")
    return joined.join(chosen, "number", "left").withColumn("copies", copies).drop(
        "pi", "whole", "extra", "blocks", "members", "number", "source", "name"
    )


def take(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    mixed = mix(docs, text, key, source, carry=True).where("copies > 0")
    return mixed.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
