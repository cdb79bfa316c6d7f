"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from .storage import LIMITS, Stored, store


def _condition(on: list[str], null_safe: bool) -> Column:
    condition = F.lit(True)
    for c in on:
        a, b = F.col(c), F.col(f"_right_{c}")
        condition = condition & (a.eqNullSafe(b) if null_safe else a == b)
    return condition


def _null_keys_spread(left: DataFrame, matches: Column, on: list[str], spread: list[str], keys: list[str]):
    """A further join key that sends rows with a null key, which match nothing, to all tasks."""
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    place = F.when(missing, F.pmod(F.xxhash64(*map(quoted, spread)), F.lit(1 << 16))).otherwise(F.lit(-1))
    left = left.withColumn("_null", place.cast("bigint"))
    return left, matches & (F.col("_null") == F.col("_right_null")), [*keys, "_null", "_right_null"]


def lookup_join(
    left: DataFrame,
    right: DataFrame | Stored,
    on: list[str],
    weight: str,
    spread: list[str],
    how: str = "left",
    null_safe: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Attach ``right`` (one row per key) to the rows of ``left``.

    ``right[weight]`` is the number of left rows holding the key; the column is dropped.
    ``rows`` is a proven bound on the rows of a narrow right side; if that is small the
    side is broadcast as it is. Otherwise it is stored and measured. A small one is
    broadcast; else both sides are shuffled, and a key above the heavy limit is spread
    over several salts derived from the ``spread`` columns of the left side. At most
    ``heavy_keys`` keys can be heavy, so their list is broadcast.
    """
    keys = [f"_right_{c}" for c in on]
    names = {c: f"_right_{c}" for c in on}
    matches = _condition(on, null_safe)
    if rows is not None and rows <= LIMITS.broadcast_rows:
        lookup = right.df if isinstance(right, Stored) else right
        small = F.broadcast(lookup.drop(weight).withColumnsRenamed(names))
        return left.join(small, matches, how).drop(*keys)
    if not isinstance(right, Stored):
        right = store(right, weight)
    lookup = right.df.withColumnsRenamed(names)
    if right.small:
        return left.join(F.broadcast(lookup.drop(weight)), matches, how).drop(*keys)
    if not null_safe:
        left, matches, keys = _null_keys_spread(left, matches, on, spread, keys)
        lookup = lookup.withColumn("_right_null", F.lit(-1).cast("bigint"))
    share = max(LIMITS.heavy_rows, right.size["total"] // LIMITS.heavy_keys)
    if right.size["most"] <= share:
        return left.join(lookup.drop(weight), matches, how).drop(*keys)
    salts, none = F.ceil(F.col(weight) / F.lit(share)).cast("bigint"), F.lit(0).cast("bigint")
    right_keys = [f"_right_{c}" for c in on]
    heavy = lookup.where(F.col(weight) > share).select(*right_keys, salts.alias("_salts"))
    salt = F.pmod(F.xxhash64(*map(quoted, spread)), F.col("_salts"))
    salted = (
        left.join(F.broadcast(heavy), _condition(on, null_safe), "left")
        .drop(*right_keys)
        .withColumn("_salt", F.coalesce(salt, none))
        .drop("_salts")
    )
    copies = F.when(F.col(weight) > share, F.sequence(none, salts - 1)).otherwise(
        F.array(none)
    )
    copied = lookup.withColumn("_right_salt", F.explode(copies)).drop(weight)
    return salted.join(copied, matches & (F.col("_salt") == F.col("_right_salt")), how).drop(
        *keys, "_salt", "_right_salt"
    )
