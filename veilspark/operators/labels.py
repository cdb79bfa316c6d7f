"""Find the columns that hold personal data, in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import (
    AGE_COLUMN_NAMES,
    AGE_LIMIT,
    DETECTORS,
    Detector,
    containment_pattern,
)
from ..functions.text import fold, quoted, text_columns
from ..plans.skew import lookup_join
from ..plans.storage import LIMITS, store
from ..spec import nan_to_null
from .containment import digests_containing, text_digest


def _key(v: Column, detector: Detector) -> Column:
    return fold(v) if detector.fold else F.lower(v)


def _pattern(terms: DataFrame) -> str | None:
    """One regular expression for a dictionary of bounded size, else None."""
    found = terms.where("term <> ''").limit(LIMITS.pattern_terms + 1).collect()
    if len(found) > LIMITS.pattern_terms:
        return None
    return containment_pattern([r.term for r in found])


def _bounded_flag(
    df: DataFrame, key: str, detector: Detector, terms: DataFrame, out: str
) -> DataFrame | None:
    """Add a boolean column, the key is in (or contains a term of) a dictionary that is
    proven small; None if it is not."""
    if detector.contains:
        pattern = _pattern(terms)
        if pattern is None:
            return None
        return df.withColumn(out, F.coalesce(F.col(key).rlike(pattern), F.lit(False)))
    listed = store(terms.select(F.col("term").alias("_term")).where("_term is not null").distinct())
    if not listed.small:
        return None
    joined = df.join(F.broadcast(listed.df), F.col(key) == F.col("_term"), "left")
    return joined.withColumn(out, F.col("_term").isNotNull()).drop("_term")


def _hits(values: DataFrame, key: str, detector: Detector, terms: DataFrame) -> DataFrame:
    """Digests of the keys that a dictionary of any size matches."""
    if detector.contains:
        return digests_containing(values.select(key), key, terms)
    return terms.where("term is not null").select(text_digest(F.col("term")).alias("digest")).distinct()


def _unbounded_flag(
    df: DataFrame, key: str, detector: Detector, terms: DataFrame, out: str
) -> DataFrame:
    """As ``_bounded_flag`` for a dictionary of any size: the rows look up the outcome by digest,
    with frequent values spread over tasks."""
    keyed = df.withColumn("_digest", text_digest(F.col(key)))
    held = keyed.where(F.col(key).isNotNull()).groupBy("_digest").agg(F.count("*").alias("_held"))
    hits = _hits(df, key, detector, terms).select(F.col("digest").alias("_digest"), F.lit(True).alias("_hit"))
    spread = [c for c, kind in df.dtypes if not kind.startswith("map")]
    outcome = store(held.join(hits, "_digest"), "_held")
    if not outcome.small:  # with the others, as a frequent one is spread, too
        outcome = held.join(outcome.df.select("_digest", "_hit"), "_digest", "left")
    joined = lookup_join(keyed, outcome, ["_digest"], "_held", spread)
    return joined.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_hit", "_digest")


def _age_hits(name: Column, rows: Column, unparsed: Column, low: Column, high: Column) -> Column:
    fits = (unparsed == 0) & (low >= 0) & (high < AGE_LIMIT)
    return F.when(F.lower(name).isin(*AGE_COLUMN_NAMES) & fits, rows).otherwise(F.lit(0))


def _age_parts(name: Column, v: Column) -> list[Column]:
    """Parts of the age test; values of other columns are not parsed."""
    v = F.when(F.lower(name).isin(*AGE_COLUMN_NAMES), v)
    number = F.when(v.rlike(r"\A\s*[-+]?0*[0-9]{1,18}\s*\z"), v.try_cast("bigint"))
    return [
        F.count_if(v.isNotNull() & number.isNull()).alias("_unparsed"),
        F.min(number).alias("_low"),
        F.max(number).alias("_high"),
    ]


def with_flag(
    df: DataFrame, col: str, label: str, dictionary: DataFrame | None = None, out: str = "flag"
) -> DataFrame:
    """Add a boolean column saying which values of ``col`` a detector recognises.

    Nulls are not recognised. Dictionary detectors take a ``(term)`` table.
    """
    detector, df = DETECTORS[label], nan_to_null(df)
    value = text_columns(df, [col])[0]
    if detector.test:
        return df.withColumn(out, F.coalesce(detector.test(value), F.lit(False)))
    if detector.dictionary:
        if dictionary is None:
            raise ValueError(f"detector {label!r} needs a dictionary")
        keyed = df.withColumn("_key", _key(value, detector))
        flagged = _bounded_flag(keyed, "_key", detector, dictionary, out)
        if flagged is None:
            flagged = _unbounded_flag(keyed, "_key", detector, dictionary, out)
        return flagged.drop("_key")
    parts = df.select(value.alias("_v")).agg(F.count("_v").alias("_rows"), *_age_parts(F.lit(col), F.col("_v")))
    hits = _age_hits(F.lit(col), F.col("_rows"), F.col("_unparsed"), F.col("_low"), F.col("_high"))
    is_age = parts.select((hits > 0).alias("is_age")).scalar()
    return df.withColumn(out, quoted(col).isNotNull() & F.coalesce(is_age, F.lit(False)))


def label_columns(
    df: DataFrame,
    dictionaries: dict[str, DataFrame] | None = None,
    existing: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Label table ``(name, ratio, type, identifier)`` of the columns of ``df``.

    Every column is turned into ``(name, value)`` pairs, and the pairs are counted per name
    and set of detectors that hit. There are few such sets, so the map-side aggregation
    leaves next to nothing to shuffle. A dictionary that is not proven small is matched
    against counted distinct values instead.
    Dictionary detectors run for the dictionaries given (``names``, ``diseases``,
    ``diseases_hu``, ``countries``). Labels of ``existing`` are kept unless the same
    column and type was found again.
    """
    dictionaries = dictionaries or {}
    columns, df = columns or df.columns, nan_to_null(df)
    entries = [
        F.struct(F.lit(c).alias("name"), text.alias("value"))
        for c, text in zip(columns, text_columns(df, columns))
    ]
    pairs = df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    active = [
        d for d in DETECTORS.values() if not d.dictionary or d.dictionary in dictionaries
    ]
    bits, counted_apart = F.lit(0).cast("bigint"), {}
    for i, detector in enumerate(active):
        if detector.test:
            flag = detector.test(F.col("value"))
        elif detector.dictionary:
            key = "_folded" if detector.fold else "_lower"
            if key not in pairs.columns:
                pairs = pairs.withColumn(key, _key(F.col("value"), detector))
            terms = dictionaries[detector.dictionary]
            flagged = _bounded_flag(pairs, key, detector, terms, f"_flag{i}")
            if flagged is None:
                held = pairs.groupBy("name", text_digest(F.col(key)).alias("digest")).agg(
                    F.count("*").alias("_held")
                )
                found = held.join(_hits(pairs, key, detector, terms), "digest", "left_semi").groupBy("name")
                counted_apart[i] = found.agg(F.sum("_held").alias("_hits"))
                continue
            pairs, flag = flagged, F.col(f"_flag{i}")
        else:
            continue
        bits = bits + F.when(flag, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    patterns = (
        pairs.select("name", "value", bits.alias("_bits"))
        .groupBy("name", "_bits")
        .agg(F.count("*").alias("_rows"), *_age_parts(F.col("name"), F.col("value")))
    )
    hits = [
        F.sum(F.when(F.col("_bits").bitwiseAND(1 << i) != 0, F.col("_rows")).otherwise(0)).alias(f"_hits{i}")
        for i in range(len(active))
        if i not in counted_apart
    ]
    profile = patterns.groupBy("name").agg(
        F.sum("_rows").alias("_rows"),
        F.sum("_unparsed").alias("_unparsed"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        *hits,
    )
    for i, found in counted_apart.items():
        found = found.withColumnRenamed("_hits", f"_hits{i}")
        profile = profile.join(found, "name", "left").na.fill(0, [f"_hits{i}"])
    outcomes = []
    for i, detector in enumerate(active):
        hit = F.col(f"_hits{i}")
        if not detector.test and not detector.dictionary:
            hit = _age_hits(F.col("name"), *map(F.col, ("_rows", "_unparsed", "_low", "_high")))
        outcomes.append(
            F.struct(
                (hit / F.col("_rows")).alias("ratio"),
                F.lit(detector.label).alias("type"),
                F.lit(detector.identifier).cast("boolean").alias("identifier"),
            )
        )
    found = (
        profile.select("name", F.explode(F.array(*outcomes)).alias("o"))
        .select("name", "o.ratio", "o.type", "o.identifier")
        .where("ratio > 0")
    )
    if existing is None:
        return found
    latest = existing.withColumn("_place", F.monotonically_increasing_id()).groupBy("name", "type")
    rows = F.struct("_place", *[quoted(c) for c in existing.columns])
    latest = latest.agg(F.max(rows).alias("_row")).select(*[f"_row.`{c}`" for c in existing.columns])
    kept = latest.join(found, ["name", "type"], "left_anti").select(*existing.columns)
    return found.unionByName(kept)
