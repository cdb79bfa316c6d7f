"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..plans.ranking import group_medians
from ..spec import PrivacySpec, nan_to_null

# Fixed value: the text that replaces a missing categorical value.
MISSING = "MISSING DATA"


#: Above this, a double does not hold every whole number.
EXACT = 1 << 53
WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")


def fill_missing(df: DataFrame, spec: PrivacySpec, approximate: bool = False) -> DataFrame:
    """Fill nulls: categorical columns with a fixed text, numeric ones with their median.

    The exact median is interpolated between the middle values; ``approximate`` takes an
    actual value near the middle from one mergeable sketch pass. Columns without a null stay as
    they are. Integers stay integers if the median is whole, or if they are too large for a
    double, where its fraction is dropped; others become double.
    """
    df = nan_to_null(df)
    kinds = dict(df.dtypes)
    numeric = [
        c
        for c, kind in kinds.items()
        if c not in spec.categorical
        and c != spec.order_by
        and (kind in (*WHOLE_TYPES, "float", "double") or "decimal" in kind)
    ]
    seen = [F.count_if(quoted(c).isNull()).alias(f"_n{i}") for i, c in enumerate(numeric)]
    seen += [F.max(F.abs(quoted(c).cast("double"))).alias(f"_m{i}") for i, c in enumerate(numeric)]
    row = df.agg(*seen).first() if numeric else None
    holes = {c: row[f"_m{i}"] for i, c in enumerate(numeric) if row[f"_n{i}"] and row[f"_m{i}"] is not None}
    medians: dict[str, float] = {}
    if approximate and holes:
        found = df.agg(*[F.percentile_approx(quoted(c), 0.5).alias(f"_{i}") for i, c in enumerate(holes)]).first()
        medians = dict(zip(holes, found))
    elif holes:
        pairs = [F.struct(F.lit(c).alias("name"), quoted(c).cast("double").alias("value")) for c in holes]
        values = df.select(F.inline(F.array(*pairs)))
        medians = {r["name"]: r["median"] for r in group_medians(values, ["name"], "value").collect()}
    filled = {}
    for c, middle in medians.items():
        if kinds[c] in WHOLE_TYPES and (float(middle).is_integer() or holes[c] > EXACT):
            filled[c] = F.coalesce(quoted(c), F.lit(int(middle)).cast(kinds[c]))
        else:
            filled[c] = F.coalesce(quoted(c).cast("double"), F.lit(float(middle)))
    for c in df.columns:
        if c in spec.categorical:
            filled[c] = F.coalesce(quoted(c).cast("string"), F.lit(MISSING))
    return df.withColumns(filled)
