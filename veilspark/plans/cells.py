"""Rows reduced to distinct (feature tuple, sensitive value) cells.

Rows with equal features always share a partition, so partitioning needs only the cells:
their row count and the first position at which each occurs. One shuffle with map-side
combining builds them, and no later step handles a frequent tuple more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_text, quoted
from ..spec import PrivacySpec


def feature_names(spec: PrivacySpec) -> list[str]:
    return [f"_c{i}" for i in range(len(spec.features))]


def categorical_positions(spec: PrivacySpec) -> list[int]:
    return [i for i, c in enumerate(spec.features) if spec.is_categorical(c)]


def cell_values(df: DataFrame, spec: PrivacySpec) -> dict[str, Column]:
    """The features in the form cells hold them: text if categorical, else double."""
    values = {}
    for name, c in zip(feature_names(spec), spec.features):
        if spec.is_categorical(c):
            values[name] = as_text(quoted(c), df.schema[c].dataType)
        else:
            values[name] = quoted(c).cast("double") + F.lit(0.0)
    return values


def build_cells(df: DataFrame, spec: PrivacySpec) -> DataFrame:
    """Cells ``(_c0.., _s, _n, _o)``: features, sensitive text, rows, first position."""
    sensitive = as_text(quoted(spec.sensitive), df.schema[spec.sensitive].dataType)
    return (
        df.select(
            *[c.alias(n) for n, c in cell_values(df, spec).items()],
            sensitive.alias("_s"),
            quoted(spec.order_by).alias("_o"),
        )
        .groupBy(*feature_names(spec), "_s")
        .agg(F.count("*").alias("_n"), F.min("_o").alias("_o"))
    )
