"""The whole run: detect, pseudonymise, anonymise, code identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.anonymise import anonymise
from ..operators.labels import label_columns
from ..operators.pseudonymise import (
    encode_identifiers,
    labels_of,
    pseudonymise_labelled,
)
from ..plans.storage import materialise
from ..sources.tables import write_table
from ..spec import PrivacySpec, nan_to_null


def run(
    df: DataFrame,
    spec: PrivacySpec,
    dictionaries: dict[str, DataFrame] | None = None,
    model: str = "l",
    labels: DataFrame | None = None,
    output: str | None = None,
    keep_partition_id: bool = False,
    anonymise_options: dict | None = None,
    **options,
) -> tuple[DataFrame, DataFrame, PrivacySpec]:
    """Publish a table: returns the anonymised rows, the label table and the final spec.

    Every labelled column but the sensitive one becomes a feature. Special
    pseudonymisers run before anonymisation; identifier columns are integer-coded after
    it, so their code stands for the joined text of the partition. A feature is coded once per
    partition, before its rows get it; a partition's rows share its text, so the order by depth
    and path tells all first appearances. ``options`` go to
    ``pseudonymise_labelled``; ``labels`` are labels of earlier runs to keep. The rows are
    read twice, so a registered pseudonymiser must be repeatable; the built-in ones are.
    """
    df = nan_to_null(df)
    found = label_columns(df, dictionaries, labels, [c for c in df.columns if c != spec.order_by])
    found = materialise(found)
    rows = labels_of(found, [c for c in df.columns if c != spec.order_by])
    labelled = {r["name"] for r in rows}
    features = [c for c in df.columns if c in labelled and c != spec.sensitive]
    if not features:
        raise ValueError("no column was labelled, so there is nothing to generalise")
    df, spec = pseudonymise_labelled(df, rows, spec.with_features(features), **options)
    common = [r for r in rows if r["name"] in spec.features]

    def encoded(values: DataFrame) -> DataFrame:
        placed = values.withColumn("_depth", F.length("partition_id"))
        return encode_identifiers(placed, common, ["_depth", "partition_id"]).drop("_depth")

    result = anonymise(
        df, spec, model, keep_partition_id=True, common_values=encoded, **(anonymise_options or {})
    )
    placed = result.withColumn("_depth", F.length("partition_id"))
    own = [r for r in rows if r["name"] not in spec.features]
    coded = encode_identifiers(placed, own, ["_depth", "partition_id", spec.order_by])
    coded = coded.drop("_depth") if keep_partition_id else coded.drop("_depth", "partition_id")
    if output:
        write_table(coded, output)
    return coded, found, spec
