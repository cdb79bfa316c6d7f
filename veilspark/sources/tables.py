"""Reading and writing tables, label tables and scraped records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..spec import nan_to_null

LABEL_SCHEMA = "name string, ratio double, type string, identifier boolean"


def read_table(
    spark: SparkSession,
    path,
    schema: T.StructType | str | None = None,
    names: list[str] | None = None,
    format: str = "csv",
    header: bool = False,
) -> DataFrame:
    """Read a table; a header-less CSV takes its schema, or at least its names, from the
    caller. A given schema avoids the extra pass that inference needs."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", header)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.format(format).load(path)
    return nan_to_null(df.toDF(*names) if names else df)


def spread(df: DataFrame) -> DataFrame:
    """Distribute a table that was just read in fewer splits than there are cores.

    Only a small input has so few splits, so its rows are cheap to shuffle; any other
    table is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, format: str = "csv", mode: str = "error") -> None:
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read_labels(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    reader = spark.read.schema(LABEL_SCHEMA)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.format(format).load(path)


def write_labels(labels: DataFrame, path: str, format: str = "csv", mode: str = "error") -> None:
    """Write to a path other than the one the labels were read from."""
    write_table(labels, path, format, mode)


def read_records(spark: SparkSession, path: str, array_col: str = "terms") -> DataFrame:
    """Scraped records: one array of strings each, a JSON array or one object per line."""
    schema = T.StructType([T.StructField(array_col, T.ArrayType(T.StringType()))])
    return spark.read.schema(schema).option("multiLine", True).json(path)
