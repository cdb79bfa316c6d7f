"""Term dictionaries built from tables the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold as fold_text
from ..functions.text import quoted, strip

PARENTHESES = r" \(.*?\)"


def read_lines(spark: SparkSession, path, encoding: str = "ISO-8859-1") -> DataFrame:
    """One value per line in the given encoding, first line included."""
    return (
        spark.read.schema("term string")
        .option("encoding", encoding)
        .option("sep", "\u0001")
        .option("quote", "")
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def term_dictionary(df: DataFrame, column: str | None = None, fold: bool = False) -> DataFrame:
    """Distinct lower-cased (and accent-free) terms of one column as ``term``."""
    c = quoted(column or df.columns[0])
    term = fold_text(c) if fold else F.lower(c)
    return df.select(term.alias("term")).where(F.col("term") != "").distinct()


def name_dictionary(*lists: DataFrame) -> DataFrame:
    """First names of all lists, lower-cased and accent-free."""
    names = lists[0].select(quoted(lists[0].columns[0]).alias("name"))
    for other in lists[1:]:
        names = names.unionByName(other.select(quoted(other.columns[0]).alias("name")))
    return term_dictionary(names, "name", fold=True)


def country_key(c: Column) -> Column:
    """The form in which country names and codes are compared."""
    return F.lower(F.regexp_replace(c, PARENTHESES, ""))


def country_dictionary(
    df: DataFrame, name: str = "name", alpha2: str = "alpha-2", alpha3: str = "alpha-3"
) -> DataFrame:
    """Country names without parenthesised parts, and both codes, as one ``term`` column."""
    keys = F.array(
        country_key(quoted(name)), F.lower(quoted(alpha2)), F.lower(quoted(alpha3))
    )
    return df.select(F.explode(keys).alias("term")).where("term is not null").distinct()


def region_dictionary(
    df: DataFrame,
    name: str = "name",
    alpha2: str = "alpha-2",
    alpha3: str = "alpha-3",
    region: str = "region",
) -> DataFrame:
    """One row per country name or code with its region, as ``(term, value)``."""
    keys = F.array(*[country_key(quoted(c)) for c in (name, alpha2, alpha3)])
    return (
        df.select(F.explode(keys).alias("term"), quoted(region).alias("value"))
        .where("term is not null")
        .groupBy("term")
        .agg(F.min("value").alias("value"))
    )


def build_dictionary(df: DataFrame, array_col: str) -> DataFrame:
    """Sorted distinct terms of an array column: lower-cased, stripped, accent-free."""
    terms = df.select(F.explode(quoted(array_col)).alias("term"))
    clean = terms.select(fold_text(strip(F.lower("term"))).alias("term"))
    return clean.where("term <> ''").distinct().orderBy("term")
