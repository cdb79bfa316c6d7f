"""What the operators share: the white space of the word rule, and rows carried beside work columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that separate words.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def name(column: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """The text as a string, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, SPACE, "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that no work column clashes with theirs."""
    return F.struct(*[name(c).alias(c) for c in df.columns])


def rows_from(df: DataFrame, row: str = "row") -> DataFrame:
    """The columns that ``row_of`` packed."""
    return df.select(F.col(row + ".*"))
