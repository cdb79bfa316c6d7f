"""Text helpers as native Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters that have no one-letter canonical decomposition.
SINGLE_LETTERS = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "ħ": "h"}
LETTER_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}


def _latin_fold_tables() -> tuple[str, str]:
    """One-to-one accent map of the Latin blocks; combining marks map to nothing."""
    source, target = [], []
    for code in range(0xC0, min(0x1F00, sys.maxunicode)):
        letter = chr(code)
        if letter in SINGLE_LETTERS:
            source.append(letter)
            target.append(SINGLE_LETTERS[letter])
            continue
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)
        )
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            source.append(letter)
            target.append(plain)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    return "".join(source + marks), "".join(target)


_FOLD_FROM, _FOLD_TO = _latin_fold_tables()


def fold(c: Column) -> Column:
    """Lower-case and strip accents from Latin text; other scripts pass unchanged."""
    folded = F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)
    for letter, pair in LETTER_PAIRS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    return folded


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(c: Column, kind: T.DataType) -> Column:
    """Cast to string; whole-number doubles are written without exponent or fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e38)
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def text_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    return [as_text(quoted(c), df.schema[c].dataType).alias(c) for c in columns]
