"""Quality rules: one table of thresholds, compiled into one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, name, squeezed, whole, words

SYMBOLS = "#*$%&|<>"

# Frequent words of the languages served.
STOP_WORDS = (
    "the be to of and that have with is in it for on was a an are by this at "
    "der die das und ist in zu den von mit im sich auf ein eine "
    "le la les de et un une est que en du des qui pour dans au "
    "el los las y que es en un una por con para se del"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if the measure is below ``least`` or above ``most``, where given."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The base every document is held against, and the method's own rules.
BASE = (Rule("n_words", least=50), Rule("repeat_percent", most=50))
RULES = (
    Rule("mean_word_length", least=2, most=20),
    Rule("symbol_ratio", most=0.25),
    Rule("stop_words", least=2),
    Rule("dup_line_ratio", most=0.5),
    Rule("letter_word_ratio", least=0.6),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.5),
)


def _repeat_places(words: Column) -> Column:
    """Ordered starts of the three-word windows that occur twice or more.

    Windows are sorted by two hashes of their words, so equal ones are neighbours; a window is
    marked if it equals the one before or after it.
    """
    windows = F.filter(
        F.transform(
            F.arrays_zip(
                words.alias("a"),
                F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"),
                F.slice(words, 3, F.greatest(F.size(words), F.lit(1))).alias("c"),
            ),
            lambda w, i: F.struct(
                F.when(w["c"].isNotNull(), F.xxhash64(w["a"], w["b"], w["c"])).alias("h"),
                F.hash(w["c"], w["b"], w["a"]).alias("g"),
                i.alias("at"),
            ),
        ),
        lambda w: w["h"].isNotNull(),
    )
    return F.sort_array(windows)


def _marked(ordered: Column) -> Column:
    size = F.greatest(F.size(ordered), F.lit(1))
    before = F.concat(F.array(F.lit(None)), F.slice(ordered, 1, size - 1))
    after = F.slice(ordered, 2, size)
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
    near = F.filter(
        F.arrays_zip(ordered.alias("own"), before.alias("before"), after.alias("after")),
        lambda z: same(z["own"], z["before"]) | same(z["own"], z["after"]),
    )
    return F.sort_array(F.transform(near, lambda z: z["own"]["at"]))


def _covered(places: Column) -> Column:
    """Words in the union of the three-word windows that start at the ordered places."""
    size = F.greatest(F.size(places), F.lit(1))
    steps = F.zip_with(
        F.slice(places, 1, size - 1),
        F.slice(places, 2, size),
        lambda a, b: F.least(F.lit(3), b - a),
    )
    inner = F.aggregate(steps, F.lit(0), lambda total, step: total + F.coalesce(step, F.lit(0)))
    return F.when(F.size(places) > 0, inner + 3).otherwise(F.lit(0)).cast("bigint")


def _ratio(part: Column, of: Column) -> Column:
    return F.when(of > 0, part / of).otherwise(F.lit(0.0))


def _share(items: Column, test: Callable[[Column], Column]) -> Column:
    return _ratio(F.size(F.filter(items, test)).cast("double"), F.size(items))


#: Each measure, from the columns that ``measured`` has prepared.
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.col("n_words"),
    "repeat_percent": lambda: _ratio(100 * F.col("n_repeat_words"), F.col("n_words")),
    "mean_word_length": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
    "symbol_ratio": lambda: _ratio(F.col("n_symbols"), F.col("word_chars")),
    "stop_words": lambda: F.size(
        F.filter("words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))
    ),
    "dup_line_ratio": lambda: _ratio(F.col("n_dup_lines"), F.size("lines")),
    "letter_word_ratio": lambda: _share(F.col("words"), lambda w: w.rlike(r"\p{L}")),
    "bullet_line_ratio": lambda: _share(F.col("lines"), lambda x: x.rlike(r"^\s*[-*•‣–]\s")),
    "ellipsis_line_ratio": lambda: _share(F.col("lines"), lambda x: x.rlike(r"(\.\.\.|…)\s*$")),
}


def _fails(rule: Rule) -> Column:
    value, failed = MEASURES[rule.measure](), F.lit(False)
    if rule.least is not None:
        failed = failed | (value < rule.least)
    if rule.most is not None:
        failed = failed | (value > rule.most)
    return failed


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words, lines."""
    split = docs.select(name(key).alias("key"), whole(name(text)).alias("body")).select(
        "key",
        "body",
        words(F.col("body")).alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
    )
    counted = split.select(
        "key",
        "words",
        "lines",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(squeezed(F.col("body"))).cast("bigint").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_places(F.col("words")).alias("ordered"),
    )
    placed = counted.select("*", _marked(F.col("ordered")).alias("places")).drop("ordered")
    return placed.select("*", _covered(F.col("places")).alias("n_repeat_words")).drop("places")


def judge(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per input row: the counts, base_failed, failed (names of the rules), kept.

    Null and empty texts have no words and fail the base. Everything is a built-in function of
    the row's own text, so no row meets another: no shuffle, and equal rows get equal answers.
    Windows are compared by 96 bits of hashes. Other columns are not read; an empty table gives
    no rows.
    """
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | _fails(rule)
    failed = F.filter(
        F.array(*[F.when(_fails(r), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull()
    )
    return measured(docs, text, key).select(
        "key",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        failed.alias("failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
