"""Spelling variants by permuterm rotations: words one edit apart share a rotation but for one letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Stored, store
from .common import name, whole

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the end of a word; no letter of a run.
END = "$"
#: Rotations of longer words are compared by their SHA-256, so a row stays short.
PLAIN = 64
#: One run of a document in so many loses a letter.
DROP_ONE_IN = 199


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def drop_letters(key: Column, run: Column) -> Column:
    """The run, without one letter if the checksum of key and run says so."""
    check = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (check % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(check % DROP_ONE_IN == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, key: str, text: str, least_letters: int, least_count: int) -> Stored:
    """Words with their occurrences ``n`` and an ``id`` that rises in code-point order."""
    runs = F.explode(F.regexp_extract_all(lowered(whole(name(text))), F.lit(RUN), F.lit(0)))
    found = docs.select(name(key).alias("key"), runs.alias("run")).select(
        drop_letters(F.col("key"), F.col("run")).alias("word")
    )
    found = found.where(F.length("word") >= least_letters)
    counted = found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return store(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()))


def _rotations(words: DataFrame) -> DataFrame:
    """Every rotation of the marked words, cut where an edit can be.

    ``gap`` rows are rotations that end in an edited letter, which ``prefix`` skips; the others are
    whole rotations, for words that lack the letter. Of the equal letters of a run only the first is
    ``first``: taking any of them away gives the same word.
    """
    length = F.length("word")
    parts = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), length)).alias("at"))
    before, after = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 1, length)
    letter, last = F.substring(after, 1, 1), F.substring(before, -1, 1)
    skipped = F.concat(F.substring(after, F.lit(2), length), F.lit(END), before)
    either = F.array(
        F.struct(F.lit(False).alias("gap"), F.lit(False).alias("first"), F.concat(after, F.lit(END), before).alias("prefix")),
        F.struct(F.lit(True).alias("gap"), (letter != last).alias("first"), skipped.alias("prefix")),
    )
    rows = parts.select("id", "n", F.explode(F.when(letter == "", F.slice(either, 1, 1)).otherwise(either)).alias("r"))
    prefix = F.col("r.prefix")
    short = F.when(F.length(prefix) <= PLAIN, prefix).otherwise(F.concat(F.lit("#"), F.sha2(prefix, 256)))
    return rows.select("id", "n", "r.gap", "r.first", short.alias("prefix"))


def _neighbours(rotations: DataFrame) -> DataFrame:
    """Per word its near words' count, and the best of them: largest n, then smallest word.

    Rotations that share a prefix stand together once sorted. A group has a word per letter at most,
    and one that ends with the prefix; a word's neighbours in it are counted, not listed.
    """
    group = Window.partitionBy("prefix")
    scan = group.orderBy(F.desc("gap"), F.desc("n"), "id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    gap, first = F.col("gap"), F.col("first")
    one = F.struct((-F.col("n")).alias("less"), "id")
    rows = rotations.select(
        "id",
        "n",
        "gap",
        "first",
        one.alias("own"),
        F.count("*").over(group).alias("members"),
        F.sum(gap.cast("bigint")).over(group).alias("gaps"),
        F.sum(first.cast("bigint")).over(group).alias("firsts"),
        F.nth_value(F.when(gap, one), 1).over(scan).alias("best"),
        F.nth_value(F.when(gap, one), 2).over(scan).alias("second"),
        F.min(F.when(first, one)).over(group).alias("best_first"),
        F.min(F.when(~gap, one)).over(group).alias("shorter"),
    ).where(F.col("members") > 1)
    replaced = F.when(F.col("best") == F.col("own"), F.col("second")).otherwise(F.col("best"))
    removed = F.when(first, F.col("shorter"))
    near = F.when(gap, F.col("gaps") - 1 + removed.isNotNull().cast("bigint")).otherwise(F.col("firsts"))
    best = F.when(gap, F.least(replaced, removed)).otherwise(F.col("best_first"))
    return (
        rows.select("id", near.alias("near"), best.alias("best"))
        .where(F.col("near") > 0)
        .groupBy("id")
        .agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    )


def _roots(forms: Stored) -> DataFrame:
    """Per word with a form, the last word that its forms lead to.

    A form occurs several times as often as its word, so there are no circles, and each round
    doubles the steps taken.
    """
    links = forms.df.select("id", F.col("form_id").alias("to"))
    while True:
        ahead = links.select(F.col("id").alias("at"), F.col("to").alias("further"))
        held = ahead.join(links.groupBy(F.col("to").alias("at")).agg(F.count("*").alias("holders")), "at")
        stepped = lookup_join(links.withColumnRenamed("to", "at"), store(held, "holders"), ["at"], "holders", ["id"])
        moved = store(
            stepped.select("id", F.coalesce("further", "at").alias("to"), F.col("further").isNotNull().alias("moved")),
            steps=F.count(F.when(F.col("moved"), 1)),
        )
        links = moved.df.select("id", "to")
        if not moved.size["steps"]:
            return links


def variants(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least_letters: int = 6,
    least_count: int = 5,
    ratio: int = 5,
) -> DataFrame:
    """Words with their more frequent spelling: word, form, root, n, n_near, form_n.

    Words are maximal runs of ``RUN`` with A-Z lower-cased, of ``least_letters`` code points and
    ``least_count`` occurrences at least. Before they are counted, a run whose checksum with its
    document's key is divisible by ``DROP_ONE_IN`` loses a letter (a null key counts as empty).
    Near words differ by one inserted, deleted or replaced code point. The form is the near word
    of largest n (ties: smallest in code-point order) if that is ``ratio`` times the word's n, else
    null; the root is where the forms end, the word itself if it has none. Null and empty texts and
    empty tables give no words; repeated rows count again; other columns are not read.

    A word of L letters has 2L + 1 rows of rotations. Those of words one edit apart share a prefix,
    and a group of one prefix has at most a word per letter of the alphabet and one more.
    """
    words = word_counts(docs, key, text, least_letters, least_count)
    near = store(_neighbours(_rotations(words.df)))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.id"))
    joined = store(
        words.df.join(near.df, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form_id")
        )
    )
    forms = store(joined.df.where(F.col("form_id").isNotNull()).select("id", "form_id"))
    texts = words.df.select("id", "word", "n")

    def named(links: DataFrame, column: str, *out: Column) -> DataFrame:
        held = links.groupBy(column).agg(F.count("*").alias("holders"))
        known = texts.join(held, texts["id"] == held[column]).select(column, "holders", *out)
        return lookup_join(links, store(known, "holders"), [column], "holders", ["id"])

    of_form = named(forms.df, "form_id", F.col("word").alias("form"), F.col("n").alias("form_n"))
    of_root = named(_roots(forms), "to", F.col("word").alias("root")).select("id", "root")
    found = joined.df.drop("form_id").join(of_form.select("id", "form", "form_n"), "id", "left").join(of_root, "id", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
