"""Replace identifying values by intervals, regions, tokens or codes."""

from __future__ import annotations

import secrets
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS
from ..functions.text import quoted
from ..plans.ranking import global_index
from ..plans.skew import lookup_join
from ..plans.storage import Stored, fits_broadcast, store
from ..sources.dictionaries import country_key
from ..spec import PrivacySpec, nan_to_null

# How an address is split, the parts of an unusable one, token lengths.
EMAIL_PARTS = r"(?d)(.+)@(.+)\.(.+)"
INVALID_PARTS = {"local": "nan", "domain": "na", "tld": "n"}
TOKEN_LENGTHS = {"local": 10, "domain": 5, "tld": 4}
TOKEN_ALPHABET = string.ascii_letters + string.digits
LONGEST_TOKEN = 16
KEYED_DIGITS = 32
FEISTEL_ROUNDS = 10
KEY_SETTING = "spark.veilspark.secret.key"


def email_parts(c: Column) -> dict[str, Column]:
    """Lower-cased local part, domain and top-level domain; null where it is no address."""
    usable = F.lower(c)
    return {
        part: F.when(usable.rlike(EMAIL_PARTS), F.regexp_extract(usable, EMAIL_PARTS, i))
        for i, part in enumerate(INVALID_PARTS, start=1)
    }


def _digest(part: Column, kind: str, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}:{kind}:"), part), 256)


def _token_length(kind: str, chosen: dict[str, int] | None) -> int:
    """The caller's length of a kind's tokens, or the reference length; the data does not change it."""
    length = {**TOKEN_LENGTHS, **(chosen or {})}[kind]
    if not 1 <= length <= LONGEST_TOKEN:
        raise ValueError(f"a token has 1 to {LONGEST_TOKEN} letters")
    return length


def _halves(length: int) -> tuple[int, int]:
    """Letters of the two halves of a token."""
    return length // 2, length - length // 2


def _numerals(number: Column, width: int) -> list[Column]:
    """The number's letters, ``width`` of them."""
    size = len(TOKEN_ALPHABET)
    return [
        F.substring(F.lit(TOKEN_ALPHABET), (F.floor(number / size**i) % size + 1).cast("int"), F.lit(1))
        for i in reversed(range(width))
    ]


def permuted_token(index: Column, secret: str, length: int) -> Column:
    """The token of a number below 62 ** length: different numbers have different tokens.

    A Feistel network under the secret whose halves are numbers of half a token's letters. Each
    round adds to one half a digest of the other, so it can be undone, and no number leaves the range.
    """
    low, high = _halves(length)
    size = len(TOKEN_ALPHABET)
    a, b = F.lit(size**low), F.lit(size**high)

    def mixed(half: Column, i: Column, most: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(secret), i, half), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % most

    def rounds(state: Column, i: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.struct(
            F.when(i % 2 == 0, (left + mixed(right, i, a)) % a).otherwise(left).alias("left"),
            F.when(i % 2 == 0, right).otherwise((right + mixed(left, i, b)) % b).alias("right"),
        )

    number = index.cast("bigint")
    start = F.struct(F.call_function("div", number, b.cast("bigint")).alias("left"), (number % b).alias("right"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(FEISTEL_ROUNDS - 1)),
        start.cast("struct<left:bigint,right:bigint>"),
        lambda state, i: rounds(state, i).cast("struct<left:bigint,right:bigint>"),
        lambda state: F.concat(*_numerals(state["left"], low), *_numerals(state["right"], high)),
    )


def _tokens(parts: Stored, secret: str, lengths: dict[str, int]) -> Stored:
    """Kind, digest, token and held of the distinct parts: their places in the order of the digests,
    permuted."""
    placed = global_index(parts, ["kind", "digest"], "_place")
    token, before = F.lit(None).cast("string"), 0
    for kind in sorted(lengths):
        own = permuted_token(F.col("_place") - before, f"{secret}:{kind}", lengths[kind])
        token = F.when(F.col("kind") == kind, own).otherwise(token)
        before += parts.size[kind]
    return store(placed.select("kind", "digest", token.alias("token"), "held"), "held")


def pseudonymise_email(
    df: DataFrame,
    col: str,
    mode: str = "keyed",
    key: str | None = None,
    on_invalid: str = "token",
    lengths: dict[str, int] | None = None,
) -> DataFrame:
    """Replace addresses by ``token@token.token``; equal parts get equal tokens.

    ``keyed``: digest prefixes under a caller's key (or the session setting
    ``spark.veilspark.secret.key``), equal between tables and runs, no shuffle.
    ``random``: short alphanumeric tokens under a one-off key that is not kept. The distinct parts are
    numbered by one sort of their digests, and a keyed permutation turns the number into the token,
    so tokens never meet and a recomputed task gives the same again. Rows look the tokens up by
    digest; no part is moved or stored. ``lengths`` sets the letters of ``local``, ``domain`` and
    ``tld`` (10, 5 and 4) at any size; a length that cannot hold a kind's parts is an error.
    Unusable or null addresses share one token, or become null with ``on_invalid='null'``.
    """
    if mode not in ("keyed", "random") or on_invalid not in ("token", "null"):
        raise ValueError("mode is 'keyed' or 'random', on_invalid is 'token' or 'null'")
    if not set(lengths or ()) <= set(INVALID_PARTS):
        raise ValueError(f"lengths are those of {', '.join(INVALID_PARTS)}")
    parts = email_parts(quoted(col).cast("string"))
    if on_invalid == "token":
        parts = {k: F.coalesce(c, F.lit(INVALID_PARTS[k])) for k, c in parts.items()}
    if mode == "keyed":
        key = key or df.sparkSession.conf.get(KEY_SETTING, None)
        if not key:
            raise ValueError(f"keyed mode needs a key, or the setting {KEY_SETTING}")
        local, domain, tld = (
            F.substring(_digest(c, k, key), 1, KEYED_DIGITS) for k, c in parts.items()
        )
        return df.withColumn(col, F.concat(local, F.lit("@"), domain, F.lit("."), tld))
    key = secrets.token_hex(32)
    lengths = {kind: _token_length(kind, lengths) for kind in parts}
    digests = {k: F.unhex(_digest(c, k, key)) for k, c in parts.items()}
    pairs = [F.struct(F.lit(k).alias("kind"), d.alias("digest")) for k, d in digests.items()]
    distinct = store(
        df.select(F.inline(F.array(*pairs)))
        .where("digest is not null")
        .groupBy("kind", "digest")
        .agg(F.count("*").alias("held")),
        **{k: F.count_if(F.col("kind") == k) for k in parts},
    )
    for kind, length in lengths.items():
        if distinct.size[kind] > len(TOKEN_ALPHABET) ** length:
            raise ValueError(f"{length} letters cannot hold {distinct.size[kind]} {kind} parts")
    known = _tokens(distinct, key, lengths)
    spread = [c for c, kind in df.dtypes if not kind.startswith("map")]
    split = df.withColumns({f"_digest_{k}": d for k, d in digests.items()})
    for kind in parts:
        own = known.df.where(F.col("kind") == kind).select(
            F.col("digest").alias(f"_digest_{kind}"), F.col("token").alias(f"_token_{kind}"), "held"
        )
        # Digests and tokens have fixed sizes, so the rows bound the bytes.
        split = lookup_join(split, own, [f"_digest_{kind}"], "held", spread, rows=distinct.size[kind])
    local, domain, tld = (F.col(f"_token_{k}") for k in parts)
    helpers = [f"{prefix}{k}" for k in parts for prefix in ("_digest_", "_token_")]
    return split.withColumn(col, F.concat(local, F.lit("@"), domain, F.lit("."), tld)).drop(*helpers)


def _value_digest(df: DataFrame, col: str, salt: str) -> Column:
    """Stands for a value under a one-off salt, so that no value is moved or stored; null for null."""
    kind, c = dict(df.dtypes)[col], quoted(col)
    if kind == "timestamp":
        c = F.unix_micros(c)
    elif kind in ("double", "float"):
        c = c + F.lit(0.0)
    elif kind == "binary":
        c = F.hex(c)
    return F.unhex(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256))


def _place(df: DataFrame, order: list[str]) -> Column:
    """What orders the rows: one long where the columns are whole numbers whose measured ranges fit it,
    so that a hash aggregate can keep the least; else a struct. Null comes first in both."""
    kinds = dict(df.dtypes)
    if any(kinds.get(c) not in ("bigint", "int", "smallint", "tinyint") for c in order):
        return F.struct(*[quoted(c) for c in order])
    if len(order) == 1 and kinds[order[0]] != "bigint":
        return F.coalesce(quoted(order[0]).cast("bigint"), F.lit(-(1 << 63)))
    ends = [f(quoted(c)).cast("bigint") for c in order for f in (F.min, F.max)]
    found = [x or 0 for x in df.agg(*ends).first()]
    place, room = None, 1
    for c, low, high in zip(order, found[::2], found[1::2]):
        width = high - low + 2
        room *= width
        own = F.coalesce(quoted(c).cast("bigint") - F.lit(low) + 1, F.lit(0).cast("bigint"))
        place = own if place is None else place * F.lit(width) + own
        if room >= 1 << 63:
            return F.struct(*[quoted(c) for c in order])
    return place


def encode_text(df: DataFrame, col: str, order_by: str | list[str]) -> DataFrame:
    """Replace values by integers from 0 in order of first appearance; null becomes -1.

    Values are reduced to their first position map-side, indexed by one distributed
    sort, and looked up again with frequent values spread over tasks.
    """
    order, df = [order_by] if isinstance(order_by, str) else list(order_by), nan_to_null(df)
    keyed = df.withColumn("_digest", _value_digest(df, col, secrets.token_hex(16)))
    first = store(
        keyed.where(F.col("_digest").isNotNull())
        .groupBy("_digest")
        .agg(F.min(_place(df, order)).alias("_first"), F.count("*").alias("_held"))
    )
    codes = global_index(first, ["_first", "_digest"], "_code").drop("_first")
    known = first.rows if first.small else None
    joined = lookup_join(keyed, codes, ["_digest"], "_held", order, rows=known)
    code = F.coalesce(F.col("_code"), F.lit(-1).cast("bigint"))
    return joined.withColumn(col, code).drop("_digest", "_code")


def interval_label(c: Column, width: int = 10) -> Column:
    """Text of the left-closed interval of the given width, from 0; negatives give null."""
    low = F.floor(c / width) * width
    return F.when(c >= 0, F.concat(low.cast("string"), F.lit(" - "), (low + (width - 1)).cast("string")))


def to_interval(
    df: DataFrame,
    col: str,
    spec: PrivacySpec,
    width: int = 10,
    keep_reference_features: bool = False,
) -> tuple[DataFrame, PrivacySpec]:
    """Turn numbers into interval texts and the column into a categorical one.

    By default the interval stays a feature, so the privacy model covers it;
    ``keep_reference_features`` takes it out of the features.
    """
    spec, df = spec.with_categorical(col), nan_to_null(df)
    if keep_reference_features:
        spec = spec.with_features(c for c in spec.features if c != col)
    number = quoted(col).try_cast("double") if dict(df.dtypes)[col] == "string" else quoted(col)
    return df.withColumn(col, interval_label(number, width)), spec


def generalise(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace country names and codes by their value in ``mapping(term, value)``.

    Keys compare as the country dictionary does; unknown values and null become null.
    """
    keyed = df.withColumn("_key", country_key(quoted(col).cast("string")))
    if fits_broadcast(mapping):
        listed = F.broadcast(mapping.select(F.col("term").alias("_key"), F.col("value").alias("_mapped")))
        joined = keyed.join(listed, "_key", "left")
    else:
        held = keyed.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_held"))
        listed = mapping.select(F.col("term").alias("_key"), F.col("value").alias("_mapped"))
        spread = [c for c, kind in df.dtypes if not kind.startswith("map")]
        joined = lookup_join(keyed, held.join(listed, "_key", "left"), ["_key"], "_held", spread)
    return joined.withColumn(col, F.col("_mapped")).drop("_key", "_mapped").select(*map(quoted, df.columns))


def _country_to_region(df, col, spec, options):
    return generalise(df, col, options["regions"]), spec.with_categorical(col)


def _age_to_interval(df, col, spec, options):
    keep = options.get("keep_reference_features", False)
    return to_interval(df, col, spec, options.get("width", 10), keep)


def _email_to_tokens(df, col, spec, options):
    mode, key = options.get("email_mode", "keyed"), options.get("key")
    lengths = options.get("email_lengths")
    return pseudonymise_email(df, col, mode, key, lengths=lengths), spec.with_categorical(col)


PSEUDONYMISERS: dict[str, Callable] = {
    "country or region": _country_to_region,
    "human age": _age_to_interval,
    "email address": _email_to_tokens,
}


def register_pseudonymiser(label: str, apply: Callable) -> None:
    """Add ``apply(df, col, spec, options) -> (df, spec)`` for columns with a label."""
    PSEUDONYMISERS[label] = apply


def labels_of(labels: DataFrame, columns: list[str]) -> list:
    """Label rows of the given columns, one per column and type, in a stable order.

    A label table holds at most one row per column and detector, so it is collected.
    """
    order = {t: i for i, t in enumerate(DETECTORS)}
    rows = labels.where(F.col("name").isin(*columns)).dropDuplicates(["name", "type"]).collect()
    return sorted(rows, key=lambda r: (columns.index(r["name"]), order.get(r["type"], len(order))))


def pseudonymise_labelled(
    df: DataFrame, labels, spec: PrivacySpec, **options
) -> tuple[DataFrame, PrivacySpec]:
    """Apply the special pseudonymiser of every label, once per column and label.

    Options: ``regions`` (mapping table), ``email_mode``, ``email_lengths``, ``key``, ``width``,
    ``keep_reference_features``.
    """
    rows = labels_of(labels, df.columns) if isinstance(labels, DataFrame) else labels
    for row in rows:
        apply = PSEUDONYMISERS.get(row["type"])
        if apply:
            df, spec = apply(df, row["name"], spec, options)
    return df, spec


def encode_identifiers(df: DataFrame, labels, order_by: str | list[str]) -> DataFrame:
    """Integer-code the columns labelled as identifiers without special pseudonymiser."""
    rows = labels_of(labels, df.columns) if isinstance(labels, DataFrame) else labels
    chosen = dict.fromkeys(
        r["name"] for r in rows if r["identifier"] and r["type"] not in PSEUDONYMISERS
    )
    for name in chosen:
        df = encode_text(df, name, order_by)
    return df
