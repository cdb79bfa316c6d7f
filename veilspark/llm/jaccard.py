"""Near duplicates by Jaccard similarity of word shingles, filtered under several token orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import LIMITS, Scratch, Stored, few_parts, store
from .common import name, row_of
from .graph import components
from .wordhash import mix, small, windows, word_hashes

WORDS = 5
PERCENT = 80
#: Shingles whose frequency is known; the table is a column of numbers of at most this length.
FREQUENT = 1 << 21
#: Bits of the filter that tells which shingles stand in several texts.
SHARED_BITS = 26
MIXED = np.uint64(0xD1342543DE82EF95)
#: Sets that are compared with one pivot in one place; more are dealt to several.
NEAR_PIVOT = 128
#: Pivots of a token by round. After these rounds, or once the pairs left are few, all are tried.
PIVOTS = (1, 4, 16)
FEW_PAIRS = 4
#: Longs of a signature, and of the part of it that goes with the tokens.
SIGN, BRIEF = 16, 4
#: Whole sets that a task compares, at least.
SETS_EACH = 1 << 10
#: Longer sets overfill a signature, so they keep prefixes under two further orders.
LONG = 1 << 10


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ascending per text, and the bounds of each text's part."""
    hashes, first = word_hashes(texts, lower=True)
    whole = windows(hashes, words)
    parts, bounds = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            found = np.unique(whole[a : b - words + 1])
        elif b > a:
            found = windows(np.append(hashes[a:b], np.uint64(b - a)), b - a + 1)
        else:
            found = hashes[:0]
        parts.append(found)
        bounds.append(bounds[-1] + len(found))
    return (np.concatenate(parts) if parts else hashes[:0]), np.array(bounds)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """So many first tokens, in any common order, that two linked sets share one of them."""
    return size - -(-percent * size // 100) + 1


def _order(tokens: np.ndarray, number: int) -> np.ndarray:
    """Further orders, none like another: by a hash of the token."""
    return np.argsort(mix(tokens ^ np.uint64(0xA0761D6478BD642F * number % (1 << 64))))


def _common(words: int):
    """Per batch, in how many of its texts each shingle is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 0):
            tokens = shingle_sets(batch.column(0), words)[0]
            tokens, count = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(count)], names=["token", "n"]
            )

    return run


def _places(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens) >> np.uint64(64 - SHARED_BITS)


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = np.unique(_places(batch.column(0).to_numpy().view(np.uint64)))
        masks = (np.uint64(1) << (places & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array(masks)], names=["word", "mask"]
        )


class Frequencies:
    """What is known of the shingles: the most frequent with their counts, ascending, and a filter of
    all that stand in several texts. Both are bounded; a full filter only knows less."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, words: np.ndarray):
        self.tokens, self.counts, self.words = tokens, counts, words

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        """The first order's rank: rare shingles before frequent; 1 is a lone one."""
        places = _places(tokens)
        shared = (self.words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)
        ranks = 1 + shared.astype(np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            ranks = np.where(self.tokens[at] == tokens, self.counts[at], ranks)
        return ranks


def frequent(source: DataFrame, words: int) -> Frequencies:
    """Counts of the shingles that texts share, over all texts: the first order's ranks.

    Any ranks serve for right results, as all texts use the same; good ones keep shared passages
    out of the prefixes. The table's length is bounded: a least count is chosen from the number of
    shingles per power of two.
    """
    with Scratch(free=True):
        found = store(
            source.select("body")
            .mapInArrow(_common(words), "token long, n long")
            .groupBy("token")
            .agg(F.sum("n").alias("n"))
            .where("n > 1")
        )
        levels = found.df.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()
        least, held = 0, 0
        for level, count in sorted(((r[0], r[1]) for r in levels), reverse=True):
            if held + count > FREQUENT:
                least = level + 1
                break
            held += count
        small = F.least("n", F.lit(127)).cast("tinyint").alias("n")
        rows = found.df.where(F.log2("n") >= least).select("token", small).toArrow()
        words = np.zeros(1 << (SHARED_BITS - 6), dtype=np.uint64)
        filled = found.df.select("token").mapInArrow(_filter_words, "word long, mask long")
        for part in filled.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
            words[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    tokens, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return Frequencies(tokens[order], np.maximum(n[order], 2), words)


def _signatures(tokens: np.ndarray, shared: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, its number of possibly shared tokens, and the parities of their counts by hashed place."""
    width, sizes = 64 * SIGN, np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)[shared]
    places = (mix(tokens[shared] ^ MIXED) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(text * width + places, minlength=len(sizes) * width) & 1).astype(np.uint8)
    return np.bincount(text, minlength=len(sizes)), np.packbits(odd).view(np.int64)


def _brief(sign: Column) -> list[Column]:
    """The signature folded to fewer longs: parities again, of fewer places."""
    return [reduce(Column.bitwiseXOR, [sign[k] for k in range(i, SIGN, BRIEF)]) for i in range(BRIEF)]


def _may_link(pairs: list[tuple[Column, Column]], percent: int) -> Column:
    """False only where two sets cannot link by their sizes and signatures.

    Each place whose parities differ stands for a shared token that one set alone holds, so the
    intersection is at most half of what is left of the shared tokens of both.
    """
    differ = reduce(Column.__add__, [F.bit_count(a.bitwiseXOR(b)) for a, b in pairs])
    most = F.col("m") + F.col("other_m") - differ
    return (100 + percent) * most >= 2 * percent * (F.col("n") + F.col("other_n"))


def _label(own: np.ndarray) -> tuple[int, int]:
    """The class of a set in 128 bits: texts with equal sets are one."""
    if not len(own):
        return 0, 0
    place = np.arange(1, len(own) + 1, dtype=np.uint64)
    found = [np.bitwise_xor.reduce(mix(own * odd + mix(place + odd))) for odd in (np.uint64(1), MIXED)]
    return tuple(int(x.view(np.int64)) for x in found)


def _described(held, words: int, percent: int):
    """Per text its size, class, signature, and prefixes: under the first order, of long sets under all.

    A shingle that is known to stand in no other text is left out of the first prefix and of the
    signature, as no pair shares it; a text whose first prefix is empty then has no partner and
    needs no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in small(batches, 3):
            tokens, bounds = shingle_sets(batch.column(3), words)
            ranks = table.ranks(tokens)
            labels, prefixes = [], ([], [], [])
            shared, signs = _signatures(tokens, ranks > 1, bounds)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own, rank = tokens[a:b], ranks[a:b]
                labels.append(_label(own))
                length = prefix_length(b - a, percent) if b > a else 0
                order = np.argsort(rank, kind="stable")[:length]
                order = order[rank[order] > 1]
                prefixes[0].append(own[order].view(np.int64))
                for i in (1, 2):
                    rest = own[_order(own, i)[: length if len(order) and b - a > LONG else 0]]
                    prefixes[i].append((rest >> np.uint64(32)).astype(np.uint32).view(np.int32))
            first, second = zip(*labels) if labels else ((), ())
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds))]
            arrays += [pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            arrays += [pa.array(x, pa.list_(t)) for x, t in zip(prefixes, (pa.int64(), pa.int32(), pa.int32()))]
            starts = pa.array(np.arange(len(shared) + 1) * SIGN, pa.int32())
            arrays += [pa.array(shared), pa.ListArray.from_arrays(starts, pa.array(signs))]
            names = ["a", "b", "key", "n", "c1", "c2", "p1", "p2", "p3", "m", "sign"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _sets(words: int):
    """The whole sets of the wanted texts, with the places that they are sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            tokens, bounds = shingle_sets(batch.column(1), words)
            sets = [tokens[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], names=["cls", "tokens", "to"]
            )

    return run


def _compared(percent: int):
    """The links of a partition's rows, which come by place, a hub before the sets sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            hubs, sides, classes = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for hub, side, cls, tokens in zip(hubs, sides, classes, batch.column(4)):
                held = np.frombuffer(tokens.as_buffer(), np.uint64)
                if side == 0:
                    own = held.copy()
                    continue
                both = len(np.intersect1d(own, held, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(held) - both):
                    links.append((cls, hub))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key reachable by links).

    A set is the distinct shingles of ``words`` words, A-Z in lower case; a text with fewer words
    is one shingle, and one without words, null included, has an empty set and no link. Two texts
    link if 100 * shared >= percent * united. Repeated rows have equal sets and link; a null key
    is never the smallest unless all are. Other columns are not read; an empty table gives no
    rows. Shingles are compared by 64-bit hashes, sets and rows are known by 128 bits.

    Texts with equal sets are one class. Linked sets share a token in their prefixes under any
    order of the tokens. Under the first (rare before frequent) the classes of a
    token meet a pivot of it; a pair goes on only if its sizes and signatures allow a link (long sets'
    prefixes must meet under two further orders, too), and then the whole sets are compared. Classes that are
    connected need no further pair. After rounds with more pivots each, all pairs of classes that
    share a token and are not yet connected are tried.
    """
    rows = _classified(docs, text, key, words, percent)
    empty = F.col("n") == 0
    return rows.select(
        "key",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("key")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """The row with the smallest key of each component, with all its columns.

    A null key comes last; rows that repeat wholly are one. Rows with an empty set all stay.
    """
    rows = store(_classified(docs, text, key, words, percent)).df
    order = F.struct(F.col("key").isNull().alias("last"), "key", "a", "b")
    first = rows.where("n > 0").groupBy("root").agg(F.min(order).alias("first"))
    stays = first.select("first.a", "first.b", F.lit(False).alias("empty"))
    empty = rows.where("n = 0").select("a", "b", F.lit(True).alias("empty")).distinct()
    stays = stays.unionAll(empty).withColumn("weight", F.lit(1))
    source = docs.select(*_identity(name(key), name(text).cast("string")), row_of(docs).alias("row"))
    kept = lookup_join(source, store(stays, "weight"), ["a", "b"], "weight", ["a"], "inner")
    each = F.when(F.col("empty"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return kept.withColumn("each", each).dropDuplicates(["a", "b", "each"]).select("row.*")


def _identity(key: Column, body: Column) -> list[Column]:
    """128 bits that stand for a row's key and text."""
    return [F.xxhash64(key, body).alias("a"), F.xxhash64(F.lit(7), body, F.lit(11), key).alias("b")]


def _classified(docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """Per row: a and b (its identity), key, n, root of its component, smallest key there."""
    plain = docs.select(name(key).alias("key"), name(text).cast("string").alias("body"))
    source = plain.select(*_identity(F.col("key"), F.col("body")), "key", "body")
    kind = source.schema["key"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(frequent(source, words))
    described = source.mapInArrow(
        _described(held, words, percent),
        f"a long, b long, key {kind}, n long, c1 long, c2 long, p1 array<long>, p2 array<int>, p3 array<int>,"
        " m long, sign array<long>",
    )
    base = store(described)
    held.destroy()
    grouped = base.df.where("n > 0").groupBy("c1", "c2").agg(
        F.min("key").alias("first"),
        F.min(F.struct("a", "b")).alias("row"),
        F.first("n").alias("n"),
        F.count("*").alias("members"),
        *[F.first(p).alias(p) for p in ("m", "sign", "p1", "p2", "p3")],
    )
    classes = grouped.withColumn("cls", F.monotonically_increasing_id())
    classes = store(classes, "members", tokens=F.sum(F.size("p1")))
    return _answer(base, classes, _connected(source, classes, words, percent))


def _shared_tokens(classes: Stored) -> Stored:
    """The tokens of the first prefixes that several classes hold, with these, their sizes and signatures."""
    brief = [c.alias(f"s{i}") for i, c in enumerate(_brief(F.col("sign")))]
    postings = classes.df.select("cls", "n", "m", *brief, F.explode("p1").alias("token"))
    often = postings.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    often = store(few_parts(often, classes.size["tokens"]), "held")
    return store(lookup_join(postings, often, ["token"], "held", ["cls"], "inner"))


def _as_other() -> list[Column]:
    """A class's columns under the names that the second of a pair has."""
    names = {"cls": "pivot", "n": "other_n", "root": "other", "m": "other_m"}
    names |= {f"s{i}": f"o_s{i}" for i in range(BRIEF)}
    return [F.col(c).alias(other) for c, other in names.items()]


def _pivots(held: DataFrame, count: int, rows: int) -> Stored:
    """Per token, up to ``count`` of its classes, each the least by a hash of its own; ``rows``
    bounds the rows of ``held``."""
    row = F.struct(*_as_other())
    least = [F.min_by(row, F.xxhash64("cls", F.lit(i))) for i in range(count)]
    found = held.groupBy("token").agg(F.array_distinct(F.array(*least)).alias("pivots"), F.count("*").alias("held"))
    return store(few_parts(found.select("token", "held", F.inline("pivots")), rows), "held")


def _connected(source: DataFrame, classes: Stored, words: int, percent: int) -> DataFrame | None:
    """Components of the linked classes: node, root; None where no two link."""
    with Scratch() as scratch:
        held = _shared_tokens(classes)
        members = held.df.select("cls").distinct()
        small_ = store(classes.df.select("cls", "n", "m", "sign", "p2", "p3").join(members, "cls"))
        open_, rows, cross = held.df.withColumn("root", F.col("cls")), held.rows, 0
        tried, found, few = None, None, False
        for pivots in (*PIVOTS, None):
            last = few or pivots is None
            with Scratch(free=True) as inner:
                met = _pairs(open_, None if last else pivots, tried, percent, rows)
                pairs = inner.keep(store(few_parts(met, cross if last else rows * pivots)))
                linked = _links(source, classes, _filtered(pairs, small_.df, percent), words, percent)
                if linked is not None and linked.rows:
                    found = inner.keep(_joined(linked, found))
                if not last:
                    tried = pairs.df if tried is None else tried.unionAll(pairs.df)
                    rest, cross = _open_tokens(open_, found, rows)
                    open_, rows = inner.keep(rest).df, rest.rows
                    few, last = cross <= FEW_PAIRS * rows, not cross
            if last:
                break
        if found is None:
            return None
        return scratch.keep(store(found.df)).df


def _joined(links: Stored, found: Stored | None) -> Stored:
    """The components by the new links and those before, whose stars stand for all earlier links."""
    if found is None:
        return components(links.df, links.rows)
    stars = found.df.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(links.df.unionAll(stars), links.rows + found.rows)


def _pairs(open_: DataFrame, pivots: int | None, tried: DataFrame | None, percent: int, rows: int) -> DataFrame:
    """Pairs of classes of different components that share a token and whose sizes and signatures
    allow a link: each class of a token with the token's pivots, or with all. ``rows`` bounds the
    rows of ``open_``."""
    if pivots is None:
        other = open_.select("token", *_as_other())
        met = open_.join(other, "token").where("root < other")
    else:
        met = lookup_join(open_, _pivots(open_, pivots, rows), ["token"], "held", ["cls"], "inner").where("root <> other")
    met = met.where(100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n"))
    met = met.where(_may_link([(F.col(f"s{i}"), F.col(f"o_s{i}")) for i in range(BRIEF)], percent))
    pairs = met.select(F.least("cls", "pivot").alias("cls"), F.greatest("cls", "pivot").alias("pivot")).distinct()
    return pairs if tried is None else pairs.join(tried, ["cls", "pivot"], "left_anti")


def _open_tokens(held: DataFrame, found: Stored | None, rows: int) -> tuple[Stored, int]:
    """What is left of the tokens whose classes are not yet in one component, and in how many pairs
    of classes of different components they are. ``rows`` bounds the rows of ``held``."""
    if found is not None:
        roots = F.broadcast(found.df) if found.small else found.df
        joined = held.drop("root").join(roots, F.col("cls") == F.col("node"), "left")
        held = joined.drop("node").withColumn("root", F.coalesce("root", "cls"))
    parts = held.groupBy("token", "root").agg(F.count("*").alias("own"))
    mixed = parts.groupBy("token").agg(
        F.sum("own").alias("held"), F.sum(F.col("own") * F.col("own")).alias("same"), F.count("*").alias("roots")
    )
    pairs = F.sum((F.col("held") * F.col("held") - F.col("same")) / 2)
    mixed = few_parts(mixed.where("roots > 1").select("token", "held", "same"), rows)
    mixed = store(mixed, "held", pairs=pairs)
    still = Stored(mixed.df.select("token", "held"), mixed.path, mixed.size)
    return store(lookup_join(held, still, ["token"], "held", ["cls"], "inner")), int(mixed.size["pairs"])


def _filtered(pairs: Stored, small_: DataFrame, percent: int) -> Stored:
    """The pairs whose whole signatures allow a link; of long sets, the prefixes must meet under the
    second and the third order, too."""
    ends = pairs.df.select(F.col("cls").alias("end")).unionAll(pairs.df.select("pivot")).distinct()
    ends = store(few_parts(ends, 2 * pairs.rows))
    longs = F.sum(F.size("sign") + F.size("p2") + F.size("p3"))
    wanted = F.broadcast(ends.df) if ends.small else ends.df
    known = store(small_.join(wanted, F.col("cls") == F.col("end")).drop("end"), longs=longs)
    few = known.small and known.size["bytes"] + 8 * known.size["longs"] <= LIMITS.broadcast_bytes
    known = known.df
    names = {"cls": "pivot", "n": "other_n", "m": "other_m"}
    other = known.select(*[F.col(c).alias(names.get(c, f"o_{c}")) for c in known.columns])
    known, other = (F.broadcast(known), F.broadcast(other)) if few else (known, other)
    both = few_parts(pairs.df.join(known, "cls").join(other, "pivot"), pairs.rows)
    short = F.least("n", "other_n") <= LONG
    meet = short | (F.arrays_overlap("p2", "o_p2") & F.arrays_overlap("p3", "o_p3"))
    signed = _may_link([(F.col("sign")[i], F.col("o_sign")[i]) for i in range(SIGN)], percent)
    return store(both.where(signed & meet).select("cls", "pivot"))


def _links(source: DataFrame, classes: Stored, pairs: Stored, words: int, percent: int) -> Stored | None:
    """Those pairs whose whole sets link: a, b.

    The side of a pair that is in more of them is its hub. A set is read once from its text and sent
    to each of its hubs; a hub with many sets has several places, and its own set goes to all.
    """
    if not pairs.rows:
        return None
    ends = pairs.df.select(F.col("cls").alias("end")).unionAll(pairs.df.select(F.col("pivot")))
    degree = store(few_parts(ends.groupBy("end").agg(F.count("*").alias("degree")), 2 * pairs.rows))
    degree = F.broadcast(degree.df) if degree.small else degree.df
    sided = pairs.df.join(degree.select(F.col("end").alias("cls"), F.col("degree").alias("d1")), "cls")
    sided = sided.join(degree.select(F.col("end").alias("pivot"), F.col("degree").alias("d2")), "pivot")
    turned = F.col("d1") > F.col("d2")
    sided = sided.select(
        F.when(turned, F.col("pivot")).otherwise(F.col("cls")).alias("cls"),
        F.when(turned, F.col("cls")).otherwise(F.col("pivot")).alias("hub"),
    )
    sided = store(few_parts(sided, pairs.rows)).df
    places = sided.groupBy("hub").agg(F.ceil(F.count("*") / NEAR_PIVOT).alias("places"))
    targets = sided.join(places, "hub").select(
        "cls", F.struct("hub", F.pmod(F.xxhash64("cls"), "places").alias("place"), F.lit(1).alias("side")).alias("to")
    )
    own = places.select(
        F.col("hub").alias("cls"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("places") - 1)).alias("place")
    ).select("cls", F.struct(F.col("cls").alias("hub"), "place", F.lit(0).alias("side")).alias("to"))
    wanted = targets.unionAll(own).groupBy("cls").agg(F.collect_list("to").alias("to"))
    rows = classes.df.select("cls", "row.a", "row.b").join(wanted, "cls")
    rows = store(few_parts(rows.withColumn("weight", F.lit(1)), 2 * pairs.rows), "weight")
    texts = lookup_join(source, rows, ["a", "b"], "weight", ["a"], "inner").dropDuplicates(["cls"])
    texts = few_parts(texts, rows.rows, SETS_EACH)
    sets = texts.select("cls", "body", "to").mapInArrow(
        _sets(words), "cls long, tokens binary, to array<struct<hub:long,place:long,side:int>>"
    )
    sent = sets.select("cls", "tokens", F.inline("to"))
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = few_parts(sent.repartition(parts, "hub", "place"), 2 * pairs.rows, SETS_EACH)
    met = met.sortWithinPartitions("hub", "place", "side")
    compared = met.select("hub", "place", "side", "cls", "tokens").mapInArrow(_compared(percent), "a long, b long")
    return store(compared)


def _answer(base: Stored, classes: Stored, comps: DataFrame | None) -> DataFrame:
    named = classes.df.select("cls", "c1", "c2", "first", "members")
    if comps is None:
        named = named.withColumn("root", F.col("cls"))
    else:
        named = named.join(comps, F.col("cls") == F.col("node"), "left").drop("node")
        named = named.withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = store(named.drop("first", "cls").join(least, "root"), "members")
    rows = base.df.drop("m", "sign", "p1", "p2", "p3")
    return lookup_join(rows, named, ["c1", "c2"], "members", ["a"])
