"""Main text of pages: runs that a host repeats are found with suffix arrays and removed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Stored, store
from .common import name, whole
from .markup import host_of, parts
from .recompress import covered
from .wordhash import STEP, mix, word_hashes

#: Words of a run, and the distinct pages of its host that it must be on: a number, or so many
#: times the root of the host's pages (200 of a million).
RUN = 6
LEAST_PAGES = 3
ROOT_SHARE = 0.2
#: The distinct articles of its host that a run of whole blocks inside an article must be on: a
#: number, and this share of them all.
LEAST_ARTICLES = 10
ARTICLE_SHARE = 0.5
#: An article that would keep a smaller share of its words is a near copy and stays whole.
ARTICLE_LEFT = 0.25
#: Words of page streams that one suffix array holds.
SHARD_WORDS = 1 << 20


def _size(blocks: list[str]) -> int:
    return sum(x.count(" ") + 1 for x in blocks)


def _packed(blocks: list[str]) -> bytes:
    """The blocks of an article: of each a hash, whose low bits are the number of its tokens. Blocks
    count as a whole, so a block of many words has no more tokens than a run."""
    hashes = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in blocks), np.uint64)
    tokens = np.array([min(RUN, x.count(" ") + 1) for x in blocks], np.uint64)
    return ((hashes & ~np.uint64(7)) | tokens).tobytes()


def _unpacked(article: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of an article, each its block's hash and its place in it; and how many a block has."""
    blocks = np.frombuffer(article, np.uint64)
    counts = (blocks & np.uint64(7)).astype(np.int64)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(blocks, counts) + place.astype(np.uint64) * STEP), counts


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks are joined by line ends, which no block holds."""
    for batch in batches:
        hosts, insides, arounds, chromes, sizes, own, packed = [], [], [], [], [], [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            inside, around, chrome = parts(html)
            hosts.append(host_of(url))
            insides.append(None if inside is None else "\n".join(inside))
            arounds.append("\n".join(around))
            chromes.append(chrome)
            sizes.append(_size(around))
            packed.append(None if inside is None else _packed(inside))
            own.append(RUN * len(inside or []))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(hosts, pa.string()),
                pa.array(insides, pa.string()),
                pa.array(arounds, pa.string()),
                pa.array(chromes, pa.list_(pa.bool_())),
                pa.array(sizes, pa.int64()),
                pa.array(own, pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            names=["key", "url", "host", "inside", "around", "chrome", "size", "article_size", "blocks"],
        )


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first tokens, at least ``depth`` of them, and the rank of
    each suffix; equal ranks mean equal first tokens. Ranks double their reach in each round."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, reach = rank.astype(np.int64), 1
    while reach < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[: max(0, len(rank) - reach)] = rank[reach:] + 1
        both = rank * (len(rank) + 2) + after
        _, rank = np.unique(both, return_inverse=True)
        reach *= 2
    return np.argsort(rank, kind="stable"), rank


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    count = len(hashes) - width + 1
    if count <= 0:
        return hashes[:0]
    found = hashes[:count]
    for k in range(1, width):
        found = mix(found * STEP + hashes[k : k + count])
    return found


def repeated_runs(streams: list[np.ndarray], least: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``run`` words that are on ``least`` of the streams, and on how many.

    The streams are concatenated, each with an end of its own. Neighbours in the suffix array
    whose common prefix is ``run`` words long hold the same run; a longer repeat is the runs that
    start at each of its words but the last few.
    """
    none = np.zeros(0, dtype=np.int64)
    lengths = np.array([len(s) for s in streams])
    if not len(streams) or lengths.sum() == 0:
        return none.astype(np.uint64), none
    ends = np.arange(len(streams), dtype=np.uint64) + np.uint64(1)
    parts = [x for s, e in zip(streams, ends) for x in (s, mix(np.array([e]) * STEP))]
    tokens = np.concatenate(parts)
    owner = np.repeat(np.arange(len(streams)), lengths + 1)
    stop = np.cumsum(lengths + 1) - 1
    order, _ = suffix_array(tokens, run)
    order = order[stop[owner[order]] - order >= run]
    # Common prefix with the neighbour, as far as it matters.
    common = np.zeros(len(order), dtype=bool)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(run):
        same &= tokens[order[1:] + k] == tokens[order[:-1] + k]
    common[1:] = same
    group = np.cumsum(~common) - 1 if len(order) else none
    pairs = np.unique(group * len(streams) + owner[order])
    counts = np.bincount(pairs // len(streams), minlength=int(group[-1]) + 1 if len(group) else 0)
    heads = order[np.flatnonzero(~common)]
    often = counts >= least
    grams = _grams(tokens, run)
    return grams[heads[often]], counts[often]


def _least(pages: Column) -> Column:
    return F.greatest(F.lit(LEAST_PAGES), F.ceil(F.lit(ROOT_SHARE) * F.sqrt(pages)))


def _least_articles(articles: Column) -> Column:
    return F.greatest(F.lit(LEAST_ARTICLES).cast("bigint"), F.ceil(F.lit(ARTICLE_SHARE) * articles))


def _streams(rows: pd.DataFrame) -> list[np.ndarray]:
    """The tokens of each page or of each article."""
    if rows["article"].iloc[0]:
        return [_unpacked(x)[0] for x in rows["body"]]
    hashes, firsts = word_hashes(pa.array(rows["body"], pa.binary()))
    return [hashes[a:b] for a, b in zip(firsts[:-1], firsts[1:])]


def _ranges(held: np.ndarray) -> np.ndarray:
    """Starts and ends of what is held, in turn."""
    return np.flatnonzero(np.diff(held.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))


def _gone(stream: np.ndarray, grams: np.ndarray, article: bytes | None = None) -> np.ndarray:
    """Starts and ends of the words that the runs cover, in turn; of an article, of the blocks."""
    hits = np.isin(_grams(stream, RUN), grams)
    held = covered(np.flatnonzero(hits), RUN, len(stream))
    if article is None or not held.any():
        return _ranges(held)
    counts = _unpacked(article)[1]
    blocks = np.logical_and.reduceat(held, np.cumsum(counts) - counts)
    return _ranges(blocks if (counts * ~blocks).sum() >= ARTICLE_LEFT * len(held) else blocks & False)


def _answers(rows: pd.DataFrame, runs: Callable[[pd.DataFrame, list[np.ndarray]], np.ndarray]) -> pd.DataFrame:
    found = [pd.DataFrame({"host": [], "content": [], "gone": []})]
    for article, part in rows.groupby("article"):
        streams = _streams(part)
        grams = runs(part, streams)
        bodies = part["body"] if article else [None] * len(part)
        gone = [_gone(s, grams, body) for s, body in zip(streams, bodies)]
        found.append(part[["host", "content"]].assign(gone=gone))
    found = pd.concat(found[1:] or found)
    return found[found["gone"].map(len) > 0]


ANSWER = "host string, content long, gone array<int>"


def _whole_host(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return _answers(rows, lambda part, streams: repeated_runs(streams, int(part["least"].iloc[0]))[0])


def _counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """On how many pages of the shard each run is, dealt to as many parts as the host has shards."""
    found, shards = [], int(rows["shards"].iloc[0])
    for article, part in rows.groupby("article"):
        grams, counts = repeated_runs(_streams(part), 1)
        place = grams % np.uint64(shards)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(1, shards, dtype=np.uint64))
        for i, own in enumerate(np.split(order, cuts)):
            packed = grams[own].tobytes(), counts[own].astype(np.uint32).tobytes()
            found.append((key[0], key[1], article, i, int(part["least"].iloc[0]), *packed))
    return pd.DataFrame(found, columns=["site", "shard", "article", "part", "least", "grams", "counts"])


COUNTED = "site long, shard long, article boolean, part long, least long, grams binary, counts binary"


def _frequent(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a part of a host's runs those on enough pages, to each shard its own."""
    grams = [np.frombuffer(x, dtype=np.uint64) for x in rows["grams"]]
    counts = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["counts"]])
    _, which = np.unique(np.concatenate(grams), return_inverse=True)
    often = (np.bincount(which, weights=counts) >= rows["least"].iloc[0])[which]
    cuts = np.cumsum([len(x) for x in grams])[:-1]
    own = [x[o].tobytes() for x, o in zip(grams, np.split(often, cuts))]
    return rows[["site", "shard", "article"]].assign(grams=own)


def _part_of_host(key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    def frequent(part, streams):
        own = runs.loc[runs["article"] == part["article"].iloc[0], "grams"]
        return np.frombuffer(b"".join(own), dtype=np.uint64)

    return _answers(rows, frequent)


def repeated_words(parsed: Stored) -> DataFrame:
    """Per host and distinct page or article the words that are in boilerplate: host, content, gone."""
    around = parsed.df.where("around != ''").select(
        "row", "host", F.lit(False).alias("article"), F.col("around").cast("binary").alias("body"), "size", "content"
    )
    inside = parsed.df.where("octet_length(blocks) > 0").select(
        "row", "host", F.lit(True), "blocks", "article_size", "article_content"
    )
    streams, same = around.unionAll(inside), ["host", "article", "content"]
    copies = streams.groupBy(*same).agg(F.min("row").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    distinct = lookup_join(streams, copies, same, "n", ["row"]).where("keeper is null or keeper = row")
    hosts = store(
        distinct.groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.ceil(F.sum("size") / SHARD_WORDS).alias("shards"),
            _least_articles(F.count_if("article")).alias("of_articles"),
            _least(F.count_if(~F.col("article"))).alias("of_pages"),
        )
        .withColumn("site", F.monotonically_increasing_id()),
        "pages",
        shards=F.max("shards"),
    )
    dealt = lookup_join(distinct, hosts, ["host"], "pages", ["content"]).select(
        "site",
        F.pmod("content", "shards").alias("shard"),
        "shards",
        "host",
        "article",
        "content",
        "body",
        F.when(F.col("article"), F.col("of_articles")).otherwise(F.col("of_pages")).alias("least"),
    )
    answers = dealt.where("shards = 1").groupBy("site", "shard").applyInPandas(_whole_host, ANSWER)
    if hosts.size["shards"] > 1:
        shards = dealt.where("shards > 1").groupBy("site", "shard")
        counts = shards.applyInPandas(_counted, COUNTED).groupBy("site", "article", "part")
        sure = counts.applyInPandas(_frequent, "site long, shard long, article boolean, grams binary")
        answers = answers.unionAll(
            shards.cogroup(sure.groupBy("site", "shard")).applyInPandas(_part_of_host, ANSWER)
        )
    return answers


def _mask(bounds: list[int] | None, size: int) -> np.ndarray:
    gone = np.zeros(size, dtype=bool)
    for a, b in zip((bounds or [])[::2], (bounds or [])[1::2]):
        gone[a:b] = True
    return gone


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, repeated, marked = [], [], []
        chromes = batch.column(4).to_pylist()
        ranges, article_ranges = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        for i, (inside, around) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            blocks = around.split("\n") if around else []
            gone = _mask(ranges[i], _size(blocks))
            kept, at, by_runs, by_markup = [], 0, 0, 0
            for block, chrome in zip(blocks, chromes[i]):
                own = block.split(" ")
                left = [w for w, g in zip(own, gone[at : at + len(own)].tolist()) if not g]
                if not left:
                    by_runs += 1
                elif chrome:
                    by_markup += 1
                elif inside is None:
                    kept += left
                at += len(own)
            if inside is not None:
                blocks = inside.split("\n") if inside else []
                gone = _mask(article_ranges[i], len(blocks))
                kept += [block for block, g in zip(blocks, gone) if not g]
                by_runs += int(gone.sum())
            texts.append(" ".join(kept))
            repeated.append(by_runs)
            marked.append(by_markup)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(texts, pa.string()),
                pa.array(repeated, pa.int64()),
                pa.array(marked, pa.int64()),
            ],
            names=["key", "url", "text", "repeated_blocks", "marked_blocks"],
        )


def main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per input row: key, url, text, and how many blocks went for repeating and by markup.

    Pages are split into blocks; character references are decoded, white space in a block is one
    space, and blocks are joined by one space. The blocks around the article are the page's
    stream of words. A run of ``RUN`` words on enough distinct pages of the host is boilerplate,
    and the words that such runs cover are removed, wherever in a block they are; a block counts
    as repeated if none is left. Then what the markup names as menu, header, footer, sidebar,
    notice, advert, form or comment goes. Where the markup tells
    no article, the words that are left are the text. Inside an article prose stays, however common:
    a block goes only if it is in a run of whole blocks, ``RUN`` words or longer, that stands in
    ``ARTICLE_SHARE`` of the host's distinct articles and in ``LEAST_ARTICLES`` at least, and only
    if ``ARTICLE_LEFT`` of the article is left; else it is a near copy and stays whole. A null page
    is empty and has an empty text; a null or broken url has the empty host. Repeated pages are
    counted once and answered each. Other columns are not read; an empty table gives no rows.

    Copies of a page are dropped by an aggregate before anything is counted or dealt. The pages of
    a host are dealt to suffix arrays of bounded size; where a host has several, the counts of its
    runs are added up in as many parts, and each shard gets those of its own runs that are frequent.
    """
    source = pages.select(
        name(key).alias("key"), name(url).cast("string").alias("url"), whole(name(html)).alias("html")
    )
    kind = source.schema["key"].dataType.simpleString()
    columns = f"key {kind}, url string, host string, inside string, around string, chrome array<boolean>"
    columns += ", size long, article_size long, blocks binary"
    content = {
        "content": F.xxhash64(F.col("inside").isNull(), "inside", "around"),
        "article_content": F.xxhash64(F.lit("article"), "inside"),
    }
    parsed = store(
        source.mapInArrow(_parsed, columns).withColumns(
            {**content, "row": F.monotonically_increasing_id()}
        )
    )
    found, joined = store(repeated_words(parsed)).df, parsed.df
    for place, own in (("content", "gone"), ("article_content", "article_gone")):
        copies = parsed.df.groupBy("host", F.col(place).alias("content")).agg(F.count("*").alias("n"))
        listed = found.join(copies, ["host", "content"]).withColumnsRenamed({"content": place, "gone": own})
        joined = lookup_join(joined, listed, ["host", place], "n", ["row"])
    rows = joined.select("key", "url", "inside", "around", "chrome", "gone", "article_gone")
    return rows.mapInArrow(
        _decided, f"key {kind}, url string, text string, repeated_blocks long, marked_blocks long"
    )
