"""Secret scans over a ledger of blobs: a text is scanned once, wherever and whenever it occurs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..plans.storage import Stored, store
from .common import name, whole


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if ``group`` has at least ``least`` characters.

    A changed pattern needs a new ``version``; the ledger then scans every blob for it again.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: The base kinds, then those that the method adds.
BASE = (
    Rule("assign", ASSIGN, 6, group=2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0),
)
RULES = BASE + ADDED
#: Of the ledger: a finding belongs to a rule and its version.
SPAN = "struct<start:bigint,end:bigint,pair:string>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hits(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Matches of all rules still to do: rule, place in the text's list, gap before it, lengths."""
    found = []
    for rank, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        pieces = F.arrays_zip(
            F.split(text, rule.pattern).alias("gap"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
        )
        listed = F.transform(
            pieces,
            lambda z, i: F.struct(
                F.lit(rank).alias("rank"),
                i.alias("at"),
                F.length(z["gap"]).alias("gap"),
                F.length(z["match"]).alias("match"),
                F.length(z["part"]).alias("part"),
            ),
        )
        todo = F.array_contains("todo", rule.pair) & text.rlike(rule.pattern)
        found.append(F.when(todo, F.filter(listed, lambda z: z["match"].isNotNull())))
    return F.concat(*[F.coalesce(f, F.array().cast("array<struct<rank:int,at:int,gap:int,match:int,part:int>>")) for f in found])


def _spans(hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Per blob, its new spans: start, end, pair."""
    along = Window.partitionBy("blob", "rank").orderBy("at")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rank") + 1)
    pair = F.element_at(F.array(*[F.lit(r.pair) for r in rules]), F.col("rank") + 1)
    end = F.sum(F.col("gap") + F.col("match")).over(along)
    placed = hits.withColumn("end", end).where(F.col("part") >= least)
    span = F.struct((F.col("end") - F.col("match")).alias("start"), "end", pair.alias("pair"))
    return placed.groupBy("blob").agg(F.collect_list(span).alias("found"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of the rules' present versions in order: start, rank, kind, end."""
    pairs = F.array(*[F.lit(r.pair) for r in rules])
    current = F.filter(spans, lambda s: F.array_contains(pairs, s["pair"]))
    ranked = F.transform(
        current,
        lambda s: F.struct(
            s["start"].alias("start"),
            (F.array_position(pairs, s["pair"]) - 1).cast("int").alias("rank"),
            F.substring_index(s["pair"], "@", 1).alias("kind"),
            s["end"].alias("end"),
        ),
    )
    return F.sort_array(ranked)


def scan(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    text: str = "text",
    key: str = "doc_id",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, Stored]:
    """Findings of every row, and the ledger that also holds this scan.

    The rows are the versions of files: ``key`` is a path, null or repeated paths included, and
    null texts are empty. The result has one row per input row: key, blob, spans (start, rank,
    kind, end in code points; empty where nothing is found). Equal texts are one blob. Only
    pairs of a blob and a rule's version that the ledger lacks are scanned, on one row of the
    blob. Other columns are not read; an empty table gives no rows.

    The ledger has a row per blob: the pairs scanned, and the spans of each pair. It keeps the
    blobs and the versions that this scan does not ask for; the result lists the versions asked for.

    A blob with a third of all rows is combined before the shuffle, scanned once, and its
    findings are joined back to salted copies. Spans of a kind follow from the lengths of the
    matches and of the gaps between them.
    """
    source = docs.select(name(key).alias("key"), whole(name(text)).alias("body"))
    hashed = source.withColumn("blob", blob_of(F.col("body")))
    paths = store(hashed.select("key", "blob", F.monotonically_increasing_id().alias("number")))
    blobs = store(paths.df.groupBy("blob").agg(F.count("*").alias("copies"))).df
    pairs = F.array(*[F.lit(r.pair) for r in rules])
    no_pairs, no_spans = F.array().cast("array<string>"), F.array().cast(f"array<{SPAN}>")
    if ledger is None:
        todo = blobs.select("blob", pairs.alias("todo"))
    else:
        seen = ledger.select("blob", F.col("scanned").alias("seen"))
        unseen = F.array_except(pairs, F.coalesce("seen", no_pairs))
        todo = blobs.join(seen, "blob", "left").select("blob", unseen.alias("todo")).where(F.size("todo") > 0)
    bodies = hashed.groupBy("blob").agg(F.first("body").alias("body")).join(todo, "blob")
    hits = bodies.select("blob", F.explode(_hits(F.col("body"), rules)).alias("hit"))
    new = _spans(hits.select("blob", "hit.*"), rules)
    grown = todo.join(new, "blob", "left")
    if ledger is None:
        grown = grown.select("blob", F.col("todo").alias("scanned"), F.coalesce("found", no_spans).alias("spans"))
    else:
        old = ledger.select("blob", F.col("scanned").alias("seen"), F.col("spans").alias("known"))
        grown = grown.join(old, "blob", "full").select(
            "blob",
            F.concat(F.coalesce("seen", no_pairs), F.coalesce("todo", no_pairs)).alias("scanned"),
            F.concat(F.coalesce("known", no_spans), F.coalesce("found", no_spans)).alias("spans"),
        )
    grown = store(grown)
    listed = grown.df.select("blob", _listed(F.col("spans"), rules).alias("spans")).where(F.size("spans") > 0)
    result = lookup_join(paths.df, listed.join(blobs, "blob"), ["blob"], "copies", ["number"])
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return result.select("key", "blob", F.coalesce("spans", none).alias("spans")), grown
