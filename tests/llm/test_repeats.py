import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from conftest import messy_rows, sentence
from veilspark.llm import graph, jaccard, recompress, suffix, wordhash
from veilspark.plans.storage import LIMITS, Stored


def plain_strings(rows, length):
    count = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    found = Counter()
    for key, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if count[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        found[(key, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return found


@pytest.mark.parametrize("hot", [4000, 2])
def test_substrings_match_brute_force(spark, messy, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = Counter(tuple(r) for r in suffix.dedup_substrings(messy, length=100).collect())
    rows = [(r.doc_id, (r.text or "").encode()) for r in messy.collect()]
    assert got == plain_strings(rows, 100)


def test_substrings_in_small_pieces(spark, monkeypatch):
    draw = random.Random(4)
    noise = lambda n: "".join(draw.choice("ab é") for _ in range(n))
    shared = noise(500)
    texts = [noise(300) + shared + noise(100), shared[50:400] + noise(200), "ab" * 400, noise(90) + shared[:90], None]
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffix, "CHUNK", 128)
    monkeypatch.setattr(suffix, "PART_BYTES", 1000)
    whole = suffix.marks(np.frombuffer(texts[0].encode(), np.uint8), 80)
    assert len(whole[0])
    data = [(k, (t or "").encode()) for k, t in rows]
    contexts = suffix.dedup_substrings(
        spark.createDataFrame(rows, "doc_id long, text string"), length=80, keep_bytes=True
    ).collect()
    got = Counter((r.key, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in contexts)
    assert got == plain_strings(data, 80)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in contexts)


def test_suffix_order_sorts():
    draw = random.Random(1)
    data = bytes(draw.choice(b"ab") for _ in range(400))
    text = suffix.Hashed(np.frombuffer(data, np.uint8), np.array([len(data)]))
    at = np.array(draw.sample(range(300), 60))
    size, group = np.full(60, 100), np.sort(np.arange(60) % 4)
    order = suffix.suffix_order(text, at, size, group)
    for g in range(4):
        own = [data[at[i] : at[i] + 100] for i in order if group[i] == g]
        assert own == sorted(own)


def test_a_sign_in_many_places_stays_small_in_memory():
    """The bytes around one sign are compared and its strings made a part at a time."""
    draw = np.random.default_rng(5)
    base = draw.integers(97, 122, 672).astype(np.uint8)
    rows = []
    for i in range(3000):
        own = base.copy()
        own[draw.integers(0, 80)], own[draw.integers(560, 672)] = 65 + i % 26, 65 + i % 25
        rows.append((i, 7, 0, 273, 272, own.tobytes()))
    rows = pd.DataFrame(rows, columns=["doc", "sign", "start", "count", "place", "context"])
    size = 672 * len(rows)
    suffix.repeated(rows[:10])
    tracemalloc.start()
    found = suffix.repeated(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    strings = Counter(c[k : k + 400] for c in rows["context"] for k in range(273))
    wanted = {(r.doc, k + b) for r in rows.itertuples() for k in range(273) if strings[r.context[k : k + 400]] > 1 for b in (0, 399)}
    got = {(r.doc, k + b) for r in found.itertuples() for k in range(r.start, r.stop - 399) for b in (0, 399)}
    assert got == wanted
    assert peak < 44 * size
    batch = pa.RecordBatch.from_pandas(rows[["doc", "sign", "start", "count", "context"]], preserve_index=False)
    made = [b.num_rows for b in suffix._strings(400)([batch])]
    assert sum(made) == 273 * len(rows) and max(made) < 300_000


def test_a_string_in_many_places_is_no_hot_task(spark):
    """Counts come back by a broadcast, not in one task for all places of a string."""
    contexts = spark.createDataFrame(
        [(i, 7, 0, 21, b"common passage " * 8) for i in range(400)],
        "doc long, sign long, start long, count long, context binary",
    )
    ranges = suffix._hot_ranges(contexts, 100)
    assert ranges.count() == 400 * 21
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ranges_of_a_text_are_stored_as_runs(spark):
    """Neighbouring and overlapping ranges of many signs are one span before they are sent to the texts."""
    draw = random.Random(12)
    shared, other = sentence(draw, 900), sentence(draw, 400)
    texts = [shared + " x", "y " + shared, sentence(draw, 50) + other + " z " + shared[:2000], "w" + other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = suffix.spans_of(docs, "text", "doc_id", 100)
    rows = spans.df.collect()
    assert spans.size["bytes"] == sum(8 * 4 + 16 * len(r.spans) for r in rows)
    found = suffix.dedup_substrings(docs, length=100).collect()
    assert Counter(tuple(r) for r in found) == plain_strings([(i, t.encode()) for i, t in enumerate(texts)], 100)
    assert sorted(len(r.spans) for r in rows) == sorted(r.n_spans for r in found)


def plain_passages(rows, window):
    first, found = {}, Counter()
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key, words in ranked:
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), key)
    for key, words in ranked:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            least = first[tuple(words[i : i + window])]
            if least is not None and (key is None or least < key):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        found[(key, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return found


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_passages_match_brute_force(messy, empty):
    got = Counter(tuple(r) for r in recompress.dedup_passages(messy).collect())
    assert got == plain_passages([(r.doc_id, split(r.text)) for r in messy.collect()], 50)
    assert recompress.dedup_passages(empty).count() == 0
    assert suffix.dedup_substrings(empty).count() == 0


def test_equal_windows_have_equal_signs():
    draw = random.Random(8)
    for shared in (sentence(draw, 50), "a " * 50, "a b " * 25, "a " * 40 + "b c d e f g h i j k"):
        texts = [
            sentence(draw, k) + " " + edge + shared + " " + edge + sentence(draw, 60)
            for k, edge in ((3, ""), (10, "a "), (29, "a a a "))
        ]
        hashes, first = wordhash.word_hashes(pa.array(texts))
        signs, whole = recompress.signs(hashes, first), recompress.window_hashes(hashes)
        by = defaultdict(set)
        for a, b in zip(first[:-1], first[1:]):
            for i in range(a, b - 49):
                by[whole[i]].add(signs[i])
        assert all(len(x) == 1 for x in by.values())


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    draw = random.Random(2)
    texts = [sentence(draw, 500), None, "", sentence(draw, 40), "x" * 300 + " y"]
    whole, first = wordhash.word_hashes(pa.array(texts), lower=True)
    monkeypatch.setattr(wordhash, "CHUNK", 64)
    pieces, again = wordhash.word_hashes(pa.array(texts), lower=True)
    assert (whole == pieces).all() and (first == again).all()


def plain_near(rows, size=5, percent=80):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        words = split((text or "").translate(low))
        shingles = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets.append(shingles if len(words) >= size else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter(
        (key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)
    )


@pytest.mark.parametrize("near_pivot", [128, 2])
def test_near_duplicates_match_all_pairs(spark, messy, empty, monkeypatch, near_pivot):
    monkeypatch.setattr(jaccard, "NEAR_PIVOT", near_pivot)
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = Counter(tuple(r) for r in jaccard.near_duplicates(messy).collect())
    assert got == plain_near(rows)
    if near_pivot > 2:
        kept = jaccard.keep_one(messy)
        assert kept.columns == messy.columns
        parts = {c for _, n, c in got if n}
        empties = sum(n for (_, size, _), n in got.items() if not size)
        assert kept.count() == len(parts) + empties
        assert jaccard.near_duplicates(empty).count() == 0
        assert jaccard.keep_one(empty).count() == 0


def test_near_copies_chain(spark):
    draw = random.Random(6)
    words, rows = sentence(draw, 120).split(), []
    for i in range(60):
        own = list(words)
        for _ in range(draw.randrange(0, 5)):
            own[draw.randrange(len(own))] = f"w{draw.randrange(9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == plain_near(rows)
    found = jaccard.near_duplicates(docs, words=3, percent=90).collect()
    assert Counter(tuple(r) for r in found) == plain_near(rows, 3, 90)


def test_near_copies_that_do_not_link_are_few_pairs(spark, monkeypatch):
    """One passage, ten changes of its own in each text: all share tokens, none link but the copies."""
    draw = random.Random(9)
    words, rows, met = [f"v{i}" for i in range(300)], [], []
    for i in range(80):
        own = list(words)
        for at in draw.sample(range(300), 10):
            own[at] = f"w{draw.randrange(3)}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, "last"]))]
    plain = jaccard._pairs

    def counted(*given):
        pairs = plain(*given)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == plain_near(rows)
    assert 80 <= sum(met) < 1000


@pytest.mark.parametrize("long", [jaccard.LONG, 20])
def test_signatures_keep_every_link(spark, monkeypatch, long):
    """Sets at and around the limit of a link, short and overfull, with the first order's table or none."""
    monkeypatch.setattr(jaccard, "LONG", long)
    draw = random.Random(3)
    rows = []
    for size in (9, 40, 1500):
        base = [f"b{draw.randrange(10**6)}" for _ in range(size)]
        for i in range(12):
            own = base[: size - round(size * 0.02 * i)] + [f"e{k}" for k in range(round(size * 0.008 * i))]
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == plain_near(rows)


def test_components_match_plain_search_in_few_steps(spark, monkeypatch):
    """Random links, one path, one hub and links of a node with itself, with nodes sent and shuffled."""
    draw = random.Random(4)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)]
    links += [(300 + i, 301 + i) for i in range(40)] + [(500, 400 + i) for i in range(60)] + [(7, 7), (999, 999)]
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    plain = {x: r for x, r in root.items() if x != 999}
    table, stored, store = spark.createDataFrame(links, "a long, b long"), [], graph.store
    monkeypatch.setattr(graph, "store", lambda *a, **b: stored.append(store(*a, **b)) or stored[-1])
    alone = {x for x in plain if not any(x in (a, b) and a != b for a, b in links)}
    for rows in (LIMITS.broadcast_rows, 10):
        monkeypatch.setattr(LIMITS, "broadcast_rows", rows)
        found = graph.components(table, len(links)).df.collect()
        assert len(found) == len(plain) - len(alone)
        assert {r.node: r.root for r in found} == {x: r for x, r in plain.items() if x not in alone}
    stored.clear()
    stars = spark.createDataFrame([(r.node, r.root) for r in found], "a long, b long")
    assert {tuple(r) for r in graph.components(stars, len(found)).df.collect()} == {tuple(r) for r in found}
    assert len(stored) == 1


def test_small_tables_of_near_duplicates_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, tables of a few rows are written by few tasks."""
    draw, stored = random.Random(6), []
    words, rows = sentence(draw, 120).split(), []
    for i in range(60):
        own = list(words)
        for _ in range(draw.randrange(0, 5)):
            own[draw.randrange(len(own))] = f"w{draw.randrange(9)}"
        rows.append((i, " ".join(own)))
    for module in (graph, jaccard):
        plain = module.store
        monkeypatch.setattr(module, "store", lambda *a, f=plain, **b: stored.append(f(*a, **b)) or stored[-1])
    files, drop = [], Stored.drop
    monkeypatch.setattr(Stored, "drop", lambda self: files.append(len(self.df.inputFiles())) or drop(self))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(tuple(r) for r in jaccard.near_duplicates(docs).collect()) == plain_near(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(stored) > 10 and len(files) > 5
    assert sum(files) <= len(files) * max(8, spark.sparkContext.defaultParallelism)


def test_messy_rows_hold_what_they_should():
    texts = [r[1] for r in messy_rows()]
    assert None in texts and "" in texts and max(len(t or "") for t in texts) > 20_000
