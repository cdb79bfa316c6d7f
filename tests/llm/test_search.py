import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from veilspark.llm import heaps, lexical, spelling, topk

VECTORS = "vec_id long, embedding array<float>, score string, `rank` string, number string"


def plain_variants(rows, least_letters=6, least_count=5, ratio=5):
    """Every pair of words compared."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found, forms = {}, {}
    for w, n in words.items():
        others = sorted((-words[x], x) for x in words if x != w and near(w, x))
        if others and -others[0][0] >= ratio * n:
            forms[w] = others[0][1]
        found[w] = (n, len(others))
    out = set()
    for w, (n, n_near) in found.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, n_near, words.get(forms.get(w))))
    return out


def spelled_rows():
    draw = random.Random(5)
    long = "".join(draw.choice("abcdeé") for _ in range(300))
    words = ["harbour", "harbor", "harbours", "aabbaa", "aabaa", "abbaaa", "ÉCLAIR", "éclair", "Straße", "strasse", long, long[:150] + long[151:], long[:-1] + "z"]
    rows = []
    for i, word in enumerate(words):
        rows += [(j, f"{word} x{word}1{word.upper()}") for j in range(5 * (1 + i % 3) ** 3)]
    base = "".join(draw.choice("abc") for _ in range(7))
    for i in range(400):
        at = draw.randrange(7)
        rows.append((1000 + i, f"{base} {base[:at] + draw.choice('abcd') + base[at + 1:]} {base[:at] + base[at + 1:]} {base[:at]}a{base[at:]}"))
    rows += [(None, "harbour HARBOR"), (None, None), (3, ""), (4, "123 ×× ÷ 漢字"), (5, "harbour" * 400)]
    return rows


def as_set(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("plain", [64, 4])
def test_variants_match_all_pairs(spark, monkeypatch, plain):
    monkeypatch.setattr(spelling, "PLAIN", plain)
    rows = spelled_rows()
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, word string, n string")
    found = spelling.variants(docs.repartition(3))
    expected = plain_variants(rows)
    assert found.count() == len(expected)
    assert as_set(found) == expected
    chained = [r for r in expected if r[1] and r[1] != r[2]]
    assert chained and any(len(r[0]) > 64 and r[1] for r in expected)


def test_variants_of_messy_rows(spark, messy, empty, tiny_limits):
    found = spelling.variants(messy, least_letters=3, least_count=2, ratio=2)
    assert as_set(found) == plain_variants([(r.doc_id, r.text) for r in messy.collect()], 3, 2, 2)
    assert spelling.variants(empty).count() == 0


def plain_top(rows, k, scale=1024):
    part = []
    for number, (key, v, *_) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(x * scale) for x in v]
            if all(abs(x) <= math.floor(math.sqrt(2.0**62 / max(1, len(v)))) for x in whole):
                part.append((number, key, whole))
    out = Counter()
    for number, key, v in part:
        if key is not None and key % 100 == 0:
            scores = [
                (-sum(a * b for a, b in zip(v, w)), other is None, other or 0)
                for n, other, w in part
                if n != number and len(w) == len(v)
            ]
            for rank, (score, none, other) in enumerate(sorted(scores)[:k], 1):
                out[(key, rank, None if none else other, -score)] += 1
    return out


def vectors(dims=40, count=700):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1 / (1 + d % 9)) for d in range(dims)], "s", "r", "n") for i in range(count)]
    same = [0.5] * dims
    rows += [(100 * i, same, "s", "r", "n") for i in range(20)] + [(7, same, "s", "r", "n")] * 30
    rows += [
        (None, same, "s", "r", "n"),
        (800, None, "s", "r", "n"),
        (900, [1.0, None], "s", "r", "n"),
        (1000, [float("nan")] * dims, "s", "r", "n"),
        (1100, [float("-inf")] * dims, "s", "r", "n"),
        (1200, [], "s", "r", "n"),
        (1201, [], "s", "r", "n"),
        (1300, [0.25, 2.0], "s", "r", "n"),
        (1301, [1.0, -2.0], "s", "r", "n"),
        (-1400, [2.0e6, 1.0e5], "s", "r", "n"),
        (1500, [3.0e38] * dims, "s", "r", "n"),
    ]
    return [(k, None if v is None else [None if x is None else float(x) for x in v], *r) for k, v, *r in rows]


@pytest.mark.parametrize("bytes_", [1 << 20, 2000])
def test_top_k_matches_all_pairs(spark, monkeypatch, bytes_):
    monkeypatch.setattr(heaps, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(heaps, "FAN", 2)
    monkeypatch.setattr(topk, "FIRST", 4)
    monkeypatch.setattr(topk, "ROWS", 30)
    rows = [tuple(r) for r in spark.createDataFrame(vectors(), VECTORS).collect()]
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    found = topk.top_k(table, lambda key: key % 100 == 0)
    got = Counter((r.query_key, r["rank"], r.key, r.score) for r in found.collect())
    assert got == plain_top(rows, 10)
    assert topk.top_k(table.limit(0), lambda key: key % 100 == 0).count() == 0


def plain_rank(docs, items, k=20):
    terms = lambda text: [
        re.sub("[A-Z]", lambda m: m[0].lower(), t)
        for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    ]
    counted = [(key, Counter(terms(text))) for key, text in docs]
    total, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    frequency = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for key, held in counted:
            if held:
                m = 75 + (25 * sum(held.values()) * total) // length
                score = sum(
                    math.floor(1000 * math.log((2 * total + 2) / (2 * frequency[t] + 1)))
                    * ((1_000_000_000 * held[t]) // (1000 * held[t] + 12 * m))
                    for t in terms(text)
                    if held[t]
                )
                if score > 0:
                    scores.append((-score, key is None, key or 0))
        for rank, (score, none, key) in enumerate(sorted(scores)[:k], 1):
            out[(item, rank, None if none else key, -score)] += 1
    return out


ITEMS = [
    (1, "the of andS hunter2hunter2 É"),
    (2, "one\x00two two_TWO 漢字🙂"),
    (2, "one\x00two two_TWO 漢字🙂"),
    (3, None),
    (4, ""),
    (5, "nowhere-at-all"),
    (None, "password = token"),
    (6, "of " * 50 + "a b"),
]


@pytest.mark.parametrize("bytes_", [1 << 20, 60])
def test_rank_matches_plain_search(spark, messy, empty, monkeypatch, bytes_):
    monkeypatch.setattr(heaps, "BLOCK_BYTES", bytes_)
    monkeypatch.setattr(heaps, "FAN", 2)
    monkeypatch.setattr(lexical, "CELLS", 64)
    items = spark.createDataFrame([(*i, "x", "y") for i in ITEMS], "item_id long, text string, item string, term string")
    found = lexical.rank(messy, items)
    got = Counter((r.item_key, r["rank"], r.key, r.score) for r in found.collect())
    assert got == plain_rank([(r.doc_id, r.text) for r in messy.collect()], ITEMS)
    if bytes_ > 60:
        assert lexical.rank(empty, items).count() == 0
        assert lexical.rank(messy, items.limit(0)).count() == 0
