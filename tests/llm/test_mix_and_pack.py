import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import cube, langid, pack


def plain_targets(sizes):
    """By source: weights 1, 2, 3 by name, null last; capped at three times the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**share, **{s: 3 * sizes[s] for s in capped}}
        capped |= over


def test_mix_meets_targets(messy, empty):
    columns = ["key", "size", "source_size", "target", "copies", "row.source", "row.text"]
    rows = cube.mix(messy, carry=True).select(*columns).collect()
    sizes = defaultdict(int)
    for r in messy.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    wanted, taken, largest = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= largest[s] / 2
    assert len(rows) == messy.count()
    assert cube.mix(empty).count() == 0
    assert cube.take(empty).count() == 0


def test_mix_reruns_agree_and_take_repeats(messy):
    key = lambda df: Counter((r.key, r.size, r.copies) for r in df.collect())
    first = key(cube.mix(messy))
    assert first == key(cube.mix(messy.repartition(3)))
    taken = cube.take(messy)
    assert taken.columns == messy.columns
    assert taken.count() == sum(copies * n for (_, _, copies), n in first.items())


def test_flight_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK_UNITS", 50)
    draw = np.random.default_rng(5)
    docs = spark.createDataFrame(
        [(i, "w " * int(draw.integers(1, 200)), "hot" if i % 3 else "b") for i in range(900)],
        "doc_id long, text string, source string",
    )
    rows = cube.mix(docs).groupBy("target").agg({"copies": "count", "size": "sum"}).collect()
    taken = Counter()
    for r in cube.mix(docs).collect():
        taken[r.target] += r.size * r.copies
    assert len(rows) == 2
    for target, words in taken.items():
        assert abs(words - target) <= 5


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(2)
    sizes, pi = draw.integers(1, 500, 400), np.full(400, 0.3)
    moved = cube.flight(pi, sizes, 9)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert (moved * sizes).sum() == pytest.approx((pi * sizes).sum())
    assert moved.sum() == pytest.approx(pi.sum())
    landed = cube.land(pi, sizes, 9)
    assert set(landed.tolist()) <= {0.0, 1.0}
    assert abs((landed * sizes).sum() - (pi * sizes).sum()) <= 1


def test_pack_places_every_id_once(messy, empty):
    rows = pack.pack(messy, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in messy.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected[(r.doc_id, tuple(ids))] += 1
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs[r.key].append(r)
        sequences[r.sequence_id].append(r)
    got = Counter()
    for key, pieces in docs.items():
        starts = Counter((p.start, p.doc_tokens) for p in pieces)
        copies = starts[(0, pieces[0].doc_tokens)]
        if key is None or len({p.doc_tokens for p in pieces}) > 1:
            continue
        pieces.sort(key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in pieces[::copies]), "<u4")
        got[(key, tuple(ids.tolist()))] += copies
    assert got == Counter({k: n for k, n in expected.items() if k[0] is not None})
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in expected.items())
    for pieces in sequences.values():
        pieces.sort(key=lambda p: p.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= 2048
    full = sum(r.length for r in rows) / 2048
    assert len(sequences) <= full + 1 + 0.02 * full
    assert pack.pack(empty).count() == 0


def test_rank_file_gives_the_same_ids():
    fast = pack.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = pack.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", " a  b\n\n c ", "it's 12345 ###$$$ ÉÀ 漢字 🙂", "x<|endoftext|>y", "  　 z\r\n"]:
        assert fast(text).tolist() == slow(text).tolist()


def test_balance_keeps_capacity_with_little_padding():
    draw = np.random.default_rng(3)
    sizes = np.concatenate([[n for _, n in pack.cuts(int(x), i) if n < 2048] for i, x in enumerate(draw.integers(1, 9000, 900))])
    spot = pack.balance(sizes)
    sums = np.bincount(spot, weights=sizes)
    assert sums.max() <= 2048 and sizes.sum() / (2048 * len(sums)) > 0.99
    assert (pack.balance(np.full(700, 410)) >= 0).all()


def test_language_identification(spark, empty, messy):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, rows=600)
    rows = langid.identify(docs, model).join(docs.selectExpr("doc_id as key", "lang"), "key").collect()
    held = [r for r in rows if zlib.crc32(str(r.key).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    found = {(r.key, r.score == 0.0): r for r in langid.identify(messy, model).collect()}
    for key in (4, 5, 6, 12, None):
        assert found[(key, True)].lang_pred == "und" and found[(key, True)].rejected
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(messy, none).collect()} == {"und"}
    kept = langid.keep_known(messy, model)
    assert kept.columns == messy.columns and kept.where("doc_id in (0, 7, 9)").count() == 3


def test_counts_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    text = "the quick Ünïcode 漢字 fox " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "BLOCK", 17)
    assert (langid.counts(text) == whole).all()


def test_no_language_is_left_out_of_training(spark):
    """Each of 230 languages is written in an alphabet of its own."""
    draw, docs = random.Random(6), []
    for i in range(230):
        letters = [chr(0x4E00 + 20 * i + k) for k in range(20)]
        for k in range(12):
            text = " ".join("".join(draw.choices(letters, k=5)) for _ in range(30))
            docs.append((f"{i}-{k}", text, f"l{i:03}"))
    table = spark.createDataFrame(docs, "doc_id string, text string, lang string").repartition(4)
    model = langid.train(table)
    assert model.languages == sorted({x[2] for x in docs})
    assert model.scores.shape == (1 << 13, 230)
