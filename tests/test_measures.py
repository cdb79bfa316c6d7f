"""Uniqueness, spans, splits, classes and distances against plain Python."""

import random
import statistics
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from veilspark import (
    PrivacySpec,
    audit_classes,
    combination_uniqueness,
    diversity,
    full_spans,
    generalise_partitions,
    global_frequencies,
    spans,
    split_side,
    t_distance,
    uniqueness,
    violations,
)
from veilspark.operators import uniqueness as uniqueness_module
from veilspark.plans import ranking, storage

COLUMNS = ["a", "b", "c"]


def rows(n=120, seed=7):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice(v)
    return [
        (i, pick(None, 1.5, 2.5, float("nan")), pick("x", "y", None), pick(1, 2, 3, 4), pick("p", "p", "p", "q", "r", None))
        for i in range(n)
    ]


def frame(spark, data=None):
    return spark.createDataFrame(data or rows(), "id int, a double, b string, c int, s string")


def clean(value):
    return None if value != value else value


def distinct(data, positions):
    return len({tuple(clean(r[p]) for p in positions) for r in data})


def test_uniqueness(spark):
    got = {r.name: r.percent for r in uniqueness(frame(spark), COLUMNS).collect()}
    expected = {c: 100 * distinct(rows(), [i]) / 120 for i, c in enumerate(COLUMNS, 1)}
    assert got == pytest.approx(expected)
    rough = {r.name: r.percent for r in uniqueness(frame(spark), COLUMNS, approx=True).collect()}
    assert rough == pytest.approx(expected, rel=0.1)


@pytest.mark.parametrize("max_size, approx", [(None, False), (2, False), (2, True)])
def test_combination_uniqueness(spark, max_size, approx):
    found = combination_uniqueness(frame(spark), COLUMNS, max_size, approx).orderBy("position").collect()
    wanted = [c for n in range(1, (max_size or 3) + 1) for c in combinations(range(3), n)]
    assert [r.columns for r in found] == [", ".join(COLUMNS[i] for i in c) for c in wanted]
    expected = [100 * distinct(rows(), [i + 1 for i in c]) / 120 for c in wanted]
    assert [r.percent for r in found] == pytest.approx(expected, rel=0.1 if approx else 1e-9)


def test_many_columns_are_walked_by_size(spark, monkeypatch):
    """13 columns; some combinations are fully unique at size 1 and 2, some never are."""
    monkeypatch.setattr(uniqueness_module, "SETS", 100)
    draw = random.Random(2)
    table = [
        (i, i // 2, i % 2, *[draw.choice([None, "a", "b"]) for _ in range(5)], 1, *[draw.random() < 0.5] * 2, i % 7, None)
        for i in range(60)
    ]
    names = ["id", "with.dot", *[f"c{i}" for i in range(2, 13)]]
    types = ["int", "int", "int", *["string"] * 5, "int", "boolean", "boolean", "int", "string"]
    df = spark.createDataFrame(table, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))
    found = {r.position: (r.columns, r.percent) for r in combination_uniqueness(df, df.columns, 3).collect()}
    wanted = [c for n in range(1, 4) for c in combinations(range(13), n)]
    assert len(found) == len(wanted)
    for i, c in enumerate(wanted):
        assert found[i] == (", ".join(names[k] for k in c), 100.0 * distinct(table, c) / 60)
    assert combination_uniqueness(df.limit(0), df.columns, 3).count() == 0


def test_many_rows_make_jobs_of_fewer_combinations(spark, monkeypatch):
    monkeypatch.setattr(uniqueness_module, "SETS", 10)
    monkeypatch.setattr(uniqueness_module, "TASK_PRINTS", 100)
    plain, seen = uniqueness_module._counted, []

    def counted(held, names, rows, sets):
        seen.append((held.rows * len(sets), uniqueness_module.partition_count(held.df)))
        return plain(held, names, rows, sets)

    monkeypatch.setattr(uniqueness_module, "_counted", counted)
    table = [(i % 2, i % 3, i % 5, i % 7) for i in range(40)]
    df = spark.createDataFrame(table, "a int, b int, c int, d int").coalesce(1)
    found = {r.position: r.percent for r in combination_uniqueness(df, df.columns).collect()}
    wanted = [c for n in range(1, 5) for c in combinations(range(4), n)]
    assert found == {i: 100.0 * distinct(table, c) / 40 for i, c in enumerate(wanted)}
    assert all(prints <= max(100 * tasks, 40) for prints, tasks in seen)


def expected_distances(data, values="all"):
    share = Counter(r[4] for r in data if r[4] is not None)
    groups = {}
    for r in data:
        groups.setdefault(r[3], []).append(r[4])
    out = {}
    for g, members in groups.items():
        held = Counter(members)
        considered = share if values == "all" else [v for v in held if v is not None]
        out[g] = max((abs(held[v] / len(members) - share[v] / len(data)) for v in considered), default=0.0)
    return out


SPARSE = [(i, 0.0, "x", i % 9, "v%d" % (i % 9 if i % 4 else (i // 9) % 25)) for i in range(400)]


@pytest.mark.parametrize("values", ["all", "present"])
@pytest.mark.parametrize("data", [rows(), SPARSE, [(1, 0.0, "x", 1, None), (2, 0.0, "x", 2, "v")]])
def test_distance(spark, values, data):
    got = {r.c: r.distance for r in t_distance(frame(spark, data), ["c"], "s", values).collect()}
    assert got == pytest.approx(expected_distances(data, values))


def test_distance_without_small_sides(spark, tiny_limits):
    got = {r.c: r.distance for r in t_distance(frame(spark, SPARSE), ["c"], "s").collect()}
    assert got == pytest.approx(expected_distances(SPARSE))


def test_frequencies_and_diversity(spark):
    got = {r.value: r.q for r in global_frequencies(frame(spark), "s").collect()}
    held = Counter(r[4] for r in rows())
    assert got == pytest.approx({v: n / 120 for v, n in held.items() if v is not None})
    found = {r.c: r.diversity for r in diversity(frame(spark), ["c"], "s").collect()}
    assert found == {c: len({r[4] for r in rows() if r[3] == c}) for c in (1, 2, 3, 4)}


def test_audit_counts_null_classes(spark):
    df = frame(spark)
    spec = PrivacySpec.for_table(df, "s", "id", features=["a", "b"], k=20, l=4, p=0.1)
    audit = audit_classes(df, spec).collect()
    sizes = Counter((clean(r[1]), r[2]) for r in rows())
    assert {(r.a, r.b): r["size"] for r in audit} == dict(sizes)
    assert all(r.k_anonymous == (r["size"] >= 20) and r.l_diverse == (r.diversity >= 4) for r in audit)
    total = violations(audit_classes(df, spec)).first()
    assert total["rows"] == 120 and total.classes == len(sizes)
    assert total.k_violations == sum(n < 20 for n in sizes.values())


def test_spans(spark):
    data = [(1, 1.0, "x", 1, "g"), (2, 4.0, None, 1, "g"), (3, None, "y", 1, "h"), (4, 2.0, "y", 1, "h")]
    df = frame(spark, data)
    spec = PrivacySpec.for_table(df, "s", "id", features=["a", "b", "c"])
    full = full_spans(df, spec)
    assert full == {"a": 3.0, "b": 3.0, "c": 0.0}
    got = {(r.s, r.column): r.span for r in spans(df, spec, "s", full).collect()}
    expected = {
        ("g", "a"): 1.0, ("g", "b"): 2 / 3, ("g", "c"): 0.0,
        ("h", "a"): 0.0, ("h", "b"): 1 / 3, ("h", "c"): 0.0,
    }
    assert got == pytest.approx(expected)


def check_sides(spark):
    data = [(1, 1.0, "x", 0, "g"), (2, 2.0, "y", 0, "g"), (3, 3.0, None, 0, "g"), (4, 10.0, "z", 0, "g"), (5, None, "x", 0, "g")]
    df = frame(spark, data * 1)
    spec = PrivacySpec.for_table(df, "s", "id")
    side = lambda c: [r.side for r in split_side(df, spec, c, "s").orderBy("id").collect()]
    assert side("a") == ["left", "left", "right", "right", "right"]
    assert side("b") == ["left", "left", "right", "right", "left"]


def test_split_side(spark):
    check_sides(spark)


def test_split_side_by_distributed_sort(spark, tiny_limits):
    check_sides(spark)


def test_generalise_given_partitions(spark):
    df = frame(spark).withColumn("partition_id", F.concat(F.lit("0"), F.col("c").cast("string")))
    spec = PrivacySpec.for_table(df.drop("partition_id"), "s", "id", features=["a", "b"])
    out = generalise_partitions(df, spec).collect()
    assert len(out) == 120
    for c in (1, 2, 3, 4):
        members = [r for r in rows() if r[3] == c]
        known = [r[1] for r in members if clean(r[1]) is not None]
        seen = "|".join(dict.fromkeys(str(r[2]).replace("None", "nan") for r in members))
        assert {(r.a, r.b) for r in out if r.c == c} == {(int(sum(known) / len(known)), seen)}
    first = generalise_partitions(df, spec, max_partitions=2)
    assert {r.c for r in first.collect()} == {1, 2}
    with pytest.raises(ValueError):
        generalise_partitions(df, spec, numeric="other")


def test_equal_lists_stand_together(spark):
    rows = [(i, f"v{i % 11}", "s", i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, s string, part int").repartition(3)
    spec = PrivacySpec.for_table(df, "s", "id", features=["a"])
    out = generalise_partitions(df, spec, "part").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.id for r in out) == list(range(400))
    runs = sum(1 for x, y in zip(out, out[1:]) if (x.task, x.a) != (y.task, y.a))
    assert runs <= 5 + 4


def test_large_sides_are_not_broadcast():
    assert not storage.Stored(None, "", {"rows": 400_000, "bytes": 40 << 20}).small
    assert storage.Stored(None, "", {"rows": 400_000, "bytes": 8 << 20}).small


def test_combinations_run_in_batches(spark, monkeypatch):
    from veilspark.operators import uniqueness

    rows = [(i % 2, i % 3, i % 5, None if i % 7 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "`a.x` int, b int, `c``y` int, d int")
    whole = uniqueness.combination_uniqueness(df, df.columns).collect()
    monkeypatch.setattr(uniqueness, "SETS", 4)
    assert sorted(uniqueness.combination_uniqueness(df, df.columns).collect()) == sorted(whole)
    assert len(whole) == 15 and {r["columns"] for r in whole} >= {"a.x", "a.x, b, c`y, d"}


def test_null_partitions_and_nan_are_values_of_their_own(spark):
    from veilspark import PrivacySpec, generalise_partitions, split_side, spans, to_interval
    from veilspark.operators.pseudonymise import encode_text

    rows = [(i, None if i < 4 else "p", float("nan") if i % 4 == 0 else float(i), "s") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, part string, x double, s string")
    spec = PrivacySpec.for_table(df, sensitive="s", order_by="id", features=["x"])
    common = {r["id"]: r["x"] for r in generalise_partitions(df, spec, "part").collect()}
    assert common[0] == common[3] == 2 and common[4] == common[7] == 6
    sides = {r["id"]: r["side"] for r in split_side(df, spec, "x", "part").collect()}
    assert sides[1] == "left" and sides[3] == "right" and sides[0] == "right" and sides[5] == "left"
    assert {r["part"]: r["span"] for r in spans(df, spec, "part").collect()} == {None: 2.0, "p": 2.0}
    assert to_interval(df, "x", spec)[0].where("id = 4").first()["x"] is None
    assert encode_text(df, "x", "id").where("id = 4").first()["x"] == -1


def test_ages_with_many_leading_zeros_are_numbers(spark):
    from veilspark import label_columns

    df = spark.createDataFrame([("0" * 30 + "25",), ("31",)], "age string")
    assert "human age" in {r["type"] for r in label_columns(df).collect()}


@pytest.mark.parametrize("sketch", [1000, 8])
def test_medians_of_skewed_groups(spark, tiny_limits, monkeypatch, sketch):
    """One group holds most rows; values repeat, differ by little, are huge, or are null."""
    monkeypatch.setattr(ranking, "SKETCH", sketch)
    draw = random.Random(9)
    data = [("hot", draw.choice([draw.gauss(0, 1e-9), 5.0, 1e300 * draw.random()])) for _ in range(3000)]
    data += [("few", 1.0), ("few", 2.0), ("one", -7.5), ("none", None), (None, 3.0), (None, 9.0), (None, None)]
    data += [("same", 4.0)] * 300 + [("even", float(i // 2)) for i in range(400)] + [("ends", float("inf")), ("ends", 0.0)]
    df = spark.createDataFrame(data, "g string, `the.value` double").repartition(5)
    found = {r.g: r.median for r in ranking.group_medians(df, ["g"], "the.value").collect()}
    groups = {}
    for g, x in data:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert found == {g: statistics.median(xs) for g, xs in groups.items()}
