"""Partitioning against an independent plain-Python Mondrian, and its invariants."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from veilspark import PrivacySpec, anonymise, audit_classes, encode_identifiers, partition, violations
from veilspark.plans import mondrian

SCHEMA = "id bigint, q1 double, q2 string, q3 bigint, s string"


def table(seed, rows):
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        out.append(
            (
                i,
                rnd.choice([None, *[x / 4 for x in range(30)]]),
                rnd.choice([None, "a", "b", "c", "d", "e"]),
                7 if seed % 2 else rnd.randrange(10) ** 2,
                rnd.choice(["flu", "flu", "flu", "cold", "gout", None]),
            )
        )
    rnd.shuffle(out)
    return out


def spec_for(df, **kw):
    return PrivacySpec.for_table(df, sensitive="s", order_by="id", **kw)


def expected_partitions(rows, k, l, p, model):
    """Sets of ids, straight from the definition; nulls of numbers go right."""
    rows = sorted(rows)
    kinds = {1: "n", 2: "c", 3: "n"}

    def span(part, c):
        if kinds[c] == "c":
            return len({r[c] for r in part})
        known = [r[c] for r in part if r[c] is not None]
        return max(known) - min(known) if known else 0

    full = {c: span(rows, c) for c in kinds}
    share = {}
    for r in rows:
        if r[4] is not None:
            share[r[4]] = share.get(r[4], 0) + 1 / len(rows)

    def ok(part):
        if len(part) < k:
            return False
        if model == "l":
            return len({r[4] for r in part}) >= l
        if model == "t":
            return all(
                abs(sum(r[4] == v for r in part) / len(part) - q) <= p + 1e-12 for v, q in share.items()
            )
        return True

    def halves(part, c):
        if kinds[c] == "c":
            seen = list(dict.fromkeys(r[c] for r in part))
            chosen = seen[: len(seen) // 2]
            return [r for r in part if r[c] in chosen], [r for r in part if r[c] not in chosen]
        known = [r[c] for r in part if r[c] is not None]
        if not known:
            return [], part
        middle = statistics.median(known)
        is_left = lambda r: r[c] is not None and r[c] < middle
        return [r for r in part if is_left(r)], [r for r in part if not is_left(r)]

    def finished(part):
        """The final partitions below one: its own rows if no feature splits it validly."""
        wide = lambda c: span(part, c) / full[c] if full[c] else 0
        tried = (halves(part, c) for c in sorted(kinds, key=wide, reverse=True))
        valid = next((pair for pair in tried if all(h and ok(h) for h in pair)), None)
        if valid is None:
            return {frozenset(r[0] for r in part)}
        return finished(valid[0]) | finished(valid[1])

    return finished(rows)


def found_partitions(df):
    groups = {}
    for r in df.select("id", "partition_id").collect():
        groups.setdefault(r[1], set()).add(r[0])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("model", ["k", "l", "t"])
@pytest.mark.parametrize("seed", [1, 2])
def test_local_finish_matches_definition(spark, model, seed):
    rows = table(seed, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    spec = spec_for(df, k=4, l=2, p=0.25)
    assert found_partitions(partition(df, spec, model)) == expected_partitions(rows, 4, 2, 0.25, model)


@pytest.mark.parametrize("model", ["k", "l", "t"])
def test_distributed_levels_match_definition(spark, model):
    rows = table(4, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    spec = spec_for(df, k=12, l=3, p=0.2)
    found = found_partitions(partition(df, spec, model, local_cells=0))
    assert found == expected_partitions(rows, 12, 3, 0.2, model)


def test_distributed_plans_without_small_sides(spark, tiny_limits):
    rows = table(6, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    spec = spec_for(df, k=15, l=2, p=0.25)
    found = found_partitions(partition(df, spec, "t", local_cells=20))
    assert found == expected_partitions(rows, 15, 2, 0.25, "t")


def test_hybrid_and_input_layout_do_not_matter(spark):
    df = spark.createDataFrame(table(8, 400), SCHEMA)
    spec = spec_for(df, k=5)
    whole = found_partitions(partition(df.repartition(1), spec, "l"))
    assert whole == found_partitions(partition(df.repartition(17), spec, "l", local_cells=100))


@pytest.mark.parametrize("model", ["k", "l", "t"])
def test_anonymised_rows_satisfy_the_model(spark, model):
    df = spark.createDataFrame(table(3, 500), SCHEMA)
    spec = spec_for(df, k=5, l=3, p=0.3)
    out = anonymise(df, spec, model, keep_partition_id=True)
    assert out.count() == 500
    assert out.select("id").distinct().count() == 500
    assert out.columns == [*df.columns, "partition_id"]
    assert out.groupBy("partition_id").agg({"q1": "count"}).count() == (
        out.select("partition_id", "q1", "q2", "q3").distinct().count()
    )
    found = violations(audit_classes(out, spec)).first()
    assert found["rows"] == 500 and found["k_violations"] == 0
    if model == "l":
        assert found["l_violations"] == 0


def test_generalised_values(spark):
    rows = [(1, 1.5, "x", 1, "a"), (2, 2.9, None, 1, "b"), (3, None, "y", 1, "a"), (4, 3.9, "x", 1, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    spec = spec_for(df, k=4)
    one = anonymise(df, spec, "k").orderBy("id").collect()
    assert [r.q1 for r in one] == [2] * 4
    assert [r.q2 for r in one] == ["x|nan|y"] * 4
    ranged = anonymise(df, spec, "k", numeric="range").first()
    assert ranged.q1 == "1.5 - 3.9"
    assert abs(anonymise(df, spec, "k", numeric="mean").first().q1 - 8.3 / 3) < 1e-9


def test_codes_of_partitions_are_those_of_rows(spark):
    make = [(i, f"n{i % 40}", f"p{i % 23}" if i % 9 else None, i % 90, "xyz"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(make, "id int, name string, plate string, age int, s string").repartition(5)
    labels = [{"name": c, "type": t, "identifier": True} for c, t in (("name", "n"), ("plate", "p"), ("s", "s"))]
    spec = PrivacySpec.for_table(df, "s", "id", features=["name", "plate", "age"], k=6)
    plain = anonymise(df, spec, "k", keep_partition_id=True).withColumn("_depth", F.length("partition_id"))
    expected = encode_identifiers(plain, labels, ["_depth", "partition_id", "id"]).drop("_depth")
    seen = []

    def coded(values):
        seen.append(values.count())
        placed = values.withColumn("_depth", F.length("partition_id"))
        return encode_identifiers(placed, labels[:2], ["_depth", "partition_id"]).drop("_depth")

    found = anonymise(df, spec, "k", keep_partition_id=True, common_values=coded)
    found = encode_identifiers(found.withColumn("_depth", F.length("partition_id")), labels[2:], ["_depth", "partition_id", "id"])
    assert sorted(map(str, found.drop("_depth").collect())) == sorted(map(str, expected.collect()))
    assert seen == [found.select("partition_id").distinct().count()] and seen[0] < 60


def test_max_partitions_keeps_that_many(spark):
    df = spark.createDataFrame(table(10, 200), SCHEMA)
    out = anonymise(df, spec_for(df, k=5), "k", max_partitions=3, keep_partition_id=True)
    assert out.select("partition_id").distinct().count() == 3


def test_splitting_before_finishing_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame(table(9, 400), SCHEMA)
    spec = spec_for(df, k=5)
    whole = found_partitions(partition(df, spec, "t"))
    monkeypatch.setattr(mondrian, "SERIAL_CELLS", 0)
    assert whole == found_partitions(partition(df, spec, "t"))


def test_unknown_model_and_numeric_sensitive(spark):
    df = spark.createDataFrame(table(1, 10), SCHEMA)
    with pytest.raises(ValueError):
        anonymise(df, spec_for(df), "x")
    numeric = PrivacySpec.for_table(df, sensitive="q3", order_by="id")
    with pytest.raises(ValueError):
        anonymise(df, numeric, "t")
