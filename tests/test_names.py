"""Columns whose names hold dots, spaces or backticks give what plain names give."""

import random

import pytest

from veilspark import (
    PrivacySpec,
    anonymise,
    audit_classes,
    diversity,
    encode_text,
    full_spans,
    generalise,
    generalise_partitions,
    global_frequencies,
    partition,
    pseudonymise_email,
    spans,
    split_side,
    t_distance,
    term_dictionary,
    to_interval,
)

PLAIN = ["id", "age", "town", "mail", "ill", "part"]
ODD = ["the.id", "age.in years", "to`wn", "c.mail", "is.ill", "par.t"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(4)
    rows = [
        (i, draw.choice([None, *map(float, range(20, 40))]), draw.choice(["x", "y", None, "z"]), f"a{i % 7}@b.hu",
         draw.choice(["p", "q", None]), draw.choice(["0", "1"]))
        for i in range(80)
    ]
    plain = spark.createDataFrame(rows, "id int, age double, town string, mail string, ill string, part string")
    return {"plain": (plain, PLAIN), "odd": (plain.toDF(*ODD), ODD)}


def run_all(df, names):
    key, age, town, mail, ill, part = names
    spec = PrivacySpec.for_table(df, ill, key, features=[age, town], k=5, l=2, p=0.4)
    regions = df.sparkSession.createDataFrame([("x", "r1"), ("y", "r2")], "term string, value string")
    return {
        "encode": encode_text(df, mail, key),
        "keyed": pseudonymise_email(df, mail, key="k"),
        "interval": to_interval(df, age, spec)[0],
        "generalise": generalise(df, town, regions),
        "anonymise k": anonymise(df, spec, "k", keep_partition_id=True),
        "anonymise levels": anonymise(df, spec, "l", local_cells=0),
        "partition": partition(df, spec, "t"),
        "generalise partitions": generalise_partitions(df, spec, part),
        "spans": spans(df, spec, part),
        "split number": split_side(df, spec, age, part),
        "split text": split_side(df, spec, town, part),
        "audit": audit_classes(df, spec),
        "diversity": diversity(df, [town, part], ill),
        "distance": t_distance(df, [town, part], ill),
        "frequencies": global_frequencies(df, ill),
        "terms": term_dictionary(df, town),
    }, full_spans(df, spec)


def test_odd_names_change_nothing(tables):
    found = {kind: run_all(*own) for kind, own in tables.items()}
    back = dict(zip(ODD, PLAIN))
    assert {back[c]: x for c, x in found["odd"][1].items()} == found["plain"][1]
    for name, plain in found["plain"][0].items():
        odd = found["odd"][0][name]
        assert [back.get(c, c) for c in odd.columns] == plain.columns, name
        rows = [sorted(repr([back.get(x, x) for x in r]) for r in df.collect()) for df in (odd, plain)]
        assert rows[0] == rows[1], name


def test_random_tokens_under_an_odd_name(tables):
    df, names = tables["odd"]
    got = pseudonymise_email(df, names[3], "random")
    assert got.columns == df.columns and len({r[3] for r in got.collect()}) == 7
