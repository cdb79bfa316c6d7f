import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilspark import (
    PSEUDONYMISERS,
    PrivacySpec,
    encode_identifiers,
    encode_text,
    fill_missing,
    fold,
    generalise,
    pseudonymise_email,
    pseudonymise_labelled,
    region_dictionary,
    register_pseudonymiser,
    strip,
    to_interval,
    with_row_order,
)
from veilspark.operators import pseudonymise as module
from veilspark.plans import storage

EMAILS = [
    "Anna@Mail.hu", "anna@mail.hu", "a@b@c.d.e", "o'hara@mail.hu", None, "broken", "zoé@mail.com",
    "anna@other.hu",
]


def emails(spark):
    return spark.createDataFrame(list(enumerate(EMAILS)), "id int, email string")


def test_fold_and_strip(spark):
    df = spark.createDataFrame(
        [("ÁRVÍZTŰRŐ TÜKÖRFÚRÓGÉP",), ("Straße æŒþ Łódź ø",), ("é",), ("  x\t\n",)], "v string"
    )
    got = [r[0] for r in df.select(fold(F.col("v"))).collect()]
    assert got[:3] == ["arvizturo tukorfurogep", "strasse aeoeth lodz o", "e"]
    assert df.select(strip(F.col("v"))).collect()[3][0] == "x"


@pytest.mark.parametrize("mode", ["keyed", "random"])
def test_email_tokens_are_consistent(spark, mode):
    out = pseudonymise_email(emails(spark), "email", mode, key="k").orderBy("id").collect()
    tokens = [r.email for r in out]
    assert tokens[0] == tokens[1] and tokens[4] == tokens[5] is not None
    local, domain, tld = zip(*(re.fullmatch(r"(\w+)@(\w+)\.(\w+)", t).groups() for t in tokens))
    assert local[0] == local[7] and domain[0] != domain[7] and tld[0] == tld[7] == tld[3]
    assert domain[0] == domain[6] and tld[0] != tld[6]
    assert len(set(local)) == 5  # anna, a@b, o'hara, the shared invalid one, zoé
    if mode == "random":
        assert [len(x) for x in (local[0], domain[0], tld[0])] == [10, 5, 4]


def test_email_parts(spark):
    parts = module.email_parts(F.col("email"))
    got = emails(spark).select("id", *[c.alias(k) for k, c in parts.items()]).orderBy("id").collect()
    assert got[2][1:] == ("a@b", "c.d", "e") and got[5][1:] == (None, None, None)


def test_email_options(spark, monkeypatch):
    nulls = pseudonymise_email(emails(spark), "email", key="k", on_invalid="null").orderBy("id").collect()
    assert nulls[4].email is None and nulls[5].email is None and nulls[0].email
    with pytest.raises(ValueError):
        pseudonymise_email(emails(spark), "email")
    with pytest.raises(ValueError):
        pseudonymise_email(emails(spark), "email", "other", key="k")
    monkeypatch.setattr(module.secrets, "token_hex", lambda n: "fixed")
    one = pseudonymise_email(emails(spark), "email", "random").orderBy("id").collect()
    assert one == pseudonymise_email(emails(spark), "email", "random").orderBy("id").collect()


@pytest.mark.parametrize("length", [1, 2, 3])
def test_every_number_has_its_own_token(spark, length):
    numbers = spark.range(0, 62**length, 1, 4)
    first, other = (module.permuted_token(F.col("id"), key, length).alias(key) for key in ("a", "b"))
    rows = numbers.select("id", first, other).collect()
    for key in ("a", "b"):
        assert len({r[key] for r in rows}) == 62**length
        assert {len(r[key]) for r in rows} == {length}
    assert sum(r.a == r.b for r in rows) < 62**length / 2
    assert sum(x.a[-1] == y.a[-1] for x, y in zip(rows, rows[1:])) < 0.1 * len(rows) + 5


def test_long_tokens_of_large_numbers(spark):
    rows = [(0,), (62**10 - 1,), (62**10 // 2,), (2**53 + 1,)]
    got = spark.createDataFrame(rows, "n long").select(module.permuted_token(F.col("n"), "k", 10).alias("t")).collect()
    assert len({r.t for r in got}) == 4 and all(re.fullmatch("[A-Za-z0-9]{10}", r.t) for r in got)


def test_no_raw_value_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "scratch_folder", lambda _: str(tmp_path))
    df = emails(spark)
    pseudonymise_email(df, "email", "random").count()
    encode_text(df, "email", "id").count()
    raw = {part for r in df.collect() if r.email for part in [r.email, *re.split("[@.]", r.email)] if len(part) > 3}
    held = b"".join(f.read_bytes() for f in tmp_path.rglob("*.parquet"))
    tables = [spark.read.parquet(str(d)) for d in tmp_path.iterdir()]
    seen = {str(x) for t in tables for r in t.collect() for x in r}
    assert tables and not raw & seen and not any(x.encode() in held for x in raw)


def test_short_tokens_do_not_collide(spark, monkeypatch):
    monkeypatch.setattr(module, "_token_length", lambda kind, parts: 2)
    rows = [(i, f"user{i}@d{i}.hu") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, email string")
    out = pseudonymise_email(df, "email", "random")
    local = F.substring_index("email", "@", 1)
    assert out.select(local).distinct().count() == 600
    assert out.select(F.length(local)).distinct().collect() == [(2,)]
    assert out.select(F.regexp_extract("email", "@(.+)[.]", 1)).distinct().count() == 600


def test_token_lengths_do_not_follow_the_size(spark, tiny_limits):
    """Many parts, looked up with heavy keys spread, keep their length."""
    rows = [(i, f"user{i % 300}@d{i % 300 if i % 2 else 0}.hu") for i in range(600)] + [(600, None)]
    df = spark.createDataFrame(rows, "id int, `with.dot` string").withColumnRenamed("with.dot", "email")
    out = pseudonymise_email(df, "email", "random", lengths={"local": 2, "domain": 2})
    assert out.columns == df.columns and out.count() == 601
    got = out.orderBy("id").collect()
    local, domain, tld = zip(*(re.fullmatch(r"(\w+)@(\w+)[.](\w+)", r.email).groups() for r in got))
    assert len(set(local)) == 301 and len(set(domain)) == 152 and len(set(tld)) == 2
    assert {len(x) for x in local + domain} == {2} and {len(x) for x in tld} == {4}
    assert all(local[i] == local[i + 300] for i in range(300))
    with pytest.raises(ValueError, match="cannot hold 301 local"):
        pseudonymise_email(df, "email", "random", lengths={"local": 1})
    with pytest.raises(ValueError):
        pseudonymise_email(df, "email", "random", lengths={"other": 3})


def expected_codes(values):
    seen = {}
    return [-1 if v is None else seen.setdefault(v, len(seen)) for v in values]


def code_input(spark):
    rnd = random.Random(3)
    values = [rnd.choice(["hot"] * 8 + [None, *"abcdefgh"]) for _ in range(150)]
    rows = [(i * 7 % 150, i) for i in range(150)]
    df = spark.createDataFrame([(i, values[i]) for _, i in sorted(rows)], "id int, v string")
    return df.repartition(7), expected_codes(values)


def test_codes_follow_first_appearance(spark):
    df, expected = code_input(spark)
    assert [r.v for r in encode_text(df, "v", "id").orderBy("id").collect()] == expected


def test_codes_by_distributed_sort_and_salted_lookup(spark, tiny_limits):
    df, expected = code_input(spark)
    out = encode_text(df, "v", ["id"])
    assert out.columns == ["id", "v"]
    assert [r.v for r in out.orderBy("id").collect()] == expected


def test_places_are_one_number_where_it_holds_them(spark):
    draw = random.Random(8)
    numbers = [None, -5, 0, 3, 1 << 40]
    rows = [(draw.choice(numbers), draw.choice([None, -2, 7]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b int, i int")
    for order in (["a", "b"], ["b"], ["b", "a"], ["a"]):
        placed = df.select("i", module._place(df, order).alias("p"), F.struct(*order).alias("s"))
        assert placed.schema["p"].dataType.simpleString() == "bigint"
        ranks = [F.dense_rank().over(Window.orderBy(c)) for c in ("p", "s")]
        assert all(r.x == r.y for r in placed.select(ranks[0].alias("x"), ranks[1].alias("y")).collect())
    wide = df.unionAll(spark.createDataFrame([(-(1 << 63), 0, 0), ((1 << 63) - 1, 0, 0)], df.schema))
    for order in (["a", "b"], ["a"]):
        assert wide.select(module._place(wide, order).alias("p")).schema["p"].dataType.simpleString()[:6] == "struct"


def test_intervals(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate([0, 9, 10, 100, -1, None])], "id int, age int")
    spec = PrivacySpec.for_table(df.withColumn("s", F.lit("x")), "s", "id")
    out, kept = to_interval(df, "age", spec)
    expected = ["0 - 9", "0 - 9", "10 - 19", "100 - 109", None, None]
    assert [r.age for r in out.orderBy("id").collect()] == expected
    assert "age" in kept.features and kept.is_categorical("age")
    assert "age" not in to_interval(df, "age", spec, keep_reference_features=True)[1].features
    assert to_interval(df, "age", spec, width=25)[0].orderBy("id").collect()[3].age == "100 - 124"


COUNTRIES = [
    ("Bolivia (Plurinational State of)", "BO", "BOL", "Americas"),
    ("Namibia", "NA", "NAM", "Africa"),
    ("Antarctica", "AQ", "ATA", None),
    ("Åland Islands", "AX", "ALA", "Europe"),
]


def test_country_to_region(spark):
    regions = region_dictionary(
        spark.createDataFrame(COUNTRIES, "name string, `alpha-2` string, `alpha-3` string, region string")
    )
    given = ["bolivia", "BOL", "Bolivia (Plurinational State of)", "NA", None, "Antarctica", "nowhere", "åland islands"]
    expected = ["Americas", "Americas", "Americas", "Africa", None, None, None, "Europe"]
    df = spark.createDataFrame(list(enumerate(given)), "id int, c string")
    assert [r.c for r in generalise(df, "c", regions).orderBy("id").collect()] == expected


def test_country_to_region_with_large_mapping(spark, tiny_limits):
    mapping = spark.createDataFrame([("hu", "Europe"), ("bo", "Americas")], "term string, value string")
    df = spark.createDataFrame([(i, "HU") for i in range(9)] + [(9, "bo"), (10, None)], "id int, c string")
    got = [r.c for r in generalise(df, "c", mapping).orderBy("id").collect()]
    assert got == ["Europe"] * 9 + ["Americas", None]


def fill_input(spark):
    rows = [(1, 1.0, "a", 1), (2, 2.0, None, 2), (3, None, "b", None), (4, 3.0, "b", 10), (5, 10.0, "b", 3)]
    return spark.createDataFrame(rows, "id int, x double, c string, n int")


def check_filled(spark):
    df = fill_input(spark)
    spec = PrivacySpec.for_table(df, "c", "id")
    got = fill_missing(df, spec).orderBy("id").collect()
    assert [r.x for r in got] == [1.0, 2.0, 2.5, 3.0, 10.0]
    assert [r.c for r in got] == ["a", "MISSING DATA", "b", "b", "b"]
    assert [r.n for r in got] == [1.0, 2.0, 2.5, 10.0, 3.0]


def test_fill_missing(spark):
    check_filled(spark)
    df = fill_input(spark)
    rough = fill_missing(df, PrivacySpec.for_table(df, "c", "id"), approximate=True)
    assert rough.where("id = 3").first().x == 2.0


def test_fill_missing_by_distributed_sort(spark, tiny_limits):
    check_filled(spark)


def test_by_label(spark):
    df = spark.createDataFrame(
        [(1, "a@b.hu", "XVG-591", 15, "s"), (2, "c@b.hu", "ABC-123", 27, "t"), (3, None, "XVG-591", 3, "s")],
        "id int, mail string, plate string, kor int, s string",
    )
    labels = spark.createDataFrame(
        [
            ("mail", 1.0, "email address", True), ("plate", 1.0, "licence plate hungarian", True),
            ("plate", 0.5, "licence plate hungarian", True), ("kor", 1.0, "human age", None),
            ("absent", 1.0, "email address", True),
        ],
        "name string, ratio double, type string, identifier boolean",
    )
    spec = PrivacySpec.for_table(df, "s", "id")
    out, changed = pseudonymise_labelled(df, labels, spec, key="k")
    coded = encode_identifiers(out, labels, "id").orderBy("id").collect()
    assert [r.plate for r in coded] == [0, 1, 0]
    assert [r.kor for r in coded] == ["10 - 19", "20 - 29", "0 - 9"]
    assert all("@" in r.mail and r.mail not in ("a@b.hu", "c@b.hu") for r in coded)
    assert changed.is_categorical("kor")


def test_registered_pseudonymiser(spark):
    register_pseudonymiser("secret", lambda df, c, spec, options: (df.withColumn(c, F.lit("***")), spec))
    try:
        df = spark.createDataFrame([(1, "x", "s")], "id int, v string, s string")
        labels = [{"name": "v", "type": "secret", "identifier": None}]
        out, _ = pseudonymise_labelled(df, labels, PrivacySpec.for_table(df, "s", "id"))
        assert out.first().v == "***"
    finally:
        del PSEUDONYMISERS["secret"]


def test_row_order(spark):
    df = with_row_order(spark.range(100).repartition(5))
    assert df.select("row_order").distinct().count() == 100
    assert df.orderBy("row_order").collect() == df.orderBy("row_order").collect()


def test_keyed_tokens_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    emails(spark).write.parquet(source)
    stream = pseudonymise_email(
        spark.readStream.schema("id int, email string").parquet(source), "email", key="k"
    )
    query = stream.writeStream.format("memory").queryName("mails").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    expected = pseudonymise_email(emails(spark), "email", key="k")
    assert sorted(spark.table("mails").collect()) == sorted(expected.collect())
