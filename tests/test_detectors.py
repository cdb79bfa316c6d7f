import ipaddress
import random

import pytest

from veilspark import DETECTORS, label_columns, name_dictionary, register_detector, with_flag
from veilspark.functions.detectors import containment_pattern
from veilspark.operators import containment

VALUES = {
    "tax number hungarian": {
        "8000000008": True, "8000000009": False, "800000000": False, "7000000007": False,
        "8000000008\n": False, "8a00000008": False, None: False,
    },
    "taj number hungarian": {"000000000": True, "100000003": True, "010000007": True, "100000004": False, "00000000": False, "000000000\n": False},
    "personal number hungarian": {"19601010004": None, "29713010004": False, "09601010004": False},
    "phone number hungarian": {
        "+36 20 954 3071": True, "06(20)9543071": True, "3620954307": True, "0620 954-3071": True,
        "+3620 9543 071": False, "x06209543071": False, "0620954307123": False, "06209543071\n": True,
    },
    "licence plate hungarian": {
        "XVG-591": True, "m 123456": True, "abcd-1-2": True, "abcde-1": True, "s-abc-123": True,
        "sp-12-34": True, "ot 12 34": True, "p-12345": True, "c-x-12-34": True, "xa1234": True,
        "xd1234": False, "abc-12": False, "cd 123 456": False,
    },
    "mac address": {
        "00:1A:2b:3c:4D:5e": True, "00:1A:2b:3c:4D:5e trailing": True, "lead 00:1A:2b:3c:4D:5e": False,
        "0011.2233.4455": True, "zzz 0011.2233.4455": False, "0011.2233.4455 x": False,
    },
    "email address": {"a@b.c": True, "a@b@c.d": True, "@b.c": False, "a@b": False, "a@b.c\nx": False, "x\na@b.c": False},
}


def flags(spark, label, values, dictionary=None):
    rows = [(i, x) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, v string")
    found = with_flag(df, "v", label, dictionary).orderBy("id").collect()
    return [r.flag for r in found]


def personal(digits):
    weights = range(10, 0, -1) if int(digits[1:3]) > 96 else range(1, 11)
    return sum(int(d) * w for d, w in zip(digits, weights)) % 11


@pytest.mark.parametrize("label", VALUES)
def test_values(spark, label):
    cases = {k: v for k, v in VALUES[label].items() if v is not None}
    assert flags(spark, label, cases) == list(cases.values())


def test_personal_number_directions(spark):
    rnd, cases = random.Random(5), {}
    for year in ("96", "97", "00", "55"):
        for _ in range(40):
            body = f"{rnd.randrange(1, 9)}{year}0{rnd.randrange(1, 10)}1{rnd.randrange(10)}{rnd.randrange(1000):03d}"
            check = personal(body)
            cases[body + str(check % 10)] = check < 10
    assert flags(spark, "personal number hungarian", cases) == list(cases.values())


def test_ip_matches_the_standard_library(spark):
    rnd = random.Random(1)
    values = ["::", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1.2.3", "256.1.1.1", "01.1.1.1", ":::", "1.2.3.4\n"]
    for _ in range(400):
        groups = [f"{rnd.randrange(65536):x}" for _ in range(rnd.randrange(1, 9))]
        values += [":".join(groups), "::".join([":".join(groups[:3]), ":".join(groups[3:])])]
        values.append(".".join(str(rnd.randrange(300)) for _ in range(4)))

    def valid(x):
        try:
            ipaddress.ip_address(x)
            return True
        except ValueError:
            return False

    values = list(dict.fromkeys(values))
    assert flags(spark, "ip address", values) == [valid(x) for x in values]
    assert flags(spark, "ip address", ["fe80::1%eth0"]) == [False]


NAMES = ["Ádám", "Anna", "Annamária", "Zoltán", "Bo"]
TEXTS = ["Dr. Szabóné Vass ANNA", "ádám", "Zoltan", "Robert", "John", "", "annnna", None, "xx" * 50 + "bo"]
HAS_NAME = [True, True, True, False, False, False, False, False, True]


@pytest.fixture(scope="module")
def names(spark):
    return name_dictionary(spark.createDataFrame([(n,) for n in NAMES], "n string"))


def test_names_inside_values(spark, names):
    assert flags(spark, "hungarian first name", TEXTS, names) == HAS_NAME


def test_names_from_a_large_dictionary(spark, names, tiny_limits):
    assert flags(spark, "hungarian first name", TEXTS, names) == HAS_NAME


def test_names_of_a_dictionary_of_any_size_in_long_texts(spark, monkeypatch):
    """30 000 names, texts of up to 33 000 letters."""
    draw = random.Random(8)
    letters = "abcdefx漢"
    known = {"".join(draw.choice(letters) for _ in range(draw.randrange(7, 13))) for _ in range(30_000)}
    monkeypatch.setattr(containment, "CHUNK", 4096)
    noise = lambda n: "".join(draw.choice(letters) for _ in range(n))
    picked = sorted(known)[:: len(known) // 20]
    texts = [noise(n) for n in (0, 3, 9, 40, 400)] + [noise(33_000) + picked[0], "z" * 33_000, None]
    texts += ["z" * draw.randrange(5000) + name + "z" * draw.randrange(50) for name in picked]
    texts += [name[:-1] for name in picked] + [picked[0] + "zz"] * 40
    table = spark.createDataFrame([(x,) for x in known], "term string")
    got = flags(spark, "hungarian first name", texts, table)
    assert got == [bool(x) and any(name in x for name in known) for x in texts]
    assert True in got and False in got


def test_pattern_drops_terms_that_start_with_another():
    assert containment_pattern(["anna", "annamaria", "adam"]) == "a(?:dam|nna)"
    assert containment_pattern([]) == "(?!)"


def terms(spark, *values):
    return spark.createDataFrame([(x,) for x in values], "term string")


def test_whole_value_dictionaries(spark):
    listed = terms(spark, "asthma", "cukorbetegseg")
    assert flags(spark, "disease name", ["Asthma", "asthma x", None], listed) == [True, False, False]
    assert flags(spark, "disease name hungarian", ["Cukorbetegség"], listed) == [True]
    assert flags(spark, "disease name", ["Cukorbetegség"], listed) == [False]


def test_whole_value_dictionary_too_large_to_broadcast(spark, tiny_limits):
    listed = terms(spark, "asthma", "flu")
    values = ["flu"] * 10 + ["Asthma", "x", None]
    assert flags(spark, "disease name", values, listed) == [True] * 11 + [False, False]


@pytest.mark.parametrize(
    "name, values, expected",
    [
        ("kor", ["9", "85", "129"], True), ("kor", ["9", "85", "150"], False),
        ("KOR", ["-1", "5"], False), ("age", ["5", "x"], False), ("years", ["5"], False),
        ("age", [None, "5"], True), ("age", [None], False), ("age", ["12.0"], False),
    ],
)
def test_age_is_a_column_test(spark, name, values, expected):
    df = spark.createDataFrame([(x,) for x in values], f"{name} string")
    found = with_flag(df, name, "human age").collect()
    assert [r.flag for r in found] == [expected and x is not None for x in values]
    labels = label_columns(df).where("type = 'human age'").collect()
    assert len(labels) == int(expected)


def test_labels(spark, names):
    check_labels(spark, names)


def test_labels_with_dictionaries_too_large_to_broadcast(spark, names, tiny_limits):
    check_labels(spark, names)


def check_labels(spark, names):
    rows = [("Anna", 5, "a@b.hu", 8000000008.0), ("x", 7, None, None), ("y", 9, "q", 1.5)]
    df = spark.createDataFrame(rows, "who string, kor int, mail string, tax double")
    dictionaries = {
        "names": names, "diseases": terms(spark, "x"), "diseases_hu": terms(spark, "y"),
        "countries": terms(spark, "q"),
    }
    found = {(r.name, r.type): (r.ratio, r.identifier) for r in label_columns(df, dictionaries).collect()}
    assert found == {
        ("who", "hungarian first name"): (1 / 3, None),
        ("who", "disease name"): (1 / 3, None),
        ("who", "disease name hungarian"): (1 / 3, None),
        ("kor", "human age"): (1.0, None),
        ("mail", "email address"): (0.5, True),
        ("mail", "country or region"): (0.5, None),
        ("tax", "tax number hungarian"): (0.5, True),
    }
    old = spark.createDataFrame(
        [("mail", 0.1, "email address", True), ("other", 1.0, "ip address", None)],
        "name string, ratio double, type string, identifier boolean",
    )
    merged = {(r.name, r.type): r.ratio for r in label_columns(df, dictionaries, old).collect()}
    assert merged[("mail", "email address")] == 0.5 and merged[("other", "ip address")] == 1.0
    assert len(merged) == len(found) + 1


def test_empty_column_gets_no_label(spark):
    df = spark.createDataFrame([(None,), (None,)], "mail string")
    assert label_columns(df).count() == 0


def test_registered_detector(spark):
    register_detector("zip", lambda v: v.rlike("^[0-9]{4}$"), True)
    try:
        df = spark.createDataFrame([("6720",), ("x",)], "z string")
        assert label_columns(df).collect() == [("z", 0.5, "zip", True)]
    finally:
        del DETECTORS["zip"]


def test_detectors_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a@b.c",), ("x",)], "v string").write.parquet(source)
    stream = with_flag(spark.readStream.schema("v string").parquet(source), "v", "email address")
    query = stream.writeStream.format("memory").queryName("flags").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert {(r.v, r.flag) for r in spark.table("flags").collect()} == {("a@b.c", True), ("x", False)}
