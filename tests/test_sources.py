import json

import pytest

from veilspark import (
    PrivacySpec,
    audit_classes,
    build_dictionary,
    country_dictionary,
    extract_cells,
    name_dictionary,
    read_labels,
    read_lines,
    read_records,
    read_table,
    run,
    term_dictionary,
    violations,
    write_labels,
    write_table,
)
from veilspark.plans import storage

COUNTRIES = [("Bolivia (Plurinational State of)", "BO", "BOL"), ("Namibia", "NA", "NAM"), ("Åland Islands", "AX", None)]


def test_headerless_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("Anna,5,1234567890123456789,\nBéla,,2,x@y.z\n", encoding="utf-8")
    names = ["nev", "kor", "szamla", "email"]
    schema = "nev string, kor int, szamla bigint, email string"
    expected = [("Anna", 5, 1234567890123456789, None), ("Béla", None, 2, "x@y.z")]
    assert read_table(spark, str(path), schema).collect() == expected
    guessed = read_table(spark, str(path), names=names)
    assert guessed.columns == names and guessed.collect() == expected
    out = str(tmp_path / "out")
    write_table(guessed, out)
    assert sorted(read_table(spark, out, schema, header=True).collect()) == expected
    parquet = str(tmp_path / "pq")
    write_table(guessed, parquet, "parquet")
    assert sorted(read_table(spark, parquet, format="parquet").collect()) == expected


def test_label_table(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("name,ratio,type,identifier\nmail,0.5,email address,True\nip,1.0,ip address,\n")
    labels = read_labels(spark, str(path))
    assert labels.collect() == [("mail", 0.5, "email address", True), ("ip", 1.0, "ip address", None)]
    out = str(tmp_path / "labels-out")
    write_labels(labels, out)
    assert sorted(read_labels(spark, out).collect()) == sorted(labels.collect())


def test_name_lists(spark, tmp_path):
    for name, text in (("noi", "Ágnes\nZsófia \n"), ("ffi", "Ádám\nZSÓFIA\n")):
        (tmp_path / name).write_bytes(text.encode("ISO-8859-1"))
    found = name_dictionary(read_lines(spark, str(tmp_path / "noi")), read_lines(spark, str(tmp_path / "ffi")))
    assert sorted(r.term for r in found.collect()) == ["adam", "agnes", "zsofia"]


def test_countries(spark):
    df = spark.createDataFrame(COUNTRIES, "name string, `alpha-2` string, `alpha-3` string")
    found = sorted(r.term for r in country_dictionary(df).collect())
    assert found == sorted(["bolivia", "bo", "bol", "namibia", "na", "nam", "åland islands", "ax"])


def test_term_dictionary(spark):
    df = spark.createDataFrame([("Asztma",), ("ASZTMA",), ("Cukorbetegség",), (None,), ("",)], "`0` string")
    assert sorted(r.term for r in term_dictionary(df).collect()) == ["asztma", "cukorbetegség"]
    assert sorted(r.term for r in term_dictionary(df, "0", fold=True).collect()) == ["asztma", "cukorbetegseg"]


PAGE = """<table><tbody><tr><th>No</th></tr>
<tr><td>1</td><td>f</td><td>80</td><td>
 Magas vérnyomás, cukorbetegség </td></tr>
<tr class="x"><td>2<td>m<td>70<td><b>Asztma</b>, x<br>y</tr>
<TR><TD>3</TD><TD>m</TD><TD>60</TD><TD> </TD></TR>
<tr><td>4</td><td>m</td><td>60</td><td></td></tr></tbody></table>"""


def test_cells(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", "<p>none</p>")], "page_id int, url string, html string")
    cells = extract_cells(df).collect()
    assert [r.terms for r in cells] == [None, ["Magas vérnyomás", "cukorbetegség"], ["Asztma"], [""], None]
    terms = [r.term for r in build_dictionary(extract_cells(df), "terms").collect()]
    assert terms == ["asztma", "cukorbetegseg", "magas vernyomas"]


NESTED = """<table><tbody><tr><td>a1<td>a2</td><td><table><tr><td>i1</td><td>i2</td></tr></table></td>
<td>a4 <b>x</b></td></tr><tr><td>b1</td><td>b2<td>b3<td>b4</table>
<ul><li>one<ul class="x"><li>in 1<li>in 2</ul></li><li>two<ol><li>deep<ul><li>deepest</ul></ol><LI >three</ul><li>loose"""


def test_nested_elements(spark):
    df = spark.createDataFrame([(1, NESTED), (2, "<ul></ul></ul><ul><li>late"), (3, None)], "page_id int, `the.html` string")
    cells = lambda *a, **k: [(r.page_id, r.cell) for r in extract_cells(df, *a, html="the.html", **k).collect()]
    assert cells() == [(1, "a4 "), (1, None), (1, "b4")]
    assert cells(n=2) == [(1, "a2"), (1, "i2"), (1, "b2")]
    items = ["one", "in 1", "in 2", "two", "deep", "deepest", "three", "loose"]
    assert cells("li", None, container=None) == [*[(1, x) for x in items], (2, "late")]
    second = [(1, "two"), (1, "in 2"), (1, None), (2, None), (2, None)]
    assert cells("ul", "li", 2, container=None) == second


def test_scraped_records(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(json.dumps([{"terms": ["Asztma", " flu "]}, {"terms": ["ASZTMA", ""]}]))
    records = read_records(spark, str(path), "terms")
    assert [r.term for r in build_dictionary(records, "terms").collect()] == ["asztma", "flu"]


def test_spec_defaults(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True, "s")], "id int, t string, x double, f boolean, s string")
    spec = PrivacySpec.for_table(df, "s", "id")
    assert spec.features == ("t", "x", "f") and spec.categorical == {"t", "f", "s"}
    assert (spec.k, spec.l, spec.p) == (3, 2, 0.2) and str(spec).startswith("s by t*, x, f* in order of id (k=3, l=2, p=0.2;")
    with pytest.raises(ValueError):
        PrivacySpec.for_table(df, "absent", "id")


def test_scratch_tables_go_away(spark):
    with storage.Scratch() as scratch:
        gone = storage.store(spark.range(5))
        kept = scratch.keep(storage.store(spark.range(7)))
    assert kept.rows == 7 and kept.df.count() == 7
    with pytest.raises(Exception):
        gone.df.count()


def test_whole_run(spark, tmp_path):
    rows = [
        (i, f"p{i % 4}", 20 + i % 30, f"u{i % 6}@m{i % 2}.hu", f"ABC-{100 + i % 5}", ["hu", "BO"][i % 2], float(i))
        for i in range(60)
    ]
    df = spark.createDataFrame(
        rows, "id int, nev string, kor int, email string, rendszam string, orszag string, koord double"
    )
    countries = spark.createDataFrame([("hu",), ("bo",)], "term string")
    regions = spark.createDataFrame([("hu", "Europe"), ("bo", "Americas")], "term string, value string")
    spec = PrivacySpec.for_table(df, "nev", "id", k=5, l=2)
    out = str(tmp_path / "out")
    result, labels, final = run(
        df, spec, {"countries": countries}, "l", output=out, regions=regions, key="k"
    )
    assert {(r.name, r.type) for r in labels.collect()} == {
        ("kor", "human age"), ("email", "email address"),
        ("rendszam", "licence plate hungarian"), ("orszag", "country or region"),
    }
    assert set(final.features) == {"kor", "email", "rendszam", "orszag"}
    assert result.columns == df.columns and result.count() == 60
    audit = violations(audit_classes(result, final)).first()
    assert audit["rows"] == 60 and audit.k_violations == 0 and audit.l_violations == 0
    assert dict(result.dtypes)["rendszam"] == "bigint"
    assert result.agg({"rendszam": "min"}).first()[0] == 0
    assert set(r.koord for r in result.collect()) == set(float(i) for i in range(60))
    assert spark.read.option("header", True).csv(out).count() == 60


def test_all_character_references_are_decoded(spark):
    from veilspark.sources.pages import decode_references
    from pyspark.sql import functions as F

    cases = {
        "magas v&eacute;rnyom&aacute;s": "magas vérnyomás",
        "cukorbetegs&#233;g &#x151;": "cukorbetegség ő",
        "&amp;lt; &nosuch; &#0; &#55296; a & b &amp": "&lt; &nosuch; � � a & b &amp",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", decode_references(F.col("t")).alias("d")).collect()}
    assert got == cases
