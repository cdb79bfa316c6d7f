"""Queries over the given tables, and the SQL that states what each must return."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import veilspark as v
from veilspark.functions import detectors as d
from veilspark.functions.text import fold
from veilspark.plans.storage import scratch_folder
from veilspark.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]

PEOPLE = """
select c_custkey as id, c_name as name, cast((c_custkey*37) % 100 as int) as age,
  case when c_custkey % 11 = 0 then null else
    lower(replace(c_name,'#','.')) || '@mail' || cast(c_custkey % 7 as string) || '.example.'
    || case when c_custkey % 3 = 0 then 'com' else 'hu' end end as email,
  '+36 20 ' || lpad(cast(c_custkey % 1000 as string),3,'0') || ' '
    || lpad(cast((c_custkey*7) % 10000 as string),4,'0') as phone,
  chr(cast(65 + c_custkey % 26 as int)) || chr(cast(65 + (c_custkey*3) % 26 as int))
    || chr(cast(65 + (c_custkey*5) % 26 as int)) || '-' || lpad(cast(c_custkey % 1000 as string),3,'0') as plate,
  lpad(cast((c_custkey*7919+12345) % 1000000000 as string),9,'0') as taj,
  '8' || lpad(cast((c_custkey*7919+12345) % 1000000000 as string),9,'0') as tax,
  '10.0.' || cast(c_custkey % 300 as string) || '.' || cast((c_custkey*13) % 300 as string) as ip,
  substr(md5(cast(c_custkey as string)),1,2) || ':' || substr(md5(cast(c_custkey as string)),3,2) || ':'
    || substr(md5(cast(c_custkey as string)),5,2) || ':' || substr(md5(cast(c_custkey as string)),7,2) || ':'
    || substr(md5(cast(c_custkey as string)),9,2) || ':' || substr(md5(cast(c_custkey as string)),11,2) as mac,
  n_name as country, r_name as region, c_mktsegment as segment, c_acctbal as balance
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

PERSONAL_NUMBERS = """
select o_orderkey as id,
  cast(1 + o_orderkey % 8 as string) || lpad(cast(year(o_orderdate) % 100 as string),2,'0')
  || lpad(cast(month(o_orderdate) as string),2,'0') || lpad(cast(day(o_orderdate) as string),2,'0')
  || lpad(cast((o_orderkey*7919) % 10000 as string),4,'0') as personal
from orders
"""

COUNTRIES = """
select n_name || ' (the)' as name, 'N' || cast(n_nationkey as string) as alpha2,
  'NA' || cast(n_nationkey as string) as alpha3, r_name as region
from nation join region on n_regionkey = r_regionkey
"""

TOKENS_DUCKDB = r"""
select doc_id, tok from
  (select doc_id, unnest(string_split_regex(text, '\s+')) as tok from documents) where tok <> ''
"""

TERMS_DUCKDB = r"""
select distinct lower(tok) as term from
  (select unnest(string_split_regex(text, '\s+')) as tok from benchmark) where tok <> ''
"""

FIRST_NAMES = (
    "Ádám", "Andrea", "Anna", "Béla", "Edina", "Elena", "Enikő", "Erik", "Helen", "Ines",
    "Leon", "Mária", "Noel", "Otto", "René", "Réka", "Theo", "Tímea", "Zoltán", "Zsófia",
)

SHARED_VIEWS = {"people": PEOPLE, "personal_numbers": PERSONAL_NUMBERS, "countries": COUNTRIES}
TABLES = ("customer", "nation", "region", "orders")
TOKEN_KEY = "example-key"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input, from the text both engines run."""
    for source in TABLES:
        read = table(spark, sf, source)
        (read if source in ("nation", "region") else spread(read)).createOrReplaceTempView(source)
    return spark.sql(SHARED_VIEWS[name])


def words(df: DataFrame, text: str = "text") -> DataFrame:
    kept = [c for c in df.columns if c != text]
    split = df.select(*kept, F.explode(F.split(text, r"\s+")).alias("tok"))
    return split.where("tok <> ''")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return words(texts(spark, sf))


def benchmark_terms(spark: SparkSession, sf: str, folded: bool) -> DataFrame:
    return v.term_dictionary(words(table(spark, sf, "benchmark").select("text")), "tok", folded)


def first_names(spark: SparkSession) -> DataFrame:
    return v.name_dictionary(spark.createDataFrame([(n,) for n in FIRST_NAMES], "name string"))


def country_terms(spark: SparkSession, sf: str) -> DataFrame:
    return v.country_dictionary(view(spark, sf, "countries"), "name", "alpha2", "alpha3")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return v.region_dictionary(view(spark, sf, "countries"), "name", "alpha2", "alpha3")


def dictionaries(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "names": first_names(spark),
        "diseases": benchmark_terms(spark, sf, False),
        "diseases_hu": benchmark_terms(spark, sf, True),
        "countries": country_terms(spark, sf),
    }


# --- uniqueness ---------------------------------------------------------------------------

ORDER_COLUMNS = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
)
PEOPLE_COLUMNS = (
    "id", "name", "age", "email", "phone", "plate", "taj", "tax", "ip", "mac",
    "country", "region", "segment", "balance",
)
CUBE_COLUMNS = ["l_returnflag", "l_linenumber", "l_quantity", "l_discount"]


def uniqueness_orders(spark, sf):
    return v.uniqueness(table(spark, sf, "orders"))


def uniqueness_people(spark, sf):
    return v.uniqueness(view(spark, sf, "people"))


def combination_uniqueness_lineitem(spark, sf):
    return v.combination_uniqueness(table(spark, sf, "lineitem"), CUBE_COLUMNS)


def dotted_columns(spark, sf):
    """Names that hold a dot, and a date, in both measures."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("o.date"), F.col("o_custkey").alias("o.customer"), "o_orderstatus"
    )
    single = v.uniqueness(orders)
    return single.unionAll(
        v.combination_uniqueness(orders, orders.columns).select(F.col("columns").alias("name"), "percent")
    )


def combination_uniqueness_pairs(spark, sf):
    columns = ["email", "age", "plate", "region", "segment"]
    return v.combination_uniqueness(view(spark, sf, "people"), columns, max_size=2)


def combination_uniqueness_wide(spark, sf):
    """All 16 383 combinations of 14 columns, walked by size."""
    return v.combination_uniqueness(view(spark, sf, "people"), list(PEOPLE_COLUMNS))


# --- detectors ----------------------------------------------------------------------------


def flag(column: str, label: str, source: str = "people") -> Query:
    def run(spark, sf):
        return v.with_flag(view(spark, sf, source), column, label).select("id", column, "flag")

    return run


def flag_tokens(label: str) -> Query:
    def run(spark, sf):
        flagged = v.with_flag(tokens(spark, sf), "tok", label, dictionaries(spark, sf).get(
            d.DETECTORS[label].dictionary
        ))
        return flagged.groupBy("doc_id").agg(F.count_if("flag").alias("hits"), F.count("*").alias("tokens"))

    return run


def flag_ipv6(spark, sf):
    """Well-formed addresses beside two double gaps and an over-long group."""
    people = view(spark, sf, "people")
    number = (F.col("id") % 1000).cast("string")
    start = F.element_at(
        F.array(*map(F.lit, ("fe80::", "2001:db8:0:0:0:0:0:", "fe80::1::", "12345::"))),
        (F.col("id") % 4 + 1).cast("int"),
    )
    made = people.select("id", F.concat(start, number).alias("ip"))
    return v.with_flag(made, "ip", "ip address")


def near_misses(column: str, label: str, changed: Callable[[F.Column], F.Column]) -> Query:
    """Every second value is damaged, so that a constant answer fails."""

    def run(spark, sf):
        people = view(spark, sf, "people")
        damaged = F.when(F.col("id") % 2 == 0, changed(F.col(column))).otherwise(F.col(column))
        source = people.select("id", damaged.alias(column))
        terms = country_terms(spark, sf) if label == "country or region" else None
        return v.with_flag(source, column, label, terms).select("id", column, "flag")

    return run


def flag_country(spark, sf):
    people = view(spark, sf, "people")
    flagged = v.with_flag(people, "country", "country or region", country_terms(spark, sf))
    return flagged.select("id", "country", "flag")


def flag_age(spark, sf):
    return v.with_flag(view(spark, sf, "people"), "age", "human age").select("id", "age", "flag")


def flag_age_mixed(spark, sf):
    """Ages as they are, up to 129, from 130 on, with a text among them, and with a negative one."""
    people = view(spark, sf, "people").where("age is not null")
    low, high = people.agg(F.min("age"), F.max("age")).first()
    age, third = F.col("age"), F.col("id") % 10 == 3
    kinds = {
        "plain": age.cast("string"),
        "edge": (age + F.lit(129 - high)).cast("string"),
        "old": (age + F.lit(130 - high)).cast("string"),
        "text": F.when(third, F.concat(F.lit("x"), age)).otherwise(age.cast("string")),
        "negative": (age - F.lit(low + 1)).cast("string"),
    }
    found = None
    for kind, value in kinds.items():
        one = v.with_flag(people.select("id", F.lit(kind).alias("kind"), value.alias("age")), "age", "human age")
        found = one if found is None else found.unionAll(one)
    return found


def flag_name_in_text(spark, sf):
    flagged = v.with_flag(texts(spark, sf), "text", "hungarian first name", first_names(spark))
    return flagged.select("doc_id", "flag")


def label_columns_people(spark, sf):
    return v.label_columns(view(spark, sf, "people"), dictionaries(spark, sf))


def label_columns_tokens(spark, sf):
    return v.label_columns(tokens(spark, sf).select("tok"), dictionaries(spark, sf))


def fold_tokens(spark, sf):
    distinct = tokens(spark, sf).select("tok").distinct()
    return distinct.select("tok", fold(F.col("tok")).alias("folded"))


# --- dictionaries and harvest ---------------------------------------------------------------


def country_dictionary(spark, sf):
    return country_terms(spark, sf)


def region_dictionary(spark, sf):
    return regions(spark, sf)


def term_dictionary_folded(spark, sf):
    return benchmark_terms(spark, sf, True)


def name_dictionary_parts(spark, sf):
    return v.name_dictionary(words(table(spark, sf, "part").select("p_name"), "p_name"))


def harvest_cells(spark, sf):
    cells = v.extract_cells(table(spark, sf, "pages"), "ul", "li", 2, container=None)
    return cells.select("page_id", "cell", F.size("terms").cast("bigint").alias("terms"))


#: What stands before and after a page.
NESTED_LISTS = ("<ul><li>first<ul><li>a<li>b</ul><li>second<ul><li>only</li></ul><li>", "</ul>")


def harvest_li(spark, sf):
    cells = v.extract_cells(table(spark, sf, "pages"), "li", None, container=None)
    return v.build_dictionary(cells, "terms")


def harvest_nested(spark, sf):
    """Second items of all lists, where each page stands in a list with two more inside."""
    nested = F.concat(F.lit(NESTED_LISTS[0]), F.col("html"), F.lit(NESTED_LISTS[1]))
    pages = table(spark, sf, "pages").select("page_id", nested.alias("html"))
    cells = v.extract_cells(pages, "ul", "li", 2, container=None)
    return cells.select("page_id", "cell")


def footer_references(spark, sf):
    """The first text of every footer, with its character references decoded."""
    cells = v.extract_cells(table(spark, sf, "pages"), "footer", None, container=None)
    return cells.select("page_id", "cell")


def stored_tables(spark, sf):
    """Write a table, its labels and a dictionary to the shared folder, and read them again."""
    folder = f"{scratch_folder(spark)}/stored-{uuid.uuid4().hex}"
    people = view(spark, sf, "people").select("id", "name", "email", "age", "balance")
    v.write_table(people, f"{folder}/people")
    again = v.read_table(spark, f"{folder}/people", people.schema, header=True)
    v.write_labels(v.label_columns(people), f"{folder}/labels")
    labels = v.read_labels(spark, f"{folder}/labels").groupBy("name").agg(F.count("*").alias("labels"))
    v.write_table(country_terms(spark, sf).orderBy("term"), f"{folder}/terms", "json")
    terms = spark.read.schema("term string").json(f"{folder}/terms").distinct().count()
    same = again.exceptAll(people).count() + people.exceptAll(again).count()
    return labels.select("name", "labels", F.lit(terms).alias("terms"), F.lit(same).alias("changed_rows"))


def generalise_dates(spark, sf):
    """Dates are categorical: each group of orders gets its dates as one list."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus", (F.col("o_orderkey") % 997).alias("part")
    )
    spec = v.PrivacySpec.for_table(
        orders, sensitive="o_orderstatus", order_by="o_orderkey", features=["o_orderdate"]
    )
    return v.generalise_partitions(orders, spec, "part")


# --- cleaning and pseudonymisation ------------------------------------------------------------


def spec_for(df, features, **kw):
    return v.PrivacySpec.for_table(df, sensitive="segment", order_by="id", features=features, **kw)


def fill_missing_people(spark, sf):
    people = view(spark, sf, "people").select(
        "id",
        F.when(F.col("id") % 5 != 0, F.col("age")).alias("age"),
        "email",
        "segment",
        F.when(F.col("id") % 3 != 0, F.col("balance")).alias("balance"),
    )
    filled = v.fill_missing(people, spec_for(people, ["age", "email", "balance"]))
    return filled.withColumn("age", F.col("age").cast("double"))


def fill_big_integers(spark, sf):
    """Integers beyond what a double holds stay exact, with and without a null."""
    people = view(spark, sf, "people").select(
        "id",
        (F.col("id") + 1234567890123456789).alias("whole"),
        F.when(F.col("id") % 4 != 0, F.col("id") * 3 + 1234567890123456700).alias("holed"),
        F.when(F.col("id") % 7 != 0, F.lit(float("nan"))).otherwise(F.col("balance")).alias("mostly_nan"),
        "segment",
    )
    filled = v.fill_missing(people, spec_for(people, ["whole", "holed", "mostly_nan"]))
    kept = F.when(F.col("id") % 4 != 0, F.col("holed")).alias("holed")
    return filled.select("id", "whole", kept, F.col("holed").isNotNull().alias("filled"), "mostly_nan")


def interval_age(spark, sf):
    people = view(spark, sf, "people").select("id", "age", "segment")
    return v.to_interval(people, "age", spec_for(people, ["age"]))[0]


def country_region(spark, sf):
    people = view(spark, sf, "people").select("id", "country")
    return v.generalise(people, "country", regions(spark, sf))


def encode_column(column: str) -> Query:
    def run(spark, sf):
        return v.encode_text(view(spark, sf, "people").select("id", column), column, "id")

    return run


def encode_tokens(spark, sf):
    """Codes of all words in text order; returns the first and last use of each."""
    split = texts(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "tok")
    )
    coded = v.encode_text(split.withColumn("code", F.col("tok")), "code", ["doc_id", "pos"])
    return coded.groupBy("tok").agg(
        F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("uses")
    )


def email_keyed(spark, sf):
    people = view(spark, sf, "people").select("id", "email")
    return v.pseudonymise_email(people, "email", key=TOKEN_KEY)


def email_random_consistency(spark, sf):
    people = view(spark, sf, "people").select("id", "email", F.col("email").alias("before"))
    tokens = v.pseudonymise_email(people, "email", mode="random")
    parts = tokens.withColumns(
        {
            "local": F.substring_index("email", "@", 1),
            "domain": F.regexp_extract("email", "@(.+)[.]", 1),
            "tld": F.substring_index("email", ".", -1),
        }
    )
    return parts.agg(
        F.count("*").alias("addresses"),
        F.count_distinct("local").alias("locals"),
        F.count_distinct("domain").alias("domains"),
        F.count_distinct("tld").alias("tlds"),
        F.count_distinct("email").alias("tokens"),
        F.max(F.length("email")).cast("bigint").alias("longest"),
        F.count_if(F.col("email") == F.col("before")).alias("unchanged"),
    )


def labelled_pseudonymise(spark, sf):
    people = view(spark, sf, "people").select(
        "id", "age", "email", "phone", "plate", "country", "segment"
    )
    labels = v.label_columns(people, {"countries": country_terms(spark, sf)})
    spec = spec_for(people, ["age", "email", "phone", "plate", "country"])
    published, _ = v.pseudonymise_labelled(
        people, labels, spec, regions=regions(spark, sf), key=TOKEN_KEY
    )
    return v.encode_identifiers(published, labels, "id")


# --- classes, spans, splits -------------------------------------------------------------------


def banded(spark, sf):
    return view(spark, sf, "people").withColumn("band", F.floor(F.col("age") / 25))


def class_diversity(spark, sf):
    return v.diversity(banded(spark, sf), ["region", "band"], "segment")


def audit_region_band(spark, sf):
    df = banded(spark, sf)
    return v.audit_classes(df, spec_for(df, ["region", "band"], k=72, l=5, p=0.08))


def global_frequencies(spark, sf):
    return v.global_frequencies(view(spark, sf, "people"), "segment")


def t_distance(values: str) -> Query:
    def run(spark, sf):
        return v.t_distance(banded(spark, sf), ["region", "band"], "country", values)

    return run


def t_distance_null_groups(spark, sf):
    people = view(spark, sf, "people")
    holed = people.withColumn("region", F.when(F.col("id") % 6 != 0, F.col("region")))
    return v.t_distance(holed, ["region"], "country")


def spans_by_region(spark, sf):
    people = view(spark, sf, "people")
    spec = spec_for(people, ["age", "balance", "country", "email"])
    return v.spans(people, spec, "region", v.full_spans(people, spec))


def split_once(column: str) -> Query:
    def run(spark, sf):
        people = view(spark, sf, "people")
        spec = spec_for(people, [column])
        return v.split_side(people, spec, column, "region").select("id", "region", column, "side")

    return run


# --- anonymisation ------------------------------------------------------------------------------

MONDRIAN_FEATURES = ("age", "country", "balance")
MONDRIAN_K, MONDRIAN_L, MONDRIAN_P = 25, 4, 0.15


#: Small enough that the given tables are split by distributed levels first.
SPLIT_CELLS = 800


def mondrian(model: str, local_cells: int = SPLIT_CELLS) -> Query:
    def run(spark, sf):
        people = view(spark, sf, "people").select("id", *MONDRIAN_FEATURES, "segment")
        spec = spec_for(
            people, list(MONDRIAN_FEATURES), k=MONDRIAN_K, l=MONDRIAN_L, p=MONDRIAN_P
        )
        return v.anonymise(people, spec, model, local_cells=local_cells, keep_partition_id=True)

    return run


def dotted_anonymise(spark, sf):
    """The k model on columns whose names hold dots."""
    people = view(spark, sf, "people").select("id", *MONDRIAN_FEATURES, "segment")
    odd = people.toDF(*[f"of.{c}" for c in people.columns])
    features = [f"of.{c}" for c in MONDRIAN_FEATURES]
    spec = v.PrivacySpec.for_table(odd, "of.segment", "of.id", features=features, k=MONDRIAN_K)
    found = v.anonymise(odd, spec, "k", local_cells=SPLIT_CELLS, keep_partition_id=True)
    return found.toDF(*people.columns, "partition_id")


def partition_people(spark, sf):
    people = view(spark, sf, "people").select("id", *MONDRIAN_FEATURES, "segment")
    spec = spec_for(people, list(MONDRIAN_FEATURES), k=MONDRIAN_K)
    return v.partition(people, spec, "k", local_cells=SPLIT_CELLS).select("id", "partition_id")


def generalise_by_region(spark, sf):
    people = view(spark, sf, "people").select("id", "age", "country", "balance", "region", "segment")
    spec = spec_for(people, ["age", "country", "balance"])
    return v.generalise_partitions(people, spec, "region")


def publish_people(spark, sf):
    """The whole run; returns what must hold of its result."""
    people = view(spark, sf, "people")
    spec = v.PrivacySpec.for_table(people, sensitive="segment", order_by="id", k=10, l=2)
    rows, _, final = v.run(
        people, spec, dictionaries(spark, sf), "l", regions=regions(spark, sf), key=TOKEN_KEY,
        anonymise_options={"local_cells": SPLIT_CELLS},
    )
    found = v.violations(v.audit_classes(rows, final))
    return found.select("rows", "k_violations", "l_violations")


PUBLISHED_K = 12


def publish_values(spark, sf):
    """Every value of a published table: intervals, regions and codes, joined by partition."""
    people = view(spark, sf, "people").select("id", "age", "country", "plate", "segment")
    spec = v.PrivacySpec.for_table(people, sensitive="segment", order_by="id", k=PUBLISHED_K)
    terms = {"countries": country_terms(spark, sf)}
    rows, _, _ = v.run(
        people, spec, terms, "k", regions=regions(spark, sf), key=TOKEN_KEY,
        anonymise_options={"local_cells": SPLIT_CELLS},
    )
    return rows.select("id", "age", "country", "plate", "segment")


def entry(spark: SparkSession) -> DataFrame:
    """Label, pseudonymise and anonymise the people of the smallest tables."""
    sf = "/root/testdata/sf0.001"
    people = view(spark, sf, "people")
    spec = v.PrivacySpec.for_table(people, sensitive="segment", order_by="id")
    return v.run(
        people, spec, dictionaries(spark, sf), "l", regions=regions(spark, sf), key=TOKEN_KEY
    )[0]


TOKEN_FLAGS = {
    "flag_email_tokens": "email address",
    "flag_ip_tokens": "ip address",
    "flag_mac_tokens": "mac address",
    "flag_phone_tokens": "phone number hungarian",
    "flag_term": "disease name",
    "flag_term_folded": "disease name hungarian",
    "flag_contains_name": "hungarian first name",
}


def corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the corpus operators; nothing where they are not installed."""
    try:
        import corpus_pipeline
        from veilspark.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "veilspark.llm"):
            raise
        return {}, {}
    found, sql = {**llm.queries(), "pipeline": corpus_pipeline.run}, llm.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    return {
        "uniqueness_orders": uniqueness_orders,
        "uniqueness_people": uniqueness_people,
        "combination_uniqueness_lineitem": combination_uniqueness_lineitem,
        "combination_uniqueness_pairs": combination_uniqueness_pairs,
        "combination_uniqueness_wide": combination_uniqueness_wide,
        "flag_tax": flag("tax", "tax number hungarian"),
        "flag_taj": flag("taj", "taj number hungarian"),
        "flag_personal": flag("personal", "personal number hungarian", "personal_numbers"),
        "flag_phone": flag("phone", "phone number hungarian"),
        "flag_plate": flag("plate", "licence plate hungarian"),
        "flag_mac": flag("mac", "mac address"),
        "flag_email": flag("email", "email address"),
        "flag_ipv4": flag("ip", "ip address"),
        **{name: flag_tokens(label) for name, label in TOKEN_FLAGS.items()},
        "flag_country": flag_country,
        "flag_age": flag_age,
        "flag_age_mixed": flag_age_mixed,
        "flag_name_in_text": flag_name_in_text,
        "label_columns_people": label_columns_people,
        "label_columns_tokens": label_columns_tokens,
        "fold_tokens": fold_tokens,
        "country_dictionary": country_dictionary,
        "region_dictionary": region_dictionary,
        "term_dictionary_folded": term_dictionary_folded,
        "name_dictionary_parts": name_dictionary_parts,
        "harvest_cells": harvest_cells,
        "harvest_li": harvest_li,
        "harvest_nested": harvest_nested,
        "fill_missing_people": fill_missing_people,
        "interval_age": interval_age,
        "country_region": country_region,
        "encode_plate": encode_column("plate"),
        "encode_email": encode_column("email"),
        "encode_tokens": encode_tokens,
        "email_keyed": email_keyed,
        "email_random_consistency": email_random_consistency,
        "labelled_pseudonymise": labelled_pseudonymise,
        "class_diversity": class_diversity,
        "audit_region_band": audit_region_band,
        "global_frequencies": global_frequencies,
        "t_distance_all": t_distance("all"),
        "t_distance_present": t_distance("present"),
        "spans_by_region": spans_by_region,
        "split_age": split_once("age"),
        "split_balance": split_once("balance"),
        "split_country": split_once("country"),
        "split_email": split_once("email"),
        "partition_people": partition_people,
        "generalise_by_region": generalise_by_region,
        "mondrian_k": mondrian("k"),
        "mondrian_l": mondrian("l"),
        "mondrian_t": mondrian("t"),
        "mondrian_k_levels": mondrian("k", local_cells=400),
        "mondrian_l_levels": mondrian("l", local_cells=400),
        "mondrian_t_levels": mondrian("t", local_cells=400),
        "fill_big_integers": fill_big_integers,
        "t_distance_null_groups": t_distance_null_groups,
        "flag_ipv6": flag_ipv6,
        "flag_phone_mixed": near_misses("phone", "phone number hungarian", lambda c: F.concat(c, F.lit("77"))),
        "flag_plate_mixed": near_misses("plate", "licence plate hungarian", lambda c: F.substring(c, 1, 5)),
        "flag_mac_mixed": near_misses("mac", "mac address", lambda c: F.translate(c, "abc", "xyz")),
        "flag_country_mixed": near_misses("country", "country or region", lambda c: F.concat(c, F.lit("!"))),
        "dotted_columns": dotted_columns,
        "dotted_anonymise": dotted_anonymise,
        "footer_references": footer_references,
        "stored_tables": stored_tables,
        "generalise_dates": generalise_dates,
        "publish_people": publish_people,
        "publish_values": publish_values,
        **corpus()[0],
    }


def oracle_sql() -> dict[str, str]:
    from oracles import all_oracles

    return {**all_oracles(), **corpus()[1]}
