"""The registered queries of the operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cube, jaccard, langid, lexical, pack, pages, recompress, rules, secrets, spelling, suffix, topk, tree_dedup

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_mix(spark, sf):
    return cube.mix(documents(spark, sf)).select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op2_pack(spark, sf):
    return pack.pack(documents(spark, sf)).withColumnRenamed("key", "doc_id")


def op3_secrets(spark, sf):
    # The base rules first; of the second scan their part comes from the ledger.
    _, ledger = secrets.scan(documents(spark, sf), rules=secrets.BASE)
    found, _ = secrets.scan(documents(spark, sf), ledger.df)
    base = [r.kind for r in secrets.BASE]

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    of_base = listed(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(of_base, 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op4_exact_dedup(spark, sf):
    return tree_dedup.decide(documents(spark, sf)).select(
        F.col("key").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op5_substrings(spark, sf):
    return suffix.dedup_substrings(documents(spark, sf)).withColumnRenamed("key", "doc_id")


def op6_main_text(spark, sf):
    found = pages.main_text(spark.read.parquet(f"{sf}/pages.parquet"))
    return found.withColumnRenamed("key", "page_id").withColumn(
        "n_chars", F.length("text").cast("bigint")
    )


def op7_quality_rules(spark, sf):
    return rules.judge(documents(spark, sf)).select(
        F.col("key").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op8_passages(spark, sf):
    return recompress.dedup_passages(documents(spark, sf)).withColumnRenamed("key", "doc_id")


def op9_near_duplicates(spark, sf):
    return jaccard.near_duplicates(documents(spark, sf)).withColumnRenamed("key", "doc_id")


def op10_language(spark, sf):
    docs = documents(spark, sf)
    found = langid.identify(docs, langid.train(docs)).withColumnRenamed("key", "doc_id")
    held_out = F.coalesce(langid.remainder(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_spelling(spark, sf):
    return spelling.variants(documents(spark, sf))


def op12_top_k(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = topk.top_k(vectors, lambda key: key % 100 == 0)
    return found.select(F.col("query_key").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def op13_ranked_search(spark, sf):
    found = lexical.rank(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select(F.col("item_key").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def queries() -> dict[str, Query]:
    return {
        "op1_mix": op1_mix,
        "op2_pack": op2_pack,
        "op3_secrets": op3_secrets,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_substrings": op5_substrings,
        "op6_main_text": op6_main_text,
        "op7_quality_rules": op7_quality_rules,
        "op8_passages": op8_passages,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_language": op10_language,
        "op11_spelling": op11_spelling,
        "op12_top_k": op12_top_k,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
