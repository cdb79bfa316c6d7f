"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it has kept; its
result is written and read again as the next one's docs.
"""

from veilspark.llm import cube, jaccard, langid, pack, tree_dedup
from veilspark.plans.storage import Scratch, store


def language(spark, docs, sf_dir):
    """Drop documents whose language is not recognised."""
    return langid.keep_known(docs, langid.train(docs))


def exact(spark, docs, sf_dir):
    """Of texts that are equal without white space, keep the longest."""
    return tree_dedup.exact_dedup(docs)


def near(spark, docs, sf_dir):
    """Keep one document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def mixed(spark, docs, sf_dir):
    """Take every source to its target weight; a document may come more than once."""
    return cube.take(docs)


def packed(spark, docs, sf_dir):
    """Cut and pack all documents into sequences."""
    return pack.pack(docs).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language identification", language),
    ("exact dedup", exact),
    ("near duplicates", near),
    ("source mixing", mixed),
    ("packing", packed),
]

#: Trained scores, near-duplicate groups, a drawn sample and a packing are not SQL; the tests hold
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. Of the tables stored on the way only those stay that it reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with Scratch(free=True) as scratch:
            table = scratch.keep(store(stage(spark, docs, sf_dir)))
        if before is not None:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
