from collections import Counter

import corpus_pipeline
from veilspark.llm import cube, jaccard, langid, queries, tree_dedup


def test_stages_keep_columns_and_take_effect(spark, messy, tmp_path):
    docs, seen = messy, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.count())
    rows = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(5)]
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    known = langid.identify(messy, langid.train(messy))
    assert seen[0] == known.where("not rejected").count() < messy.count()
    decided = tree_dedup.decide(rows[0]).where("kept")
    assert Counter(r.key for r in decided.collect()) == Counter(r.doc_id for r in rows[1].collect())
    near = jaccard.near_duplicates(rows[1]).collect()
    assert seen[2] == len({r.component_id for r in near if r.n_shingles})
    assert not texts(rows[2]) - texts(rows[1])
    copies = Counter()
    for r in cube.mix(rows[2], carry=True).select("key", "copies", "row.text").collect():
        copies[(r.key, r.text)] += r.copies
    assert texts(rows[3]) == +copies
    packed = rows[4].collect()
    assert sum(r.start == 0 for r in packed) == seen[3]


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    names = queries.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.oracle_sql()) <= set(names)
