"""The pipeline against its stages, and the queries' registration."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from driftframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = [n]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "shards":
            assert out.columns == columns
        if name in ("quality", "near_duplicates", "decontamination"):
            assert out.count() < seen[-1] or name == "decontamination"
            assert out.exceptAll(docs).count() == 0
        seen.append(out.count())
        docs = out
    assert seen[-1] == seen[-2] == corpus_pipeline.run(spark, SF).count()
    kept = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    quality = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    good = kept.where("quality = 1").select("doc_id")
    assert good.join(quality, "doc_id", "left_anti").count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
