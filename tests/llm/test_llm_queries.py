"""The registered queries over whole tables; those with SQL give the same rows in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gapscore.llm.mixing import mixed_words, word_count
from gapscore.llm.queries import ORACLES, QUERIES
from test_queries import canonical

SF = "/root/testdata/sf0.001"


def test_registration():
    assert set(QUERIES) <= set(queries()) and "pipeline" in queries() and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, cursor = QUERIES[name](spark, SF), connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())


def test_stages(spark, tmp_path):
    """Each stage takes effect on what the one before wrote; the last covers every token."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "mixing", "packing"]
    kept = seen["line_dedup"]
    assert 0.8 * seen["quality_classifier"].count() < kept.count() < seen["quality_classifier"].count()
    words = lambda df: df.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert words(seen["near_dedup"]) < words(kept)
    assert seen["mixing"].count() < seen["near_dedup"].count()
    assert words(seen["packing"]) == mixed_words(seen["mixing"]).agg(F.sum("taken")).first()[0]
    assert docs.agg(F.sum("length")).first()[0] > words(seen["packing"])
    tokens = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    assert tokens(docs) == tokens(corpus_pipeline.run(spark, SF))  # sequences follow the order of the rows as written
