"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest
from conftest import SF_DIR

from stintbook.llm import queries


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, total = docs.columns, docs.count()
    rows = [total]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        rows.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    assert rows[1] >= 0.98 * total and rows[1] >= rows[2] >= rows[3] <= rows[4] == rows[5]
    assert corpus_pipeline.run(spark, SF_DIR).count() == rows[-1]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_answer_each_row(spark, name):
    df = queries.queries()[name](spark, SF_DIR)
    table = "conversations" if name.startswith("op4_") else "documents"
    rows = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
    if name.startswith("op4_"):
        assert df.count() == rows.select("conv_id").distinct().count() + 1
    elif name.startswith("op11_"):
        assert df.count() and df.agg({"rank": "max"}).first()[0] <= 5
    elif name != "pipeline":
        assert df.select("doc_id").distinct().count() == rows.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = database.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    df = queries.queries()[name](spark, SF_DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(names).collect()) == expected
