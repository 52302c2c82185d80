"""The pipeline's stages on each other's results, and the registered queries against their SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from gridlore.llm import queries
from tools.compare import tidy


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, sf)
    a, b = tidy(df.columns, df.collect()), tidy([c[0] for c in want.description], want.fetchall())
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.columns[: len(columns)] == columns and docs.count() > 0
    texts = [r[0] for r in docs.where("copy_no = 1").select("text").collect()]
    assert len(texts) == len(set(texts)) and all(any(c.isalpha() for c in t) for t in texts)


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
