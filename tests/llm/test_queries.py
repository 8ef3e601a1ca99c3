"""The registered corpus queries at sf 0.01, and the pipeline."""

import duckdb
import pytest

from slantstack.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_tables(spark, name):
    n = queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    if name.startswith("op"):
        table = "pages" if name.startswith("op10_") else "documents"
        assert n == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    else:
        assert n > 0


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "sources"]
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, SF)
        if k < 4:
            assert out.columns == docs.columns
        n = out.count()
        assert 0.3 * docs.count() < n <= left.count()
        left = spark.createDataFrame(out.collect(), out.schema)
    assert "taken" in left.columns and left.count() == left.select("doc_id").distinct().count()
