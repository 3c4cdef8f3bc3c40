"""The registered text queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from terrakit.llm import queries

SF = "/root/testdata/sf0.001"
NAMES = [n for n in queries.all_queries() if n != "pipeline"]


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_whole(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF)
    found = rows.collect()
    assert found
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for table in ("documents", "pages", "embeddings"):
            con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        result = con.execute(queries.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        want = sorted((tuple(r) for r in result.fetchall()), key=repr)
        assert sorted(tuple(r) for r in rows.select(*columns).collect()) == sorted(want) or sorted(
            (tuple(r) for r in rows.select(*columns).collect()), key=repr
        ) == want


def test_stages_keep_columns(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), awkward.schema)
        assert docs.columns == columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_pipeline(spark):
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    ids = {r["doc_id"] for r in rows}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids <= {r["doc_id"] for r in docs.collect()} and len(ids) > 50
