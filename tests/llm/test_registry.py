"""Registered queries against their SQL on a whole small table."""

import duckdb
import pytest

from pedalflow.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_gives_every_document(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name.startswith("op7"):
        assert df.groupBy("query_id").count().where("count = 20").count() == 25
    else:
        assert df.select("doc_id").distinct().count() == df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
