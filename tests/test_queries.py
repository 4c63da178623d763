"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

from pedalflow.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return (2, float(f"{float(value):.9g}"))
    return (3, str(value).removesuffix(" 00:00:00"))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert name in catalogue.ORACLES
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    assert sorted(df.columns) == columns
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
