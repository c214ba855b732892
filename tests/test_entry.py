import math
from collections import Counter

import __spark_entry__ as entry
import duckdb
import pytest
from broadsheet import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def values(rows, order):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)[:19]

    return Counter(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    got = values([tuple(r) for r in df.collect()], [df.columns.index(c) for c in names])
    assert got == values(rel.fetchall(), [rel.columns.index(c) for c in names])


def test_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    core = Counter(r["edition"] for r in rows if r["decision"] == "selected_core")
    assert rows and max(core.values()) <= 8
    assert {r["decision"] for r in rows} <= {"selected_core", "selected_topic_pool", "rejected"}


def test_names_of_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
