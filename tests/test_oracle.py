"""Every registered query against its DuckDB oracle (the driver's correctness gate, run locally)."""

import re

import pytest

from scripts.check_oracle import rows_of
from tests.conftest import SF_CHECK, SF_SMALL

import __spark_entry__ as E

QUERIES = E.queries()
ORACLE = E.oracle_sql()
#: Queries of the corpus subpackage have their own tests.
CORPUS = re.compile(r"op\d+_|pipeline$")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from tickwise.plans.views import TABLES
    cons = {}
    for sf in (SF_SMALL, SF_CHECK):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        cons[sf] = con
    return cons


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _compare(spark, duck, name, sf):
    df = QUERIES[name](spark, sf)
    cols = df.columns
    rel = duck[sf].sql(ORACLE[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == duck_types
    srows = [tuple(r) for r in df.collect()]
    res = duck[sf].execute(ORACLE[name])
    dcols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, srows) == rows_of(dcols, res.fetchall())
    return len(srows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    _compare(spark, duck, name, SF_CHECK)


@pytest.mark.parametrize("name", ["exposure_by_industry", "enrich_positions", "match_notifications",
                                  "final_answers", "similarity_search", "carry_provider"])
def test_query_matches_oracle_smoke_scale(spark, duck, name):
    _compare(spark, duck, name, SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLE) if not CORPUS.match(n)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["industry", "n_positions", "shares", "market_value", "weight"]
    # industries without any priced holding have no market value and no weight
    assert abs(sum(r["weight"] for r in rows if r["weight"] is not None) - 1.0) < 1e-6


def test_only_documented_queries_lack_an_oracle():
    assert sorted(n for n in set(QUERIES) - set(ORACLE) if not CORPUS.match(n)) == ["embed_filings", "similarity_search_lsh"]


def test_every_query_is_listed_in_the_readme():
    import os
    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    missing = [n for n in QUERIES if n not in readme]
    assert missing == []
