"""Every query against its SQL, over the smallest tables."""

import duckdb
import pytest

from marketloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    own = sorted((plain(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    out = sql.sql(plans.ORACLES[name])
    at = [out.columns.index(c) for c in sorted(df.columns)]
    assert sorted(out.columns) == sorted(df.columns)
    assert own == sorted((plain(r[k] for k in at) for r in out.fetchall()), key=repr)


def test_queries_without_sql():
    assert sorted(set(plans.QUERIES) - set(plans.ORACLES)) == ["churn_model_choice", "churn_prediction_summary", "churn_predictions", "text_quality_scores"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
