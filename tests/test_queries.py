"""Every named query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from folio_spark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.limit(10_000_000).fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_required_text_in_split_and_glued_words(spark, tmp_path):
    passage = "the longestwordofall stands here"
    docs = [(1, f"a {passage} b"), (2, "a the longestword ofall stands here b"), (3, "xthelongestwordofallstandsherex"), (4, "the longest word is missing"), (5, "!!!!!!!!!! and more"), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "!!!!!!!!!!"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((x.item_id, x.doc_id, x.tier) for x in registry.QUERIES["required_text"](spark, str(tmp_path)).collect())
    want = c.sql(registry.SQL["required_text"])
    assert got == sorted(tuple(dict(zip(want.columns, r))[k] for k in ("item_id", "doc_id", "tier")) for r in want.fetchall())
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 3), (2, 5, 1)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
