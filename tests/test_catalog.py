"""Every registered query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from webloom import catalog, catalog_crawl, catalog_tables, catalog_transfer  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def rows(df: pd.DataFrame) -> Counter:
    cell = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return Counter(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_llm(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "HAS_LLM", False)
    monkeypatch.setattr(e, "HAS_PIPELINE", False)
    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) == set(catalog.ORACLE)


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """Pages of which several have one URL but different bodies."""
    at = tmp_path_factory.mktemp("twice")
    p = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    moved = p.where("page_id < 20").selectExpr("page_id + 100000 AS page_id", "url", "concat(html, '<a href=\"/only/', page_id, '\">x</a>') AS html")
    p.unionByName(moved).coalesce(1).write.parquet(str(at / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{at}/pages.parquet/*.parquet'")
    return str(at), c


def same_where_urls_repeat(spark, twice, name):
    got, want = catalog.QUERIES[name](spark, twice[0]).toPandas(), twice[1].sql(catalog.ORACLE[name]).df()
    assert rows(got) == rows(want)


def test_links_of_pages_of_one_url(spark, twice):
    same_where_urls_repeat(spark, twice, "links_once_searched")


def test_lists_that_hold_one_url(spark, twice):
    same_where_urls_repeat(spark, twice, "url_list_lines")
