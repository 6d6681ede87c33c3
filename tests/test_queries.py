"""Registered queries against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import html
import os
import re

import pyarrow as pa
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _kind(t: pa.DataType) -> str:
    """Kinds of types that two engines must agree on; widths may differ."""
    for kind, test in (("bool", pa.types.is_boolean), ("float", pa.types.is_floating), ("date", pa.types.is_date), ("time", pa.types.is_timestamp), ("null", pa.types.is_null)):
        if test(t):
            return kind
    if pa.types.is_integer(t) or pa.types.is_decimal(t) and t.scale == 0:
        return "whole"
    if pa.types.is_decimal(t):
        return f"decimal {t.scale}"
    return "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else "list" if pa.types.is_list(t) else str(t)


def _rows(table: pa.Table) -> list:
    """Values in full, floats to nine significant digits, in a fixed order of columns and rows."""

    def plain(v):
        if v is None:
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else str(v)

    return sorted(tuple(map(plain, r)) for r in zip(*(table.column(c).to_pylist() for c in sorted(table.column_names)), strict=True))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in sorted(entry.oracle_sql()) if not n.startswith(("op", "pipeline"))])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    kinds = lambda t: {f.name: _kind(f.type) for f in t.schema}
    assert kinds(got) == kinds(want)
    assert _rows(got) == _rows(want)
    assert got.num_rows or name in FEW, "proves nothing"


#: Queries whose rows are too rare for the smallest tables.
FEW = {"orphans_after_purge"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert entry.entry(spark).columns == ["search_id", "property_id", "price", "score", "position"]


@pytest.mark.parametrize(("name", "rows"), [("search_key", 1), ("index_filter", 1), ("frontier_urls", 3), ("recount_results", 1)])
def test_every_search_has_its_rows(spark, name, rows):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert entry.queries()[name](spark, SF).count() == rows * spark.read.parquet(f"{SF}/orders.parquet").count()


def test_consolidated_search_answers_every_search(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert entry.queries()["consolidated_search"](spark, SF).where("search_id % 20 <> 0").count() > 0


def test_every_text_is_cleaned(spark, tmp_path):
    texts = ["a &amp; b", "R&D", "&lt;b&gt;bold&lt;/b&gt; x", "caf&eacute;&nbsp; &#8364;5", "<p>plain</p>\n text", "&amp;lt; twice", "  ", "", None, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(t))).strip() if t else None
    got = entry.queries()["clean_texts"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, plain(t))) for i, t in rows)
