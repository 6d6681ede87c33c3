"""Relational reads in partitions, dated appends, crawl rules, and orders of names."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from hearthline.functions import extract
from hearthline.operators import documents, filters, frontier, listings
from hearthline.sources import io

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    url = "jdbc:derby:memory:listings;create=true"
    rows = spark.range(1000).selectExpr("cast(id * 3 as int) as id", "concat('t', id) as title", "date_add(date'2024-01-01', cast(id % 90 as int)) as seen", "if(id % 100 = 0, null, cast(id as int)) as price")
    rows.write.jdbc(url, "properties", properties=DERBY)
    return url


def test_a_relational_table_is_read_in_ranges(spark, database):
    rows = io.read_relational(spark, database, "properties", "id", 4, **DERBY)
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 1000 and max(r["count"] for r in sizes) < 300
    kept = rows.where("id >= 2000 and title like 't9%'").select("title")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "numPartitions=4" in plan and "GreaterThanOrEqual(ID,2000)" in plan.upper().replace("GREATERTHANOREQUAL", "GreaterThanOrEqual") and "*(1) Filter" not in plan
    assert kept.count() == 100  # t900 to t999


def test_bounds_come_from_the_rows_that_are_read(spark, database):
    rows = io.read_relational(spark, database, "properties", "seen", 3, '"id" < 150', **DERBY)
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 50 and rows.groupBy(F.spark_partition_id()).count().count() == 3
    assert io.read_relational(spark, database, "properties", "price", 3, **DERBY).where("price is null").count() == 10
    assert io.read_relational(spark, database, "properties", "id", 3, '"id" < 0', **DERBY).count() == 0


@pytest.mark.parametrize("by", ["day", "month"])
def test_dated_appends_are_read_by_their_folders(spark, tmp_path, by):
    rows = spark.range(200).selectExpr("id", "timestamp'2024-01-01 05:00:00' + make_interval(0, 0, 0, cast(id as int)) as captured_at")
    for k in (0, 1):
        io.append_snapshots(rows.where(f"id % 2 = {k}"), f"{tmp_path}/s", by)
    folders = [d for d in os.listdir(f"{tmp_path}/s") if d.startswith("capture_date=")]
    assert len(folders) == (200 if by == "day" else 7)
    got = io.read_snapshots(spark, f"{tmp_path}/s", "2024-02-10", "2024-03-05", by)
    assert sorted(r.id for r in got.select("id").collect()) == list(range(40, 65))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in plan
    assert len(got.inputFiles()) < 200 * 2 and io.read_snapshots(spark, f"{tmp_path}/s", last="2023-01-01", by=by).count() == 0


def test_crawl_rules_by_prefixes(spark):
    files = spark.createDataFrame(
        [("a", "User-agent: *\nDisallow: /x\nAllow: /x/y\nDisallow: /x/y/z\nAllow: /t\nDisallow: /t\n"), ("b", "User-agent: bot\nDisallow: /\nAllow: /é\n\nUser-agent: *\nAllow: /\n"), ("c", "User-agent: bot\n\nUser-agent: *\nDisallow: /\n"), ("d", None)],
        "host string, content string",
    )
    pages = [("a", "/x", 1), ("a", "/x/y", 2), ("a", "/x/y/z/1", 3), ("a", "/", 4), ("a", "/t1", 5), ("a", None, 6), ("b", "/q", 7), ("b", "/éa", 8), ("c", "/q", 9), ("d", "/q", 10), ("e", "/q", 11), (None, "/q", 12), ("a", "/x", 1)]
    table = spark.createDataFrame(pages, "host string, path string, n int")
    got = filters.robots_allowed(table, extract.robots_rules(files), "Bot/2").collect()
    assert len(got) == len(pages)
    # agents on end without a rule between share what follows, so c's rule is the agent's own
    assert {r.n for r in got if not r.allowed} == {1, 3, 7, 9}


def test_names_stand_in_the_order_of_the_language(spark):
    names = ["Agudos", "Água Branca", "Águas", "Aguanil", "água branca", "Agua Branca", "Zé Doca", "Abaíra", "Ágata"]
    table = spark.createDataFrame([(n, "SP") for n in names], "name string, state string")
    got = frontier.autocomplete(table, spark.createDataFrame([("ag",), ("a",)], "query string"))
    order = [r.name for r in got.orderBy("rn").collect()]
    assert order == ["Ágata", "Agua Branca", "água branca", "Água Branca", "Aguanil", "Águas", "Agudos"]


def test_a_document_is_read_as_a_variant(spark):
    docs = ['{"titulo": "a", "preco_venda": 1500.50, "n": {"x": 1}, "l": ["u", {"url": "v"}], "ativo": true, "big": 12345678901234567890}', "no json", None, "[]", '{"titulo": ""}']
    got = spark.createDataFrame([(d,) for d in docs], "doc string").select(*[documents.field(F.col("doc"), n).alias(n) for n in ("titulo", "preco_venda", "ativo", "l", "big", "none")]).collect()
    assert [r.titulo for r in got] == ["a", None, None, None, ""]
    assert (float(got[0].preco_venda), got[0].ativo, got[0].big, got[0].none) == (1500.5, "true", "12345678901234567890", None)
    assert got[0].l.replace(" ", "") == '["u",{"url":"v"}]'


def test_offers_list_their_items(spark):
    item = '{"offers": [{"itemListElement": [{"url": "h/imovel/1"}, {"item": {"url": "h/imovel/2", "p": {"q": 1}}}, {"url": "h/x/3"}, 5, null]}]}'
    rows = spark.createDataFrame([(1, 0, item), (2, 7, '{"offers": {"itemListElement": {"url": "h/imovel/9"}}}'), (3, 0, "no"), (4, 0, None)], "page_id int, seq int, item string")
    got = listings.offer_items(rows).orderBy("seq").collect()
    assert [(r.page_id, r.url, r.seq.place) for r in got] == [(1, "h/imovel/1", 0), (1, "h/imovel/2", 1)]
    assert got[1].item.replace(" ", "") == '{"p":{"q":1},"url":"h/imovel/2"}'
