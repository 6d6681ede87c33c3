"""Frontier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier
from .registry import query
from .views import table, view


def _requests(spark, sf):
    return view(spark, sf, "v_search").select(
        "search_id", "city", "state", F.lit(None).cast("string").alias("neighborhood"), F.col("transaction_type").alias("transaction"), "property_type", F.col("price_min").alias("min_price"), F.col("price_max").alias("max_price"), F.col("area_min").alias("min_area"),
        F.lit(None).cast("double").alias("max_area"), F.col("bedrooms_min").alias("bedrooms"),
    )


_SLUG = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g')"


@query(f"""WITH s AS (SELECT *, {_SLUG('city')} AS c, lower(state) AS st, CASE transaction_type WHEN 'RENT' THEN 'aluguel' ELSE 'venda' END AS act FROM v_search)
SELECT search_id, 'CASAMINEIRA' AS portal, 'https://www.casamineira.com.br/' || act || '/imovel/' || c || '_' || st AS url FROM s
UNION ALL SELECT search_id, 'VIVAREAL', 'https://www.vivareal.com.br/' || act || '/' || {_SLUG('state')} || '/' || c || CASE property_type WHEN 'HOUSE' THEN '/casa_residencial' WHEN 'APARTMENT' THEN '/apartamento_residencial' ELSE '' END || '/?precoMinimo=' || CAST(CAST(price_min AS BIGINT) AS VARCHAR)
  || '&precoMaximo=' || CAST(CAST(price_max AS BIGINT) AS VARCHAR) || '&quartos=' || CAST(bedrooms_min AS VARCHAR) || coalesce('&areaMinima=' || CAST(CAST(area_min AS BIGINT) AS VARCHAR), '') FROM s
UNION ALL SELECT search_id, 'OLX', 'https://www.olx.com.br/imoveis/' || act || CASE property_type WHEN 'HOUSE' THEN '/casas' WHEN 'APARTMENT' THEN '/apartamentos' ELSE '' END || '/estado-' || st || '/' || c || '-e-regiao' FROM s""")
def frontier_urls(spark, sf):
    return frontier.frontier(_requests(spark, sf), ("CASAMINEIRA", "VIVAREAL", "OLX")).select("search_id", "portal", "url")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS municipality FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def municipality_match(spark, sf):
    nation = table(spark, sf, "nation")
    known = nation.select(F.lit("BR").alias("state"), F.col("n_name").alias("name"))
    rows = table(spark, sf, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select("c_custkey", F.concat(F.lit(" "), F.lower("n_name")).alias("city"), F.when(F.col("c_custkey") % 2 == 0, "br").otherwise("xx").alias("state"))
    return frontier.municipality_match(rows, known).select("c_custkey", "municipality")


@query("""WITH q AS (SELECT DISTINCT substr(n_name, 2, 2) AS query FROM nation)
SELECT query, name, state, rn FROM (SELECT q.query, n.n_name AS name, 'BR' AS state, CAST(row_number() OVER (PARTITION BY q.query ORDER BY NOT starts_with(lower(n.n_name), lower(q.query)), lower(n.n_name), n.n_name) AS INT) AS rn
FROM q JOIN nation n ON contains(lower(n.n_name), lower(q.query))) t WHERE rn <= 12""")
def city_autocomplete(spark, sf):
    nation = table(spark, sf, "nation")
    queries = nation.select(F.substring("n_name", 2, 2).alias("query")).distinct()
    return frontier.autocomplete(nation.select(F.col("n_name").alias("name"), F.lit("BR").alias("state")), queries)
