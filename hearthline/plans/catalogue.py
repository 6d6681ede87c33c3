"""Search, catalogue, averages and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import cards, filters, search
from . import pipelines
from .registry import query
from .views import view

_ROLLUP = """r AS (SELECT property_id, min(price) AS price, min(condo_fee) AS condo_fee, count(DISTINCT source_code) AS source_count,
    array_to_string(list_sort(list(DISTINCT source_code)), ',') AS sources FROM v_listing WHERE active GROUP BY property_id)"""
_MATCH = """p.transaction_type = s.transaction_type AND (s.property_type IS NULL OR p.property_type = s.property_type)
    AND (s.price_min IS NULL OR coalesce(r.price, 0) >= s.price_min) AND (s.price_max IS NULL OR coalesce(r.price, 0) <= s.price_max)
    AND (s.area_min IS NULL OR coalesce(p.area_m2, 0) >= s.area_min) AND (s.bedrooms_min IS NULL OR coalesce(p.bedrooms, 0) >= s.bedrooms_min)
    AND (s.parking_spaces_min IS NULL OR coalesce(p.parking_spaces, 0) >= s.parking_spaces_min)"""
_SCORE = """20 + CASE WHEN (s.price_min IS NULL OR coalesce(r.price, 0) >= s.price_min) AND (s.price_max IS NULL OR coalesce(r.price, 0) <= s.price_max) THEN 30 ELSE 0 END + 25
    + CASE WHEN s.area_min IS NULL OR coalesce(p.area_m2, 0) >= s.area_min THEN 10 ELSE 0 END
    + CASE WHEN s.bedrooms_min IS NULL OR coalesce(p.bedrooms, 0) >= s.bedrooms_min THEN 10 ELSE 0 END
    + CASE WHEN s.parking_spaces_min IS NULL OR coalesce(p.parking_spaces, 0) >= s.parking_spaces_min THEN 5 ELSE 0 END"""


@query(f"""WITH {_ROLLUP}, h AS (SELECT s.search_id, p.property_id, r.price, CAST(least(100, {_SCORE}) AS INT) AS score
  FROM v_property p JOIN r ON r.property_id = p.property_id JOIN v_search s ON lower(s.city) = lower(p.city) WHERE {_MATCH})
SELECT search_id, property_id, price, score, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, price, property_id) AS INT) AS position FROM h""")
def consolidated_search(spark, sf):
    return search.consolidated_search(view(spark, sf, "v_property"), view(spark, sf, "v_listing"), view(spark, sf, "v_search"))


@query(f"""WITH {_ROLLUP} SELECT s.search_id, p.property_id, CAST(least(100, {_SCORE}) AS INT) AS score,
  array_to_string(list_filter([CASE WHEN (s.price_min IS NULL OR coalesce(r.price, 0) >= s.price_min) AND (s.price_max IS NULL OR coalesce(r.price, 0) <= s.price_max) THEN 'Preço dentro da faixa' END,
  'Bairro desejado', CASE WHEN s.area_min IS NULL OR coalesce(p.area_m2, 0) >= s.area_min THEN 'Metragem compatível' END,
  CASE WHEN s.bedrooms_min IS NULL OR coalesce(p.bedrooms, 0) >= s.bedrooms_min THEN 'Quartos compatíveis' END,
  CASE WHEN s.parking_spaces_min IS NULL OR coalesce(p.parking_spaces, 0) >= s.parking_spaces_min THEN 'Vagas compatíveis' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM v_property p JOIN r ON r.property_id = p.property_id JOIN v_query s ON lower(s.city) = lower(p.city)""")
def rank_with_reasons(spark, sf):
    return search.rank_candidates(view(spark, sf, "v_property"), view(spark, sf, "v_listing"), view(spark, sf, "v_query"), "; ")


@query(f"""WITH {_ROLLUP} SELECT r.property_id, price, condo_fee, CAST(source_count AS INT) AS source_count, sources FROM r""")
def listing_rollup(spark, sf):
    return search.listing_rollup(view(spark, sf, "v_listing")).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {_ROLLUP}, f AS (SELECT DISTINCT property_id FROM v_result WHERE search_id % 10 = 0)
SELECT p.property_id, p.title, r.price, CAST(r.source_count AS INT) AS source_count, f.property_id IS NOT NULL AS favorite FROM v_property p JOIN r ON r.property_id = p.property_id LEFT JOIN f ON f.property_id = p.property_id""")
def priced_properties(spark, sf):
    # favourites: the results of the searches whose number ends in 0
    favorites = view(spark, sf, "v_result").where("search_id % 10 = 0")
    rows = search.priced_properties(view(spark, sf, "v_property"), view(spark, sf, "v_listing"), favorites)
    return rows.select("property_id", "title", "price", "source_count", "favorite")


_CATALOGUE = "status = 'ACTIVE' AND (sale_price IS NOT NULL OR rental_price IS NULL) AND bedrooms >= 2 AND usable_area >= 40 AND usable_area <= 180 AND sale_price >= 1000"


def _catalogue(spark, sf):
    return filters.catalogue(view(spark, sf, "v_collector"), "SALE", bedrooms=2, min_area=40, max_area=180, min_price=1000)


@query(f"SELECT id, source, city, sale_price, usable_area, updated_at FROM v_collector WHERE {_CATALOGUE} ORDER BY updated_at DESC, id DESC LIMIT 100 OFFSET 20")
def catalogue_page(spark, sf):
    return search.page(_catalogue(spark, sf), 5000, 20).select("id", "source", "city", "sale_price", "usable_area", "updated_at")


@query(f"SELECT count(*) AS total FROM v_collector WHERE {_CATALOGUE}")
def catalogue_total(spark, sf):
    return search.total(_catalogue(spark, sf))


@query("""SELECT count(*) AS total FROM v_collector WHERE status = 'ACTIVE' AND rental_price IS NOT NULL AND lower(city) = 'brazil' AND lower(property_type) = 'house' AND rental_price <= 1500""")
def catalogue_rent_total(spark, sf):
    return search.total(filters.catalogue(view(spark, sf, "v_collector"), "RENT", city="BRAZIL", property_type="House", max_price=1500))


_ONCE = "o AS (SELECT {keys} property_id, arg_min(coalesce(sale_price, rental_price), id) AS price, arg_min_null(usable_area, id) AS usable_area FROM (SELECT *, id // 7 AS property_id FROM v_collector WHERE status = 'ACTIVE') GROUP BY {keys} property_id)"
_MEANS = """round(CAST(sum(CASE WHEN price > 0 THEN price END) AS DOUBLE) / count(CASE WHEN price > 0 THEN 1 END), 6) AS average_price, count(CASE WHEN price > 0 THEN 1 END) AS price_sample,
  round(avg(CASE WHEN price > 0 AND usable_area > 0 THEN CAST(price AS DOUBLE) / usable_area END), 4) AS average_price_per_area, count(CASE WHEN price > 0 AND usable_area > 0 THEN 1 END) AS area_sample"""


def _cards(spark, sf):
    rows = view(spark, sf, "v_collector").where("status = 'ACTIVE'")
    return rows.select("id", "city", F.floor(F.col("id") / 7).alias("card"), F.coalesce("sale_price", "rental_price").alias("price"), "usable_area")


@query(f"WITH {_ONCE.format(keys='')} SELECT {_MEANS} FROM o")
def value_averages(spark, sf):
    return search.value_averages(_cards(spark, sf), card="card", order="id")


@query(f"WITH {_ONCE.format(keys='city,')} SELECT city, {_MEANS} FROM o GROUP BY city")
def value_averages_by_city(spark, sf):
    return search.value_averages(_cards(spark, sf), ["city"], card="card", order="id")


@query("""SELECT state, city, neighborhood, round(CAST(sum(coalesce(sale_price, rental_price)) AS DOUBLE) / count(*), 6) AS average_price, count(*) AS price_sample FROM v_collector WHERE coalesce(sale_price, rental_price) > 0 GROUP BY ROLLUP (state, city, neighborhood)""")
def value_averages_rollup(spark, sf):
    return search.averages_by_place(view(spark, sf, "v_collector").withColumn("price", F.coalesce("sale_price", "rental_price")))


@query("""SELECT city, source, id, rn FROM (SELECT city, source, id, CAST(row_number() OVER (PARTITION BY city, source ORDER BY updated_at DESC, id) AS INT) AS rn FROM v_collector WHERE status = 'ACTIVE') t WHERE rn <= 6""")
def top_n_per_source(spark, sf):
    rows = view(spark, sf, "v_collector").where("status = 'ACTIVE'")
    return search.top_n(rows, ["city", "source"], [F.desc("updated_at"), "id"], 6).select("city", "source", "id", "rn")


@query("""SELECT 'collector-' || CAST(id AS VARCHAR) AS id, coalesce(nullif(title, ''), 'x') AS title, url AS href, TRUE AS external, city, sale_price AS price, usable_area, source AS sources, FALSE AS favorite FROM v_collector WHERE status = 'ACTIVE'""")
def collector_cards(spark, sf):
    rows = cards.collector_cards(view(spark, sf, "v_collector").where("status = 'ACTIVE'"))
    return rows.select("id", "title", "href", "external", "city", "price", "usable_area", F.array_join("sources", ",").alias("sources"), "favorite")


_WORD = lambda c: f"CASE upper(strip_accents(trim({c}))) WHEN 'APARTAMENTO' THEN 'APARTMENT' WHEN 'CASA' THEN 'HOUSE' WHEN 'COMERCIAL' THEN 'COMMERCIAL' WHEN 'VENDA' THEN 'SALE' WHEN 'ALUGUEL' THEN 'RENT' ELSE upper(strip_accents(trim({c}))) END"  # noqa: E731, E501


def _text_sql(a: str, b: str) -> str:
    x, y = _WORD(f"coalesce({a}, '')"), _WORD(f"coalesce({b}, '')")
    words = lambda c: f"list_filter(regexp_split_to_array({c}, '[^A-Za-z0-9_]+'), lambda w: w <> '')"
    overlap = f"CASE WHEN len({words(x)}) > 0 AND len({words(y)}) > 0 THEN len(list_filter({words(y)}, lambda w: list_contains({words(x)}, w))) / len({words(y)})::DOUBLE ELSE 0.0 END"
    return f"(CASE WHEN {y} = '' THEN 1.0 WHEN {x} = '' THEN 0.35 WHEN {x} = {y} THEN 1.0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.8 ELSE {overlap} END)"


_RANGE = """(CASE WHEN p.price IS NULL THEN 0.45 WHEN p.price < s.price_min THEN greatest(0.0, 1 - (p.price - s.price_min) / -greatest(s.price_min, 1)) WHEN p.price > s.price_max THEN greatest(0.0, 1 - (p.price - s.price_max) / greatest(s.price_max, 1)) ELSE 1.0 END)"""


#: Pairs of p and s with their scores, and the six best of each search; p and s go before.
COMPATIBLE = f"""s AS (SELECT search_id, city, state, property_type, transaction_type, bedrooms_min, area_min, CAST(price_min AS DOUBLE) AS price_min, CAST(price_max AS DOUBLE) AS price_max FROM v_query),
k AS (SELECT s.search_id, p.property_id,
  28 * {_text_sql('p.city', 's.city')} + 10 * {_text_sql('p.state', 's.state')} + CASE WHEN s.property_type IS NULL THEN 0.0 ELSE 14 * {_text_sql('p.property_type', 's.property_type')} END
  + 8 * {_text_sql('p.transaction_type', 's.transaction_type')} + 8 * (CASE WHEN p.bedrooms IS NULL THEN 0.45 WHEN p.bedrooms >= s.bedrooms_min OR s.bedrooms_min <= 0 THEN 1.0 ELSE p.bedrooms / s.bedrooms_min::DOUBLE END)
  + CASE WHEN s.area_min IS NULL THEN 0.0 ELSE 7 * (CASE WHEN p.area_m2 IS NULL THEN 0.45 WHEN p.area_m2 < s.area_min THEN greatest(0.0, 1 - (s.area_min - p.area_m2) / greatest(s.area_min, 1)) ELSE 1.0 END) END + 7 * {_RANGE} AS score,
  28 + 10 + 8 + 8 + 7 + CASE WHEN s.property_type IS NULL THEN 0 ELSE 14 END + CASE WHEN s.area_min IS NULL THEN 0 ELSE 7 END AS possible FROM p JOIN s ON p.city IN (s.city, upper(s.city), lower(s.city)) AND p.state IN (s.state, upper(s.state), lower(s.state)) WHERE (s.price_min IS NULL OR p.price >= s.price_min) AND (s.price_max IS NULL OR p.price <= s.price_max)),
t AS (SELECT search_id, property_id, CAST(floor(score / possible * 100 + 0.5) AS INT) AS score FROM k)"""


@query(f"""WITH {_ROLLUP}, p AS (SELECT v.property_id, v.city, v.state, v.neighborhood, v.property_type, v.transaction_type, v.bedrooms, v.area_m2, CAST(r.price AS DOUBLE) AS price FROM v_property v JOIN r ON r.property_id = v.property_id), {COMPATIBLE}
SELECT search_id, property_id, score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, property_id) AS INT) AS rn FROM t WHERE score > 0) WHERE rn <= 6""")
def compat_score_topk(spark, sf):
    p = search.priced_properties(view(spark, sf, "v_property"), view(spark, sf, "v_listing"))
    none = F.lit(None).cast("string")
    p = p.select("property_id", "city", "state", "neighborhood", none.alias("address"), none.alias("description"), "property_type", F.col("transaction_type").alias("transaction"), "bedrooms", F.col("area_m2").alias("usable_area"), F.col("price").cast("double").alias("price"))
    return search.compatibility_top(p, asked(spark, sf), 6).select("search_id", "property_id", "score", "rn")


def asked(spark, sf):
    """The stated queries as requests of portals and document sources."""
    return view(spark, sf, "v_query").select(
        "search_id", "city", "state", F.lit(None).cast("string").alias("neighborhood"), "property_type", F.col("transaction_type").alias("transaction"), F.col("bedrooms_min").alias("bedrooms"), F.col("area_min").alias("min_area"),
        F.lit(None).cast("double").alias("max_area"), F.col("price_min").cast("double").alias("min_price"), F.col("price_max").cast("double").alias("max_price"),
    )


@query("""SELECT search_id, 'status: ANY("ACTIVE") AND transactionTypes: ANY("' || transaction_type || '") AND city: ANY("' || city || '")' || coalesce(' AND propertyType: ANY("' || property_type || '")', '')
  || ' AND ' || CASE WHEN transaction_type = 'RENT' THEN 'rentalPrice' ELSE 'salePrice' END || ' >= ' || CAST(CAST(price_min AS BIGINT) AS VARCHAR) || ' AND ' || CASE WHEN transaction_type = 'RENT' THEN 'rentalPrice' ELSE 'salePrice' END || ' <= ' || CAST(CAST(price_max AS BIGINT) AS VARCHAR)
  || coalesce(' AND usableArea >= ' || CAST(CAST(area_min AS BIGINT) AS VARCHAR), '') || ' AND bedrooms >= ' || CAST(bedrooms_min AS VARCHAR) AS filter FROM v_search""")
def index_filter(spark, sf):
    s = view(spark, sf, "v_search").withColumn("neighborhoods", F.array().cast("array<string>")).alias("s")
    return s.select("s.search_id", filters.index_filter("s").alias("filter"))


@query("""SELECT s.search_id, c.id FROM v_collector c JOIN v_query s ON lower(c.city) = lower(s.city)
WHERE (s.property_type IS NULL OR c.property_type = s.property_type) AND (s.bedrooms_min IS NULL OR coalesce(c.bedrooms, 0) >= s.bedrooms_min) AND (s.area_min IS NULL OR (c.usable_area IS NOT NULL AND c.usable_area >= s.area_min))
  AND (CASE WHEN s.transaction_type = 'RENT' THEN c.rental_price ELSE c.sale_price END) BETWEEN s.price_min AND s.price_max""")
def collector_match(spark, sf):
    s = view(spark, sf, "v_query").select(
        "search_id", "city", F.lit(None).cast("string").alias("neighborhood"), "property_type", F.col("transaction_type").alias("transaction"), F.col("bedrooms_min").alias("bedrooms"), F.col("area_min").alias("min_area"),
        F.lit(None).cast("double").alias("max_area"), F.col("price_min").alias("min_price"), F.col("price_max").alias("max_price"),
    )
    return search.collector_matches(view(spark, sf, "v_collector"), s).select("search_id", "id")


@query("""SELECT CASE WHEN price_min > 20000 AND bedrooms_min > 1 THEN 'minimum area above maximum' WHEN bedrooms_min = 0 THEN 'bedrooms must be a whole number from 0' END AS error, count(*) AS n FROM v_search GROUP BY 1""")
def criteria_errors(spark, sf):
    bad_area = (F.col("price_min") > 20000) & (F.col("bedrooms_min") > 1)
    rows = view(spark, sf, "v_search").select(
        F.col("city"), F.col("state"), F.lit(" ").alias("neighborhood"), F.col("property_type"), F.lower("transaction_type").alias("transaction"), F.col("price_min").alias("min_price"), F.col("price_max").alias("max_price"),
        F.when(bad_area, 90).otherwise(10).alias("min_area"), F.lit(80).alias("max_area"), F.when(F.col("bedrooms_min") == 0, -1).otherwise(F.col("bedrooms_min")).alias("bedrooms"),
    )
    return filters.validate_criteria(rows).groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT property_id FROM (SELECT property_id FROM v_property WHERE city = 'BRAZIL' UNION ALL SELECT property_id FROM v_result WHERE search_id % 7 = 0) t""")
def cached_or_indexed(spark, sf):
    cached = view(spark, sf, "v_property").where("city = 'BRAZIL'").select("property_id")
    return search.distinct_union(cached, view(spark, sf, "v_result").where("search_id % 7 = 0").select("property_id"))


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN 'collected' ELSE 'stored' END AS origin FROM (SELECT id FROM v_collector WHERE source IN ('src1', 'src2')) a FULL JOIN (SELECT id FROM v_collector WHERE source IN ('src2', 'src3')) b ON a.id = b.id""")
def collected_over_stored(spark, sf):
    rows = view(spark, sf, "v_collector").select("id", "source")
    a = rows.where("source in ('src1', 'src2')").select("id", F.lit("collected").alias("origin"))
    b = rows.where("source in ('src2', 'src3')").select("id", F.lit("stored").alias("origin"))
    return search.first_wins([a, b], "id")


@query("SELECT id, source FROM v_collector WHERE source NOT IN ('src1', 'src5', 'src6')")
def enabled_sources_only(spark, sf):
    rows = view(spark, sf, "v_collector").select("id", "source")
    sources = rows.select(F.col("source").alias("code")).distinct().withColumn("enabled", ~F.col("code").isin("src1", "src5"))
    return filters.without_disabled(rows, sources, internal=("src6",))


@query(f"""WITH {_ROLLUP}, h AS (SELECT s.search_id, p.property_id, CAST(r.price AS DOUBLE) AS price, p.area_m2 FROM v_property p JOIN r ON r.property_id = p.property_id JOIN v_query s ON lower(s.city) = lower(p.city) WHERE {_MATCH})
SELECT search_id, round(sum(CASE WHEN price > 0 THEN price END) / count(CASE WHEN price > 0 THEN 1 END), 6) AS average_price, count(CASE WHEN price > 0 THEN 1 END) AS price_sample,
  round(avg(CASE WHEN price > 0 AND area_m2 > 0 THEN price / area_m2 END), 4) AS average_price_per_area, count(CASE WHEN price > 0 AND area_m2 > 0 THEN 1 END) AS area_sample FROM h GROUP BY search_id""")
def search_averages(spark, sf):
    """Averages over the results of each search."""
    _, averages = pipelines.searches_with_averages(view(spark, sf, "v_property"), view(spark, sf, "v_listing"), view(spark, sf, "v_query"))
    return averages.select("search_id", "average_price", "price_sample", "average_price_per_area", "area_sample")


@query(f"""WITH {_ROLLUP} SELECT CAST(p.property_id AS STRING) AS id, title, '/property/' || CAST(p.property_id AS STRING) AS href, FALSE AS external, city, price, area_m2 AS usable_area, sources, FALSE AS favorite FROM v_property p JOIN r ON r.property_id = p.property_id""")
def consolidated_cards(spark, sf):
    rows = cards.consolidated_cards(search.priced_properties(view(spark, sf, "v_property"), view(spark, sf, "v_listing")))
    return rows.select("id", "title", "href", "external", "city", "price", "usable_area", F.array_join("sources", ",").alias("sources"), "favorite")
