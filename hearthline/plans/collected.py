"""Queries over collected pages and documents: listings in JSON-LD pages, portal rows, documents of auctions, facts in texts.

Pages and documents are made by Spark from the given tables, one for each listing or property, so each query's SQL can say from those tables what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, keys, numbers, text, urls
from ..operators import documents, listings
from ..operators.dedup import spread
from . import pipelines
from .catalogue import COMPATIBLE, asked
from .registry import query
from .views import table, view

_BASE = "https://portal.example"
#: What a listing's page holds: one JSON-LD item.
_ITEM = """to_json(named_struct('@type', if(property_type = 'HOUSE', 'House', 'Apartment'), 'sku', listing_id, 'name', title, 'url', concat('/imovel/', listing_id), 'description', concat('<p>', title, '</p>'),
  'numberOfRooms', bedrooms, 'numberOfBathroomsTotal', bathrooms, 'floorSize', named_struct('value', area_m2), 'amenities', 'pool, gym; Pool', 'image', array('/a.jpg', concat('/', listing_id, '.jpg')), 'condoFee', condo_fee,
  'address', named_struct('streetAddress', concat('Rua ', title), 'addressLocality', city, 'addressRegion', lower(state)), 'offers', named_struct('price', price)))"""
_JOINED = "v_listing l JOIN v_property p ON p.property_id = l.property_id"


def _pages(spark, sf):
    # pages are dealt out before they are made and parsed: few bytes, of which adaptive execution would make few tasks
    rows = spread(view(spark, sf, "v_listing").join(view(spark, sf, "v_property"), "property_id"), "listing_id")
    rows = rows.withColumn("item", F.expr(_ITEM))
    html = F.concat(F.lit("<html><head><script type='application/ld+json'>"), "item", F.lit("</script></head><body><article><h1>x</h1></article></body></html>"))
    number = F.expr("property_id * 7 + cast(substring(source_code, 4) as bigint)")
    return rows.select(number.alias("page_id"), F.concat(F.lit(f"{_BASE}/busca/"), "listing_id").alias("url"), html.alias("html"), "listing_id")


@query(f"""SELECT l.listing_id AS external_id, '{_BASE}/imovel/' || l.listing_id AS url, trim(title) AS title, CASE WHEN property_type = 'HOUSE' THEN 'HOUSE' ELSE 'APARTMENT' END AS property_type, city, upper(state) AS state, 'Rua ' || title AS street,
  CAST(price AS DOUBLE) AS price, CAST(condo_fee AS DOUBLE) AS condo_fee, CAST(bedrooms AS INT) AS bedrooms, CAST(bathrooms AS INT) AS bathrooms, area_m2, 'POOL,GYM' AS amenities, '{_BASE}/a.jpg' AS image_url, 2 AS n_images, lower('Rua ' || title || ', Não informado, ' || city) AS normalized_address, CAST(NULL AS STRING) AS reject FROM {_JOINED}""")
def page_listings(spark, sf):
    """Pages to normalised listings: parsed, typed, addresses resolved, images and amenities made distinct."""
    items = extract.page_items(_pages(spark, sf))
    rows = listings.normalize_listings(items, "portal", "SALE", "APARTMENT", "nowhere")
    return rows.select(
        "external_id", "url", "title", "property_type", "city", "state", "street", "price", "condo_fee", "bedrooms", "bathrooms", "area_m2", F.array_join("amenities", ",").alias("amenities"), "image_url",
        F.size("image_urls").alias("n_images"), "normalized_address", "reject",
    )


@query(f"""SELECT l.listing_id AS source_id, title, CASE WHEN property_type = 'HOUSE' THEN 'HOUSE' ELSE 'APARTMENT' END AS property_type, city, lower(state) AS state, 'Rua ' || title AS street, CAST(price AS DOUBLE) AS sale_price, nullif(CAST(bedrooms AS INT), 0) AS bedrooms,
  nullif(CAST(bathrooms AS INT), 0) AS bathrooms, CAST(area_m2 AS INT) AS usable_area, '/a.jpg' AS image_url FROM {_JOINED} WHERE price > 0""")
def portal_page_rows(spark, sf):
    """The same pages as a portal's connector reads them."""
    rows = listings.portal_rows(extract.page_items(_pages(spark, sf)), "PORTAL", {"transaction": "SALE"})
    return rows.where("sale_price > 0").select("source_id", "title", "property_type", "city", "state", "street", "sale_price", F.expr("nullif(bedrooms, 0)").alias("bedrooms"), "bathrooms", "usable_area", "image_url")


@query(f"""SELECT l.listing_id AS external_id, '{_BASE}/g/' || l.listing_id AS url, property_type, transaction_type, upper(state) AS state, lower(p.normalized_address) AS normalized_address, CAST(price AS DOUBLE) AS price, area_m2, CAST(bedrooms AS INT) AS bedrooms FROM {_JOINED}""")
def gateway_payloads(spark, sf):
    """Payloads of a gateway to normalised listings."""
    rows = view(spark, sf, "v_listing").join(view(spark, sf, "v_property"), "property_id")
    payload = F.expr(f"""to_json(named_struct('externalId', listing_id, 'link', concat('{_BASE}/g/', listing_id), 'title', title, 'propertyType', property_type, 'transaction', transaction_type, 'state', lower(state),
      'address', upper(normalized_address), 'price', price, 'area_m2', area_m2, 'bedrooms', bedrooms))""")
    return listings.gateway_listings(rows.select(payload.alias("payload")), "gateway").select("external_id", "url", "property_type", "transaction_type", "state", "normalized_address", "price", "area_m2", "bedrooms")


#: An auction document for each property: layouts and marks vary with its id.
_DOC = f"""to_json(named_struct('id', cast(property_id as string), 'titulo', title, 'cidade', upper(city), 'estado', upper(state), 'bairro', neighborhood, 'endereco', normalized_address, 'preco_venda', price, 'area', area_m2, 'quartos', bedrooms,
  'tipo', property_type, 'ativo', property_id % 5 <> 0, 'situacao', if(property_id % 7 = 0, 'Vendido', 'disponivel'), 'url', if(property_id % 11 = 0, null, concat('{_BASE}/lote/', property_id)), 'descricao', concat('Lote ', title)))"""
_PRICED = "(SELECT p.*, r.price FROM v_property p JOIN (SELECT property_id, min(price) AS price FROM v_listing WHERE active GROUP BY property_id) r ON r.property_id = p.property_id)"


def _documents(spark, sf):
    price = view(spark, sf, "v_listing").where("active").groupBy("property_id").agg(F.min("price").alias("price"))
    return view(spark, sf, "v_property").join(price, "property_id").select("property_id", F.expr(_DOC).alias("doc"))


@query(f"SELECT property_id, property_id % 5 <> 0 AND property_id % 7 <> 0 AS available FROM {_PRICED} t")
def available_documents(spark, sf):
    return _documents(spark, sf).select("property_id", documents.available(F.col("doc")).alias("available"))


@query(f"""SELECT CAST(property_id AS STRING) AS id, title, '{_BASE}/lote/' || CAST(property_id AS STRING) AS href, upper(city) AS city, upper(state) AS state, neighborhood, CAST(price AS DOUBLE) AS price, area_m2 AS usable_area, CAST(bedrooms AS DOUBLE) AS bedrooms, property_type FROM {_PRICED} t WHERE property_id % 11 <> 0""")
def document_candidates(spark, sf):
    rows = documents.candidates(_documents(spark, sf))
    return rows.select("id", "title", "href", "city", "state", "neighborhood", "price", "usable_area", F.col("bedrooms").cast("double").alias("bedrooms"), "property_type")


@query(f"SELECT property_id FROM {_PRICED} t WHERE property_id % 5 <> 0 AND city = 'NATION_11' AND state = 'AMERICA' AND price BETWEEN 5000 AND 30000")
def document_prefilter(spark, sf):
    return documents.prefilter(_documents(spark, sf), "imoveis", "Nation_11", "America", min_price=5000, max_price=30000).select("property_id")


@query(f"SELECT property_id FROM {_PRICED} t WHERE property_id % 5 <> 0 AND property_id % 7 <> 0 AND (city = 'BRAZIL' OR contains(lower(state), 'asia') OR contains(lower(normalized_address), 'asia'))")
def document_prefilter_generic(spark, sf):
    return documents.prefilter(_documents(spark, sf), "other", "Brazil", "Asia").select("property_id")


@query(f"SELECT property_id FROM {_PRICED} t WHERE property_id % 5 <> 0 AND city = 'NATION_18' AND state = 'EUROPE'")
def document_collector_prefilter(spark, sf):
    return documents.collector_prefilter(_documents(spark, sf), " nation_18", "europe").select("property_id")


@query(f"""SELECT 'INTERNAL' AS source, CAST(property_id AS STRING) AS source_id, title, '{_BASE}/lote/' || CAST(property_id AS STRING) AS url, upper(city) AS city, upper(state) AS state, neighborhood, normalized_address AS street, CAST(price AS DOUBLE) AS sale_price,
  CAST(NULL AS DOUBLE) AS rental_price, area_m2 AS usable_area, bedrooms, CASE property_type WHEN 'APARTMENT' THEN 'APARTMENT' ELSE 'OTHER' END AS property_type FROM {_PRICED} t WHERE property_id % 11 <> 0""")
def document_rows(spark, sf):
    """Collector rows of auction documents."""
    rows = documents.collector_rows(_documents(spark, sf))
    return rows.select("source", "source_id", "title", "url", "city", "state", "neighborhood", "street", "sale_price", "rental_price", "usable_area", "bedrooms", "property_type")


#: A page of up to ten properties as a RealEstateListing whose offers list them: plain elements, and elements that hold the item; some aren't listings.
_OFFER = f"""named_struct('@type', 'Apartment', 'url', concat('{_BASE}/', if(property_id % 4 = 0, 'lancamento', 'imovel'), '/', property_id, '/'), 'name', title, 'sku', cast(property_id as string),
  'address', named_struct('streetAddress', if(property_id % 3 = 0, 'Não informado', concat('Rua ', property_id)), 'addressLocality', city), 'offers', named_struct('price', area_m2 * 1000))"""


@query(f"""SELECT property_id // 10 AS page_id, '{_BASE}/imovel/' || CAST(property_id AS STRING) || '/' AS url, CAST(property_id AS STRING) AS source_id, title, city, CASE WHEN property_id % 3 <> 0 THEN 'Rua ' || CAST(property_id AS STRING) END AS street, area_m2 * 1000 AS sale_price
FROM v_property WHERE property_id % 4 <> 0""")
def offer_listings(spark, sf):
    """Listings inside the offers of a page's one item."""
    rows = view(spark, sf, "v_property").withColumn("page_id", F.floor(F.col("property_id") / 10))
    plain, held = F.expr(f"to_json({_OFFER})"), F.expr(f"to_json(named_struct('@type', 'ListItem', 'position', 1, 'item', {_OFFER}))")
    element = F.when(F.col("property_id") % 2 == 0, plain).otherwise(held)
    pages = rows.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(element)), ",").alias("list"))  # ten elements at most
    item = F.concat(F.lit('{"@type":"RealEstateListing","offers":{"@type":"AggregateOffer","itemListElement":['), "list", F.lit("]}}"))
    pages = pages.select("page_id", F.lit(_BASE).alias("url"), F.lit(0).alias("seq"), item.alias("item"))
    found = listings.portal_rows(listings.offer_items(pages), "CHAVESNAMAO", {"transaction": "SALE"})
    return found.select("page_id", "url", "source_id", "title", "city", listings.street_or_null(F.col("street")).alias("street"), "sale_price")


#: A description for each part, and what it says.
_TEXT = """concat('Apto com ', p_size % 4 + 1, ' banheiros, ', p_size % 3 + 1, ' suítes e ', p_size % 5 + 1, ' vagas. Condomínio: R$ 1.', lpad(cast(p_size as string), 3, '0'), ',50 IPTU R$ ', p_size, ',25')"""


@query("""SELECT p_partkey, CAST(p_size % 4 + 1 AS INT) AS bathrooms, CAST(p_size % 3 + 1 AS INT) AS suites, CAST(p_size % 5 + 1 AS INT) AS parking, CAST(1000 + p_size + 0.5 AS DOUBLE) AS condominium, CAST(p_size + 0.25 AS DOUBLE) AS property_tax FROM part""")
def description_facts(spark, sf):
    c = F.col("t")
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_TEXT).alias("t"))
    return rows.select("p_partkey", extract.bathrooms(c).alias("bathrooms"), extract.suites(c).alias("suites"), extract.parking(c).alias("parking"), extract.condominium(c).alias("condominium"), extract.property_tax(c).alias("property_tax"))


@query("""SELECT p_partkey, CAST(p_size AS INT) AS usable_area, CAST(p_size % 5 AS INT) AS bedrooms, CAST(p_size % 4 AS INT) AS bathrooms, CAST(p_size % 3 AS INT) AS parking_spaces, 'Rua ' || p_name AS street, p_brand AS neighborhood FROM part""")
def card_facts(spark, sf):
    """Texts of a card: "80 m²", "3 quartos", ... and its place."""
    texts = F.expr("array(concat(p_size, ' m²'), concat(p_size % 5, ' quartos'), concat(p_size % 4, ' banheiros'), concat(p_size % 3, ' vagas'), 'novo')")
    place = F.expr("concat('Rua ', p_name, ', 10, ', p_brand, ' - Cidade')")
    return table(spark, sf, "part").select("p_partkey", extract.card_attributes(texts).alias("a"), extract.card_location(place).alias("l")).select("p_partkey", "a.*", "l.*")


@query("""SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) + 0.5 AS decimal, CAST(o_custkey AS INT) AS whole, CAST(floor(o_totalprice) AS DOUBLE) + 0.25 AS loose, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS number_or_null, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE CAST(o_custkey AS DOUBLE) END AS not_negative FROM orders""")
def number_texts(spark, sf):
    """Numbers in loose texts: with thousands and a comma, whole, with a unit, signed, and none."""
    whole = F.floor("o_totalprice").cast("string")
    thousands = F.expr("replace(format_number(floor(o_totalprice), 0), ',', '.')")
    return table(spark, sf, "orders").select(
        "o_orderkey", numbers.decimal(F.concat(F.lit("cerca de "), thousands, F.lit(",5 m²"))).alias("decimal"), numbers.integer(F.concat(F.col("o_custkey").cast("string"), F.lit(",9 quartos"))).alias("whole"),
        numbers.document_number(F.concat(F.lit("R$ "), thousands, F.lit(",25"))).alias("loose"), numbers.number_or_null(F.when(F.col("o_orderkey") % 3 == 0, "NaN").otherwise(F.col("o_custkey").cast("string"))).alias("number_or_null"),
        numbers.not_negative(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("-"), whole)).otherwise(F.col("o_custkey").cast("string"))).alias("not_negative"),
    )


@query("""SELECT page_id, substr(sha256(url), 1, 24) AS stable_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x/' || CAST(page_id AS STRING) AS absolute, CASE WHEN page_id % 2 = 0 THEN CAST(page_id + 1000000 AS STRING) ELSE 'sku' || CAST(page_id AS STRING) END AS generic_id FROM pages""")
def address_ids(spark, sf):
    """Ids of addresses and references resolved against their page."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("/x/"), F.col("page_id").cast("string")).alias("reference"))
    listing = F.concat(F.lit(f"{_BASE}/imovel/"), (F.col("page_id") + 1_000_000).cast("string"), F.lit("/"))
    sku = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("sku"), F.col("page_id").cast("string")))
    return rows.select("page_id", urls.stable_id(F.col("url")).alias("stable_id"), urls.absolute(F.col("reference"), F.col("url")).alias("absolute"), urls.generic_id(listing, sku).alias("generic_id"))


@query("""SELECT property_id, sha256('{"bedrooms":' || CAST(bathrooms AS STRING) || ',"city":"' || lower(city) || '"' || CASE WHEN property_id % 2 = 0 THEN ',"type":"' || lower(property_type) || '"' ELSE '' END || '}') AS key, lower(trim(title)) AS folded FROM v_property""")
def sorted_keys(spark, sf):
    """Keys of requests with sorted names, blanks left out, texts folded."""
    kind = F.when(F.col("property_id") % 2 == 0, F.col("property_type"))
    c = keys.sorted_key(type=keys.folded(kind), city=keys.folded(F.col("city")), bedrooms=F.col("bathrooms"))
    return view(spark, sf, "v_property").select("property_id", c.alias("key"), keys.folded(F.concat(F.lit("  "), "title")).alias("folded"))


_LABEL = "CASE property_type WHEN 'APARTMENT' THEN 'Apartamento' WHEN 'HOUSE' THEN 'Casa' WHEN 'PENTHOUSE' THEN 'Cobertura' WHEN 'COMMERCIAL' THEN 'Imóvel comercial' WHEN 'COMMERCIAL_ROOM' THEN 'Sala comercial' ELSE 'Imóvel' END"


@query(f"""SELECT property_id, {_LABEL} || CASE WHEN bedrooms = 1 THEN ' com 1 quarto' WHEN bedrooms > 1 THEN ' com ' || CAST(bedrooms AS STRING) || ' quartos' ELSE '' END || ' em ' || neighborhood || ', ' || city AS title,
  CASE WHEN property_type IN ('HOUSE', 'PENTHOUSE') THEN 'HOUSE' ELSE 'APARTMENT' END AS page_type, CASE property_id % 4 WHEN 0 THEN NULL ELSE 'Rua ' || title END AS street FROM v_property""")
def listing_titles(spark, sf):
    """Titles of listings without one, types of pages, and streets behind placeholders."""
    street = F.expr("case property_id % 8 when 0 then 'Não informado' when 4 then ' - ' else concat('Rua ', title) end")
    c = F.col
    return view(spark, sf, "v_property").select(
        "property_id", listings.title_of(c("property_type"), c("bedrooms"), c("neighborhood"), c("city")).alias("title"), listings.page_property_type(c("property_type")).alias("page_type"), listings.street_or_null(street).alias("street")
    )


@query("""SELECT p_partkey, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) AS key_text FROM part""")
def key_texts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.key_text(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).alias("key_text"))


_FOUND = f"""p AS (SELECT property_id, upper(city) AS city, upper(state) AS state, neighborhood, property_type, CAST(NULL AS STRING) AS transaction_type, CAST(bedrooms AS DOUBLE) AS bedrooms, area_m2, CAST(price AS DOUBLE) AS price FROM {_PRICED} t
  WHERE property_id % 5 <> 0 AND property_id % 7 <> 0 AND property_id % 11 <> 0)"""


@query(f"""WITH {_FOUND}, {COMPATIBLE}
SELECT search_id, 'mongo-' || CAST(property_id AS STRING) AS id, '{_BASE}/lote/' || CAST(property_id AS STRING) AS href, TRUE AS external, score AS match_score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, CAST(property_id AS STRING)) AS INT) AS rn FROM t WHERE score > 0) WHERE rn <= 6""")
def document_search(spark, sf):
    """Cards of the six best available documents of each search."""
    rows = pipelines.document_cards(_documents(spark, sf), asked(spark, sf), layout="imoveis")
    return rows.select("search_id", "id", "href", "external", "match_score", "rn")


def _collected(spark, sf):
    """A full run over the pages of two properties of three; what is known of all listings stands in `presence`."""
    pages = _pages(spark, sf).where("property_id % 3 <> 0").select(F.lit("run").alias("run_id"), "page_id", F.lit(1).alias("page_no"), "url", "html")
    last = spark.range(1).select(F.lit("run").alias("run_id"), F.lit(-1).cast("bigint").alias("page_id"), F.lit(2).alias("page_no"), F.lit("https://portal.example/").alias("url"), F.lit("<p>none</p>").alias("html"))
    stored = view(spark, sf, "v_listing")
    scope = {"scope_id": "all", "source": "portal", "transaction": "SALE", "property_type": "APARTMENT", "city": "nowhere"}
    presence = stored.selectExpr(
        "concat('portal-', listing_id) as listing_id", "'all' as scope_id", "cast(property_id % 4 as int) as misses", "'ACTIVE' as status",
        "if(property_id % 2 = 0, timestamp'2024-01-31 12:00:00', timestamp'2024-01-01 00:00:00') as last_seen_at", "cast(null as timestamp) as inactive_at",
    )
    known = stored.selectExpr("'portal' as source_code", "listing_id as external_id", "property_id", "cast(price as double) as price", "true as active")
    runs = spark.sql("select 'all' scope_id, date'2024-01-01' run_day, 'COMPLETED' status, 2L listings_found")
    return pipelines.collection_run(pages.union(last), scope, known, view(spark, sf, "v_property"), presence, runs, "2024-02-01", max_pages=1_000_000)


_ABSENT = "l.property_id % 4 + 1 >= 3 AND l.property_id % 2 = 1"


@query(f"""SELECT 'portal-' || l.listing_id AS listing_id, CAST(CASE WHEN l.property_id % 3 <> 0 THEN 0 ELSE l.property_id % 4 + 1 END AS INT) AS misses, CASE WHEN l.property_id % 3 <> 0 THEN 'ACTIVE' WHEN {_ABSENT} THEN 'INACTIVE' ELSE 'STALE' END AS status,
  l.property_id % 3 = 0 AND {_ABSENT} AS inactivated FROM {_JOINED}""")
def collection_presence(spark, sf):
    """Who was seen in a run, who was missed, and which listings went."""
    out = _collected(spark, sf)
    gone = out["inactivated"].select("listing_id").withColumn("inactivated", F.lit(True))
    return out["presence"].join(gone, "listing_id", "left").select("listing_id", "misses", "status", F.coalesce("inactivated", F.lit(False)).alias("inactivated"))


@query(f"""SELECT 'COMPLETED' AS status, TRUE AS complete, count(*) AS listings_found, count(*) AS snapshots, CAST(0 AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS reviews, count(*) AS documents FROM {_JOINED} WHERE l.property_id % 3 <> 0""")
def collection_summary(spark, sf):
    """A run's status and what it wrote."""
    out = _collected(spark, sf)
    n = lambda name: out[name].agg(F.count("*").alias(name))
    row = out["run"].select("status", "complete", F.col("listings_found").cast("bigint").alias("listings_found"))
    for name in ("snapshots", "rejected", "reviews", "documents"):
        row = row.join(F.broadcast(n(name)), F.lit(True))  # one row each
    return row


@query(f"""WITH c AS (SELECT l.listing_id, l.property_id FROM {_JOINED} WHERE l.property_id % 2 = 0)
SELECT listing_id AS external_id, property_id, 'PRICE_CHANGED' AS event_type FROM c WHERE property_id % 4 = 0 UNION ALL SELECT listing_id, property_id, 'LISTING_REACTIVATED' FROM c WHERE property_id % 6 = 0""")
def collection_events(spark, sf):
    """A full collection of all pages against what is stored of every second property: what has changed."""
    pages = _pages(spark, sf).select(F.lit("run").alias("run_id"), "page_id", F.lit(1).alias("page_no"), "url", "html")
    stored = view(spark, sf, "v_listing").where("property_id % 2 = 0").selectExpr(
        "'portal' as source_code", "listing_id as external_id", "property_id", "cast(price as double) + if(property_id % 4 = 0, 1, 0) as price", "property_id % 6 <> 0 as active"
    )
    scope = {"scope_id": "all", "source": "portal", "transaction": "SALE", "property_type": "APARTMENT", "city": "nowhere"}
    presence = spark.sql("select '' listing_id, '' scope_id, 0 misses, '' status, current_timestamp() last_seen_at, current_timestamp() inactive_at").where("false")
    runs = spark.sql("select '' scope_id, current_date() run_day, '' status, 0L listings_found").where("false")
    out = pipelines.collection_run(pages, scope, stored, view(spark, sf, "v_property"), presence, runs, "2024-02-01", max_pages=1_000_000)
    return out["events"].select("external_id", "property_id", "event_type")
