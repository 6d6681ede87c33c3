"""Requests, queues, index and outbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums, keys
from ..operators import index, maintenance, requests, search
from . import pipelines
from .registry import query
from .views import view

NOW = "1998-06-01 12:00:00"
_NOW = f"CAST('{NOW}' AS TIMESTAMP)"
_BEAT = "coalesce(last_heartbeat_at, started_at, updated_at)"


@query("""WITH h AS (SELECT r.request_id, r.search_key, r.requested_at, c.search_id, c.completed_at FROM v_request r ASOF LEFT JOIN (SELECT search_key, completed_at, max(search_id) AS search_id FROM v_psearch WHERE status = 'COMPLETED' AND completed_at IS NOT NULL GROUP BY search_key, completed_at) c
  ON r.search_key = c.search_key AND r.requested_at >= c.completed_at)
SELECT request_id, search_key, requested_at, CASE WHEN completed_at >= requested_at - INTERVAL 1440000 MINUTE THEN search_id END AS cached_id FROM h""")
def cached_as_of(spark, sf):
    return requests.cached_as_of(view(spark, sf, "v_request"), view(spark, sf, "v_psearch"), ttl_minutes=1_440_000)


@query(f"""WITH live AS (SELECT search_key, arg_max(search_id, struct_pack(a := created_at, b := search_id)) AS id FROM v_psearch WHERE (status = 'PENDING' AND created_at >= {_NOW} - INTERVAL 30000 MINUTE) OR (status = 'RUNNING' AND {_BEAT} >= {_NOW} - INTERVAL 30000 MINUTE) GROUP BY search_key),
fresh AS (SELECT search_key, arg_max(search_id, struct_pack(a := completed_at, b := search_id)) AS id FROM v_psearch WHERE status = 'COMPLETED' AND completed_at >= {_NOW} - INTERVAL 20000 MINUTE GROUP BY search_key),
f AS (SELECT search_key, min(request_id) AS first_id FROM v_request GROUP BY search_key)
SELECT r.request_id, r.search_key, CASE WHEN live.id IS NOT NULL THEN 'REUSED' WHEN fresh.id IS NOT NULL THEN 'CACHED' WHEN r.request_id = f.first_id THEN 'CREATED' ELSE 'REUSED_NEW' END AS outcome, coalesce(live.id, fresh.id) AS search_id,
  CASE WHEN coalesce(live.id, fresh.id) IS NULL THEN f.first_id END AS created_by
FROM v_request r LEFT JOIN live ON live.search_key = r.search_key LEFT JOIN fresh ON fresh.search_key = r.search_key JOIN f ON f.search_key = r.search_key""")
def request_outcome(spark, sf):
    return requests.request_outcomes(view(spark, sf, "v_request"), view(spark, sf, "v_psearch"), NOW, ttl_minutes=20_000, stale_minutes=30_000)


@query(f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_key ORDER BY created_at DESC, search_id DESC) AS rn FROM v_psearch) t WHERE rn = 1),
d AS (SELECT *, CASE WHEN last_collected_at > {_NOW} - INTERVAL 60000 MINUTE THEN 'CACHE_FRESH' WHEN status = 'RUNNING' AND lock_expires_at > {_NOW} THEN 'ALREADY_RUNNING'
  WHEN status = 'FAILED' AND collection_finished_at > {_NOW} - INTERVAL 90000 MINUTE THEN 'FAILURE_COOLDOWN' ELSE 'CLAIM' END AS decision FROM l)
SELECT search_key, search_id, status, decision, CASE WHEN decision = 'CLAIM' THEN {_NOW} + INTERVAL 30 MINUTE ELSE lock_expires_at END AS lock_expires_at FROM d""")
def claim_decision(spark, sf):
    return requests.claim_decisions(view(spark, sf, "v_psearch"), NOW, cache=60_000, running=30, cooldown=90_000)


_RECOVER = f"""WITH f AS (SELECT *, status = 'RUNNING' AND {_BEAT} < {_NOW} - INTERVAL 30 MINUTE AS dead, status = 'PENDING' AND created_at < {_NOW} - INTERVAL 60 MINUTE AS late FROM v_psearch),
r AS (SELECT search_id, status, CASE WHEN dead AND attempts < 3 THEN 'PENDING' WHEN dead OR late THEN 'FAILED' ELSE status END AS new_status, dead OR late AS recovered,
  CASE WHEN dead AND attempts < 3 THEN {_NOW} + INTERVAL 5 MINUTE WHEN NOT dead THEN next_attempt_at END AS new_next_attempt_at, CASE WHEN late OR (dead AND attempts >= 3) THEN {_NOW} WHEN NOT dead THEN completed_at END AS new_completed_at,
  CASE WHEN dead THEN '{enums.RECOVERED}' WHEN late THEN '{enums.EXPIRED}' END AS error_message FROM f)
"""


@query(f"{_RECOVER}SELECT * FROM r")
def stale_recovery(spark, sf):
    return requests.recover_stale(view(spark, sf, "v_psearch"), NOW).select("search_id", "status", "new_status", "recovered", "new_next_attempt_at", "new_completed_at", "error_message")


@query(f"{_RECOVER}SELECT new_status, count(*) AS n FROM r WHERE recovered GROUP BY new_status")
def stale_recovery_counts(spark, sf):
    return requests.recovery_counts(requests.recover_stale(view(spark, sf, "v_psearch"), NOW))


@query("SELECT search_key, search_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY search_key ORDER BY created_at DESC, search_id DESC) AS rn FROM v_psearch) t WHERE rn = 1")
def latest_per_key(spark, sf):
    rows = search.latest_per_key(view(spark, sf, "v_psearch"), ["search_key"], [F.desc("created_at"), F.desc("search_id")])
    return rows.select("search_key", "search_id", "status", "created_at")


@query("""WITH e AS (SELECT user_id AS search_id, event_type AS source, event_type <> 'error' AND event_type <> 'click' AS ok, event_type || ' failed' AS error, CAST(event_id % 50 AS INT) AS retry_after, CAST(user_id % 4 AS INT) AS attempt FROM events)
SELECT search_id, CASE WHEN bool_or(ok) THEN 'COMPLETED' WHEN max(attempt) < 3 THEN 'RETRYING' ELSE 'FAILED' END AS status,
  CASE WHEN bool_or(ok) THEN nullif(substr(coalesce(string_agg(CASE WHEN NOT ok THEN source || ': ' || error END, '; ' ORDER BY source || ': ' || error), ''), 1, 2000), '') ELSE arg_max(error, struct_pack(a := retry_after, b := source, c := error)) FILTER (WHERE NOT ok) END AS message,
  CASE WHEN NOT bool_or(ok) THEN max(retry_after) END AS retry_after FROM e GROUP BY search_id""")
def run_outcome(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id as search_id", "event_type as source", "event_type <> 'error' and event_type <> 'click' as ok", "concat(event_type, ' failed') as error", "cast(event_id % 50 as int) as retry_after", "cast(user_id % 4 as int) as attempt"
    )
    return requests.run_outcomes(rows)


@query("""SELECT DISTINCT r.search_id, c.id AS property_id FROM v_result r JOIN v_collector c ON c.source_id = CAST(r.property_id AS VARCHAR) AND c.source = 'src1' WHERE NOT EXISTS (SELECT 1 FROM v_result o JOIN v_collector d ON d.source_id = CAST(o.property_id AS VARCHAR) AND d.source = 'src1' WHERE o.search_id = r.search_id AND d.id = c.id AND o.search_id % 3 = 0)""")
def new_result_links(spark, sf):
    items = view(spark, sf, "v_result").select("search_id", F.lit("src1").alias("source"), F.col("property_id").cast("string").alias("source_id"))
    rows = view(spark, sf, "v_collector")
    none = requests.new_links(items.where("false"), rows, spark.createDataFrame([], "search_id long, property_id long"))
    linked = requests.new_links(items.where("search_id % 3 = 0"), rows, none)
    return requests.new_links(items, rows, linked)


@query("""SELECT search_id, id, rn FROM (SELECT r.search_id, c.id, CAST(row_number() OVER (PARTITION BY r.search_id ORDER BY c.updated_at DESC, c.id DESC) AS INT) AS rn FROM v_result r JOIN v_collector c ON c.id = r.property_id) t WHERE rn <= 100""")
def newest_search_results(spark, sf):
    return requests.newest_results(view(spark, sf, "v_result"), view(spark, sf, "v_collector")).select("search_id", "id", "rn")


@query("""SELECT search_id, sha256('{"collectorVersion":"multi-portal-v9","city":"' || lower(city) || '","state":"' || lower(state) || '","neighborhood":null,"transaction":"' || transaction_type || '","propertyType":' || coalesce('"' || property_type || '"', 'null')
  || ',"minPrice":' || CAST(CAST(price_min AS BIGINT) AS VARCHAR) || ',"maxPrice":' || CAST(CAST(price_max AS BIGINT) AS VARCHAR) || ',"minArea":' || coalesce(CAST(CAST(area_min AS BIGINT) AS VARCHAR), 'null') || ',"maxArea":null,"bedrooms":' || CAST(bedrooms_min AS VARCHAR) || '}') AS search_key FROM v_search""")
def search_key(spark, sf):
    c, none = F.col, F.lit(None)
    key = keys.search_key(
        city=c("city"), state=c("state"), neighborhood=none.cast("string"), transaction=c("transaction_type"), property_type=c("property_type"), min_price=c("price_min"), max_price=c("price_max"), min_area=c("area_min"), max_area=none.cast("double"), bedrooms=c("bedrooms_min")
    )
    return view(spark, sf, "v_search").select("search_id", key.alias("search_key"))


@query("SELECT listing_id, lower(source_code) || '-' || external_id AS id FROM v_listing")
def document_id(spark, sf):
    return view(spark, sf, "v_listing").select("listing_id", keys.document_id(F.col("source_code"), F.col("external_id")).alias("id"))


def _documents(spark, sf):
    p = view(spark, sf, "v_property").select("property_id", "title", "property_type", "transaction_type", "city", "state", "neighborhood", "normalized_address", "bedrooms", "area_m2")
    return index.index_documents(view(spark, sf, "v_listing").join(p, "property_id"))


@query("""SELECT l.listing_id AS id, upper(source_code) AS source, external_id AS source_listing_id, title, transaction_type AS transactions, CASE WHEN transaction_type = 'SALE' THEN price END AS sale_price, CASE WHEN transaction_type <> 'SALE' THEN price END AS rental_price, p.city, normalized_address AS street, url,
  CASE WHEN active THEN 'ACTIVE' ELSE 'INACTIVE' END AS status FROM v_listing l JOIN v_property p ON p.property_id = l.property_id""")
def index_document(spark, sf):
    return _documents(spark, sf).select("id", "source", "source_listing_id", "title", F.array_join("transaction_types", ",").alias("transactions"), "sale_price", "rental_price", "city", "street", "url", "status")


@query("""SELECT l.listing_id AS id, CASE WHEN length(p.state) > 2 THEN 'state' ELSE '' END || CASE WHEN l.property_id % 5 = 0 THEN ',url' ELSE '' END AS violations FROM v_listing l JOIN v_property p ON p.property_id = l.property_id""")
def document_violations(spark, sf):
    docs = _documents(spark, sf).withColumn("url", F.when(F.col("property_id").cast("long") % 5 != 0, F.col("url")))
    return index.violations(docs).select("id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT document_id, arg_max(outbox_id, struct_pack(a := created_at, b := outbox_id)) AS outbox_id, arg_max(operation, struct_pack(a := created_at, b := outbox_id)) AS operation, max(created_at) AS created_at, count(*) AS merged FROM v_outbox GROUP BY document_id""")
def outbox_lastwins(spark, sf):
    return index.compact_outbox(view(spark, sf, "v_outbox"))


@query("SELECT outbox_id, document_id, status, attempts FROM v_outbox WHERE status IN ('PENDING', 'FAILED') AND attempts < 5 ORDER BY created_at, outbox_id LIMIT 50")
def outbox_batch(spark, sf):
    return index.pending(view(spark, sf, "v_outbox")).select("outbox_id", "document_id", "status", "attempts")


@query("""WITH o AS (SELECT l.*, p.title, property_id * 7 + CAST(substring(source_code, 4) AS BIGINT) AS outbox_id, CASE property_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END AS status, property_id % 7 AS attempts FROM v_listing l JOIN v_property p USING (property_id)),
d AS (SELECT * FROM o WHERE status IN ('PENDING', 'FAILED') AND attempts < 5 ORDER BY captured_at, outbox_id LIMIT 50)
SELECT listing_id AS id, title, price, CASE WHEN active THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, '' AS violations FROM d WHERE property_id % 5 <> 0
UNION ALL SELECT listing_id, title, price, CASE WHEN active THEN 'ACTIVE' ELSE 'INACTIVE' END, 'url' FROM o WHERE property_id % 5 = 0""")
def index_projection(spark, sf):
    """From the outbox to documents: the valid ones among the oldest pending rows, and all that break a rule."""
    place = view(spark, sf, "v_property").select("property_id", "title", "property_type", "transaction_type", "city", F.substring("state", 1, 2).alias("state"), "neighborhood", "bedrooms", "area_m2")
    rows = view(spark, sf, "v_listing").join(place, "property_id").withColumn("url", F.when(F.col("property_id") % 5 != 0, F.col("url")))
    status = F.when(F.col("property_id") % 3 == 0, "COMPLETED").when(F.col("property_id") % 3 == 1, "FAILED").otherwise("PENDING")
    number = F.expr("property_id * 7 + cast(substring(source_code, 4) as bigint)")
    outbox = rows.select(number.alias("outbox_id"), F.col("listing_id").alias("document_id"), status.alias("status"), (F.col("property_id") % 7).cast("int").alias("attempts"), F.col("captured_at").alias("created_at"))
    valid, broken = pipelines.index_projection(rows, outbox)
    price = lambda at: F.coalesce(f"{at}sale_price", f"{at}rental_price")
    valid = valid.select("id", "structData.title", price("structData.").alias("price"), "structData.status", F.lit("").alias("violations"))
    return valid.union(broken.select("id", "title", price(""), "status", F.array_join("violations", ",")))


@query("""WITH c AS (SELECT s.search_id, c.*, row_number() OVER (PARTITION BY s.search_id, c.source ORDER BY c.id) AS place FROM v_result r JOIN v_query s ON s.search_id = r.search_id JOIN v_collector c ON c.id // 7 = r.property_id AND lower(c.city) = lower(s.city)
  WHERE (s.property_type IS NULL OR c.property_type = s.property_type) AND coalesce(c.bedrooms, 0) >= s.bedrooms_min AND (s.area_min IS NULL OR (c.usable_area IS NOT NULL AND c.usable_area >= s.area_min))
  AND (CASE WHEN s.transaction_type = 'RENT' THEN c.rental_price ELSE c.sale_price END) BETWEEN s.price_min AND s.price_max),
d AS (SELECT *, row_number() OVER (PARTITION BY search_id, street, neighborhood, property_type, usable_area, bedrooms, bathrooms, parking_spaces, sale_price IS NULL ORDER BY id) AS nth FROM c WHERE place <= 6)
SELECT search_id, id AS property_id FROM d WHERE nth = 1 OR (usable_area IS NULL AND bedrooms IS NULL)""")
def portal_links(spark, sf):
    """An on-demand search over all portals: what the stated searches link after caps and copies across portals."""
    asked = view(spark, sf, "v_query").select(
        "search_id", "city", "state", F.lit(None).cast("string").alias("neighborhood"), "property_type", F.col("transaction_type").alias("transaction"), F.col("bedrooms_min").alias("bedrooms"), F.col("area_min").alias("min_area"),
        F.lit(None).cast("double").alias("max_area"), F.col("price_min").alias("min_price"), F.col("price_max").alias("max_price"),
    )
    none = F.lit(None)
    rows = view(spark, sf, "v_collector").withColumns({"description": none.cast("string"), "suites": none.cast("int")}).drop("status", "updated_at")
    results = view(spark, sf, "v_result").join(asked.select("search_id"), "search_id", "left_semi")
    collected = rows.join(results.withColumnRenamed("property_id", "_property"), F.floor(F.col("id") / 7) == F.col("_property")).drop("_property").withColumn("seq", F.col("id"))
    seen = {c: F.lit("2024-01-01").cast("timestamp") for c in ("first_seen_at", "created_at", "last_seen_at", "updated_at")}
    stored = rows.where("source <> 'src6'").withColumns({"status": F.lit("ACTIVE"), **seen})
    links = spark.createDataFrame([], "search_id long, property_id long")
    return pipelines.portal_results(asked, collected, stored, links, "2024-02-01")["links"].select("search_id", "property_id")


@query("SELECT status, count(*) AS n FROM v_psearch GROUP BY status")
def queue_status_counts(spark, sf):
    return maintenance.status_counts(view(spark, sf, "v_psearch"))
