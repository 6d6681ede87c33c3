"""Repair and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance
from ..sources import io
from .registry import query
from .views import table, view


@query("SELECT DISTINCT property_id FROM v_listing WHERE source_code <> 'src6' AND property_id NOT IN (SELECT property_id FROM v_listing WHERE source_code = 'src6')")
def orphans_after_purge(spark, sf):
    rows = view(spark, sf, "v_listing")
    return maintenance.orphans_after_purge(rows, rows.where("source_code <> 'src6'").select(F.col("source_code").alias("code")).distinct())


@query("""WITH o AS (SELECT DISTINCT property_id FROM v_listing WHERE source_code <> 'src6' AND property_id NOT IN (SELECT property_id FROM v_listing WHERE source_code = 'src6'))
SELECT 'result' AS name, count(*) AS n FROM v_result WHERE property_id NOT IN (SELECT property_id FROM o) UNION ALL SELECT 'snapshot', count(*) FROM v_snapshot WHERE property_id NOT IN (SELECT property_id FROM o)""")
def rows_after_purge(spark, sf):
    kept = maintenance.purge_source({"result": (view(spark, sf, "v_result"), "property_id"), "snapshot": (view(spark, sf, "v_snapshot"), "property_id")}, orphans_after_purge(spark, sf))
    return maintenance.table_summary(kept)


_URL = "CASE property_id % 3 WHEN 0 THEN 'https://x/-aluguel-' WHEN 1 THEN 'https://x/-venda-' ELSE 'https://x/y' END"


@query("""SELECT r.search_id, r.property_id FROM v_result r JOIN v_search s ON s.search_id = r.search_id WHERE (r.property_id % 3 = 0 AND s.transaction_type = 'SALE') OR (r.property_id % 3 = 1 AND s.transaction_type = 'RENT')""")
def mismatched_links(spark, sf):
    properties = view(spark, sf, "v_property").select("property_id", F.expr(_URL).alias("url"))
    return maintenance.mismatched_links(view(spark, sf, "v_result"), view(spark, sf, "v_search"), properties)


@query("SELECT s.search_id, count(r.property_id) AS results_count FROM v_search s LEFT JOIN v_result r ON r.search_id = s.search_id GROUP BY s.search_id")
def recount_results(spark, sf):
    return maintenance.recount(view(spark, sf, "v_search"), view(spark, sf, "v_result"))


@query("""SELECT l.listing_id, CASE WHEN l.property_id % 4 = 3 THEN l.property_id - l.property_id % 16 % 4 WHEN l.property_id % 4 IN (1, 2) THEN l.property_id - l.property_id % 4 ELSE l.property_id END AS property_id FROM v_listing l""")
def apply_merge_map(spark, sf):
    # chains: 4k+3 -> 4k+2 -> 4k+1 -> 4k
    rows = view(spark, sf, "v_listing")
    merges = rows.select("property_id").distinct().where("property_id % 4 > 0").select("property_id", (F.col("property_id") - 1).alias("candidate_id"))
    merges = merges.union(view(spark, sf, "v_property").where("property_id % 4 > 0").select("property_id", (F.col("property_id") - 1).alias("candidate_id"))).distinct()
    return maintenance.apply_merges(rows, maintenance.resolve_merges(merges)).select("listing_id", "property_id")


@query("""SELECT id, CASE WHEN property_id % 3 = 0 THEN NULL WHEN property_id % 3 = 1 THEN coalesce(sale_price, rental_price) ELSE sale_price END AS sale_price, CASE WHEN property_id % 3 = 0 THEN coalesce(rental_price, sale_price) WHEN property_id % 3 = 1 THEN NULL ELSE rental_price END AS rental_price
FROM (SELECT *, CAST(source_id AS BIGINT) AS property_id FROM v_collector) t""")
def repaired_transactions(spark, sf):
    rows = view(spark, sf, "v_collector").withColumn("property_id", F.col("source_id").cast("bigint")).withColumn("url", F.expr(_URL))
    return maintenance.repair_transaction(rows).select("id", "sale_price", "rental_price")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'listing', count(*) FROM v_listing UNION ALL SELECT 'review_queue', count(*) FROM v_outbox UNION ALL SELECT 'pending_reviews', count(*) FROM v_outbox WHERE status = 'PENDING'")
def table_summary(spark, sf):
    return maintenance.table_summary({"orders": table(spark, sf, "orders"), "events": table(spark, sf, "events"), "listing": view(spark, sf, "v_listing"), "review_queue": view(spark, sf, "v_outbox")})


@query("SELECT scope_id, run_day, status, label FROM (SELECT r.*, 'scope ' || r.scope_id AS label FROM v_run r) t ORDER BY run_day DESC, scope_id LIMIT 100")
def last_runs(spark, sf):
    runs = view(spark, sf, "v_run")
    scopes = runs.select("scope_id").distinct().withColumn("label", F.concat(F.lit("scope "), F.col("scope_id")))
    return maintenance.last_runs(runs, scopes).select("scope_id", "run_day", "status", "label")


@query("""WITH c AS (SELECT * FROM v_collector WHERE source <> 'src6'), b AS (SELECT * FROM v_collector WHERE source IN ('src5', 'src6'))
SELECT coalesce(b.source, c.source) AS source, coalesce(b.source_id, c.source_id) AS source_id, CASE WHEN b.id IS NOT NULL THEN b.sale_price * 2 ELSE c.sale_price END AS sale_price, CASE WHEN b.id IS NOT NULL THEN 'ACTIVE' ELSE c.status END AS status,
  CASE WHEN b.id IS NOT NULL THEN TIMESTAMP '2001-01-01' ELSE c.updated_at END AS updated_at, coalesce(c.updated_at, TIMESTAMP '2001-01-01') AS created_at FROM c FULL JOIN b ON b.source = c.source AND b.source_id = c.source_id""")
def collector_upsert(spark, sf):
    rows = view(spark, sf, "v_collector").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    rows = rows.withColumns({"first_seen_at": F.col("updated_at"), "created_at": F.col("updated_at"), "last_seen_at": F.col("updated_at")})
    batch = rows.where("source in ('src5', 'src6')").withColumns({"sale_price": (F.col("sale_price") * 2).cast("decimal(14,2)"), "seq": F.lit(1)})
    batch = batch.unionByName(batch.withColumns({"sale_price": F.lit(1).cast("decimal(14,2)"), "seq": F.lit(0)}))
    return io.upsert(rows.where("source <> 'src6'"), batch, "2001-01-01 00:00:00").select("source", "source_id", "sale_price", "status", "updated_at", "created_at")
