"""History, presence and run health queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import history
from ..operators.components import shared_folder
from ..sources import io
from .registry import query
from .views import view

_W = "PARTITION BY source_code, external_id ORDER BY captured_at, price"


@query("""SELECT property_id, source_code, external_id, captured_at, price, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY captured_at DESC, source_code, external_id, price) AS INT) AS rn FROM v_snapshot) t WHERE rn <= 30""")
def price_history_top30(spark, sf):
    return history.price_history(view(spark, sf, "v_snapshot")).select("property_id", "source_code", "external_id", "captured_at", "price", "rn")


@query(f"""SELECT source_code, external_id, property_id, captured_at, 'PRICE_CHANGED' AS event_type, CAST(old AS VARCHAR) AS old_value, CAST(price AS VARCHAR) AS new_value
FROM (SELECT *, lag(price) OVER ({_W}) AS old, row_number() OVER ({_W}) AS n FROM v_snapshot) t WHERE n > 1 AND price IS DISTINCT FROM old""")
def price_changed_events(spark, sf):
    return history.price_changes(view(spark, sf, "v_snapshot"))


@query(f"SELECT source_code, external_id, property_id, captured_at, 'LISTING_REACTIVATED' AS event_type FROM (SELECT *, lag(active) OVER ({_W}) AS was FROM v_snapshot) t WHERE active AND NOT was")
def reactivated_events(spark, sf):
    return history.reactivations(view(spark, sf, "v_snapshot"))


@query("""SELECT source_code, external_id, arg_max(property_id, captured_at) AS property_id, arg_max(price, captured_at) AS price, arg_max(condo_fee, captured_at) AS condo_fee, arg_max(active, captured_at) AS active,
  min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at FROM v_snapshot GROUP BY source_code, external_id""")
def listing_current(spark, sf):
    return history.current_listings(view(spark, sf, "v_snapshot"))


@query("""SELECT l.property_id, count(DISTINCT l.source_code) AS listings, CAST(least(30, any_value(s.n)) AS BIGINT) AS history FROM v_listing l JOIN (SELECT property_id, count(*) AS n FROM v_snapshot GROUP BY property_id) s ON s.property_id = l.property_id GROUP BY l.property_id""")
def property_details(spark, sf):
    captures = view(spark, sf, "v_snapshot")
    rows = history.property_details(captures.select("property_id").distinct(), view(spark, sf, "v_listing"), captures, history.price_changes(captures))
    return rows.select("property_id", F.size("listings").cast("bigint").alias("listings"), F.size("history").cast("bigint").alias("history"))


def _presence(spark, sf):
    """Presence after the log up to a day, as of that day; the day's runs and sightings."""
    seen, runs = view(spark, sf, "v_seen"), view(spark, sf, "v_run")
    return seen, runs, runs.agg(F.date_add(F.min("run_day"), 15).alias("day")).first().day


@query("""WITH d AS (SELECT min(run_day) + 15 AS day FROM v_run),
b AS (SELECT listing_id, scope_id, max(run_day) AS last_seen FROM v_seen, d WHERE run_day < d.day GROUP BY listing_id, scope_id),
h AS (SELECT r.scope_id FROM v_run r, d WHERE r.run_day = d.day AND r.status = 'COMPLETED' AND r.run_type = 'FULL'),
t AS (SELECT DISTINCT s.listing_id, s.scope_id FROM v_seen s, d WHERE s.run_day = d.day)
SELECT coalesce(b.listing_id, t.listing_id) AS listing_id, coalesce(b.scope_id, t.scope_id) AS scope_id,
  CAST(CASE WHEN t.listing_id IS NOT NULL THEN 0 WHEN h.scope_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS misses,
  CASE WHEN t.listing_id IS NOT NULL OR h.scope_id IS NULL THEN 'ACTIVE' WHEN b.last_seen <= d.day - 2 THEN 'INACTIVE' ELSE 'STALE' END AS status
FROM b FULL JOIN t ON t.listing_id = b.listing_id AND t.scope_id = b.scope_id LEFT JOIN h ON h.scope_id = coalesce(b.scope_id, t.scope_id) CROSS JOIN d""")
def presence_after_run(spark, sf):
    return _after(spark, sf).select("listing_id", "scope_id", "misses", "status")


def _after(spark, sf):
    seen, runs, day = _presence(spark, sf)
    before = seen.where(F.col("run_day") < F.lit(day)).groupBy("listing_id", "scope_id").agg(F.max("run_day").cast("timestamp").alias("last_seen_at"))
    before = before.select("listing_id", "scope_id", F.lit(0).alias("misses"), F.lit("ACTIVE").alias("status"), "last_seen_at", F.lit(None).cast("timestamp").alias("inactive_at"))
    today = seen.where(F.col("run_day") == F.lit(day)).select("listing_id", "scope_id", F.col("run_day").cast("timestamp").alias("seen_at"))
    marked = history.mark_seen(before, today)
    return history.apply_absences(marked, today, runs.where(F.col("run_day") == F.lit(day)), day.isoformat(), misses=1, hours=48)


@query("""WITH d AS (SELECT min(run_day) + 15 AS day FROM v_run),
b AS (SELECT listing_id, scope_id, max(run_day) AS last_seen FROM v_seen, d WHERE run_day <= d.day GROUP BY listing_id, scope_id),
h AS (SELECT r.scope_id FROM v_run r, d WHERE r.run_day = d.day AND r.status = 'COMPLETED' AND r.run_type = 'FULL'),
s AS (SELECT b.listing_id, h.scope_id IS NOT NULL AND b.last_seen <= d.day - 2 AS gone FROM b LEFT JOIN h ON h.scope_id = b.scope_id CROSS JOIN d)
SELECT listing_id, 'LISTING_INACTIVATED' AS event_type, 'MISSING_FROM_HEALTHY_FULL_RUNS' AS reason FROM s GROUP BY listing_id HAVING bool_and(gone)""")
def global_inactivation(spark, sf):
    return history.global_inactivations(_after(spark, sf))


@query("""WITH f AS (SELECT scope_id, run_day FROM v_run WHERE status = 'COMPLETED' AND run_type = 'FULL'), l AS (SELECT listing_id, scope_id, max(run_day) AS last_seen FROM v_seen GROUP BY listing_id, scope_id),
m AS (SELECT l.listing_id, l.scope_id, l.last_seen, count(f.run_day) AS misses, max(f.run_day) AS last_full FROM l LEFT JOIN f ON f.scope_id = l.scope_id AND f.run_day > l.last_seen GROUP BY l.listing_id, l.scope_id, l.last_seen)
SELECT listing_id, scope_id, last_seen, misses, CASE WHEN misses = 0 THEN 'ACTIVE' WHEN misses >= 3 AND last_full - last_seen >= 2 THEN 'INACTIVE' ELSE 'STALE' END AS status FROM m""")
def presence_replay(spark, sf):
    return history.presence_replay(view(spark, sf, "v_seen"), view(spark, sf, "v_run"))


_PREVIOUS = "last_value(CASE WHEN status = 'COMPLETED' THEN listings_found END IGNORE NULLS) OVER (PARTITION BY scope_id ORDER BY run_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT scope_id, run_day, listings_found, {_PREVIOUS} AS previous FROM v_run")
def prev_healthy_asof(spark, sf):
    return history.previous_healthy(view(spark, sf, "v_run")).select("scope_id", "run_day", "listings_found", "previous")


@query(f"""SELECT scope_id, run_day, outcome, CASE WHEN outcome = 'COMPLETED' THEN 'HEALTHY' ELSE 'DEGRADED' END AS health FROM (SELECT scope_id, run_day, CASE WHEN previous >= 10 AND listings_found < previous * 0.9 THEN 'SUSPECT' ELSE status END AS outcome
FROM (SELECT *, {_PREVIOUS} AS previous FROM v_run) t) u""")
def volume_drop(spark, sf):
    return history.volume_drops(view(spark, sf, "v_run"), ratio=0.1).select("scope_id", "run_day", "outcome", "health")


@query("""WITH p AS (SELECT scope_id AS run_id, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY run_day) AS INT) AS page_no, CASE WHEN day(run_day) % 11 = 0 THEN 0 ELSE listings_found END AS n_items FROM v_run),
s AS (SELECT run_id, min(CASE WHEN n_items = 0 THEN page_no END) AS stop FROM p GROUP BY run_id)
SELECT p.run_id, count(*) AS pages_processed, CAST(sum(n_items) AS BIGINT) AS listings_found, coalesce(max(stop <= 20), FALSE) AS complete, CASE WHEN coalesce(max(stop <= 20), FALSE) THEN 'EMPTY_PAGE' ELSE 'MAX_PAGES' END AS stop_reason
FROM p JOIN s ON s.run_id = p.run_id WHERE page_no <= 20 AND (stop IS NULL OR page_no <= stop) GROUP BY p.run_id""")
def run_completeness(spark, sf):
    pages = view(spark, sf, "v_run").selectExpr("scope_id as run_id", "cast(row_number() over (partition by scope_id order by run_day) as int) as page_no", "case when day(run_day) % 11 = 0 then 0 else listings_found end as n_items")
    return history.run_completeness(pages, 20)


@query("""SELECT source_code, date_trunc('month', captured_at)::DATE AS month, count(*) AS captures, sum(price) AS total FROM v_snapshot WHERE captured_at >= DATE '1995-02-10' AND captured_at < DATE '1996-03-21' GROUP BY 1, 2""")
def dated_snapshots(spark, sf):
    """Captures of two appends, read back for some days: only the folders of their months are opened."""
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = view(spark, sf, "v_snapshot").select("source_code", "external_id", F.col("captured_at").cast("timestamp").alias("captured_at"), "price")
    for part in (rows.where("property_id % 2 = 0"), rows.where("property_id % 2 = 1")):
        io.append_snapshots(part, path, "month")
    found = io.read_snapshots(spark, path, "1995-02-10", "1996-03-20", "month")
    return found.groupBy("source_code", F.to_date(F.date_trunc("month", "captured_at")).alias("month")).agg(F.count("*").alias("captures"), F.sum("price").alias("total"))
