"""Streams over the driver's tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.components import shared_folder
from ..sources.buckets import BucketTable
from ..streaming import jobs, state
from .registry import query
from .views import view

#: Files of a micro-batch, and buckets of a state table.
FILES, BUCKETS = 8, 16


def _folder(spark) -> str:
    """A shared place for a stream's input, output and checkpoint."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _drain(stream, schema, folder: str):
    """All rows that an append stream gives for the input there is."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def _through(rows, apply, schema: str, folder: str):
    """All rows that the micro-batches of a stream of `rows` write; a batch that has none leaves no folder."""
    spark = rows.sparkSession
    rows.write.parquet(f"{folder}/in")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/batch=-1")
    jobs.each_batch(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), apply, f"{folder}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").drop("batch")


def _into_table(rows, apply, keys: list[str]):
    """The table that a stream of micro-batches leaves: rows in the files in which Spark writes them, FILES a batch."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")
    jobs.each_batch(stream, apply(f"{folder}/table"), f"{folder}/state").awaitTermination()
    return BucketTable(spark, f"{folder}/table", keys, BUCKETS).read()


@query("""SELECT document_id, arg_max(outbox_id, struct_pack(a := created_at, b := outbox_id)) AS outbox_id, arg_max(operation, struct_pack(a := created_at, b := outbox_id)) AS operation FROM v_outbox GROUP BY document_id""")
def stream_outbox_compaction(spark, sf):
    rows = view(spark, sf, "v_outbox")
    return _into_table(rows, lambda path: jobs.compact_outbox_to(spark, path, BUCKETS), ["document_id"]).select("document_id", "outbox_id", "operation")


@query("""SELECT source_code, external_id, arg_max(price, struct_pack(a := captured_at, b := price)) AS price, arg_max(active, struct_pack(a := captured_at, b := price)) AS active,
  CAST(min(captured_at) AS DATE) AS first_seen, CAST(max(captured_at) AS DATE) AS last_seen FROM v_snapshot GROUP BY source_code, external_id""")
def stream_listing_upserts(spark, sf):
    rows = view(spark, sf, "v_snapshot").select("source_code", "external_id", F.col("captured_at").cast("timestamp").alias("captured_at"), "price", "active")
    table = _into_table(rows, lambda path: jobs.upsert_listings_to(spark, path, BUCKETS), ["source_code", "external_id"])
    return table.select("source_code", "external_id", "price", "active", F.to_date("first_seen_at").alias("first_seen"), F.to_date("last_seen_at").alias("last_seen"))


@query("""SELECT source, source_id, v.sale_price AS sale_price, v.rental_price AS rental_price, v.url AS url, 'ACTIVE' AS status, created, updated
FROM (SELECT source, source_id, arg_max(struct_pack(sale_price := sale_price, rental_price := rental_price, url := url), r) AS v, CAST(min(updated_at) AS DATE) AS created, CAST(max(updated_at) AS DATE) AS updated
FROM (SELECT *, struct_pack(a := updated_at, b := id) AS r FROM (SELECT * FROM v_collector UNION ALL SELECT * REPLACE (CAST(NULL AS DECIMAL(14,2)) AS sale_price, updated_at + INTERVAL 1 DAY AS updated_at) FROM v_collector WHERE id % 3 = 0) t) u GROUP BY source, source_id) w""")
def stream_collector_upserts(spark, sf):
    rows = view(spark, sf, "v_collector").select("source", "source_id", F.col("id").alias("seq"), "sale_price", "rental_price", "url", F.col("updated_at").cast("timestamp").alias("seen_at"))
    again = rows.where("seq % 3 = 0").withColumns({"sale_price": F.lit(None).cast("decimal(14,2)"), "seen_at": F.col("seen_at") + F.expr("INTERVAL 1 DAY")})
    table = _into_table(rows.union(again), lambda path: jobs.upsert_collector_to(spark, path, BUCKETS), ["source", "source_id"])
    return table.select("source", "source_id", "sale_price", "rental_price", "url", "status", F.to_date("created_at").alias("created"), F.to_date("updated_at").alias("updated"))


@query("""WITH h AS (SELECT event_type AS source_code, date_trunc('hour', ts) AS hour, count(*) AS captures FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events)
SELECT source_code, hour, captures FROM h, m WHERE hour + INTERVAL 1 HOUR <= w""")
def stream_hourly_volume(spark, sf):
    folder = _folder(spark)
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("source_code"), F.col("ts").cast("timestamp").alias("captured_at"))
    rows.write.parquet(f"{folder}/in")
    stream = jobs.hourly_volume(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    return _drain(stream, stream.schema, folder).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT *, lag(price) OVER w AS old, lag(active) OVER w AS was, row_number() OVER w AS n FROM v_snapshot WINDOW w AS (PARTITION BY source_code, external_id ORDER BY captured_at, price))
SELECT source_code, external_id, CAST(captured_at AS DATE) AS day, 'PRICE_CHANGED' AS event_type, CAST(old AS VARCHAR) AS old_value, CAST(price AS VARCHAR) AS new_value FROM c WHERE n > 1 AND price IS DISTINCT FROM old
UNION ALL SELECT source_code, external_id, CAST(captured_at AS DATE), 'LISTING_REACTIVATED', NULL, NULL FROM c WHERE active AND NOT was""")
def stream_capture_events(spark, sf):
    folder = _folder(spark)
    rows = view(spark, sf, "v_snapshot").select("source_code", "external_id", F.col("captured_at").cast("timestamp").alias("captured_at"), "price", "active")
    events = _through(rows, jobs.capture_events_to(spark, f"{folder}/table", f"{folder}/out", BUCKETS), state.EVENTS, folder)
    return events.select("source_code", "external_id", F.to_date("captured_at").alias("day"), "event_type", "old_value", "new_value")


_BEATS = """b AS (SELECT search_id, started_at AS beat_at, 'RUNNING' AS status FROM v_psearch WHERE started_at IS NOT NULL UNION ALL SELECT search_id, last_heartbeat_at, 'RUNNING' FROM v_psearch WHERE last_heartbeat_at IS NOT NULL
  UNION ALL SELECT search_id, updated_at, status FROM v_psearch WHERE status IN ('COMPLETED', 'FAILED'))"""


@query(f"""WITH {_BEATS}, l AS (SELECT search_id, max(beat_at) AS last_beat, bool_or(status IN ('COMPLETED', 'FAILED')) AS done FROM b GROUP BY search_id)
SELECT search_id, last_beat FROM l WHERE NOT done AND last_beat + INTERVAL 30 MINUTE <= (SELECT max(beat_at) - INTERVAL 1 MINUTE FROM b)""")
def stream_stale_alerts(spark, sf):
    """Searches that had started and fell silent, by a stream of their heartbeats."""
    folder, rows = _folder(spark), view(spark, sf, "v_psearch")
    beat = lambda c, status, where: rows.where(where).select("search_id", F.col(c).cast("timestamp").alias("beat_at"), status.alias("status"))
    running = F.lit("RUNNING")
    beats = beat("started_at", running, "started_at is not null").union(beat("last_heartbeat_at", running, "last_heartbeat_at is not null")).union(beat("updated_at", F.col("status"), "status in ('COMPLETED', 'FAILED')"))
    alerts = _through(beats, jobs.stale_alerts_to(spark, f"{folder}/table", f"{folder}/out", buckets=BUCKETS), state.ALERTS, folder)
    return alerts.withColumn("last_beat", F.col("last_beat").cast("timestamp_ntz"))
