"""Outbox compaction, upserts and hourly volumes as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.buckets import BucketTable, Merge, last_by

def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that hands micro-batches to `apply(batch, id)`, which must be idempotent by id."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_buckets(table: BucketTable, merge: Merge) -> Callable[[DataFrame, int], None]:
    """For each_batch(): every micro-batch is merged into a table's touched buckets, once for each batch id; versions that no restart needs go."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if table.apply(batch, batch_id, merge) and batch_id:
            table.vacuum(batch_id - 1)  # that batch is committed, as this one has started

    return apply


def compact_outbox_to(spark: SparkSession, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Last operation per document, in a table of buckets by document."""
    keys = ["document_id"]
    merge = last_by(keys, ["created_at", "outbox_id"])
    return into_buckets(BucketTable(spark, path, keys, buckets), lambda batch, current: merge(batch.select("document_id", "outbox_id", "operation", "created_at"), current))


def upsert_listings_to(spark: SparkSession, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Current listings after each micro-batch of captures(source_code, external_id, captured_at, ...): values of the last capture, first_seen_at, last_seen_at."""
    keys = ["source_code", "external_id"]
    merge = last_by(keys, ["last_seen_at"], ("first_seen_at", "last_seen_at"))
    return into_buckets(BucketTable(spark, path, keys, buckets), lambda batch, current: merge(batch.withColumnRenamed("captured_at", "last_seen_at"), current))


def upsert_collector_to(spark: SparkSession, path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """The flat collector table after micro-batches of rows(source, source_id, seq, seen_at, ...): the values of a key's last row by (seen_at, seq), nulls too; first_seen_at and created_at stay those of its first."""
    keys = ["source", "source_id"]
    merge = last_by(keys, ["last_seen_at", "seq"], ("first_seen_at", "last_seen_at"))

    def step(batch: DataFrame, current: DataFrame | None) -> DataFrame:
        rows = merge(batch.withColumnRenamed("seen_at", "last_seen_at"), None if current is None else current.drop("created_at", "updated_at", "status"))
        return rows.withColumns({"created_at": F.col("first_seen_at"), "updated_at": F.col("last_seen_at"), "status": F.lit("ACTIVE")})

    return into_buckets(BucketTable(spark, path, keys, buckets), step)


def capture_events_to(spark: SparkSession, path: str, out: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """state.capture_events() without a Python call for each listing: every micro-batch's events go to `out`, in a folder of its own, by windows over its captures and the last capture of each listing,
    which a table of buckets under `path` holds. Captures older than that are dropped."""
    keys, values = ["source_code", "external_id"], ["captured_at", "price", "active"]
    table, merge = BucketTable(spark, path, keys, buckets), last_by(keys, ["captured_at", "price"])

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*keys, *values)
        touched = [r[0] for r in batch.select(table.bucket()).distinct().collect()]  # at most `buckets`
        before = table.read(batch_id, touched)
        rows = batch.withColumn("known", F.lit(False))
        if before is not None:
            rows = rows.unionByName(before.select(*batch.columns).withColumn("known", F.lit(True)))
            last = F.max(F.when(F.col("known"), F.col("captured_at"))).over(Window.partitionBy(*keys))
            rows = rows.withColumn("last", last).where("last is null or captured_at >= last").drop("last")
        _events(rows, F.desc("known"), "captured_at", "price").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if table.apply(batch, batch_id, merge) and batch_id:
            table.vacuum(batch_id - 1)

    return apply


def stale_alerts_to(spark: SparkSession, path: str, out: str, minutes: float = 30, late: float = 1, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """state.stale_alerts() without a Python call for each search: a table of buckets under `path` holds each search's last beat and whether it is watched. Event time stands `late` minutes before the newest beat of all;
    an alert goes to `out`, in a folder of its micro-batch, once that passes `minutes` after a watched search's last beat."""
    table, wait, lag = BucketTable(spark, path, ["search_id"], buckets), int(minutes * 60_000_000), int(late * 60_000_000)

    def merge(batch: DataFrame, current: DataFrame | None) -> DataFrame:
        over = F.coalesce(F.col("status").isin("COMPLETED", "FAILED"), F.lit(False))
        new = batch.groupBy("search_id").agg(F.max("beat_at").alias("beat"), F.bool_or(over).alias("done"))
        if current is None:
            return new.select("search_id", F.col("beat").alias("last_beat"), (~F.col("done")).alias("watched"))
        both = new.join(current, "search_id", "full_outer")
        return both.select("search_id", F.greatest("beat", "last_beat").alias("last_beat"), F.coalesce(~F.col("done"), "watched").alias("watched"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = table.read(batch_id)
        if not table.apply(batch, batch_id, merge):
            return
        after, micros = table.read(batch_id + 1), F.unix_micros("last_beat")
        due, newest = micros + wait, F.max(micros)
        now = after.agg(newest).first()[0] - lag
        rows = after.where(F.col("watched") & (due <= now))
        if before is not None:  # those due before are known, unless a beat came since
            then = before.agg(newest).first()[0] - lag
            rows = rows.join(before.select("search_id", F.col("last_beat").alias("old")), "search_id", "left").where(F.col("old").isNull() | (F.col("last_beat") > F.col("old")) | (due > then))
        rows.select("search_id", "last_beat").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id:
            table.vacuum(batch_id - 1)

    return apply


def hourly_volume(captures: DataFrame, late: str = "2 hours") -> DataFrame:
    """Captures per source and hour (an extension)."""
    rows = captures.withWatermark("captured_at", late).groupBy(F.window("captured_at", "1 hour"), "source_code").agg(F.count("*").alias("captures"))
    return rows.select("source_code", F.col("window.start").alias("hour"), "captures")


def batch_events(captures: DataFrame) -> DataFrame:
    """What state.capture_events() gives for the same captures in one batch."""
    return _events(captures, "captured_at", "price")


def _events(captures: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("source_code", "external_id").orderBy(*order)
    rows = captures.withColumns({"old": F.lag("price").over(w), "was": F.lag("active").over(w), "n": F.row_number().over(w)})
    both = rows.where("n > 1").withColumn("event", F.explode(F.array_compact(F.array(F.when(~F.col("price").eqNullSafe(F.col("old")), "PRICE_CHANGED"), F.when(F.col("active") & ~F.col("was"), "LISTING_REACTIVATED")))))
    changed = F.col("event") == "PRICE_CHANGED"
    return both.select("source_code", "external_id", "captured_at", F.col("event").alias("event_type"), F.when(changed, F.col("old").cast("string")).alias("old_value"), F.when(changed, F.col("price").cast("string")).alias("new_value"))
