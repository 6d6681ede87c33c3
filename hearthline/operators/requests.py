"""Requests, caches, guards and outcomes of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import enums


def _minutes(n: int) -> Column:
    return F.make_interval(mins=F.lit(n))


def cached_as_of(requests: DataFrame, searches: DataFrame, ttl_minutes: int = 10) -> DataFrame:
    """Per request the newest completed search with its key, completed at most ttl before: requests and completions in one sorted union, no range join."""
    done = searches.where("status = 'COMPLETED' and completed_at is not null").select("search_key", F.col("completed_at").alias("at"), F.lit(0).alias("kind"), F.col("search_id").alias("id"))
    asked = requests.select("search_key", F.col("requested_at").alias("at"), F.lit(1).alias("kind"), F.col("request_id").alias("id"))
    w = Window.partitionBy("search_key").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 0, F.struct("id", "at")), ignorenulls=True).over(w)
    rows = asked.union(done).withColumn("hit", last).where("kind = 1")
    fresh = F.col("hit.at") >= F.col("at") - _minutes(ttl_minutes)
    return rows.select(F.col("id").alias("request_id"), "search_key", F.col("at").alias("requested_at"), F.when(fresh, F.col("hit.id")).alias("cached_id"))


def is_stale(now: Column, stale_minutes: int) -> Column:
    beat = F.coalesce("last_heartbeat_at", "started_at", "updated_at")
    cutoff = now - _minutes(stale_minutes)
    return ((F.col("status") == "PENDING") & (F.col("created_at") < cutoff)) | ((F.col("status") == "RUNNING") & (beat < cutoff))


def request_outcomes(requests: DataFrame, searches: DataFrame, now, ttl_minutes: int = 10, stale_minutes: int = 15) -> DataFrame:
    """Per request of a batch handled at `now`: REUSED (an active search that isn't stale), CACHED (completed within ttl), CREATED (first of its key) or REUSED_NEW; with the search it gets."""
    now = F.lit(now).cast("timestamp_ntz")
    live = searches.where(F.col("status").isin("PENDING", "RUNNING") & ~is_stale(now, stale_minutes))
    active = live.groupBy("search_key").agg(F.max_by("search_id", F.struct("created_at", "search_id")).alias("active_id"))
    fresh = searches.where((F.col("status") == "COMPLETED") & (F.col("completed_at") >= now - _minutes(ttl_minutes)))
    cached = fresh.groupBy("search_key").agg(F.max_by("search_id", F.struct("completed_at", "search_id")).alias("cached_id"))
    rows = requests.join(active, "search_key", "left").join(cached, "search_key", "left")
    # the first request of a key is a partial aggregate, so a popular key isn't sorted in one task
    first = requests.groupBy("search_key").agg(F.min("request_id").alias("first_id"))
    rows = rows.join(first, "search_key")
    outcome = F.when(F.col("active_id").isNotNull(), "REUSED").when(F.col("cached_id").isNotNull(), "CACHED").when(F.col("request_id") == F.col("first_id"), "CREATED").otherwise("REUSED_NEW")
    return rows.select("request_id", "search_key", outcome.alias("outcome"), F.coalesce("active_id", "cached_id").alias("search_id"), F.when(F.coalesce("active_id", "cached_id").isNull(), F.col("first_id")).alias("created_by"))


def claim_decisions(searches: DataFrame, now, cache: int = 120, running: int = 30, cooldown: int = 10) -> DataFrame:
    """Per key as of now, by its newest row: CACHE_FRESH (collected within `cache` minutes), ALREADY_RUNNING (its lock holds), FAILURE_COOLDOWN (failed within `cooldown`), else CLAIM with a lock of `running` minutes."""
    now = F.lit(now).cast("timestamp_ntz")
    columns = F.struct("search_id", "status", "last_collected_at", "collection_finished_at", "lock_expires_at")
    latest = searches.groupBy("search_key").agg(F.max_by(columns, F.struct("created_at", "search_id")).alias("r")).select("search_key", "r.*")
    decision = (
        F.when(F.col("last_collected_at") > now - _minutes(cache), "CACHE_FRESH")
        .when((F.col("status") == "RUNNING") & (F.col("lock_expires_at") > now), "ALREADY_RUNNING")
        .when((F.col("status") == "FAILED") & (F.col("collection_finished_at") > now - _minutes(cooldown)), "FAILURE_COOLDOWN")
        .otherwise("CLAIM")
    )
    rows = latest.select("search_key", "search_id", "status", decision.alias("decision"), "lock_expires_at")
    return rows.withColumn("lock_expires_at", F.when(F.col("decision") == "CLAIM", now + _minutes(running)).otherwise(F.col("lock_expires_at")))


def recover_stale(searches: DataFrame, now, running_minutes: int = 30, pending_minutes: int = 60, max_attempts: int = 3, retry_minutes: int = 5) -> DataFrame:
    """Adds new_status, recovered, new_next_attempt_at, new_completed_at and error_message.

    RUNNING rows without a sign of life (heartbeat, else start, else update) go back to PENDING with a next attempt or, with no attempts left, to FAILED; PENDING rows past
    their time are FAILED; others stay as they are.
    """
    now = F.lit(now).cast("timestamp_ntz")
    beat = F.coalesce("last_heartbeat_at", "started_at", "updated_at")
    dead = F.coalesce((F.col("status") == "RUNNING") & (beat < now - _minutes(running_minutes)), F.lit(False))
    late = F.coalesce((F.col("status") == "PENDING") & (F.col("created_at") < now - _minutes(pending_minutes)), F.lit(False))
    again = dead & (F.col("attempts") < max_attempts)
    failed = late | (dead & ~again)
    return searches.withColumns(
        {
            "new_status": F.when(again, "PENDING").when(failed, "FAILED").otherwise(F.col("status")),
            "recovered": dead | late,
            "new_next_attempt_at": F.when(again, now + _minutes(retry_minutes)).when(~dead, F.col("next_attempt_at")),
            "new_completed_at": F.when(failed, now).when(~again, F.col("completed_at")),
            "error_message": F.when(dead, enums.RECOVERED).when(late, enums.EXPIRED),
        }
    )


def recovery_counts(recovered: DataFrame) -> DataFrame:
    return recovered.where("recovered").groupBy("new_status").agg(F.count("*").alias("n"))


def run_outcomes(parts: DataFrame, attempt: str = "attempt", max_attempts: int = 3, longest: int = 2000) -> DataFrame:
    """From parts(search_id, source, ok, error, retry_after, attempt): any success is COMPLETED with the joined errors; else RETRYING while attempts are left, or FAILED, with the error of the longest wait."""
    g = parts.groupBy("search_id").agg(
        F.bool_or("ok").alias("any_ok"), F.max(attempt).alias("attempt"), F.max("retry_after").alias("retry_after"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.concat_ws(": ", "source", "error")))), "; ").alias("errors"),
        F.max_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.struct("retry_after", "source", "error"))).alias("worst"),
    )
    status = F.when(F.col("any_ok"), "COMPLETED").when(F.col("attempt") < max_attempts, "RETRYING").otherwise("FAILED")
    message = F.when(F.col("any_ok"), F.when(F.col("errors") != "", F.substring("errors", 1, longest))).otherwise(F.col("worst"))
    return g.select("search_id", status.alias("status"), message.alias("message"), F.when(~F.col("any_ok"), F.col("retry_after")).alias("retry_after"))


def new_links(items: DataFrame, properties: DataFrame, links: DataFrame) -> DataFrame:
    """(search_id, property_id) of items(search_id, source, source_id) that are stored and not linked yet."""
    ids = items.join(properties.select("source", "source_id", F.col("id").alias("property_id")), ["source", "source_id"]).select("search_id", "property_id").distinct()
    return ids.join(links.select("search_id", "property_id"), ["search_id", "property_id"], "left_anti")


def newest_results(links: DataFrame, properties: DataFrame, n: int = 100) -> DataFrame:
    """The n newest properties of each search."""
    rows = links.join(properties, links.property_id == properties.id).drop("property_id")
    w = Window.partitionBy("search_id").orderBy(F.desc("updated_at"), F.desc("id"))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
