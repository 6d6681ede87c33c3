"""Streams against their batch counterparts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from hearthline.operators import history
from hearthline.sources.buckets import BucketTable, last_by
from hearthline.streaming import jobs, state


def _captures(spark):
    rows = [("s", str(k % 7), f"2024-01-{d:02d} 0{k % 5}:00:00", str(100 + (k * d) % 3), (k + d) % 4 > 0) for k in range(20) for d in range(1, 9)]
    df = spark.createDataFrame(rows, "source_code string, external_id string, t string, p string, active boolean").dropDuplicates(["source_code", "external_id", "t"])
    return df.select("source_code", "external_id", F.to_timestamp("t").alias("captured_at"), F.col("p").cast("decimal(14,2)").alias("price"), "active")


def _run(stream, path):
    with state.rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def test_capture_events_equal_batch(spark, tmp_path):
    captures = _captures(spark)
    # ordered files, one a micro-batch
    for d in range(1, 9):
        captures.where(F.dayofmonth("captured_at") == d).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, _run(state.capture_events(source, "30 days"), str(tmp_path)).collect()), key=str)
    assert got == sorted(map(tuple, jobs.batch_events(captures).collect()), key=str) and got


def test_stale_alerts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "RUNNING"), (2, "2024-01-01 00:00:00", "RUNNING"), (2, "2024-01-01 00:05:00", "COMPLETED"), (3, "2024-01-01 03:00:00", "RUNNING")]
    df = spark.createDataFrame(rows, "search_id long, t string, status string").select("search_id", F.to_timestamp("t").alias("beat_at"), "status")
    for i, part in enumerate((df.where("search_id < 3"), df.where("search_id = 3"), df.where("search_id = 3").withColumn("search_id", F.lit(4).cast("long")))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert i < 3
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert [r.search_id for r in _run(state.stale_alerts(source), str(tmp_path)).collect()] == [1]


def test_a_heartbeat_puts_the_alert_off_and_one_is_enough(spark, tmp_path):
    rows = [(1, "00:00", "RUNNING"), (2, "00:00", "RUNNING"), (1, "00:20", "RUNNING"), (9, "00:45", "COMPLETED"), (9, "00:47", "COMPLETED"), (2, "00:50", "RUNNING"), (9, "01:10", "COMPLETED"), (9, "03:00", "COMPLETED")]
    df = spark.createDataFrame(rows, "search_id long, t string, status string").select("search_id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t", F.lit(":00"))).alias("beat_at"), "status")
    for t in sorted({r[1] for r in rows}):
        df.where(F.date_format("beat_at", "HH:mm") == t).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.search_id, r.last_beat.strftime("%H:%M")) for r in _run(state.stale_alerts(source), str(tmp_path)).collect())
    # search 2 was silent from 00:00 until the watermark passed 00:30, and again from 00:50
    assert got == [(1, "00:20"), (2, "00:00"), (2, "00:50")]


def test_state_of_a_listing_expires(spark, tmp_path):
    rows = [("a", 1, "1.00"), ("b", 1, "1.00"), ("b", 9, "2.00"), ("c", 12, "5.00"), ("a", 20, "3.00"), ("b", 15, "4.00")]
    df = spark.createDataFrame(rows, "external_id string, d int, p string").select(F.lit("s").alias("source_code"), "external_id", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, d)").alias("captured_at"), F.col("p").cast("decimal(14,2)").alias("price"), F.lit(True).alias("active"))
    for i in (1, 9, 12, 15, 20):
        df.where(F.dayofmonth("captured_at") == i + 1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.external_id, r.old_value, r.new_value) for r in _run(state.capture_events(source, "1 hour", keep_days=10), str(tmp_path)).collect())
    assert got == [("b", "1.00", "2.00"), ("b", "2.00", "4.00")]  # a's state was gone after ten days


def _files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upserts_are_those_of_one_batch(spark, tmp_path):
    captures = _captures(spark)
    for d in (3, 1, 2):  # late files too
        captures.where(F.dayofmonth("captured_at") == d).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(captures.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.each_batch(source, jobs.upsert_listings_to(spark, f"{tmp_path}/table", 4), f"{tmp_path}/c1").awaitTermination()
    got = BucketTable(spark, f"{tmp_path}/table", ["source_code", "external_id"], 4).read()
    want = history.current_listings(captures.where(F.dayofmonth("captured_at") <= 3)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_batch_touches_its_buckets_alone_and_counts_once(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, v string")
    merge = last_by(["k"], ["at"], ("first", "at"))
    table = BucketTable(spark, f"{tmp_path}/t", ["k"], 8)
    assert table.read() is None and table.apply(rows().where("false"), 0, merge) == 0
    assert table.apply(rows(*[(f"k{i}", 1, "a") for i in range(40)], (None, 1, "n")), 0, merge) == 8
    before = _files(tmp_path)
    batch = rows(("k1", 2, "b"), ("k1", 3, None), ("k2", 0, "late"), ("new", 5, "c"))
    touched = {r[0] for r in batch.select(table.bucket()).distinct().collect()}
    assert table.apply(batch, 1, merge) == len(touched) < 8
    after = _files(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before  # no file of any bucket is changed
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} == touched
    state = sorted(map(tuple, table.read().collect()), key=str)
    assert ("k1", 3, None, 1) in state and ("k2", 1, "a", 0) in state and ("new", 5, "c", 5) in state and (None, 1, "n", 1) in state and len(state) == 42
    table.apply(batch, 1, merge)  # the batch once more, as after a crash
    assert sorted(map(tuple, table.read().collect()), key=str) == state
    assert {b: v for b, v in table.versions().items() if len(v) > 1}.keys() == touched
    assert table.vacuum(1) == len(touched) and sorted(map(tuple, table.read().collect()), key=str) == state
    assert "k1" in {r.k for r in table.read(buckets=touched).collect()} and table.read(before=0) is None


def test_a_restarted_stream_goes_on_with_its_table(spark, tmp_path):
    captures = _captures(spark)
    for d in (1, 2, 3, 4):
        captures.where(F.dayofmonth("captured_at") == d).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(captures.schema).parquet(f"{tmp_path}/in")
        jobs.each_batch(source, jobs.upsert_listings_to(spark, f"{tmp_path}/table", 4), f"{tmp_path}/c").awaitTermination()
    got = BucketTable(spark, f"{tmp_path}/table", ["source_code", "external_id"], 4).read()
    want = history.current_listings(captures.where(F.dayofmonth("captured_at") <= 4)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hourly_volume(spark, tmp_path):
    captures = _captures(spark).select("source_code", "captured_at")
    captures.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = _run(jobs.hourly_volume(spark.readStream.schema(captures.schema).parquet(f"{tmp_path}/in")), str(tmp_path))
    last = captures.agg(F.max("captured_at")).first()[0]
    want = captures.groupBy("source_code", F.date_trunc("hour", "captured_at").alias("hour")).agg(F.count("*").alias("captures"))
    want = [r for r in want.collect() if (last - r.hour).total_seconds() >= 3 * 3600]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_events_and_alerts_by_batches(spark, tmp_path):
    """Micro-batches of captures and beats give what one batch of all gives, without Python for each key; a batch that runs again changes nothing."""
    from hearthline.streaming import jobs

    captures = spark.sql("select concat('s', id % 3) source_code, cast(id % 7 as string) external_id, timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) captured_at, if(id % 11 = 0, null, cast(id % 4 as decimal(14,2))) price, id % 5 <> 0 active from range(200)")
    apply = jobs.capture_events_to(spark, f"{tmp_path}/t", f"{tmp_path}/e", 4)
    for k, where in enumerate(("day(captured_at) < 20 and month(captured_at) = 1", "month(captured_at) between 1 and 2 and not (day(captured_at) < 20 and month(captured_at) = 1)", "month(captured_at) > 2")):
        apply(captures.where(where), k)
        apply(captures.where(where), k)
    got = spark.read.parquet(f"{tmp_path}/e").drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.batch_events(captures).collect())) and got.count()
    apply(captures.where("month(captured_at) = 1"), 3)  # all older than what is known
    assert spark.read.parquet(f"{tmp_path}/e").where("batch = 3").count() == 0

    alerts = jobs.stale_alerts_to(spark, f"{tmp_path}/b", f"{tmp_path}/a", 30, 1, 4)
    beats = lambda *rows: spark.createDataFrame(rows, "search_id long, minute int, status string").selectExpr("search_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, minute) beat_at", "status")
    alerts(beats((1, 0, "RUNNING"), (2, 0, "RUNNING"), (3, 5, "RUNNING"), (9, 20, "RUNNING")), 0)
    alerts(beats((2, 10, "COMPLETED"), (9, 33, "RUNNING")), 1)  # event time 32: search 1 is due, 2 is done
    alerts(beats((1, 34, "RUNNING"), (9, 70, "RUNNING")), 2)  # event time 69: 3 is due, 1 beats again and is due again
    alerts(beats((9, 71, "RUNNING")), 3)
    found = spark.read.parquet(f"{tmp_path}/a").selectExpr("batch", "search_id", "minute(last_beat)").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0), (2, 1, 34), (2, 3, 5)]
