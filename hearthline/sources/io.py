"""Relational and document sources, raw snapshots, upserts and index files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import to_index_json


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """A relational table in partitions of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions, **options)
    return reader.load()


def read_relational(spark: SparkSession, url: str, table: str, column: str, partitions: int, where: str | None = None, **options) -> DataFrame:
    """A relational table in `partitions` ranges between the least and greatest value of a numeric, date or timestamp column, which the database itself is asked for (one row).

    where: a condition in the database's SQL that bounds and rows share. Filters and columns of what is built upon the result are pushed to the database. Rows without a value of the column come with the first range.
    """
    source = f"(SELECT * FROM {table} WHERE {where}) t" if where else table
    reader = lambda what: spark.read.format("jdbc").options(url=url, dbtable=what, **options)
    rows = reader(source).load()
    name = next(c for c in rows.columns if c.lower() == column.lower())  # as the database spells it
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)
    low, high = reader(f"(SELECT min({quoted}) AS low, max({quoted}) AS high FROM {source}) b").load().select(*[F.col(c).cast("string") for c in ("low", "high")]).first()
    if low is None:  # empty, or no values to part by
        return rows
    return reader(source).options(partitionColumn=name, lowerBound=low, upperBound=high, numPartitions=partitions).load()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as text (doc): fields are read by path, so no schema is inferred."""
    return spark.read.text(path).select(F.col("value").alias("doc")).where(F.trim("doc") != "")


def append_snapshots(payloads: DataFrame, path: str, by: str = "day") -> None:
    """Appends raw payloads(captured_at, ...), a folder for each day (or month) of capture. Rows of a folder are brought together first, spread over as many tasks as its rows need, so an append adds few files to each."""
    dated = payloads.withColumn("capture_date", F.to_date(F.date_trunc(by, "captured_at")))
    spread = F.pmod(F.xxhash64(*payloads.columns), F.lit(8))
    dated.repartition("capture_date", spread).write.mode("append").partitionBy("capture_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str, first=None, last=None, by: str = "day") -> DataFrame:
    """Payloads captured from day `first` to day `last`, both included; folders of other days (or months) aren't opened."""
    rows, day = spark.read.parquet(path), F.to_date("captured_at")
    floor = lambda d: F.to_date(F.date_trunc(by, F.lit(d).cast("date")))
    if first is not None:
        rows = rows.where((F.col("capture_date") >= floor(first)) & (day >= F.lit(first).cast("date")))
    if last is not None:
        rows = rows.where((F.col("capture_date") <= floor(last)) & (day <= F.lit(last).cast("date")))
    return rows.drop("capture_date")


def upsert(current: DataFrame, batch: DataFrame, now, order: str = "seq") -> DataFrame:
    """The flat collector table after a batch with keys (source, source_id): values of the batch's last row replace all, nulls too; first_seen_at and created_at stay, status is ACTIVE, last_seen_at and updated_at are now."""
    keys, kept = ["source", "source_id"], ["first_seen_at", "created_at", "last_seen_at", "updated_at", "status"]
    values = [c for c in current.columns if c not in (*keys, *kept)]
    now = F.lit(now).cast(current.schema["updated_at"].dataType)
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"))
    rows = current.join(last, keys, "full_outer")
    new = F.col("v").isNotNull()
    pick = {c: F.when(new, F.col(f"v.{c}")).otherwise(F.col(c)) for c in values}
    pick |= {c: F.coalesce(c, now) for c in ("first_seen_at", "created_at")} | {c: F.when(new, now).otherwise(F.col(c)) for c in ("last_seen_at", "updated_at")}
    pick["status"] = F.when(new, "ACTIVE").otherwise(F.col("status"))
    return rows.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in current.columns])


def write_index(docs: DataFrame, path: str) -> None:
    to_index_json(docs).write.mode("overwrite").json(path)
