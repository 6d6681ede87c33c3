"""State tables kept in hash buckets of their key, of which a batch rewrites only those that it touches.

Rows of a bucket lie in `bucket=B/version=V`, V the batch that wrote them; the bucket's state is its last version. A batch reads the versions before it of
the buckets that its rows fall in, and writes those buckets anew by dynamic partition overwrite; versions before are left as they are. A batch that is run again (a stream
that starts anew, a lost driver) therefore reads the same state and overwrites its own version alone, so each batch counts once, and a crash in
between loses nothing. `vacuum` drops versions that no run can ask for again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame | None], DataFrame]


class BucketTable:
    """The table under `path` with rows keyed by `keys` in `buckets` buckets; the number stays for the table's life. Keys may be null."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket that has any, by the names of its folders."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        system = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found: dict[int, list[int]] = {}
        for status in system.globStatus(hadoop.Path(root, "bucket=*/version=*")) or []:
            at = status.getPath()
            found.setdefault(int(at.getParent().getName().split("=")[1]), []).append(int(at.getName().split("=")[1]))
        return {b: sorted(v) for b, v in found.items()}

    def read(self, before: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The state, or that before a batch, of all buckets or of some; None if there is none. Other buckets' files aren't looked at."""
        chosen = None if buckets is None else set(buckets)
        folders = []
        for bucket, versions in self.versions().items():
            fit = [v for v in versions if before is None or v < before]
            if fit and (chosen is None or bucket in chosen):
                folders.append(f"{self.path}/bucket={bucket}/version={fit[-1]}")
        if not folders:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*folders).drop("bucket", "version")

    def apply(self, batch: DataFrame, batch_id: int, merge: Merge) -> int:
        """Writes merge(batch's rows, state before) for the buckets that the batch touches; returns how many those are. merge gives each key once and keeps keys that the batch lacks."""
        batch = batch.withColumn("_bucket", self.bucket())
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # at most `buckets`
        if not touched:
            return 0
        state = merge(batch.drop("_bucket"), self.read(batch_id, touched))
        rows = state.withColumns({"bucket": self.bucket(), "version": F.lit(batch_id)}).repartition(len(touched), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
        return len(touched)

    def vacuum(self, done: int) -> int:
        """Drops the versions that come before the last one up to batch `done`, which must be committed; returns how many."""
        hadoop, dropped = self.spark._jvm.org.apache.hadoop.fs, 0
        for bucket, versions in self.versions().items():
            for old in [v for v in versions if v <= done][:-1]:
                at = hadoop.Path(f"{self.path}/bucket={bucket}/version={old}")
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
                dropped += 1
        return dropped


def last_by(keys: list[str], order: list[str], first_seen: tuple[str, str] | None = None) -> Merge:
    """Of each key the row that is greatest by `order` and then by all values, whichever batch brought it, so late and repeated rows change nothing.

    first_seen = (column, source): the least value of the source column that any of the key's rows had.
    """

    def merge(batch: DataFrame, current: DataFrame | None) -> DataFrame:
        values = [c for c in batch.columns if c not in keys]
        rows = batch.withColumn(first_seen[0], F.col(first_seen[1])) if first_seen else batch
        if current is not None:
            rows = rows.unionByName(current.select(rows.columns))
        more = [F.min(first_seen[0]).alias(first_seen[0])] if first_seen else []
        best = F.max_by(F.struct(*values), F.struct(*order, *[v for v in values if v not in order])).alias("v")
        return rows.groupBy(*keys).agg(best, *more).select(*keys, "v.*", *([first_seen[0]] if first_seen else []))

    return merge
