"""Groups of linked rows by rounds of joins: connected components, and leaders that take what comes later."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. A temporary one is made in local sessions alone: executors elsewhere wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _staged(df: DataFrame) -> DataFrame:
    """As _cut(), for wide or large tables: compressed Parquet in the shared folder, where a checkpoint holds rows as they lie in memory."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Links of a component that one task may settle.
SMALL = 100_000
#: Rounds of joins before components are looked at, and between.
EAGER = 3


def first_leaders(links: DataFrame, small: int = SMALL, eager: int = EAGER) -> DataFrame:
    """(node): of the nodes of links(a, b), a before b, those that no earlier leader is linked with.

    A round settles every node without an undecided earlier neighbour, all chains that hang on it (nodes with one undecided earlier neighbour: the opposite of it, so chains are contracted by pointers
    that double), and what the new leaders lead. Sparse links are done after a few. What is left after `eager` rounds is parted in components: each of at most `small` links is
    settled in one task, in order; larger ones go on in rounds. Rounds thus grow with the logarithm of a chain, and for the rest with how deep nodes of several earlier neighbours stand in components of over `small` links.
    """
    live = _cut(links.select("a", "b").where("a < b").distinct())
    leaders = _cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct())
    nodes, leaders, rounds = leaders, leaders.where("false"), 0
    while not nodes.isEmpty():
        if rounds and rounds % eager == 0:
            linked = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
            leaders = leaders.union(_cut(nodes.join(linked, "node", "left_anti")))  # all that they were linked with is led
            new, live = _settle_small(live, small)
            leaders = leaders.union(new)
            nodes = _cut(live.select(F.col("a").alias("node")).union(live.select("b")).distinct())
            if nodes.isEmpty():
                break
        new, out = _settle_chains(live, nodes)
        leaders = leaders.union(new)
        led = live.join(new, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node"))
        nodes = _cut(nodes.join(new.union(out).union(led).distinct(), "node", "left_anti"))
        live = _cut(live.join(nodes, F.col("a") == F.col("node"), "left_semi").join(nodes, F.col("b") == F.col("node"), "left_semi"))
        rounds += 1
    return leaders


def _settle_chains(live: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, others) among the nodes without an earlier neighbour and the chains on them. At even distance from a chain's first node stand leaders."""
    before = live.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("up"))
    single = _cut(before.where("n = 1").select("node", "up", F.lit(True).alias("odd")))
    first = _cut(nodes.join(before, "node", "left_anti"))
    while True:
        above = single.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("odd").alias("turn"))
        step = single.join(above, "up", "left")
        if step.where("next is not null").isEmpty():
            break
        single = _cut(step.select("node", F.coalesce("next", "up").alias("up"), (F.col("odd") != F.coalesce("turn", F.lit(False))).alias("odd")))
    hung = _cut(single.join(first.withColumnRenamed("node", "up"), "up", "left_semi").select("node", "odd"))
    return _cut(first.union(hung.where("not odd").select("node"))), hung.where("odd").select("node")


def _settle_small(live: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(leaders of all components with at most `small` links, links of the others)."""
    parts = _cut(live.join(components(live), F.col("a") == F.col("node")).select("a", "b", "component"))
    large = _cut(parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > small).select("component"))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        earlier: dict = {}
        for a, b in zip(group.a.tolist(), group.b.tolist(), strict=True):
            earlier.setdefault(a, [])
            earlier.setdefault(b, []).append(a)
        leads = {}
        for node in sorted(earlier):
            leads[node] = not any(leads[a] for a in earlier[node])
        return pd.DataFrame({"node": [n for n, yes in leads.items() if yes]})

    kind = live.schema["a"].dataType.simpleString()
    new = parts.join(large, "component", "left_anti").groupBy("component").applyInPandas(settle, f"node {kind}")
    return _cut(new), _cut(parts.join(large, "component", "left_semi").select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links(a, b) reach. Every round doubles the reach (labels of labels); rounds end with a checkpoint."""
    both = _cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = _cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = _cut(step.join(up, "component").select("node", F.least("component", "up").alias("component"), (F.least("component", "up") != F.col("old")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        label = new.select("node", "component")
        if not moved:
            return label
