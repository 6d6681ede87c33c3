"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

A rotation is learned on a bounded sample of `SAMPLE` vectors: their mean is taken off, then principal directions are turned by alternating between
binary codes and the best rotation for them, so that bits are balanced. Every vector gets a code of at most `BITS` bits; a substring of it is the key of
each of `TABLES` hash tables, longer as there are more vectors. A vector looks into its own bucket of each table and into those that it reaches by flipping bits near their
threshold (flipped bits' squared distances to it sum to `ENERGY` at most; a linked pair differs by 0.1 over all directions).

Codes come first: what meets in a bucket is compared by the Hamming distance of its whole codes, and only entries with a partner that is near enough (`DEVIATIONS` standard
deviations beyond what the cosine lets expect) go on. To those the original vectors are fetched, and they are compared by cosine in double precision.

Equal vectors are one node with a count. Buckets of over `BLOCK` entries are dealt in pairs of blocks, so a task holds two blocks at
most. A bucket returns per vector a number of links and a forest of links, never the pairs. A pair that meets in several buckets counts in
the first of them only, which both sides can tell from their codes.

Recall is not proven but measured (tests: over 0.99 of random pairs at cosine 0.95 to 0.96); no pair below the threshold is ever linked.
Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null vec_id, link with nothing;
shorter vectors are padded with zeros; repeated rows are vectors of their own, linked with each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .simhash import _forest
from .store import cut, staged

COSINE = 0.95
#: How far beyond the expected Hamming distance of a barely linked pair codes are near enough.
DEVIATIONS = 3.5
SAMPLE, ROUNDS = 20_000, 25
BITS, TABLES, ENERGY = 64, 4, 0.0025
BLOCK = 2048
#: Large buckets that are broadcast at most (16 bytes each); more of them are joined.
BROADCAST_BUCKETS = 100_000


def usable(column: str = "embedding"):
    return F.expr(f"{column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)")


def learn_rotation(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix from vectors to `bits` numbers, and the numbers' thresholds: a bit is set above its threshold."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    values, vectors = np.linalg.eigh(centred.T @ centred)
    project = vectors[:, np.argsort(-values)[:bits]]
    v = centred @ project
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        code = np.where(v @ turn > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        turn = (u @ w).T
    matrix = project @ turn
    return matrix, mean @ matrix


class Coder:
    """Distances of unit vectors to the thresholds of all bits, and which bits are the keys of each table."""

    def __init__(self, matrix: np.ndarray, threshold: np.ndarray, tables: int, width: int, energy: float):
        self.matrix, self.threshold, self.tables, self.width, self.energy = matrix, threshold, tables, width, energy
        self.bits = matrix.shape[1]

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.matrix - self.threshold

    def key_bits(self, table: int) -> slice:
        first = table * (self.bits // self.tables)
        return slice(first, first + self.width)

    def codes(self, z: np.ndarray) -> np.ndarray:
        return ((z > 0) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))).astype(np.uint64)


def _masks(squares: np.ndarray, energy: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit mask) of all masks whose squares sum to `energy` at most; 0 is among them. Bit by bit, over all rows at once."""
    row, mask, total = np.arange(len(squares)), np.zeros(len(squares), np.int64), np.zeros(len(squares))
    for k in range(squares.shape[1]):
        more = total + squares[row, k]
        on = np.flatnonzero(more <= energy)
        row, mask, total = np.concatenate((row, row[on])), np.concatenate((mask, mask[on] | 1 << k)), np.concatenate((total, more[on]))
    return row, mask


def _entries(coder: Coder, codes: bool):
    """(bucket, home), with codes also (node, code), of all buckets that the vectors look into."""
    weights = 1 << np.arange(coder.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                z = coder.distances(_unit(_padded(part.column("embedding"), len(coder.matrix)).astype(float)))
                rows, buckets, homes = [], [], []
                for t in range(coder.tables):
                    own = z[:, coder.key_bits(t)]
                    row, mask = _masks(own * own, coder.energy)
                    rows.append(row)
                    buckets.append((((own > 0) @ weights)[row] ^ mask) * coder.tables + t)
                    homes.append(mask == 0)
                columns = [pa.array(np.concatenate(buckets)), pa.array(np.concatenate(homes))]
                if codes:
                    at = np.concatenate(rows)
                    columns += [part.column("node").take(pa.array(at)), pa.array(coder.codes(z)[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "home", "node", "code"][: len(columns)])

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Whole units of at least `least` rows together; rows come sorted by unit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch.select(names))
        size += batch.num_rows
        if size >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            unit = table.column("unit").to_numpy()
            cut_at = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut_at:
                yield table.slice(0, cut_at)
            held, size = table.slice(cut_at).to_batches(), table.num_rows - cut_at
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _with_partners(radius: int):
    """Of each unit's entries those that have a partner within the radius: one that is at home where the other asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("unit", "node", "code", "flags"), 4 * BLOCK):
            unit, code, flags = (table.column(c).to_numpy() for c in ("unit", "code", "flags"))
            code, n = code.view(np.uint64), len(unit)
            home, asks = (flags & 1) > 0, (flags & 2) > 0
            last = np.concatenate((np.flatnonzero(unit[1:] != unit[:-1]), [n - 1]))
            stop = last[np.searchsorted(last, np.arange(n))]
            found, at, shift = np.zeros(n, bool), np.arange(n), 1
            while len(at := at[at + shift <= stop[at]]):
                other = at + shift
                near = ((home[at] & asks[other]) | (asks[at] & home[other])) & (np.bitwise_count(code[at] ^ code[other]) <= radius)
                found[at[near]] = found[other[near]] = True
                shift += 1
            on = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(on) for c in ("unit", "node", "flags")], names=["unit", "node", "flags"])

    return run


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the column's own float type."""
    out = np.zeros((len(column), width), column.type.value_type.to_pandas_dtype())
    size = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _compare(coder: Coder, cosine: float):
    def solve(flags: np.ndarray, node: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        left, right = np.flatnonzero(flags & 2), np.flatnonzero(flags & 1)
        if not len(left) or not len(right):
            return None
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        a, b = left[a], right[b]
        a, b = a[node[a] != node[b]], b[node[a] != node[b]]
        if len(a):
            z, table = coder.distances(x), int(flags[0]) >> 2
            first = np.ones(len(a), bool)
            for i in range(0, len(a), 100_000):
                p, q = a[i : i + 100_000], b[i : i + 100_000]
                differ = (z[p] > 0) != (z[q] > 0)
                for t in range(table + 1):
                    bits = coder.key_bits(t)
                    out, back = ((z[k][:, bits] ** 2 * differ[:, bits]).sum(axis=1) <= coder.energy for k in (p, q))
                    first[i : i + 100_000] &= ~(out | back) if t < table else ~back | (node[p] < node[q])
            a, b = a[first], b[first]
        if not len(a):
            return None
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        distinct, place = np.unique(node, return_inverse=True)
        label = _forest(place[a], place[b], len(distinct))
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, links)
        on = np.flatnonzero(total)
        return distinct[on], total[on], distinct[label[on]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("unit", "node", "flags", "n", "embedding"), BLOCK):
            unit, node, flags, n = (table.column(c).to_numpy() for c in ("unit", "node", "flags", "n"))
            x = _unit(_padded(table.column("embedding").combine_chunks(), len(coder.matrix)).astype(float))
            begin = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)])).tolist()
            found = [r for a, b in zip(begin[:-1], begin[1:], strict=True) if b - a > 1 and (r := solve(flags[a:b], node[a:b], n[a:b], x[a:b])) is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["node", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, energy: float = ENERGY, block: int = BLOCK) -> DataFrame:
    """The op2 rows: vec_id, n_links, component_id, kept. The energy is meant for cosines from 0.95."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").withColumn("node", F.when(usable() & F.col("vec_id").isNotNull(), F.xxhash64("embedding")))
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    plain = rows.select("vec_id", "node")
    if not facts.n:
        return plain.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = min(facts.width, BITS), min(tables, facts.width)
    width = max(1, min(bits // tables, max(6, int(np.ceil(np.log2(facts.n / 500 + 1))))))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    coder = Coder(*learn_rotation(_unit(_padded(sample, facts.width).astype(float)), bits), tables, width, energy)
    share = np.arccos(cosine) / np.pi
    radius = int(np.ceil(bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share))))

    sizes = nodes.select("embedding").mapInArrow(_entries(coder, False), "bucket bigint, home boolean").groupBy("bucket").agg(F.count("*").alias("entries"), F.sum(F.col("home").cast("int")).alias("homes"))
    # large buckets are few: their number bounds the entries from above
    large = cut(sizes.where((F.col("homes") > 0) & (F.col("entries") > block)).select("bucket", F.ceil(F.col("entries") / block).alias("blocks")))
    spread = nodes.select("node", "embedding").mapInArrow(_entries(coder, True), "bucket bigint, home boolean, node bigint, code bigint")
    n_large = large.count()
    if n_large:
        spread = spread.join(F.broadcast(large) if n_large <= BROADCAST_BUCKETS else large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    else:
        spread = spread.withColumn("blocks", F.lit(1).cast("bigint"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    # a unit is (bucket, block of residents, block of those who ask)
    seats = F.when(
        F.col("home"), F.concat(F.transform(every, lambda k: F.struct(F.col("own").alias("r"), k.alias("q"), F.lit(1).alias("resident"), F.when(k == F.col("own"), 2).otherwise(0).alias("asks"))),
                                F.filter(F.transform(every, lambda k: F.struct(k.alias("r"), F.col("own").alias("q"), F.lit(0).alias("resident"), F.lit(2).alias("asks"))), lambda s: s["r"] != F.col("own")))
    ).otherwise(F.transform(every, lambda k: F.struct(k.alias("r"), F.col("own").alias("q"), F.lit(0).alias("resident"), F.lit(2).alias("asks"))))
    flags = F.col("seat.resident") + F.col("seat.asks") + F.pmod("bucket", F.lit(tables)).cast("int") * 4
    unit = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", "seat.r", "seat.q"))
    units = spread.withColumn("own", own).withColumn("seat", F.explode(seats)).select(unit.alias("unit"), "node", "code", flags.alias("flags"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(partitions, "unit").sortWithinPartitions("unit")
    wanted = staged(dealt(units).mapInArrow(_with_partners(radius), "unit bigint, node bigint, flags int"))
    met = dealt(wanted.join(nodes.select("node", "n", "embedding"), "node"))
    found = staged(met.select("unit", "node", "flags", "n", "embedding").mapInArrow(_compare(coder, cosine), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "least", "n").join(links, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut(known.join(roots, "component").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    out = plain.join(known, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
