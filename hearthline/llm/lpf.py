"""Exact repeats of long byte strings by longest-previous-factor arrays.

Content-chosen anchors (see repeats.py) bring all places that could hold a repeated string of `length` bytes together, under keys of
`length` / 2 bytes and more. Equal contexts are one class, decided by its count. Where contexts that share a key differ, one copy of each goes
into a shard of about 1 MB: the shard's suffixes are sorted (prefix doubling), previous and next smaller positions in suffix
order give each suffix its longest earlier match, and the same with positions reversed its longest later one. A key with more than
`SHARD_CONTEXTS` differing contexts is never gathered: its windows are counted by hash, spread over the cluster.

Texts are UTF-8 bytes; matches never cross documents. Defined results: null is empty; texts shorter than `length` keep all; equal rows are copies
of each other; null doc_ids are documents like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .repeats import Lengths, byte_values, covered, members, units, with_lists, with_row_id
from .store import staged

LENGTH = 400
SHARD_BYTES, SHARD_CONTEXTS = 1 << 20, 1500


def lengths(length: int) -> Lengths:
    gram = max(1, min(64, length // 6))
    return Lengths(gram, ((length + gram + 1) // 2,), length)


def _levels(text: np.ndarray, stop: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, up to `length` at least. stop: where each suffix's piece ends."""
    n = len(text)
    ranks, step = [text.astype(np.int64) + 1], 1
    at = np.arange(n)
    while step < length:
        ahead = at + step
        second = np.where(ahead < stop, ranks[-1][np.minimum(ahead, n - 1)], 0)
        first = ranks[-1]
        key = first * np.int64(max(int(first.max(initial=0)), 256) + 1) + second
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (sorted_[1:] != sorted_[:-1]).astype(np.int64))))
        ranks.append(rank)
        step *= 2
    return ranks


def _smaller(order: np.ndarray, back: bool) -> np.ndarray:
    """For each place in suffix order, the nearest place before (or behind, if back) with a smaller position; -1 if none. By pointer jumping."""
    if back:
        out = _smaller(order[::-1], False)[::-1]
        return np.where(out < 0, -1, len(order) - 1 - out)
    n = len(order)
    near = np.arange(n) - 1
    live = np.arange(1, n)
    while len(live):
        live = live[(near[live] >= 0)]
        live = live[order[near[live]] > order[live]]
        near[live] = near[near[live]]
    return near


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b (piece ends don't match), as far as the ranks reach."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    enda, endb = stop[a], stop[b]
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        inside = (a + step <= enda) & (b + step <= endb)
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        a[same] += step
        b[same] += step
        total[same] += step
    return total


def longest_previous_factors(pieces: list[bytes], starts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first starts[i] positions of each piece i (in order), the longest earlier and the longest later match, exact up to twice `length` at most."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    stop = np.repeat(begin + sizes, sizes)
    ranks = _levels(text, stop, length)
    count = np.array(starts, np.int64)
    which = np.repeat(np.arange(len(pieces)), count)
    chosen = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    order = chosen[np.argsort(ranks[-1][chosen], kind="stable")]
    out = []
    for sign in (1, -1):
        best = np.zeros(len(text), np.int64)
        for back in (False, True):
            near = _smaller(order * sign, back)
            has = np.flatnonzero(near >= 0)
            best[order[has]] = np.maximum(best[order[has]], _common(ranks, order[has], order[near[has]], stop))
        out.append(best[chosen])
    return out[0], out[1]


def _lpf_shards(length: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[5])
        before, behind = longest_previous_factors([r[3] for r in rows], [r[2] for r in rows], length)
        n = np.array([r[2] for r in rows], np.int64)
        which = np.repeat(np.arange(len(rows)), n)
        j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero((before >= length) | (behind >= length))
        key, context = (np.array([r[k] for r in rows], np.int64)[which[hit]] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(context), pa.array(j[hit].astype(np.int32)), pa.array(before[hit] >= length)], names=["key", "context", "j", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            first = [tuple(x.values()) for x in batch.column("first").to_pylist()]
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "n", "piece", "key")), first, strict=True):
                if size >= SHARD_BYTES and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append((*row[:5], (row[5][0] is not None, *(v or 0 for v in row[5]))))
                size += len(row[3])
                last = row[0]
        if held:
            yield solve(held)

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(rid, doc_id, lo, n): starts of strings of `length` bytes that also start elsewhere (keep_first: at a smaller doc_id, row or place). docs: doc_id, text, rid."""
    found = units(docs, byte_values, lengths(length))
    classes = found.groupBy("key", "context").agg(F.sum(F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more"))).alias("members"), F.min(F.struct("doc_id", "rid", "lo")).alias("first"), F.first("n").alias("n"))
    keys = classes.groupBy("key").agg(F.count("*").alias("contexts"), F.min("members").alias("least")).where("contexts > 1" + ("" if keep_first else " and least = 1"))
    mixed = staged(
        classes.join(keys, "key").select("first.rid", "first.doc_id", "first.lo", "n", "key", "context", "first", (F.col("members") > 1).alias("many"), (F.col("contexts") > SHARD_CONTEXTS).alias("hot"))
    )
    struct = "struct<doc_id: bigint, rid: bigint, lo: int>"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            data, offsets = arrays.utf8(chunk.column("text"))
            prefix = arrays.window_prefix(data) if any(r["hot"] for x in chunk.column("found").to_pylist() for r in x) else None
            rows = []
            for i, x in enumerate(chunk.column("found").to_pylist()):
                for r in x:
                    a = int(offsets[i]) + r["lo"]
                    hashes = arrays.window_hash(prefix, a + np.arange(r["n"]), length).view(np.int64).tolist() if r["hot"] else None
                    rows.append({k: r[k] for k in ("key", "context", "n", "many", "first")} | {"piece": None if r["hot"] else data[a : a + r["n"] - 1 + length].tobytes(), "hashes": hashes})
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pylist(rows[k : k + 2000], schema=_FETCHED)

    texts = with_lists(docs, mixed, ["lo", "n", "key", "context", "first", "many", "hot"], "inner").select("text", "found")
    rows = staged(texts.mapInArrow(fetch, f"key bigint, context bigint, n int, many boolean, first {struct}, piece binary, hashes array<bigint>"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = rows.where("piece is not null").select("key", "context", "n", "piece", "first").dropDuplicates(["key", "context"]).repartition(partitions, "key").sortWithinPartitions("key", "context")
    near = shards.mapInArrow(_lpf_shards(length), "key bigint, context bigint, j int, earlier boolean")
    hot = rows.where("hashes is not null").dropDuplicates(["key", "context"]).select("key", "context", "first", "many", F.posexplode("hashes").alias("j", "hash"))
    counted = hot.groupBy("key", "hash").agg(F.count("*").alias("n"), F.min("first").alias("least")).where("n > 1")
    far = hot.join(counted, ["key", "hash"]).select("key", "context", "j", (F.col("first") > F.col("least")).alias("earlier"))
    windows = near.union(far)
    every = members(found.join(classes.select("key", "context", "members", "first"), ["key", "context"]))
    own = F.struct("doc_id", "rid", "lo")
    if keep_first:
        windows, whole, part = windows.where("earlier"), own > F.col("first"), own == F.col("first")
    else:
        whole, part = F.col("members") > 1, F.col("members") == 1
    single = every.where(part).join(windows.select("key", "context", "j").distinct(), ["key", "context"])
    return every.where(whole).select("rid", "doc_id", "lo", "n").union(single.select("rid", "doc_id", (F.col("lo") + F.col("j")).alias("lo"), F.lit(1).alias("n")))


_FETCHED = pa.schema(
    [("key", pa.int64()), ("context", pa.int64()), ("n", pa.int32()), ("many", pa.bool_()), ("first", pa.struct([("doc_id", pa.int64()), ("rid", pa.int64()), ("lo", pa.int32())])), ("piece", pa.binary()), ("hashes", pa.list_(pa.int64()))]
)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay)."""
    texts = with_row_id(docs)
    repeats = repeated_windows(texts, length, keep_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            data, offsets = arrays.utf8(chunk.column("text"))
            rows = []
            for i, found in enumerate(chunk.column("found").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                gone = covered(found, length, len(raw))
                rows.append((len(raw), int(gone.sum()), len(arrays.runs(gone)[0]), raw[~gone].tobytes() if found else raw.tobytes()))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_lists(texts, repeats, ["lo", "n"], "left").select("doc_id", "text", "found").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The op5 rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same by a dictionary of all strings, for tests."""
    count: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, raw in raws:
        for s in range(len(raw) - length + 1):
            k = raw[s : s + length]
            count[k] = count.get(k, 0) + 1
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if count[raw[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((d, len(raw), int(gone.sum()), len(arrays.runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out
