"""Long windows (of bytes or words) that occur more than once, found level by level through content-chosen anchors.

A window of W values has one anchor: the place of the least hash among its short grams, so equal windows have their anchors at the same
place within. Consecutive windows with one anchor form a unit (at most two: windows that hold the gram's longer extension to the
right, and the others, which hold the one to the left). A unit carries the hash of that extension at each level's length (its keys), the hash of all that its
windows cover (its context), and where its windows start. Level by level, units whose key stands alone can hold no repeated window
and are dropped; only the others go on to the next length, about twice as long. Equal contexts mean equal windows, so a group of copies is a few
aggregated rows from then on.

Contexts and windows are told apart under one key, by polynomial hashes modulo 2**61 - 1 of different bases: a false match needs both to collide by chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays
from .store import staged


@dataclass(frozen=True)
class Lengths:
    """gram: values of an anchor; levels: lengths at which units are tested, rising, about twice the one before each; window: at most twice the last. 2 * levels[-1] <= window + gram + 1."""

    gram: int
    levels: tuple[int, ...]
    window: int


Values = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = arrays.word_bounds(data, offsets, arrays.SPACE)
    return arrays.word_hashes(data, starts, ends), first


def unit_arrays(values: np.ndarray, first: np.ndarray, size: Lengths) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(document, keys of each level, context, first start, number of windows) of all units of a chunk; starts count from the chunk's start."""
    n, (k, h, w) = len(values), (size.gram, size.levels[-1], size.window)
    empty = np.zeros(0, np.int64)
    none = (empty, [empty.view(np.uint64) for _ in size.levels], empty.view(np.uint64), empty, empty)
    if n < w:
        return none
    anchor = arrays.sliding_first_min(arrays.gram_ranks(values, k), w - k + 1)
    prefix, around = arrays.window_prefix(values), arrays.window_prefix(values, arrays.CONTEXT)
    starts = np.zeros(n - w + 2, np.int8)
    long = np.flatnonzero(np.diff(first) >= w)
    starts[first[long]] += 1
    np.subtract.at(starts, first[long + 1] - w + 1, 1)
    valid = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
    if not len(valid):
        return none
    own = anchor[valid]
    change = np.flatnonzero((own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
    lo = valid[np.concatenate(([0], change))]
    hi = valid[np.concatenate((change - 1, [len(valid) - 1]))]
    p = own[np.concatenate(([0], change))]
    turn = p + h - w
    sides = []
    for side, (a, b) in enumerate(((np.maximum(lo, turn), hi), (lo, np.minimum(hi, turn - 1)))):
        use = a <= b
        a, b, at = a[use], b[use], p[use]
        keys = [arrays.window_hash(prefix, at + (k - m) * side, m) ^ np.uint64(side * 0x5851F42D4C957F2D) for m in size.levels]
        sides.append((np.searchsorted(first, a, "right") - 1, *keys, arrays.window_hash(around, a, b + w - a, arrays.CONTEXT), a, b - a + 1))
    doc, *keys, context, lo, n = (np.concatenate(x) for x in zip(*sides, strict=True))
    return doc, keys, context, lo, n


_MORE = [pa.field("doc_id", pa.int64()), pa.field("rid", pa.int64()), pa.field("lo", pa.int32())]


def candidates(docs: DataFrame, values: Values, size: Lengths) -> DataFrame:
    """Rows (key0, key1, ..., context, n, doc_id, rid, lo, more, sure, leads) of all units of docs(doc_id, text, rid); starts count from the document's start.

    Equal units of a chunk of documents are one row, the least (doc_id, rid, lo) first and the others in `more`, so a passage that very many
    documents share is a row for each chunk. Bit k of `sure`: its key of level k comes more than once in the chunk; of `leads`: it stands for its key there.
    """
    levels = range(len(size.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            got, first = values(*arrays.utf8(chunk.column("text")))
            doc, keys, context, lo, n = unit_arrays(got, first, size)
            lo = (lo - first[doc]).astype(np.int32)
            ids, rids = chunk.column("doc_id"), chunk.column("rid").to_numpy()
            rank = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            order = np.lexsort((lo, rids[doc], rank[doc], context, *keys[::-1]))  # by the first level's key, then the next one's
            doc, keys, context, lo, n = doc[order], [k[order] for k in keys], context[order], lo[order], n[order]
            new = np.ones(len(context), bool)
            new[1:] = (keys[-1][1:] != keys[-1][:-1]) | (context[1:] != context[:-1])
            heads, rest = np.flatnonzero(new), np.flatnonzero(~new)
            extra = np.diff(np.concatenate((heads, [len(context)]))) - 1
            more = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(extra))).astype(np.int32)),
                pa.StructArray.from_arrays([ids.take(pa.array(doc[rest])), pa.array(rids[doc[rest]]), pa.array(lo[rest])], fields=_MORE),
                mask=pa.array(extra == 0),
            )
            keys, doc = [k[heads] for k in keys], doc[heads]
            sure, leads = np.zeros(len(heads), np.int32), np.zeros(len(heads), np.int32)
            for level, key in enumerate(keys):
                same = np.zeros(len(key), bool)
                same[1:] = key[1:] == key[:-1]
                company = same | (extra > 0)
                company[:-1] |= same[1:]
                sure |= company.astype(np.int32) << level
                leads |= (~same).astype(np.int32) << level
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k.view(np.int64)) for k in keys), pa.array(context[heads].view(np.int64)), pa.array(n[heads].astype(np.int32)), ids.take(pa.array(doc)), pa.array(rids[doc]), pa.array(lo[heads]), more, pa.array(sure), pa.array(leads)],
                names=[*(f"key{k}" for k in levels), "context", "n", "doc_id", "rid", "lo", "more", "sure", "leads"],
            )

    schema = ", ".join(f"key{k} bigint" for k in levels) + ", context bigint, n int, doc_id bigint, rid bigint, lo int, more array<struct<doc_id: bigint, rid: bigint, lo: int>>, sure int, leads int"
    return docs.select("doc_id", "text", "rid").mapInArrow(run, schema)


def survivors(rows: DataFrame, level: int) -> DataFrame:
    """The rows whose key of this level occurs more than once.

    A row has company if the one before or behind it has its key: a look at neighbours, whatever the size of the group. Rows that are sure of it
    but don't stand for their key are spread over the cluster instead of meeting there.
    """
    key, bit = F.col(f"key{level}"), lambda c: F.getbit(F.col(c), F.lit(level)) == 1
    slot = F.when(bit("leads"), key).otherwise(F.xxhash64("context", "rid", "lo"))
    near = Window.partitionBy("_slot").orderBy(f"key{level}")
    company = bit("sure") | F.coalesce(F.lag(key).over(near) == key, F.lit(False)) | F.coalesce(F.lead(key).over(near) == key, F.lit(False))
    return rows.withColumn("_slot", slot).withColumn("_company", company).where("_company").drop("_slot", "_company")


def units(docs: DataFrame, values: Values, size: Lengths) -> DataFrame:
    """Rows (key, context, n, doc_id, rid, lo, more) of the units that are repeated at every level, each level tested on the survivors of the one before."""
    rows = candidates(docs, values, size)
    for level in range(len(size.levels)):
        rows = staged(survivors(rows, level))
        if rows.isEmpty():
            break
    return rows.select(F.col(f"key{len(size.levels) - 1}").alias("key"), "context", "n", "doc_id", "rid", "lo", "more")


def members(rows: DataFrame) -> DataFrame:
    """A row (its own columns, doc_id, rid, lo) for each unit of units()' rows."""
    own = F.array(F.struct("doc_id", "rid", "lo"))
    every = F.when(F.col("more").isNull(), own).otherwise(F.concat(own, F.col("more")))
    others = [c for c in rows.columns if c not in ("doc_id", "rid", "lo", "more")]
    return rows.select(*others, F.explode(every).alias("m")).select(*others, "m.*")


def with_row_id(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a hash of both: equal rows share it. Rows are told apart by doc_id and rid."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def with_lists(docs: DataFrame, rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """docs with all rows of its doc_id and rid as the list `found`, equal ones once: rows of docs that are equal bring the same ones each."""
    lists = rows.groupBy("rid", "doc_id").agg(F.collect_set(F.struct(*columns)).alias("found")).withColumnsRenamed({"rid": "_rid", "doc_id": "_doc"})
    return docs.join(lists, (F.col("rid") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_doc")), how).drop("_rid", "_doc")


def covered(found: list | None, window: int, size: int) -> np.ndarray:
    """Flags of the values under windows that start in [lo, lo + n) of each entry."""
    edge = np.zeros(size + 1, np.int64)
    if found:
        lo = np.array([r["lo"] for r in found], np.int64)
        n = np.array([r["n"] for r in found], np.int64)
        np.add.at(edge, lo, 1)
        np.subtract.at(edge, lo + n - 1 + window, 1)
    return np.cumsum(edge[:size]) > 0
