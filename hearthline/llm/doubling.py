"""Substring dedup by level-wise doubling over words.

Lengths rise by doubling: 7, 13, 25, 50 words for a window of 50. At the first length the windows are 7-word grams at content-chosen places (a
50-word window's gram of least hash), so equal long windows are tested at the same places and nothing is lost. Each level counts only what was
repeated at the level before, extended to about twice its length: grams that occur once never reach 13 words, and so on, until no
candidate survives or the whole window is reached. There a window counts as a copy if a document with a smaller doc_id holds it, decided
per class of equal contexts, and window by window only where contexts that share a key differ.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Defined results: a null text has no words; documents shorter than a window keep all; documents
with a null id keep all and remove nothing elsewhere; repeated rows (same id and text) get the same result each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .repeats import Lengths, covered, members, units, with_lists, with_row_id, word_values
from .store import staged

WINDOW = 50


def lengths(window: int) -> Lengths:
    levels = [-(-window // 2)]
    while len(levels) < 3 and levels[0] > 1:
        levels.insert(0, -(-levels[0] // 2))
    return Lengths(levels[0], tuple(levels), window)


def copied_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, doc_id, lo, n): starts of windows that also start in a document with a smaller doc_id. docs: doc_id, text, rid."""
    size = lengths(window)
    found = units(docs.where("doc_id is not null"), word_values, size)
    classes = found.groupBy("key", "context").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "rid", "lo", "n")).alias("one"))
    keys = classes.groupBy("key").agg(F.count("*").alias("contexts"), F.min("least").alias("a"), F.max("least").alias("b"))
    # contexts with the same key but other first documents: these must be told apart window by window
    mixed = staged(classes.join(keys.where("contexts > 1 and a < b"), "key").select("one.rid", "one.doc_id", "one.lo", "one.n", "key", "context", "least"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            values, first = word_values(*arrays.utf8(chunk.column("text")))
            prefix = arrays.window_prefix(values)
            want = chunk.column("found")
            row = np.repeat(np.arange(chunk.num_rows), np.diff(want.offsets.to_numpy()))
            entry = want.flatten()
            lo, n = entry.field("lo").to_numpy().astype(np.int64), entry.field("n").to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(lo)), n)
            j = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            hashes = arrays.window_hash(prefix, first[row[which]] + lo[which] + j, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), entry.field("key").take(pa.array(which)), entry.field("context").take(pa.array(which)), entry.field("least").take(pa.array(which)), pa.array(j.astype(np.int32))],
                names=["hash", "key", "context", "least", "j"],
            )

    texts = with_lists(docs, mixed, ["lo", "n", "key", "context", "least"], "inner").select("text", "found")
    rows = staged(texts.mapInArrow(windows, "hash bigint, key bigint, context bigint, least bigint, j int"))
    first = rows.groupBy("key", "hash").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b")
    late = rows.join(first, ["key", "hash"]).where("least > a").select("key", "context", "j").distinct()
    least = classes.select("key", "context", "least")
    every = members(found.join(least, ["key", "context"]))
    whole = every.where("doc_id > least").select("rid", "doc_id", "lo", "n")
    part = every.where("doc_id = least").join(late, ["key", "context"]).select("rid", "doc_id", (F.col("lo") + F.col("j")).alias("lo"), F.lit(1).alias("n"))
    return whole.union(part)


def remove_copies(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    texts = with_row_id(docs)
    copies = copied_windows(texts, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            rows = []
            for text, found in zip(chunk.column("text").to_pylist(), chunk.column("found").to_pylist(), strict=True):
                words = (text or "").encode().split()
                if found:
                    gone = covered(found, window, len(words))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_lists(texts, copies, ["lo", "n"], "left").select("doc_id", "text", "found").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The op8 rows: doc_id, n_words, n_removed, kept_sha256."""
    return remove_copies(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by a dictionary of all windows, for tests."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < d:
                gone |= set(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
