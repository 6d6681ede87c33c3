"""Benchmark decontamination: binary search of every test suffix in suffix arrays of the training shards.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the ASCII-lower-cased text. Each task cuts its documents into shards of
about 2 MB and sorts a word-level suffix array of each shard. Only suffixes that can hold a match are sorted: those followed by enough
words of the benchmark's vocabulary (a match holds no other word). Every test suffix is then found by binary search; the suffixes
around its place give its longest verbatim match, and those between its lower and upper bound are all its occurrences.

The documents are never shuffled. The benchmark is read in blocks of at most `block_words` words (BLOCK_WORDS by default), so what a
task holds is bounded; blocks reach the tasks as broadcast files, so the driver holds one at a time. Where there are more, rows get a key and are staged once; blocks
beyond the first cost another pass each, whose hits are united per row.

Defined results: a null or empty text has no words, hence no hits; a null item has none and matches nothing; repeated
documents get a row each; an empty benchmark hits nothing; other columns of the tables are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .store import staged

WINDOW = 10
#: Words of the benchmark that are held in a task at once (about 40 bytes each).
BLOCK_WORDS = 2_000_000
#: Bytes of a shard in decontaminate(): its workers hold less, as they serve other stages too.
SHARD = 1 << 19

_MATCH = "array<struct<start: bigint, end: bigint, item_id: string, item_word: bigint, length: bigint>>"


def _ranks(ids: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of ids up to `depth` words by prefix doubling. stop: where each suffix's document ends. Beyond it, words are absent (0)."""
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while step < depth:
        at = np.arange(n) + step
        second = np.where(at < stop, rank[np.minimum(at, n - 1)], 0)
        _, rank = np.unique(rank * np.int64(n + 2) + second, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
    return rank


def _compare(text: np.ndarray, at: np.ndarray, query: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of (suffix at `at` - query row) over the first `depth` words of each row, and the length of their common prefix."""
    width = query.shape[1]
    got = text[at[:, None] + np.arange(width)]
    cols = np.arange(width)[None, :]
    differ = (got != query) & (cols < depth[:, None])
    any_ = differ.any(axis=1)
    first = np.where(any_, differ.argmax(axis=1), depth)
    row = np.arange(len(at))
    col = np.minimum(first, width - 1)
    sign = np.where(any_, np.sign(got[row, col].astype(np.int64) - query[row, col].astype(np.int64)), 0)
    return sign, first


def _search(text: np.ndarray, order: np.ndarray, query: np.ndarray, depth: np.ndarray, upper: bool) -> np.ndarray:
    """Lower or upper bound of each query row in the suffix array `order`."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    while (active := lo < hi).any():
        mid = (lo + hi) // 2
        sign, _ = _compare(text, order[np.minimum(mid, len(order) - 1)], query, depth)
        right = active & ((sign <= 0) if upper else (sign < 0))
        lo, hi = np.where(right, mid + 1, lo), np.where(active & ~right, mid, hi)
    return lo


class Benchmark:
    """Suffixes of a block of test items, as word numbers (1 and up) in a vocabulary of word hashes."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = arrays.utf8(column)
        data = arrays.lower_ascii(data)
        starts, ends, first = arrays.word_bounds(data, offsets, arrays.NOT_ALNUM)
        hashes = arrays.word_hashes(data, starts, ends)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = np.concatenate((ids.astype(np.int32) + 1, np.zeros(window, np.int32)))
        self.names = [str(i) for i, _ in items]
        item = np.repeat(np.arange(len(items)), np.diff(first))
        at, left = np.arange(len(item)), first[item + 1] - np.arange(len(item)) if len(item) else np.zeros(0, np.int64)
        size = np.minimum(np.diff(first)[item], window) if len(item) else left
        use = left >= size  # suffixes shorter than a window end inside another's
        self.item, self.at, self.depth = item[use], (at - first[item])[use] if len(item) else at, size[use]
        rows = ids[at[use][:, None] + np.arange(window)]
        rows[np.arange(window)[None, :] >= self.depth[:, None]] = 0
        self.query, self.window = rows, window
        self.words, self.start, self.left = ids, at[use], left[use]
        self.least = int(self.depth.min()) if len(self.depth) else 0

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document its number of words, and rows (document, word, query, length of the match, depth)."""
        data = arrays.lower_ascii(data)
        starts, ends, first = arrays.word_bounds(data, offsets, arrays.NOT_ALNUM)
        counts, none = np.diff(first), np.zeros((0, 5), np.int64)
        if not self.least or not len(starts):
            return counts, none
        hashes = arrays.word_hashes(data, starts, ends)
        place = np.searchsorted(self.vocabulary, hashes)
        known = self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] == hashes
        text = np.where(known, place + 1, 0).astype(np.int32)
        doc = np.repeat(np.arange(len(counts)), counts)
        # how many words of the vocabulary follow on end in the same document
        n = len(text)
        broken = np.flatnonzero(~known)
        stop = first[doc + 1]
        next_broken = np.concatenate((broken, [n]))[np.searchsorted(broken, np.arange(n))]
        stop = np.minimum(stop, next_broken)
        suffixes = np.flatnonzero(stop - np.arange(n) >= self.least)
        if not len(suffixes):
            return counts, none
        # the stretches that such suffixes reach, laid end to end with zeros behind each
        reach = np.zeros(n + 1, np.int64)
        np.add.at(reach, suffixes, 1)
        np.add.at(reach, stop[suffixes], -1)
        keep = np.flatnonzero(np.cumsum(reach[:n]) > 0)
        gap = np.ones(len(keep), bool)
        gap[1:] = (np.diff(keep) > 1) | (stop[keep[1:]] != stop[keep[:-1]])
        block = np.cumsum(gap) - 1
        dense = np.arange(len(keep)) + block * self.window
        packed = np.zeros(len(keep) + (block[-1] + 1) * self.window + self.window, np.int32)
        origin = np.full(len(packed), -1, np.int64)
        packed[dense], origin[dense] = text[keep], keep
        zero = np.flatnonzero(packed == 0)
        ends_at = zero[np.searchsorted(zero, np.arange(len(packed)))]
        rank = _ranks(packed, ends_at, self.window)
        chosen = np.flatnonzero((origin >= 0) & (ends_at - np.arange(len(packed)) >= self.least))
        order = chosen[np.argsort(rank[chosen], kind="stable")]
        low = _search(packed, order, self.query, self.depth, upper=False)
        high = _search(packed, order, self.query, self.depth, upper=True)
        hit = np.flatnonzero(high > low)
        size = (high - low)[hit]
        query = np.repeat(hit, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = order[low[query] + within]
        # the verbatim match runs on beyond the window
        length, live = self.depth[query].copy(), np.arange(len(query))
        while len(live):
            more = length[live] < np.minimum(self.left[query[live]], (ends_at - np.arange(len(packed)))[at[live]])
            live = live[more]
            live = live[packed[at[live] + length[live]] == self.words[self.start[query[live]] + length[live]]]
            length[live] += 1
        word = origin[at]
        return counts, np.column_stack((doc[word], word - first[doc[word]], query, length, self.depth[query])) if len(word) else none


def _finder(items: Broadcast, window: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = _loaded(items, window)
        for chunk in arrays.chunks(batches):
            counts, found = bench.matches(*arrays.utf8(chunk.column("text")))
            by_doc: dict[int, list] = {}
            for row in found.tolist():
                by_doc.setdefault(row[0], []).append(row)
            hits, names, out = [], [], []
            for i in range(chunk.num_rows):
                rows = by_doc.get(i, ())
                hits.append(_union([(r[1], r[1] + r[4]) for r in rows]))
                names.append(sorted({bench.names[bench.item[r[2]]] for r in rows}))
                if spans:
                    out.append([{"start": r[1], "end": r[1] + r[3], "item_id": bench.names[bench.item[r[2]]], "item_word": int(bench.at[r[2]]), "length": r[3]} for r in rows])
            columns = {c: chunk.column(c) for c in chunk.schema.names if c != "text"}
            columns |= {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, _SPANS), "items": pa.array(names, pa.list_(pa.string()))}
            if spans:
                columns["matches"] = pa.array(out, _MATCHES)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _loaded(items: Broadcast, window: int) -> Benchmark:
    bench = Benchmark(items.value, window)
    items.__dict__.pop("_value", None)  # a worker that sees many blocks keeps none of their texts
    return bench


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("length", pa.int64())]))


def _union(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most block_words words, an item of its own beyond that; read part by part, never all at once."""
    block, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null").orderBy("i").toLocalIterator():
        n = len(row.t) // 2 + 1
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row.i, row.t))
        words += n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, spans: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, hits (united word spans under windows), items (those found, sorted), matches (all verbatim matches: word span, item, its word, length)."""
    send = docs.sparkSession.sparkContext.broadcast
    blocks = [send(block) for block in _blocks(benchmark, block_words)] or [send([])]
    schema = "doc_id bigint, n_words bigint, hits array<struct<start: bigint, end: bigint>>, items array<string>" + (f", matches {_MATCH}" if spans else "")
    texts = docs.select("doc_id", "text")
    if len(blocks) == 1:
        return texts.mapInArrow(_finder(blocks[0], window, spans), schema)
    # a key for each row, fixed by writing it: ids may be null or come twice
    texts = staged(texts.select(F.monotonically_increasing_id().alias("row"), "*"))
    parts, *others = (texts.mapInArrow(_finder(block, window, spans), f"row bigint, {schema}") for block in blocks)
    for more in others:
        parts = parts.union(more.where("size(items) > 0"))
    found = parts.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        *([F.flatten(F.collect_list("matches")).alias("matches")] if spans else []),
    )
    return found.drop("row").mapInArrow(_unite, schema)


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = pa.array([_union([(s["start"], s["end"]) for s in row]) for row in b.column("hits").to_pylist()], _SPANS)
        yield b.set_column(b.schema.get_field_index("hits"), "hits", hits)


def digest(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [sum(s["end"] - s["start"] for s in _union([(s["start"], s["end"]) for s in row])) for row in b.column("hits").to_pylist()]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hit])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The op7 rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return digest(find_leaks(docs, benchmark, window, spans=False))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the documents that hold a window of a benchmark item. Rows, columns and types stay otherwise."""

    def keeps(items: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = _loaded(items, window)
            for chunk in arrays.chunks(batches, size=SHARD):
                _, found = bench.matches(*arrays.utf8(chunk.column("text")))
                clean = np.ones(chunk.num_rows, bool)
                clean[found[:, 0]] = False
                yield chunk.filter(pa.array(clean))

        return run

    for block in _blocks(benchmark, block_words):
        docs = docs.mapInArrow(keeps(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs
