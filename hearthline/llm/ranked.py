"""Ranked lexical search: each item's best documents, by masks of the item's terms that documents hold.

1. Every document is read once: its number of terms and, for the terms that some item has, how often they occur. These postings are staged;
   sums per term (documents holding it), N and L come from them, so weights are those of all documents.
2. Each task takes its postings in blocks of BLOCK_DOCUMENTS documents and makes a bitmap over the block's documents for every term. For an item, its
   terms' bitmaps are united, which leaves the documents that match at all, and turned around, which gives each of them the mask of the item's terms
   that it holds. Documents of one mask are a group.
3. A mask's highest possible score is the sum of its terms' weights times the block's best share for each. Masks are evaluated from the highest down, until
   no mask that is left can reach the item's k-th score so far: the rest is safe to leave. Nothing is approximate, and ties go by doc_id.
4. Tasks give at most k documents an item; a window ranks them.

The items are read in blocks of at most `block_terms` terms, which bounds what is broadcast and the collected sums (a number for each of the block's terms).
Documents are neither shuffled nor collected. Each further block costs another pass.

Defined results: a null or empty text has no terms, is no document of N and is found for nothing; a null, empty or termless item finds nothing; every row
of the items is an item, whatever its item_id; repeated doc_ids are documents of their own; null doc_ids come last among equal scores; documents
with score 0 aren't listed; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays
from .store import staged

BEST = 10
#: Terms of items that a task holds at once (with repeats).
BLOCK_TERMS = 2_000_000
#: Documents whose bitmaps a task holds at once.
BLOCK_DOCUMENTS = 1 << 16

#: Bytes of terms stay (A-Z in lower case, beyond ASCII as they are), all others part terms.
_TERMS = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of [0-9a-z] and characters beyond ASCII, after lower-casing A-Z alone."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass
class Block:
    """Items as (number, their distinct terms' numbers, how often each); vocabulary: term -> number."""

    items: list[tuple[int, np.ndarray, np.ndarray]]
    vocabulary: dict[bytes, int]


def item_blocks(numbered: DataFrame, most: int) -> Iterator[Block]:
    """Items(item, text) in blocks of at most `most` terms, an item of its own beyond that; read part by part, never all at once."""
    block, held = Block([], {}), 0
    for row in numbered.select("item", "text").toLocalIterator():
        counts = Counter(terms(row.text))
        if not counts:
            continue
        if block.items and held + counts.total() > most:
            yield block
            block, held = Block([], {}), 0
        held += counts.total()
        numbers = [block.vocabulary.setdefault(t, len(block.vocabulary)) for t in counts]
        block.items.append((row.item, np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
    if block.items:
        yield block


def postings(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n (terms with repeats) and the document's terms of the vocabulary with their occurrences; documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for chunk in arrays.chunks(batches):
            rows, sizes, found, often = [], [], [], []
            ends = [0]
            for i, text in enumerate(chunk.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                have, times = np.unique(np.array([x for x in map(number, words) if x is not None], np.int32), return_counts=True)
                rows.append(i)
                sizes.append(len(words))
                found.append(have)
                often.append(times)
                ends.append(ends[-1] + len(have))
            join = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind))
            offsets = pa.array(np.array(ends, np.int32))
            columns = [chunk.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, join(found, np.int32)), pa.ListArray.from_arrays(offsets, join(often, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<bigint>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms: 25 and 75 times their length over the mean."""
    if len(n) and int(n.max()) * 75 * documents >= 1 << 63:  # only then are Python's integers needed
        return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    return 25 + 75 * n * documents // total


class Postings:
    """Postings of a block of documents, term by term: ascending documents, shares, and the bitmap of the documents."""

    def __init__(self, size: int, document: np.ndarray, term: np.ndarray, share: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.size, self.document, self.share = size, document[order], share[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.concatenate((first, [len(order)]))
        self.bitmaps = np.zeros((len(self.terms), -(-size // 8)), np.uint8)
        flags = np.zeros(size, bool)
        for i in range(len(self.terms)):
            at = self.document[self.first[i] : self.first[i + 1]]
            flags[at] = True
            self.bitmaps[i] = np.packbits(flags)
            flags[at] = False
        self.best = np.maximum.reduceat(self.share, self.first[:-1]) if len(self.terms) else np.zeros(0, np.int64)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents with one of the terms, the number of each one's mask, masks as rows of flags)."""
        bitmaps = self.bitmaps[rows]
        any_ = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0))[: self.size])
        turned = np.packbits(np.unpackbits(bitmaps, axis=1)[:, any_], axis=0).T  # a row of bytes for each document: its mask
        width = -(-turned.shape[1] // 8) * 8
        padded = np.zeros((len(any_), width), np.uint8)
        padded[:, : turned.shape[1]] = turned
        number = np.zeros(len(any_), np.int64)
        for word in padded.view(np.uint64).T:  # 64 terms at a time
            _, part = np.unique(word, return_inverse=True)
            _, number = np.unique(number * np.int64(len(any_) + 1) + part, return_inverse=True)
        _, sample = np.unique(number, return_index=True)
        return any_, number, np.unpackbits(turned[sample], axis=1)[:, : len(rows)].astype(bool)

    def scores(self, documents: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(documents), np.int64)
        for row, w in zip(rows.tolist(), weights.tolist(), strict=True):
            a, b = self.first[row], self.first[row + 1]
            at = a + np.searchsorted(self.document[a:b], documents)
            there = (at < b) & (self.document[np.minimum(at, b - 1)] == documents)
            out[there] += w * self.share[at[there]]
        return out


class Best:
    """The k best of an item so far: score descending, null ids last, ids ascending."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document must reach; equal scores may still win by their id."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        use = score >= self.least()
        score, null, ids = (np.concatenate(x) for x in ((self.score, score[use]), (self.null, null[use]), (self.id, ids[use])))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.null, self.id = score[order], null[order], ids[order]


def search_block(block: Postings, null: np.ndarray, ids: np.ndarray, numbers: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the block's documents to an item's best; numbers, weights: its terms and their weights times repeats. Returns how many documents it scored."""
    at = np.searchsorted(block.terms, numbers)
    have = np.flatnonzero((at < len(block.terms)) & (block.terms[np.minimum(at, len(block.terms) - 1)] == numbers)) if len(block.terms) else at[:0]
    if not len(have):
        return 0
    rows, weights = at[have], weights[have]
    highest = weights * block.best[rows]
    if highest.sum() < best.least():
        return 0
    documents, number, flags = block.masks(rows)
    most = flags.astype(np.int64) @ highest
    order = np.argsort(-most, kind="stable")
    group = np.argsort(number, kind="stable")  # documents mask by mask
    first = np.searchsorted(number[group], np.arange(len(most) + 1))
    sizes = np.diff(first)[order]
    done, scored, step = 0, 0, 4 * best.k
    while done < len(order) and most[order[done]] >= best.least():
        upto = done + max(1, int(np.searchsorted(np.cumsum(sizes[done:]), step)))
        now = order[done:upto]
        now = now[most[now] >= best.least()]
        at = np.concatenate([group[first[m] : first[m + 1]] for m in now])
        chosen = documents[at]
        best.add(block.scores(chosen, rows, weights), null[chosen], ids[chosen])
        scored += len(chosen)
        done, step = upto, step * 2
    return scored


def _finder(block: Broadcast, holding: Broadcast, documents: int, total: int, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = block.value, holding.value
        best = [Best(k) for _ in items]
        for chunk in _joined(batches, size):
            lists, n = chunk.column("terms"), chunk.column("n").to_numpy()
            owner = np.repeat(np.arange(chunk.num_rows), np.diff(lists.offsets.to_numpy()))
            times = chunk.column("times").flatten().to_numpy()
            m = lengths(n, documents, total)
            share = 1_000_000_000 * times // (1000 * times + 8 * m[owner])
            found = Postings(chunk.num_rows, owner, lists.flatten().to_numpy(), share)
            ids = chunk.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for (_, numbers, repeats), b in zip(items, best, strict=True):
                search_block(found, null, ids, numbers, weights[numbers] * repeats, b)
        for (item, _, _), b in zip(items, best, strict=True):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item)), pa.array(b.id, mask=b.null), pa.array(b.score)], names=["item", "doc_id", "score"])

    return run


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` rows."""
    held, rows = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            part = batch.slice(a, size)
            if held and rows + part.num_rows > size:
                yield pa.concat_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield pa.concat_batches(held)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of every item, by (score descending, doc_id)."""
    spark = docs.sparkSession
    numbered = staged(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    parts: list[DataFrame] = []
    for block in item_blocks(numbered, block_terms):
        found = staged(postings(docs, spark.sparkContext.broadcast(block.vocabulary)))
        documents, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(block.vocabulary), np.int64)  # of a block's terms, so bounded by block_terms
        for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():
            holding[term] = n
        weights = np.array([weight(documents, int(n)) for n in holding], np.int64)
        send = spark.sparkContext.broadcast
        run = _finder(send(block.items), send(weights), documents, total, k, block_documents)
        parts.append(found.mapInArrow(run, "item bigint, doc_id bigint, score bigint"))
    if not parts:
        return numbered.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    best = parts[0]
    for more in parts[1:]:
        best = best.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
