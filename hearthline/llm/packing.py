"""Packing documents into fixed windows of tokens by non-negative least squares over length combinations.

1. Every document is tokenised once (whitespace words through a bounded cache of word -> ids, so a repeated word costs a look-up) and
   cut into full windows and one rest. Only piece lengths and checksums are kept.
2. Rests are counted by length class (`CLASSES` classes, rounded up): a histogram of bounded size, whatever the corpus.
3. On the histogram alone: all combinations of up to `DEPTH` classes that fill a window are enumerated, their repeat counts solved
   by non-negative least squares (active set), rounded down, and what is left is packed greedily, largest class first, as
   combinations with repeat counts too.
4. Pieces are numbered within their class by counts per (class, hash bucket), so that no class is gathered in one task, and take the seat of
   their number in the plan; a window over each sequence sums the offsets.

Defined results: a null or empty text is the end token alone; repeated documents (same id) are packed each; an empty table gives no rows; other
columns are ignored. Null doc_ids stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import cut

WINDOW = 4096
END_ID = 2
CLASSES = 256
DEPTH = 3
#: Words that a Python worker keeps with their ids; beyond that it starts anew.
CACHED_WORDS = 1_000_000
VOCABULARY = "word_bpe_49k.json"

#: \s of the tokenizer isn't white space of str.split for these; the lower case of sigma depends on its place, that of dotted I isn't composed.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ", "<|")


class _Cache(dict):
    """word -> ids; notes the words that it hasn't."""

    def __init__(self):
        super().__init__()
        self.missing: set[str] = set()
        self.misses = 0

    def __missing__(self, word: str) -> bytes:
        self.missing.add(word)
        self.misses += 1
        return b""


class WordTokenizer:
    """ids of whole texts as little-endian 32-bit bytes. The tokenizer drops white space and never joins across it, so words are encoded alone."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends, self.cache, self.most = ends, _Cache(), CACHED_WORDS

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Words of letters are one piece of the pre-tokenizer each: encoded in one go and parted at word ends."""
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                raw, a = ids.tobytes(), 0
                for word, b in zip(part, (last * 4).tolist(), strict=True):
                    self.cache[word] = raw[a:b]
                    a = b
            else:
                self.cache.update(zip(part, self._raw(part), strict=True))

    def _learn(self, words: set[str]) -> None:
        letters, tailed, other = set(), [], {".", ","}
        for w in words:
            if w.isalpha():
                letters.add(w)
            elif w[-1] in ".," and w[:-1].isalpha():
                tailed.append(w)
                letters.add(w[:-1])
            else:
                other.add(w)
        self._letters([w for w in letters if w not in self.cache])
        rare = [w for w in other if w not in self.cache]
        self.cache.update(zip(rare, self._raw(rare), strict=True))
        for w in tailed:
            self.cache[w] = self.cache[w[:-1]] + self.cache[w[-1]]

    def trim(self) -> None:
        if len(self.cache) > self.most:
            self.cache.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        cache, again, odd = self.cache, [], []
        self.trim()
        look = cache.__getitem__
        for i, text in enumerate(texts):
            if any(c in text for c in _ODD):
                odd.append(i)
                continue
            words, cache.misses = text.lower().split(), 0
            out[i] = b"".join(map(look, words))
            if cache.misses:
                again.append((i, words))
        if cache.missing:
            missing, cache.missing = cache.missing, set()
            self._learn(missing)
            for i, words in again:
                out[i] = b"".join(map(look, words))
        for i, raw in zip(odd, self._raw([texts[i] for i in odd]), strict=True):
            out[i] = raw
        return out  # type: ignore[return-value]


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(name_or_path: str) -> WordTokenizer:
    """One per Python worker."""
    if name_or_path not in _loaded:
        path = name_or_path
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        _loaded[name_or_path] = WordTokenizer(path)
    return _loaded[name_or_path]


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, copy bigint"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Per document full windows and a rest: doc_id, start, length, ids_crc32, doc_tokens; copy: a number that parts rows of one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        words.most, encode = cached_words, words.encode
        end = np.array([END_ID], "<u4").tobytes()
        seen = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, batch.num_rows, 256):
                rows = []
                for doc, raw in zip(ids[i : i + 256], encode([t or "" for t in texts.slice(i, 256).to_pylist()]), strict=True):
                    raw += end
                    total = len(raw) // 4
                    rows += [(doc, a, min(window, total - a), zlib.crc32(raw[4 * a : 4 * (a + window)]), total, seen) for a in range(0, total, window)]
                    seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])
        words.trim()

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of up to `depth` classes that sum to `classes`: they fill a window."""
    out = [(classes,)]

    def extend(head: tuple[int, ...], left: int, most: int, depth: int) -> None:
        if left == 0:
            out.append(head)
        elif depth:
            for c in range(min(left, most), 0, -1):
                if c * depth < left:
                    break
                extend((*head, c), left - c, c, depth - 1)

    extend((), classes, classes - 1, depth)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0.0)) * a.shape[0]
    for _ in range(rounds or 3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= tolerance:
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (z <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x += step * (z - x)
            x[passive & (x <= 1e-12)] = 0
            passive &= x > 0
        x = z
    return x


def plan(counts: dict[int, int], classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination of classes, repeats) that seat every item of the histogram once. Its length depends on the classes alone."""
    left = np.zeros(classes + 1, np.int64)
    for c, n in counts.items():
        left[c] = n
    out: list[tuple[tuple[int, ...], int]] = []
    options = [o for o in combinations(classes, depth) if all(left[c] for c in o)]
    if options:
        matrix = np.zeros((classes, len(options)))
        for j, o in enumerate(options):
            for c in o:
                matrix[c - 1, j] += 1
        x = nnls(matrix, left[1:].astype(float))
        for j in np.argsort(-x):
            o = options[j]
            uses = {c: o.count(c) for c in o}
            repeats = min(int(np.floor(x[j] + 1e-6)), *(int(left[c]) // k for c, k in uses.items()))
            if repeats > 0:
                out.append((o, repeats))
                for c, k in uses.items():
                    left[c] -= k * repeats
    while left.any():  # each turn uses up a class
        room, head, rest = classes, [], left.copy()
        while room:
            fits = np.flatnonzero(rest[1 : room + 1]) + 1
            if not len(fits):
                break
            c = int(fits[-1])
            k = int(min(rest[c], room // c))
            head += [c] * k
            rest[c] -= k
            room -= c * k
        uses = {c: head.count(c) for c in head}
        repeats = min(int(left[c]) // k for c, k in uses.items())
        out.append((tuple(head), repeats))
        for c, k in uses.items():
            left[c] -= k * repeats
    return out


def seats(chosen: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Rows (class, first rank, last rank + 1, first sequence, seat): the items of a class with those ranks sit there, one in each sequence."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combination, repeats in chosen:
        for seat, c in enumerate(combination):
            a = used.get(c, 0)
            rows.append((c, a, a + repeats, sequence, seat))
            used[c] = a + repeats
        sequence += repeats
    return pd.DataFrame(rows, columns=["class", "low", "high", "sequence", "seat"])


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, classes: int = CLASSES, depth: int = DEPTH, cached_words: int = CACHED_WORDS) -> DataFrame:
    """The op3 rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. cached_words: what a Python worker keeps of words with their ids."""
    cells = cut(pieces(docs, vocabulary, window, cached_words))
    width = window // classes
    full, rests = cells.where(F.col("length") == window), cells.where(F.col("length") < window)
    buckets = max(16, docs.sparkSession.sparkContext.defaultParallelism * 4)
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(buckets))
    rests = rests.withColumn("class", F.ceil(F.col("length") / width)).withColumn("bucket", bucket)
    fulls = full.withColumn("class", F.lit(0).cast("bigint")).withColumn("bucket", bucket)
    every = rests.union(fulls)
    # rows of a class before each bucket: a table of at most (classes + 1) * buckets rows
    tally = every.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).select("class", "bucket", "before")
    histogram = {r["class"]: r.n for r in tally.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    n_full = histogram.pop(0, 0)
    table = seats(plan(histogram, classes, depth))
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "copy")
    ranked = every.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(before), ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    lows = {int(c): g.sort_values("low")[["low", "sequence", "seat"]].to_numpy() for c, g in table.groupby("class")}

    def sit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c, rank = f["class"].to_numpy(), f["rank"].to_numpy()
            sequence, seat = rank.copy(), np.zeros(len(f), np.int64)
            for k in np.unique(c):
                if k:
                    own, at = lows[int(k)], c == k
                    row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                    sequence[at], seat[at] = n_full + row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            yield f.drop(columns=["class", "rank"]).assign(sequence_id=sequence, seat=seat)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in [*columns, "sequence_id", "seat"]])
    seated = ranked.select(*columns, "class", "rank").mapInPandas(sit, schema)
    within = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select(*columns, "sequence_id", "offset")
