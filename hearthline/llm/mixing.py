"""Language-model scoring by online logistic context mixing of hashed-context bit predictors.

A text is its lower-cased words and an end, coded in order. A symbol is a path of bits in a Huffman tree: one tree holds the end and the most frequent
words of the training documents (at most `VOCABULARY`), and a leaf for all others, whose letters follow one by one in a second tree. Three
bit predictors hold counts of zeros and ones, one for each hashed context: of a word, the tree's node alone, and the node with the one or two
words before (over the whole text); of a letter, the node with the one, two or three letters before. Their stretched probabilities are mixed by weights that a
gate chooses (how well the longer contexts are known), and an adaptive probability map refines the result. While a document is coded its mixing weights go
on learning from what it has shown, in rounds of 64, 128, 256, ... words; they start anew with each document, so a score depends on no
other document. Minus log2 of the product of all bits' probabilities over the text's bytes is `bits_per_byte`.

On Spark: word counts cover all training documents and give the base score and the vocabulary. Each counting task adds all bits of its training documents
to tables of counts and emits them as compressed blobs of `BLOB` counts, which are added up by place, first by a salt, then in all. No context
is dropped: those whose hashes meet share their counts. The tables have one slot for each training word, at most 2**`TABLE_BITS` in each predictor (two bytes a slot as
broadcast). Where the mixer starts is learned in parallel from all training documents, a document's own bits taken
out of the counts, in parts by hash, and averaged, so scores don't depend on partitions. The base score of words in the vocabulary comes with
the codes; the others leave their task as lists and are joined with their counts, so texts are never shuffled.

Defined results: a null, empty or blank text is the end token alone, with null bits_per_byte; documents with a null id are scored, never learned from; repeated rows
count and are scored each; with no training documents N and V are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .store import staged

#: Bound of the vocabulary: the driver holds its hashes and codes.
VOCABULARY = 1 << 17
#: Longest word of the vocabulary; longer ones are spelled.
WORD_BYTES = 64
#: Bound of each predictor's slots, as a power of two.
TABLE_BITS = 21
#: Parts that training documents are dealt to at least where they show the mixer where to start, and bytes of text in one of more.
PARTS, PART_BYTES = 8, 16 << 20
#: Bytes of text that one task counts into tables; fewer would send more blobs through the shuffle.
TABLE_BYTES = 128 << 20
BLOB, SALTS = 1 << 15, 16
#: Bytes that are laid out at once, and symbols whose bits are.
CHUNK, SYMBOLS = 1 << 18, 1 << 15
DELTA, RATE, FIRST_RATE, MAP_RATE, FIRST_ROUND = 0.3, 1.0, 0.3, 0.02, 64
ORDERS, _GATES, _STEPS = 3, 64, 33
_START, _END = np.uint64(0x51ED27), np.uint64(0xE0D)


def huffman(weights: np.ndarray, first_node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, nodes, places, bits) of all leaves' paths from the root, laid end to end. Four bits on end share the node of the first; their places in it are 1, 2-3, 4-7, 8-15."""
    n = len(weights)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    heap = [(int(w), i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    for inner in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = inner
        side[j] = 1
        heapq.heappush(heap, (a + b, inner))
    at, steps = np.arange(n), []
    while (live := at != 2 * n - 2).any():
        steps.append((live, np.where(live, parent[at], -1), side[at]))
        at = np.where(live, parent[at], at)
    lengths = np.sum([s[0] for s in steps], axis=0, dtype=np.int64) if steps else np.zeros(n, np.int64)
    stop = np.cumsum(lengths)
    nodes, bits = np.zeros(int(stop[-1]), np.uint32), np.zeros(int(stop[-1]), np.uint8)
    for k, (live, node, bit) in enumerate(steps):
        place = (stop - 1 - k)[live]
        nodes[place], bits[place] = node[live] - n + first_node, bit[live]
    depth = np.arange(len(nodes)) - np.repeat(stop - lengths, lengths)
    local = np.ones(len(nodes), np.uint8)
    for k in range(1, 4):
        on = np.flatnonzero(depth % 4 == k)
        local[on] = 2 * local[on - 1] + bits[on - 1]
    nodes = nodes[np.arange(len(nodes)) - depth % 4]
    return lengths, nodes, local, bits


class Codes:
    """Codes of words (by hash), of the end, of other words, and of letters. words: hashes and counts of the vocabulary."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, others: int, ends: int, letters: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, v = hashes[order], counts[order], len(hashes)
        self.end, self.other, self.letters = v, v + 1, v + 2  # letter c is the symbol letters + c, 256 ends a word
        a = huffman(np.concatenate((counts[order] + 1, [ends + 1, others + 1])), 1)
        b = huffman(letters, v + 2)
        self.length = np.concatenate((a[0], b[0]))
        self.start = np.cumsum(self.length) - self.length
        self.node, self.local, self.bit = np.concatenate((a[1], b[1])) * np.uint32(0x9E3779B1), np.concatenate((a[2], b[2])), np.concatenate((a[3], b[3]))


class Symbols:
    """The symbols of a chunk of texts in the order of their rounds: contexts of each order, number in the tree, and document."""

    def __init__(self, codes: Codes, data: np.ndarray, offsets: np.ndarray):
        data = arrays.lower_ascii(data)
        starts, ends, first = arrays.word_bounds(data, offsets, arrays.SPACE)
        n, n_docs = len(starts), len(offsets) - 1
        size = np.diff(first) + 1
        doc = np.repeat(np.arange(n_docs, dtype=np.int32), size)
        total = n + n_docs
        at = np.arange(total) - (np.cumsum(size) - size)[doc]
        word = np.repeat(np.arange(n_docs), size - 1) + np.arange(n)  # one end stands behind each document before
        h = np.full(total, _END, np.uint64)
        h[word] = arrays.word_hashes(data, starts, ends)
        place = np.minimum(np.searchsorted(codes.hashes, h), max(len(codes.hashes) - 1, 0))
        sym = np.where(codes.hashes[place] == h, place, codes.other) if len(codes.hashes) else np.full(total, codes.other)
        is_end = np.ones(total, bool)
        is_end[word] = False
        sym[is_end] = codes.end
        short = (h >> np.uint64(32)).astype(np.uint32)
        contexts, c = [np.zeros(total, np.uint32)], np.zeros(total, np.uint32)
        for k in range(1, ORDERS):
            before = np.full(total, 0xABCD, np.uint32)
            before[k:] = short[: total - k]
            before[at < k] = 0xABCD + k
            c = (c ^ before) * np.uint32(0x85EBCA6B)
            c ^= c >> np.uint32(15)
            contexts.append(c + np.uint32(k * 0x3C6EF372))
        round_ = np.searchsorted(FIRST_ROUND * ((1 << np.arange(1, 40)) - 1), at, "right").astype(np.uint8)
        # the letters of words beyond the vocabulary
        rare = np.flatnonzero(sym == codes.other)
        which = rare - doc[rare]
        long = ends[which] - starts[which] + 1
        of = np.repeat(np.arange(len(rare)), long)
        pos = np.arange(len(of)) - (np.cumsum(long) - long)[of]
        byte = data[np.minimum(starts[which][of] + pos, max(len(data) - 1, 0))].astype(np.uint32) if len(of) else np.zeros(0, np.uint32)
        letter = np.where(pos < long[of] - 1, byte, np.uint32(256))
        self.size, self.rare = size, (np.bincount(doc[rare], minlength=n_docs), long - 1, byte[letter != 256].astype(np.uint8))
        c = np.zeros(len(of), np.uint32)
        for k in range(ORDERS):
            before = np.zeros(len(of), np.uint32)
            before[k + 1 :] = byte[: max(len(of) - k - 1, 0)]
            before[pos <= k] = 300
            c = (c ^ before) * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
            c ^= c >> np.uint32(13)
            contexts[k] = np.concatenate((contexts[k], c + np.uint32(k)))
        sym = np.concatenate((sym, letter.astype(np.int64) + codes.letters))
        doc = np.concatenate((doc, doc[rare][of]))
        round_ = np.concatenate((round_, round_[rare][of]))
        order = np.argsort(round_, kind="stable")
        self.contexts, self.symbol, self.doc = [c[order] for c in contexts], sym[order], doc[order]
        self.rounds = np.cumsum(np.bincount(round_)) if total else np.zeros(0, np.int64)
        self.n_docs, self.codes = n_docs, codes

    def known(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document, the sum of `base` over its words of the vocabulary, and how many these are."""
        on = self.symbol < self.codes.end
        return np.bincount(self.doc[on], base[self.symbol[on]], self.n_docs), np.bincount(self.doc[on], minlength=self.n_docs)

    def others(self) -> pa.Array:
        """For each document, its words beyond the vocabulary."""
        per_doc, long, data = self.rare
        offsets = [np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in (long, per_doc)]
        words = pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(offsets[0].tobytes()), pa.py_buffer(data.tobytes())])
        return pa.ListArray.from_arrays(pa.array(offsets[1]), words)

    def pieces(self) -> Iterator[tuple[int, int, bool]]:
        """Runs of symbols of one round, and whether a round ends with them."""
        a = 0
        for b in self.rounds.tolist():
            while a < b:
                stop = min(b, a + SYMBOLS)
                yield a, stop, stop == b
                a = stop

    def bits(self, a: int, b: int, slot_bits: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(slots of each order, bit, document) of all bits of the symbols from a to b."""
        codes, sym = self.codes, self.symbol[a:b]
        length = codes.length[sym]
        total = int(length.sum())
        at = np.arange(total) + np.repeat(codes.start[sym] - (np.cumsum(length) - length), length)
        node, local, bit = codes.node[at], codes.local[at].astype(np.int64), codes.bit[at]
        slots, begin = [], 0
        for c, n in zip(self.contexts, slot_bits, strict=True):
            x = (np.repeat(c[a:b], length) ^ node) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            slots.append((x >> np.uint32(36 - n) << np.uint32(4)).astype(np.int64) + (local + begin))
            begin += 1 << n
        return slots, bit, np.repeat(self.doc[a:b], length)


#: What a byte says of a count: exact to 32, then eight steps to a doubling.
_COUNT = np.concatenate((np.arange(33), 32 * 2 ** (np.arange(1, 223) / 8)))


def _byte_of(count: np.ndarray) -> np.ndarray:
    return np.where(count <= 32, count, np.minimum(32 + np.round(8 * np.log2(np.maximum(count, 1) / 32)), 254)).astype(np.uint16)


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + DELTA) / (zeros + DELTA)).astype(np.float32)


_ZEROS, _ONES = np.repeat(_COUNT, 256)[: 255 * 256], np.tile(np.concatenate((_COUNT, _COUNT[-1:])), 255)
_KNOWN = _stretch(_ZEROS, _ONES)
#: The same without one zero, or without one that was seen.
_WITHOUT = np.stack((_stretch(np.maximum(_ZEROS - 1, 0), _ONES), _stretch(_ZEROS, np.maximum(_ONES - 1, 0))))


def _level(total: np.ndarray) -> np.ndarray:
    """How well a context is known, from 0 to 7."""
    return np.searchsorted([0, 1, 3, 7, 31, 127, 1023], total).astype(np.uint8)


_LEVEL = _level(_ZEROS + _ONES)
_LEVEL_WITHOUT = _level(np.maximum(_ZEROS + _ONES - 1, 0))


class Predictors:
    """Counts of zeros and ones of all slots of all orders."""

    def __init__(self, slot_bits: tuple[int, ...]):
        self.slot_bits = slot_bits
        size = sum(1 << b for b in slot_bits)
        self.counts = np.zeros(2 * size, np.uint32)

    def add(self, symbols: Symbols) -> None:
        for a, b, _ in symbols.pieces():
            slots, bit, _ = symbols.bits(a, b, self.slot_bits)
            for s in slots:
                np.add.at(self.counts, 2 * s + bit, np.uint32(1))


def packed(counts: np.ndarray) -> np.ndarray:
    """Both counts of each slot in two bytes."""
    return _byte_of(counts[::2].astype(float)) << np.uint16(8) | _byte_of(counts[1::2].astype(float))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


class Mixer:
    """Weights of each gate and order, and the adaptive probability map: the state before a document."""

    def __init__(self):
        self.weights = np.full((ORDERS, _GATES), 0.3, np.float32)
        self.map = np.tile(_squash(np.linspace(-8, 8, _STEPS)).astype(np.float32), (_GATES, 1))
        self.seen = 0

    @staticmethod
    def _place(mixed: np.ndarray) -> np.ndarray:
        return ((np.clip(mixed, -8, 8) + np.float32(8)) * np.float32((_STEPS - 1) / 16) + np.float32(0.5)).astype(np.int32)

    def learn(self, symbols: Symbols, table: np.ndarray, slot_bits: tuple[int, ...], batch: int = 4096) -> None:
        """Weights and map go on from the bits of the symbols, whose own occurrence is taken out of the counts."""
        for a, b, _ in symbols.pieces():
            slots, bits, _ = symbols.bits(a, b, slot_bits)
            for i in range(0, len(bits), batch):
                bit = bits[i : i + batch]
                code = [table[s[i : i + batch]] for s in slots]
                x = [_WITHOUT[bit, c] for c in code]
                level = [_LEVEL_WITHOUT[c] for c in code[1:]]
                gate = (level[0] * 8 + level[1]).astype(np.int64)
                mixed = sum(self.weights[k][gate] * x[k] for k in range(ORDERS))
                p = _squash(mixed)
                error = bit - p
                seen = np.maximum(np.bincount(gate, minlength=_GATES), 64)
                for k in range(ORDERS):
                    self.weights[k] += FIRST_RATE * np.bincount(gate, error * x[k], _GATES) / seen
                near = gate * _STEPS + self._place(mixed)
                hits = np.bincount(near, minlength=_GATES * _STEPS)
                target = np.bincount(near, bit, _GATES * _STEPS) / np.maximum(hits, 1)
                flat = self.map.reshape(-1)
                flat += (1 - (1 - MAP_RATE) ** hits) * (target - flat)
            self.seen += len(bits)
        np.clip(self.map, 1e-6, 1 - 1e-6, out=self.map)

    def log2(self, symbols: Symbols, table: np.ndarray, slot_bits: tuple[int, ...]) -> np.ndarray:
        """log2 of each document's probability. Its weights learn on after each round."""
        n = symbols.n_docs
        total = np.zeros(n)
        own = np.repeat(self.weights[:, None, :], n, axis=1).reshape(ORDERS, -1)
        change, seen = np.zeros((ORDERS, n * _GATES)), np.zeros(n * _GATES)
        flat = self.map.reshape(-1)
        for a, b, over in symbols.pieces():
            slots, bit, doc = symbols.bits(a, b, slot_bits)
            code = [table[s].astype(np.int64) for s in slots]
            x = [_KNOWN[c] for c in code]
            gate = (_LEVEL[code[1]] * np.uint8(8) + _LEVEL[code[2]]).astype(np.int64)
            seat = doc * np.int64(_GATES) + gate
            mixed = own[0][seat] * x[0]
            for k in range(1, ORDERS):
                mixed += own[k][seat] * x[k]
            p = _squash(mixed)
            both = np.clip((p + flat[gate * _STEPS + self._place(mixed)]) * np.float32(0.5), 1e-6, 1 - 1e-6)
            total += np.bincount(doc, np.log2(np.where(bit == 1, both, 1 - both)), n)
            if b < len(symbols.symbol):  # nothing is coded behind the last round
                error = bit - p
                seen += np.bincount(seat, minlength=n * _GATES)
                for k in range(ORDERS):
                    change[k] += np.bincount(seat, error * x[k], n * _GATES)
                if over:
                    on = np.flatnonzero(seen)
                    own[:, on] += (RATE * change[:, on] / (seen[on] + 64)).astype(np.float32)
                    change[:], seen[:] = 0, 0
        return total


def _chunks(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[tuple[pa.RecordBatch, Symbols]]:
    for chunk in arrays.chunks(batches, size=CHUNK):
        yield chunk, Symbols(codes, *arrays.utf8(chunk.column("text")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times); a word can come in several rows."""
    kept: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        names, times = list(kept), list(kept.values())
        for i in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 100_000], pa.binary()), pa.array(times[i : i + 100_000], pa.int64())], names=["word", "times"])
        kept.clear()

    for chunk in arrays.chunks(batches):
        for text in chunk.column("text").to_pylist():
            kept.update((text or "").encode().lower().split())
        if len(kept) > 500_000:
            yield from flush()
    yield from flush()


def _codes(words: DataFrame, vocabulary: int, ends: int, total: int) -> Codes:
    """Codes from words(word, c): the most frequent ones, all of a count or none, at most `vocabulary` of them."""
    step = F.floor(F.log2("c") * 16)
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()  # at most 16 rows for each doubling of a count
    least, size = None, 0
    for row in steps:
        size += row.n
        if size > vocabulary:
            break
        least = row.step
    got = words.where(step >= least).where(F.octet_length("word") <= WORD_BYTES).toArrow() if least is not None else None
    names = got.column("word").combine_chunks() if got is not None and got.num_rows else pa.array([], pa.binary())
    counts = got.column("c").to_numpy() if len(names) else np.zeros(0, np.int64)
    raw = names.to_pylist()
    long = np.fromiter(map(len, raw), np.int64, len(raw))
    stop = np.cumsum(long)
    data = np.frombuffer(b"".join(raw), np.uint8)
    letters = np.bincount(data, minlength=257).astype(np.int64) + 1
    letters[256] += len(raw)
    return Codes(arrays.word_hashes(data, stop - long, stop), counts, total - int(counts.sum()), ends, letters)


def _count(shared, slot_bits: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = Predictors(slot_bits)
        salt = 0
        for chunk, symbols in _chunks(batches, shared.value):
            into.add(symbols)
            salt += chunk.column("text").nbytes
        yield from _blobs(enumerate(into.counts.reshape(-1, BLOB)), salt % SALTS)

    return run


def _blobs(parts: Iterator[tuple[int, np.ndarray]], salt: int) -> Iterator[pa.RecordBatch]:
    for place, counts in parts:
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([salt], pa.int32()), pa.array([pa.compress(counts.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["place", "salt", "blob"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blobs of each (place, salt); rows come in that order."""
    key, total = None, None
    for batch in batches:
        for place, salt, blob in zip(*(batch.column(c).to_pylist() for c in ("place", "salt", "blob")), strict=True):
            got = np.frombuffer(pa.decompress(blob, decompressed_size=4 * BLOB, codec="zstd", asbytes=True), np.uint32)
            if (place, salt) == key:
                total = total + got
            else:
                if key:
                    yield from _blobs([(key[0], total)], key[1])
                key, total = (place, salt), got
    if key:
        yield from _blobs([(key[0], total)], key[1])


def count_bits(docs: DataFrame, codes: Codes, slot_bits: tuple[int, ...], n_tasks: int) -> np.ndarray:
    """Zeros and ones of every slot over all docs(text)."""
    schema = "place int, salt int, blob binary"
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    parts = docs.coalesce(n_tasks).select("text").mapInArrow(_count(shared, slot_bits), schema)
    parts = parts.repartition("place", "salt").sortWithinPartitions("place", "salt").mapInArrow(_add_up, schema).withColumn("salt", F.lit(0))
    rows = parts.repartition("place").sortWithinPartitions("place", "salt").mapInArrow(_add_up, schema).select("place", "blob").toArrow()  # all slots once
    out = np.zeros(2 * sum(1 << b for b in slot_bits), np.uint32)
    cells = out.reshape(-1, BLOB)
    for place, blob in zip(rows.column("place").to_pylist(), rows.column("blob").to_pylist(), strict=True):
        cells[place] = np.frombuffer(pa.decompress(blob, decompressed_size=4 * BLOB, codec="zstd", asbytes=True), np.uint32)
    return out


def _first_weights(shared, slot_bits: tuple[int, ...]):
    def run(part: pa.Table) -> pa.Table:
        codes, table = shared.value
        mixer = Mixer()
        for _, symbols in _chunks(iter(part.sort_by([("at", "ascending"), ("text", "ascending")]).combine_chunks().to_batches()), codes):
            mixer.learn(symbols, table, slot_bits)
        return pa.table([pa.array([mixer.seen]), pa.array([mixer.weights.ravel()]), pa.array([mixer.map.ravel()])], names=["seen", "weights", "map"])

    return run


def train_mixer(docs: DataFrame, shared, slot_bits: tuple[int, ...]) -> Mixer:
    """The mean, by their bits, of the mixers that parts of docs(doc_id, text) teach. Parts and orders go by hashes of the rows, the mean is exact, so partitions don't matter. Every row teaches, equal ones too."""
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("at"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(PARTS, -(-int(size) // PART_BYTES))
    row = rows.groupBy(F.pmod("at", F.lit(parts)).alias("part")).applyInArrow(_first_weights(shared, slot_bits), "seen bigint, weights array<float>, map array<float>")
    weighed = F.sum((F.col("x").cast("double") * F.col("seen")).cast("decimal(28,6)")).cast("double") / F.sum("seen")
    flat = row.where("seen > 0").select(F.posexplode(F.concat("weights", "map")).alias("i", "x"), "seen").groupBy("i").agg(weighed.alias("x")).orderBy("i").toPandas().x.to_numpy()
    out = Mixer()
    if len(flat):
        out.weights = flat[: ORDERS * _GATES].reshape(ORDERS, _GATES).astype(np.float32)
        out.map = flat[ORDERS * _GATES :].reshape(_GATES, _STEPS).astype(np.float32)
    return out


def _scorer(shared, mixer: Mixer, slot_bits: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table = shared.value
        base = np.log10(codes.counts + 0.5)
        for chunk, symbols in _chunks(batches, codes):
            total, many = symbols.known(base)
            n_bytes = np.diff(arrays.utf8(chunk.column("text"))[1])
            columns = [pa.array(x) for x in (symbols.size.astype(np.int64), many.astype(np.int64), total, mixer.log2(symbols, table, slot_bits), n_bytes)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("held_out"), *columns, symbols.others()], names=["doc_id", "held_out", "n_tokens", "many", "total", "lp", "n_bytes", "others"])

    return run


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, many bigint, total double, lp double, n_bytes bigint, others array<binary>"


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """The op4 rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; and bits_per_byte."""
    spark = docs.sparkSession
    left = F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 5)")
    docs = docs.select("doc_id", "text", F.coalesce(left == 1, F.lit(False)).alias("held_out"), F.coalesce(left != 1, F.lit(False)).alias("learned"))
    totals = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.sum(F.col("learned").cast("long")).alias("ends")).first()
    ends, learned = int(totals.ends or 0), docs.where("learned")
    known = staged(learned.select("text").mapInArrow(_word_counts, "word binary, times bigint").groupBy("word").agg(F.sum("times").alias("c")))
    row = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(row.n) + ends, int(row.v) + (ends > 0)

    codes = _codes(known, vocabulary, ends, int(row.n))
    most = min(TABLE_BITS, max(14, n.bit_length()))
    slot_bits = (min(19, most), most, most)
    counts = count_bits(learned, codes, slot_bits, max(spark.sparkContext.defaultParallelism, -(-int(totals.bytes) // TABLE_BYTES)))
    shared = spark.sparkContext.broadcast((codes, packed(counts)))
    del counts
    scorer = _scorer(shared, train_mixer(learned, shared, slot_bits), slot_bits)

    # words beyond the vocabulary meet their counts; a row number stands for the document
    scored = staged(docs.select("doc_id", "held_out", "text").mapInArrow(scorer, _SCORED).withColumn("row", F.monotonically_increasing_id()))
    words = scored.select("row", F.explode("others").alias("word")).join(known, "word")
    rare = words.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5) - float(np.log10(0.5))).alias("more"), F.count("*").alias("also"))
    more, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0).cast("bigint"))
    unknown = (F.col("n_tokens") - 1 - F.col("many")) * float(np.log10(0.5))
    base = F.col("total") + unknown + more + float(np.log10(ends + 0.5)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    return scored.drop("others").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("many") + also + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("lp") * float(np.log10(2))).alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("lp") / F.col("n_bytes")).alias("bits_per_byte"),
    )
