"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, of which near copies differ in at most `radius`. It is seen as a ring of radius + shared segments. At most `radius` of them
can differ, so two near fingerprints agree in at least `shared` whole segments: choices of so many segments are the index (for radius 3 and two segments, ten
tables of about 26 bits). Within a bucket, pairs are pruned by the pigeonring condition before the full Hamming check: from some segment on, each
chain of 1, 2, ... consecutive segments, up to half the ring, must keep its summed difference within its proportional part of the radius. Every near pair meets it.

Equal fingerprints are one node from the start. Buckets of one fingerprint are dropped; larger ones are dealt in blocks of `BLOCK`
fingerprints, and each pair of blocks is a group of its own, so no task holds more than two blocks of a bucket. A group compares in
numpy and returns no pairs but a forest of links that connects the same fingerprints, so results grow with the members. Components
follow by checkpointed star steps over all links.

`deduplicate()` works on texts. Fingerprints of their sets of words are the index (those of shingles are too far apart for texts that share four fifths of their
five-word shingles). In a group, a text's candidates are the texts of a smaller doc_id within the radius, with as many shingles as the similarity asks
for, and with fingerprints of shingle sets within `SHINGLE_RADIUS`, nearest first; a pair counts in the first bucket alone that it shares. A pair counts if the sets of five-word
shingles have a Jaccard similarity of at least 0.8, computed exactly from the whole texts. All candidates are verified in the end. Each bucket goes through one shuffle, in blocks that are compared with
themselves and give each text's `FIRST` nearest (`FEW` if the nearest is as good as a match); these are verified nearest first, until a match is found. Only texts without a match that have more behind those, or stand in a bucket
of several blocks, go on in rounds through the index: they alone visit the other blocks, so a large group of copies makes no pairs of blocks. In those rounds rows carry sketches (how many shingles fall in each of some parts), and a pair whose
sketches differ in more shingles than the similarity allows leaves no row: texts that are merely alike aren't verified by the square of their number.

Defined results: null, empty or blank texts have fingerprint zero and link with what is within the radius of it; repeated rows get a row
each, with their doc_id's smallest reachable id; null doc_ids get a fingerprint and the component of the others that reach them (null
if none do); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .graph import components
from .store import cut, staged

RADIUS, SHINGLE, SEED = 3, 3, 42
#: deduplicate(): bits that fingerprints of word sets may differ in, words of a shingle, and least Jaccard similarity.
WORD_RADIUS, WORDS, SIMILARITY = 8, 5, 0.8
#: Bits that fingerprints of shingle sets of similarity 0.8 may differ in: 10 on average, 3 standard deviation (12 and 3 in sets of five); unlike sets differ in 32, 4.
SHINGLE_RADIUS = 24
BLOCK = 2048
#: The same where all near pairs of a group are ranked.
RANKED_BLOCK = 1024
#: By what the candidates of a text grow from round to round.
GROWTH = 8
#: Candidates of a text in its own block that are verified without another round, and those where shingle fingerprints of the nearest differ in `LIKELY` bits at most.
FIRST, FEW, LIKELY = 5, 3, 4
#: Shingles to a part of a sketch, about.
PART = 4
#: Bytes of text whose word and shingle hashes are laid out at once.
CHUNK = 1 << 18
#: Rows of (doc_id, list of text hashes) that are broadcast at most, about 50 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def ring(radius: int, shared: int) -> list[tuple[int, int]]:
    """First bit and width of each of radius + shared segments."""
    cuts = [64 * i // (radius + shared) for i in range(radius + shared + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= n:
        return np.array([digest(text, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-n])).tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    return np.fromiter([digest(text[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(stops))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half the shingles' hashes."""
    hashes = _shingle_hashes((text or "").encode().lower().split(), shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def chain_viable(x: np.ndarray, radius: int, segments: list[tuple[int, int]]) -> np.ndarray:
    """Pigeonring: some segment starts a chain of up to half the ring whose every prefix of l segments differs in at most l * radius / m bits."""
    m = len(segments)
    d = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << w) - 1)) for a, w in segments]).astype(np.int64)
    out = np.zeros(len(x), bool)
    for i in range(m):
        total, fine = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for length in range(1, (m + 1) // 2 + 1):
            total = total + d[(i + length - 1) % m]
            fine &= total * m <= length * radius
        out |= fine
    return out


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """A label for each of n places: the least place that the links reach."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[new])
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
        live = label[left] != label[right]
        left, right = left[live], right[live]
    return label


def _near_pairs(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, segments: list[tuple[int, int]], size: np.ndarray | None = None, similarity: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of near fingerprints within each run of equal `group`. side: 0 or 1 are blocks to compare with each other, 2 a block with itself.

    size: sizes, rising within a run; pairs of sets that can't be similar for their sizes are passed over.
    """
    n = len(fp)
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, shift = np.arange(n), 1
    last = np.concatenate((np.flatnonzero(group[1:] != group[:-1]), [n - 1]))
    run = np.searchsorted(last, at)
    stop = last[run]
    if size is not None and n:
        width = int(size.max()) + 1
        most = np.minimum(np.floor(size / similarity + 1e-9).astype(np.int64), width - 1)
        stop = np.searchsorted(run * width + size, run * width + most, "right") - 1
    while True:
        at = at[at + shift <= stop[at]]
        if not len(at):
            break
        pair = at[(side[at] == 2) | (side[at] != side[at + shift])]
        x = fp[pair] ^ fp[pair + shift]
        if size is None:
            fine = chain_viable(x, radius, segments)
            fine[fine] = np.bitwise_count(x[fine]) <= radius
        else:  # all bits at once are one step for each pair, where chains take a hundred
            fine = np.bitwise_count(x) <= radius
        pair = pair[fine]
        lefts.append(pair)
        rights.append(pair + shift)
        shift += 1
    return np.concatenate(lefts), np.concatenate(rights)


def _linked(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """Rows (id, id) that connect what the pairs link."""
    ids = rows["id"]
    label = _forest(left, right, len(ids))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return [ids[moved], ids[label[moved]]]


def _ranked(start: int, stop: int, few: int, similarity: float, segments: list[tuple[int, int]], shared: int):
    """Rows (id, smaller id, rank, beyond): candidates of each live id from rank `start` to below `stop` by distance of shingles, `few` if the nearest is likely a match.

    beyond: more stand behind these. A row of the id with itself at rank -1, where rows tell (many): its bucket has other blocks.
    """
    masks = np.array([sum(1 << i for i in c) for c in combinations(range(len(segments)), shared)], np.int64)

    def choose(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        turned = rows["id"][left] > rows["id"][right]
        left, right = np.where(turned, right, left), np.where(turned, left, right)
        x, y = rows["size"][left], rows["size"][right]
        far = np.bitwise_count((rows["shingle_fp"][left] ^ rows["shingle_fp"][right]).view(np.uint64))  # of signed numbers it counts the bits of the absolute value
        fine = (rows["live"][right] > 0) & (far <= SHINGLE_RADIUS) & (np.minimum(x, y) >= similarity * np.maximum(x, y))
        left, right, far = left[fine], right[fine], far[fine]
        differ = (rows["fp"][left] ^ rows["fp"][right]).view(np.uint64)
        common, seen = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for i, (a, w) in enumerate(segments):
            same = ((differ >> np.uint64(a)) & np.uint64((1 << w) - 1) == 0) & (seen < shared)
            common += same.astype(np.int64) << i
            seen += same
        first = common == masks[rows["t"][right]]
        left, right, far = left[first], right[first], far[first]
        if "sketch" in rows:
            fine = _possible(rows["sketch"], rows["size"], left, right, similarity)
            left, right, far = left[fine], right[fine], far[fine]
        order = np.lexsort((rows["id"][left], far, right))
        left, right, far = left[order], right[order], far[order]
        new = np.ones(len(right), bool)
        new[1:] = right[1:] != right[:-1]
        nearest = np.maximum.accumulate(np.where(new, np.arange(len(right)), 0))
        rank = np.arange(len(right)) - nearest
        end = np.where(far[nearest] <= LIKELY, few, stop)
        out = (rank >= start) & (rank <= end)
        many = np.flatnonzero((rows["many"] > 0) & (rows["live"] > 0)) if start == 0 and few < stop else np.zeros(0, np.int64)
        ids = rows["id"]
        return [
            np.concatenate((ids[right[out]], ids[many])), np.concatenate((ids[left[out]], ids[many])), np.concatenate((rank[out], np.full(len(many), -1))), np.concatenate(((rank == end)[out], np.ones(len(many), bool))),
        ]

    return choose


def _compare(radius: int, segments: list[tuple[int, int]], columns: list[str], names: list[str], choose, similarity: float = 0):
    """similarity: rows have sizes, which rise within a unit."""
    numbers, sketched = [c for c in columns if c != "sketch"], "sketch" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sketches: list[bytes] = []
        size = 0

        def emit(table: np.ndarray, sketches: list[bytes]) -> pa.RecordBatch:
            rows = dict(zip(numbers, np.ascontiguousarray(table.T), strict=True))
            if "marks" in rows:
                rows |= {"t": rows["marks"] >> 4, "many": rows["marks"] >> 3 & 1, "live": rows["marks"] >> 2 & 1, "side": rows["marks"] & 3}
            if sketched:
                rows["sketch"] = sketches
            out = choose(rows, *_near_pairs(rows["unit"], rows["fp"].view(np.uint64), rows["side"], radius, segments, rows["size"] if similarity else None, similarity))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(c).to_numpy() for c in numbers]).astype(np.int64)
            held.append(rows)
            if sketched:
                sketches += batch.column("sketch").to_pylist()
            size += len(rows)
            if size >= 4 * BLOCK:
                rows = np.concatenate(held)
                cut_at = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last group may go on
                if cut_at:
                    yield emit(rows[:cut_at], sketches[:cut_at])
                held, sketches, size = [rows[cut_at:].copy()], sketches[cut_at:], len(rows) - cut_at
        if size:
            yield emit(np.concatenate(held), sketches)

    return run


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of 2**k parts, 255 at most; about PART a part."""
    parts = 1 << max(6, (len(shingles) // PART).bit_length())
    return np.minimum(np.bincount((shingles & np.uint64(parts - 1)).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def _possible(sketches: list[bytes], size: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of each pair can be similar: they differ in as many shingles at least as the counts of their parts do. No similar pair fails."""
    fine, parts = np.ones(len(left), bool), np.fromiter(map(len, sketches), np.int64, len(sketches))
    least = np.minimum(parts[left], parts[right])
    for n in np.unique(least).tolist():
        at = np.flatnonzero(least == n)
        used, place = np.unique(np.concatenate((left[at], right[at])), return_inverse=True)
        # parts of the finer one are added up
        table = np.stack([np.minimum(np.frombuffer(sketches[u], np.uint8).reshape(-1, n).sum(axis=0, dtype=np.int32), 255) for u in used.tolist()]).astype(np.int16)
        x, y = place[: len(at)], place[len(at) :]
        for a in range(0, len(at), step := max(1, (1 << 20) // n)):
            i, j = x[a : a + step], y[a : a + step]
            both = size[used[i]] + size[used[j]]
            fine[at[a : a + step]] = (both - np.abs(table[i] - table[j]).sum(axis=1, dtype=np.int64)) / 2 >= similarity * both / (1 + similarity) - 1e-6
    return fine


def _keyed(nodes: DataFrame, radius: int, shared: int) -> DataFrame:
    """A row of nodes(fp, ...) for each choice of `shared` segments: key tells them and their number (modulo the choices)."""
    keys, choices = [], list(combinations(ring(radius, shared), shared))
    for t, chosen in enumerate(choices):
        part = F.lit(0).cast("bigint")
        for a, w in chosen:
            part = part * (1 << w) + F.shiftrightunsigned("fp", a).bitwiseAND((1 << w) - 1)
        keys.append(part * len(choices) + t)
    return nodes.select(F.explode(F.array(*keys)).alias("key"), *nodes.columns)


def _met(nodes: DataFrame, radius: int, shared: int, block: int, choose, schema: str = "a bigint, b bigint") -> DataFrame:
    """(a, b, ...): what `choose` makes of the near pairs among nodes(fp, id, ...), group by group."""
    segments, table = ring(radius, shared), _keyed(nodes, radius, shared)
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    table = table.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    units = table.select("key", *nodes.columns, "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        *nodes.columns,
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("bigint").alias("side"),
    )
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in schema.split(", ")]
    return units.repartition(n, "unit").sortWithinPartitions("unit", "id").mapInArrow(_compare(radius, segments, units.columns, names, choose), schema)


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, shared: int = 2) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all those within the radius of each other."""
    return _met(distinct.select("fp", F.col("fp").alias("id")), radius, shared, block, _linked)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The op6 rows: doc_id, fingerprint, component_id."""
    fps = cut(fingerprints(docs, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(nodes.select("fp"), radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    nodes = nodes.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = nodes.join(roots, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a chunk, and each text's first."""
    data = arrays.lower_ascii(data)
    starts, ends, first = arrays.word_bounds(data, offsets, arrays.SPACE)
    return arrays.word_hashes(data, starts, ends), first


def _set_fingerprint(hashes: np.ndarray) -> int:
    """As fingerprint(), of a set of hashes, each counted once."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _text_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's sequence of words."""
    return arrays.spans_hash(arrays.window_prefix(words), first[:-1], first[1:], arrays._STEP).view(np.int64)


def _shingles(prefix, a: int, b: int, size: int) -> np.ndarray:
    """The set of hashes of the shingles of words a to b; fewer words than `size` are one shingle."""
    k = min(size, b - a)
    return _distinct(arrays.window_hash(prefix, np.arange(a, b - k + 1), k)) if k else np.zeros(0, np.uint64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """As np.unique, which takes longer on arrays as short as these."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _signatures(size: int, sketched: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches, size=CHUNK):
            words, first = _words(*arrays.utf8(chunk.column("text")))
            prefix, signs, sketches = arrays.window_prefix(words), [], []
            grams = arrays.window_hash(prefix, np.arange(max(0, len(words) - size + 1)), size)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                shingles = _distinct(grams[a : b - size + 1]) if b - a >= size else _shingles(prefix, a, b, size)
                signs.append((_set_fingerprint(_distinct(words[a:b])), _set_fingerprint(shingles), len(shingles)))
                if sketched:
                    sketches.append(_sketch(shingles))
            columns = [pa.array(x, pa.int64()) for x in (zip(*signs, strict=True) if signs else [()] * 3)] + [pa.array(sketches, pa.binary())] * sketched
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(_text_hashes(words, first)), *columns], names=["doc_id", "tid", "fp", "shingle_fp", "size", *["sketch"] * sketched])

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches, size=CHUNK):
            words, first = _words(*arrays.utf8(chunk.column("text")))
            tids, prefix = _text_hashes(words, first), arrays.window_prefix(words)
            keep, sets = [], []
            for i, wanted in enumerate(chunk.column("tids").to_pylist()):
                if int(tids[i]) in wanted:
                    keep.append(i)
                    sets.append(_shingles(prefix, int(first[i]), int(first[i + 1]), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(tids[keep]), pa.array(sets, pa.list_(pa.int64()))], names=["tid", "shingles"])

    return run


def _with(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined with rows(doc_id, ...) by a broadcast of few rows, or by a shuffle of many."""
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "doc_id", how)


def _fresh(docs: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _few(df: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast to joins while it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): the shingle sets of the texts of pairs(a, b)."""
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(nodes, "id").select(F.col("id").alias("doc_id"), F.array("tid").alias("tids")))
    sets = _with(docs.select("doc_id", "text"), wanted, "inner").select("text", "tids").mapInArrow(_shingle_sets(shingle), "tid bigint, shingles array<bigint>").dropDuplicates(["tid"])
    return staged(sets.join(nodes.select("id", "tid"), "tid").select("id", "shingles"))


def _sifted(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b, rank) whose sketches allow the similarity: a small part of those whose sets would be moved to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size = np.concatenate([batch.column(c).to_numpy() for c in ("m", "n")])
            fine = _possible(batch.column("x").to_pylist() + batch.column("y").to_pylist(), size, np.arange(n), np.arange(n, 2 * n), similarity)
            yield batch.select(["a", "b", "rank"]).filter(pa.array(fine))

    left, right = nodes.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("m")), nodes.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("n"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a bigint, b bigint, rank bigint")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(id): the ids a of pairs(a, b) whose texts have a Jaccard similarity of at least `similarity`."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").where(common >= similarity * (F.size("x") + F.size("y") - common))
    return both.select(F.col("a").alias("id")).distinct()


def _candidates(nodes: DataFrame, live: DataFrame | None, big: DataFrame, radius: int, shared: int, start: int, stop: int, similarity: float) -> DataFrame:
    """(a, b, rank, beyond) of live(id), or of all in their own blocks. big: (key, blocks) of buckets of several blocks."""
    table, segments = _keyed(nodes, radius, shared), ring(radius, shared)
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    unit = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "block"))
    if live is None:
        table = table.withColumn("live", F.lit(1).cast("bigint"))
    else:
        marked = nodes.join(_few(live.withColumn("mark", F.lit(1).cast("bigint"))), "id", "left").select(*nodes.columns, F.coalesce("mark", F.lit(0).cast("bigint")).alias("live"))
        asked = cut(_keyed(marked.where("live > 0").select("fp"), radius, shared).distinct().select("key").distinct())
        table = _keyed(marked, radius, shared).join(_few(asked), "key", "left_semi")
    table = table.join(_few(big), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))) if not big.isEmpty() else table.withColumn("blocks", F.lit(1).cast("bigint"))
    units = table.withColumn("block", own).withColumn("side", F.lit(2).cast("bigint"))
    if live is not None and not big.isEmpty():
        # of a bucket of several blocks, live rows visit the other ones
        visits = units.where("live > 0 and blocks > 1").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("other <> block")
        units = units.union(visits.withColumn("block", F.col("other")).withColumn("side", F.lit(0).cast("bigint")).drop("other"))
    tables = len(list(combinations(segments, shared)))
    marks = F.pmod("key", F.lit(tables)) * 16 + F.when(F.col("blocks") > 1, 8).otherwise(0) + F.col("live") * 4 + F.col("side")
    units = units.select(unit.alias("unit"), *nodes.columns, marks.alias("marks"))
    choose = _ranked(start, stop, FEW if live is None else stop, similarity, segments, shared)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "a bigint, b bigint, rank bigint, beyond boolean"
    return units.repartition(n, "unit").sortWithinPartitions("unit", "size").mapInArrow(_compare(radius, segments, units.columns, ["a", "b", "rank", "beyond"], choose, similarity), schema)


def near_texts(docs: DataFrame, signed: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, radius: int = WORD_RADIUS, block: int = RANKED_BLOCK) -> DataFrame:
    """(tid): hashes of texts that are near copies of a text of a smaller least doc_id. signed: (doc_id, tid, fp, shingle_fp, size) of docs, and sketch, where later rounds are to use them."""
    sketch = [c for c in signed.columns if c == "sketch"]
    texts = signed.groupBy("tid", "fp", "shingle_fp", "size").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in sketch]).where("least is not null")
    nodes = cut(texts.groupBy("least").agg(F.min(F.struct("tid", "fp", "shingle_fp", "size", *sketch)).alias("t")).select(F.col("least").alias("id"), "t.*"))
    n = nodes.count()
    # more segments in common make longer keys and more tables; all pairs within the radius have them, so the candidates don't depend on it
    shared = next((k for k in (2, 3) if n <= BLOCK * 2 ** (64 * k // (radius + k))), 4)
    entries, found = nodes.select("fp", "id", "shingle_fp", "size"), nodes.select("id").where("false")
    sizes = _keyed(nodes.select("fp"), radius, shared).groupBy("key").agg(F.count("*").alias("n"))
    big = cut(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).alias("blocks")))
    sketched = nodes.select("fp", "id", "shingle_fp", "size", *sketch)
    live, start, stop = None, 0, FIRST
    for turn in count():
        met = staged(_candidates(entries if live is None else sketched, live, big, radius, shared, start, stop, similarity))
        pairs = met.where("not beyond").groupBy("a", "b").agg(F.min("rank").alias("rank"))
        pairs = cut(_sifted(pairs, nodes, similarity) if sketch and live is None else pairs)
        if not pairs.isEmpty():
            sets, low = _sets(docs, nodes, pairs, shingle), 0
            for high in (1, stop) if live is None else (stop,):
                step = cut(pairs.where((F.col("rank") >= low) & (F.col("rank") < high)).select("a", "b").join(found.select(F.col("id").alias("a")), "a", "left_anti"))
                if not step.isEmpty():
                    found = cut(found.union(_similar(step, sets, similarity)))
                low = high
        live = cut(met.where("beyond").select(F.col("a").alias("id")).distinct().join(found, "id", "left_anti"))
        if live.isEmpty():
            return nodes.join(found, "id", "left_semi").select("tid").distinct()
        # the second round takes in the other blocks
        start, stop = stop if turn else 0, GROWTH * stop


def deduplicate(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, radius: int = WORD_RADIUS) -> DataFrame:
    """docs without near copies: of each group of texts whose sets of five-word shingles are similar, that of the smallest doc_id stays.

    Texts of the same lower-cased words are copies, empty ones too; of those and of equal rows under one id, one stays. An id that comes with several texts
    stands for the one of the least hash in the search for near copies. Rows with a null id stay, unless a text of an id is the same.
    """
    signed = cut(docs.select("doc_id", "text").mapInArrow(_signatures(shingle, True), "doc_id bigint, tid bigint, fp bigint, shingle_fp bigint, size bigint, sketch binary"))
    near = near_texts(docs, signed, shingle, similarity, radius)
    named = signed.where("doc_id is not null").select("doc_id", "tid")
    stay = named.groupBy("tid").agg(F.min("doc_id").alias("doc_id")).join(near, "tid", "left_anti").withColumn("stays", F.lit(True))
    # joined by id as well, so that copies of one text don't meet in one task
    judged = named.join(stay, ["doc_id", "tid"], "left")
    name = _fresh(docs, "_stays")
    # ids whose rows all go, or that come more than once: the texts that stay
    marks = cut(judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("stays"), F.col("tid"))).alias(name)).where(f"n > 1 or size({name}) = 0").select("doc_id", name))
    marked = _with(docs, marks, "left").select(*[F.col(f"`{c}`") for c in docs.columns], name)
    single = marked.where(F.col(name).isNull()).drop(name)
    if marks.where(F.size(name) > 0).isEmpty():  # no id comes twice: one pass over the documents will do
        return single
    tid = _fresh(docs, "_tid")
    schema = marked.drop(name).schema.add(tid, "long")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches, size=CHUNK):
            tids = _text_hashes(*_words(*arrays.utf8(chunk.column("text"))))
            keep = [t in stays for t, stays in zip(tids.tolist(), chunk.column(name).to_pylist(), strict=True)]
            rows = chunk.drop_columns([name])
            yield rows.append_column(tid, pa.array(tids)).filter(pa.array(keep, pa.bool_()))

    repeated = marked.where(F.size(name) > 0).mapInArrow(chosen, schema).dropDuplicates(["doc_id", tid]).drop(tid)
    return single.unionByName(repeated)
