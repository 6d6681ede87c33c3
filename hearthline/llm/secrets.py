"""Secret scans: fixed patterns, and a log-likelihood ratio of two character Markov models.

Fixed patterns find assignments, access keys and hexadecimal runs. Beyond them, every run of `[A-Za-z0-9+/_=-]` of `MIN_RUN` or more characters
is scored whole by two order-2 character Markov models, of random strings and of ordinary identifiers; runs whose log-likelihood ratio passes a
length-normalised and a total threshold are spans of kind `random`, unless one base span holds all of the run; such a span may overlap base spans. The models learn from labelled samples: the values that the
fixed patterns find are random strings, as are seeded strings over common alphabets; other runs of 8 or more characters that seldom change between cases and digits
are ordinary, as are seeded identifiers of common words. The
sample is bounded (`SAMPLE` documents by hash); its transition counts are summed per task, so the driver sees at most two tables of 65**3 counts.

Defined results: null is empty; spans are code points, end exclusive; repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Bound of the labelled sample, in documents.
SAMPLE = 4000
MIN_RUN, MIN_LABELLED = 16, 8
#: A run is a secret from so many nats in all and for each character.
MIN_TOTAL, MIN_EACH = 8.0, 0.4
KINDS = ("assign", "access", "hex", "random")
MARK = "[REDACTED]"

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = arrays.table_of((0x30, 0x39), (0x61, 0x66))
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[np.frombuffer(_ALPHABET, np.uint8)] = np.arange(1, len(_ALPHABET) + 1)
_SIZE = len(_ALPHABET) + 1  # 0 stands before the first character
_RUN = _SYMBOL > 0
#: Kind of each symbol: the start, capitals, small letters, digits, others.
_KIND = np.array([0] + [1] * 26 + [2] * 26 + [3] * 10 + [4] * 5)
_SYNTHETIC = 600


def _hex_runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = arrays.word_bounds(data, offsets, ~table)
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of assignments and access keys in one text."""
    found = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    return found


def _scan(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int]]]]:
    """Per document its base spans, and the runs of at least `least` characters, whole, whether base spans touch them or not; bytes from the document's start."""
    base = [base_spans(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    starts, ends = _hex_runs(data, offsets, _HEX, 16)
    docs = np.searchsorted(offsets, starts, "right") - 1
    for d, a, b in zip(docs.tolist(), (starts - offsets[docs]).tolist(), (ends - offsets[docs]).tolist(), strict=True):
        base[d].append((a, 2, b))
    starts, ends = _hex_runs(data, offsets, _RUN, least)
    docs = np.searchsorted(offsets, starts, "right") - 1
    other: list[list[tuple[int, int]]] = [[] for _ in base]
    for d, a, b in zip(docs.tolist(), (starts - offsets[docs]).tolist(), (ends - offsets[docs]).tolist(), strict=True):
        other[d].append((a, b))
    return base, other


def _touched(spans: list[tuple[int, int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, _, y in spans)


def _transitions(codes: np.ndarray) -> np.ndarray:
    """Numbers of the order-2 transitions of one string."""
    s = _SYMBOL[codes]
    p1, p2 = np.concatenate(([0], s[:-1])), np.concatenate(([0, 0], s[:-2]))[: len(s)]
    return (p2 * _SIZE + p1) * _SIZE + s


def _seeded() -> list[bytes]:
    """Random strings over common alphabets."""
    r = random.Random(11)
    sets = [b"0123456789abcdef", b"0123456789ABCDEF", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[26:62], _ALPHABET[:26] + _ALPHABET[52:62]]
    return [bytes(r.choice(a) for _ in range(r.randint(16, 64))) for a in sets for _ in range(_SYNTHETIC)]


def _ordinary(codes: np.ndarray) -> bool:
    """Few changes between lower case, upper case and digits, a capital before small letters aside: a label for the sample, not a verdict."""
    kind = np.where(codes >= 97, 0, np.where(codes >= 65, 1, np.where(codes >= 48, 2, 3)))
    changes = (kind[1:] != kind[:-1]) & ~((kind[:-1] == 1) & (kind[1:] == 0))
    return int(changes.sum()) * 5 <= len(codes)


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The log-likelihood ratio of each transition, a table of 66**3 numbers, from a bounded sample of documents."""
    order = F.xxhash64("doc_id", F.lit(3))
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(order, "doc_id").limit(sample).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _SIZE**3), np.int64)
        for chunk in arrays.chunks(batches):
            data, offsets = arrays.utf8(chunk.column("text"))
            base, other = _scan(data, offsets, MIN_LABELLED)
            for d, (found, runs) in enumerate(zip(base, other, strict=True)):
                text = data[offsets[d] : offsets[d + 1]]
                for a, kind, b in found:
                    raw = text[a:b]
                    if kind == 0:
                        raw = np.frombuffer(_ASSIGN.match(raw.tobytes())[2], np.uint8)
                    np.add.at(counts[1], _transitions(raw[_RUN[raw]]), 1)
                for a, b in runs:
                    if _ordinary(text[a:b]) and not _touched(found, a, b):
                        np.add.at(counts[0], _transitions(text[a:b]), 1)
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(counts[kind, at])], names=["kind", "at", "n"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "kind bigint, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, _SIZE**3))
    counts[rows.kind.to_numpy(np.int64), rows["at"].to_numpy(np.int64)] = rows.n.to_numpy(float)
    for raw in _seeded():
        np.add.at(counts[1], _transitions(np.frombuffer(raw, np.uint8)), 1)
    for raw in _seeded_plain():
        np.add.at(counts[0], _transitions(np.frombuffer(raw, np.uint8)), 1)
    plain, rand = (_smoothed(c.reshape(_SIZE, _SIZE, _SIZE)) for c in counts)
    return np.log(rand / plain).ravel().astype(np.float32)


#: Words of seeded ordinary identifiers.
_PARTS = (
    "get set make build read write load store user name value item list table index count total first last next price area room street city state source target config option default "
    "request response server client session handler manager factory builder parser reader writer buffer stream string number length width height color image button window service account"
).split()


def _seeded_plain() -> list[bytes]:
    """Identifiers of two to four common words, in snake, kebab and camel case."""
    r = random.Random(12)
    out = []
    for _ in range(5 * _SYNTHETIC):
        words = [r.choice(_PARTS) for _ in range(r.randint(2, 4))]
        style = r.randrange(4)
        camel = words[0] + "".join(w.capitalize() for w in words[1:])
        out.append(("_".join(words), "-".join(words), camel, "_".join(words).upper())[style].encode())
    return out


def _smoothed(c: np.ndarray) -> np.ndarray:
    """Interpolated order-2 probabilities: each order's counts plus a weight of what lies below, down to the kinds of characters (so that unseen words in known styles are likely)."""
    kinds = np.eye(_KIND.max() + 1)[_KIND]  # symbol -> kind
    letter = (c.sum(axis=(0, 1)) + 1) / (kinds @ (kinds.T @ (c.sum(axis=(0, 1)) + 1)))  # of its kind
    pairs = np.einsum("abc,ax,by,cz->xyz", c, kinds, kinds, kinds, optimize=True) + 0.5
    styled = (pairs / pairs.sum(axis=2, keepdims=True))[_KIND[:, None], _KIND[None, :]][:, :, _KIND] * letter
    one = (c.sum(axis=0) + 5 * np.einsum("xbc,x->bc", styled, kinds.sum(axis=1) / len(kinds))) / (c.sum(axis=(0, 2))[:, None] + 5)
    return (c + 5 * (one[None] + styled) / 2) / (c.sum(axis=2)[:, :, None] + 5)


def _found(ratio: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per document all spans (start, kind, end) in bytes, in order."""
    base, other = _scan(data, offsets, MIN_RUN)
    for d, runs in enumerate(other):
        text = data[offsets[d] : offsets[d + 1]]
        for a, b in runs:
            score = float(ratio[_transitions(text[a:b])].sum())
            if score >= MIN_TOTAL and score >= MIN_EACH * (b - a) and not any(x <= a and b <= y for x, _, y in base[d]):
                base[d].append((a, 3, b))
    return [sorted(x) for x in base]


def _code_points(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80))).tolist()
    return [(place[a], k, place[b]) for a, k, b in spans]


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for chunk in arrays.chunks(batches):
            data, offsets = arrays.utf8(chunk.column("text"))
            rows = [_code_points(data[offsets[d] : offsets[d + 1]], x) if x else [] for d, x in enumerate(_found(shared.value, data, offsets))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in rows], kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def find_secrets(docs: DataFrame) -> DataFrame:
    """The op1 rows: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spans = scan(docs, train(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every span (overlapping ones united) replaced by a mark, and n_chars, where it exists and text changed, counted anew. All rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            data, offsets = arrays.utf8(chunk.column("text"))
            found = _found(shared.value, data, offsets)
            if any(found):
                texts, sizes = chunk.column("text").to_pylist(), chunk.column("n_chars").to_pylist() if "n_chars" in names else None
                for d, spans in enumerate(found):
                    if spans:
                        raw, out, at = data[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                        for a, _, b in spans:
                            if a >= at:
                                out += [raw[at:a], mark.encode()]
                            at = max(at, b)
                        texts[d] = b"".join([*out, raw[at:]]).decode()
                        if sizes:
                            sizes[d] = len(texts[d])
                columns = {c: chunk.column(c) for c in names} | {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array(sizes, chunk.column("n_chars").type)} if sizes else {})
                chunk = pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)
            yield chunk

    return docs.mapInArrow(run, docs.schema)
