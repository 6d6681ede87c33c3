"""Token ids as binary files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

A folder holds `ranks.bin` (little-endian unsigned 32-bit ids, the most frequent first), shards `shard-*.tok` in ascending order of documents, and
`manifest.json` (shards with their documents, ids, bytes and checksum). A shard is `MAGIC` and blocks. A block is five little-endian unsigned 64-bit numbers
(documents, ids, control bytes, data bytes, 1 if some doc_ids are null), then doc_ids (64-bit), for the last kind a byte for each document (1: null), ids per document
(64-bit), the control stream and the data stream. Each id is its rank in 1 to 4 bytes, least byte first; a control byte holds the lengths less one of four ids, two bits each,
the first in the lowest bits. Blocks are read one after another; a table of 256 rows gives the lengths of a control byte's ids, and sums of them the places in
the data stream, so a block is decoded by a few array operations.

How it runs: documents are tokenised once and staged as 16- or 32-bit ids; frequencies are summed per task, then over tasks (a row for each id of the vocabulary); staged rows
are dealt by ranges of doc_id, sorted within, and each task writes one shard. Shards get their final names when Spark commits the write, so lost or repeated tasks leave nothing behind.
Readers take a shard each and know from the manifest how many ids stand before it.

Defined results: a null or empty text is the end id alone; repeated or null doc_ids keep a row each (nulls first; rows of one doc_id stand in the order in which they were staged); an empty
table gives a manifest without shards and no rows; other columns are ignored. A text is held whole in memory, with its ids.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import arrays
from .store import checkpoint_dir, staged
from .units import Units, byte_tokenizer, head

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"TOKVB1\n\0"
#: Ids of a shard and of a block, about; a document isn't parted.
SHARD_IDS, BLOCK_IDS = 1 << 23, 1 << 19
FORMAT = "token_files"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: Lengths of the four ids of each control byte.
_LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS) & 3) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit numbers."""
    n = len(ranks)
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = code
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFTS, axis=1)
    used = np.arange(4, dtype=np.uint8)[None, :] <= code[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: bytes | np.ndarray, data: bytes | np.ndarray, n: int) -> np.ndarray:
    """The n numbers of the two streams."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    data = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype("<u4")
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system that pyarrow opens by address; a bare path, file:/x and file:///x are local."""
    local = re.match(r"(?:file:/*)?(/[^:]*)$", re.sub(r"^file:/+", "file:/", path))
    return (pafs.LocalFileSystem(), local[1]) if local else pafs.FileSystem.from_uri(path)


def _put(path: str, name: str, content: bytes) -> None:
    system, folder = _filesystem(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{name}") as out:
        out.write(content)


def _get(path: str, name: str) -> bytes:
    system, folder = _filesystem(path)
    with system.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    file: str
    documents: int
    ids: int
    size: int
    crc32: int


class _Writer(DataSourceArrowWriter):
    """A shard for each task. Rows are (doc_id, ids): ids in 16- or 32-bit little-endian binary."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        order = np.frombuffer(_get(self.path, "ranks.bin"), "<u4")
        rank = np.zeros(int(order.max(initial=0)) + 1, "<u4")
        rank[order] = np.arange(len(order), dtype="<u4")
        system, folder = _filesystem(self.path)
        done = _Written(TaskContext.get().partitionId(), f"_attempt-{uuid.uuid4().hex}", 0, 0, 0, 0)
        ids, held, size = [], [], 0
        with system.open_output_stream(f"{folder}/{done.file}") as out:

            def put(content: bytes) -> None:
                out.write(content)
                done.size += len(content)
                done.crc32 = zlib.crc32(content, done.crc32)

            def flush() -> None:
                counts = np.array([len(x) // self.width for x in held], "<i8")
                values = rank[np.frombuffer(b"".join(held), f"<u{self.width}")]
                control, data = encode(values)
                null = np.array([i is None for i in ids], np.uint8)
                put(np.array([len(ids), len(values), len(control), len(data), int(null.any())], "<u8").tobytes())
                put(np.array([i or 0 for i in ids], "<i8").tobytes())
                if null.any():
                    put(null.tobytes())
                for content in (counts.tobytes(), control, data):
                    put(content)
                done.documents += len(ids)
                done.ids += len(values)

            put(MAGIC)
            for batch in iterator:
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    held.append(raw)
                    size += len(raw) // self.width
                    if size >= BLOCK_IDS:
                        flush()
                        ids, held, size = [], [], 0
            if ids:
                flush()
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _filesystem(self.path)
        kept = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.partition)
        shards = []
        for i, m in enumerate(kept):
            name = f"shard-{i:06d}.tok"
            system.move(f"{folder}/{m.file}", f"{folder}/{name}")
            shards.append({"file": name, "documents": m.documents, "ids": m.ids, "bytes": m.size, "crc32": m.crc32})
        self._sweep()
        _put(self.path, "manifest.json", json.dumps({"version": 1, "shards": shards}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        system, folder = _filesystem(self.path)
        for info in system.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.startswith("_attempt-"):
                system.delete_file(info.path)


class _Shard(InputPartition):
    def __init__(self, file: str, first: int, ids: int, size: int):
        self.file, self.first, self.ids, self.size = file, first, ids, size


def blocks(stream, size: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ranks of all) of each block of a shard of `size` bytes."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("no token file")
    left = size - len(MAGIC)
    while left:
        head = stream.read(40)
        documents, n, n_control, n_data, nulls = np.frombuffer(head, "<u8").tolist()
        body = np.frombuffer(stream.read(documents * (17 if nulls else 16) + n_control + n_data), np.uint8)
        parts = np.split(body, np.cumsum([8 * documents, documents if nulls else 0, 8 * documents, n_control]))
        ids = parts[0].view("<i8").tolist()
        if nulls:
            ids = [None if null else i for i, null in zip(ids, parts[1].tolist(), strict=True)]
        yield ids, parts[2].copy().view("<i8"), decode(parts[3], parts[4], n)
        left -= 40 + len(body)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Shard]:
        out, first = [], 0
        for s in json.loads(_get(self.path, "manifest.json"))["shards"]:
            out.append(_Shard(s["file"], first, s["ids"], s["bytes"]))
            first += s["ids"]
        return out or [_Shard("", 0, 0, 0)]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        order = np.frombuffer(_get(self.path, "ranks.bin"), "<u4")
        system, folder = _filesystem(self.path)
        first = partition.first
        with system.open_input_stream(f"{folder}/{partition.file}") as stream:
            for ids, counts, ranks in blocks(stream, partition.size):
                raw = order[ranks].tobytes()
                ends = np.cumsum(counts)
                cut = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(ids, pa.int64()), pa.array(first + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
                first += len(ranks)


class TokenFiles(DataSource):
    """`spark.read.format("token_files")`: doc_id, start (ids before it in the whole folder), n_tokens, ids (unsigned 32-bit). Writing takes (doc_id, ids) in order; see write_tokens()."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("width", 4)))


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids of each whole text with the end id behind: unsigned, 16 bits where the vocabulary allows, else 32."""
    width = id_width(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, width, end_id)
        if key not in _coders:
            _coders[key] = Coder(*key)
        encode = _coders[key].encode
        for chunk in arrays.chunks(batches):
            ids = encode([t or "" for t in chunk.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids binary")


class Coder:
    """Texts to little-endian ids with the end id behind, word by word; one for each Python worker."""

    def __init__(self, vocabulary: str, width: int, end_id: int):
        self.tokenizer, self.kind = byte_tokenizer(vocabulary, plain_specials=False), f"<u{width}"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], self.kind).tobytes()
        entries = self.tokenizer.get_vocab()
        #: Entries that start with a space or a line feed, in byte-level BPE's spelling.
        self.opens = np.zeros(max(entries.values()) + 1, bool)
        self.opens[[i for t, i in entries.items() if t[0] in "\u0120\u010a"]] = True
        self.tails, self.heads = Units(self._learn), Units(lambda units: self._whole([u[1:] for u in units]))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> list[bytes]:
        """Many units in one call: each starts with the only space or line feed that it has, or else they are encoded one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, self.kind)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(units):
            half = len(units) // 2
            return self._whole(units) if len(units) < 64 else self._learn(units[:half]) + self._learn(units[half:])
        raw, size = ids.tobytes(), ids.itemsize
        cut = (starts * size).tolist() + [len(raw)]
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        plain = [i for i in range(len(texts)) if i not in whole] if whole else range(len(texts))
        out, end = [b""] * len(texts), self.end
        for i, ids in zip(sorted(whole), self._whole([texts[i] for i in sorted(whole)]), strict=True):
            out[i] = ids + end
        # units are encoded with what parts them; a text's head has no space before it
        for i, ids, own in zip(plain, self.tails.values([texts[i] for i in plain]), self.heads.values([head(texts[i]) for i in plain]), strict=True):
            ids[0] = own[0]
            ids.append(end)
            out[i] = b"".join(ids)
        return out


_coders: dict[tuple[str, int, int], Coder] = {}


def id_width(vocabulary: str, end_id: int) -> int:
    size = max(byte_tokenizer(vocabulary, plain_specials=False).get_vocab_size(), end_id + 1)
    return 2 if size <= 1 << 16 else 4


def joined(column: pa.Array, width: int) -> np.ndarray:
    """The ids of all rows of a binary column without nulls, end to end."""
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    ends = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, n = int(ends[0]), int(ends[-1] - ends[0]) // width
    return np.frombuffer(data, f"<u{width}", n, first) if n else np.zeros(0, f"<u{width}")


def frequencies(rows: DataFrame, width: int) -> DataFrame:
    """(id, n) over all rows' ids: a row for each id that a task has, then one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(joined(batch.column(0), width), minlength=len(total))  # once a batch: it is as long as the vocabulary
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Tokenises docs(doc_id, text) and writes a folder of token files in ascending order of doc_id."""
    spark, width = docs.sparkSession, id_width(vocabulary, end_id)
    rows = staged(tokenised(docs, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()))
    ranked = frequencies(rows, width).collect()  # a row for each id of the vocabulary at most
    ranked.sort(key=lambda r: (-r.n, r.id))
    _put(path, "ranks.bin", np.array([r.id for r in ranked], "<u4").tobytes())
    shards = max(1, -(-sum(r.n for r in ranked) // shard_ids))
    ordered = rows.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    spark.dataSource.register(TokenFiles)
    ordered.write.format(FORMAT).mode("append").option("width", width).save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of all documents of a folder."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(path)


def round_trip(docs: DataFrame) -> DataFrame:
    """The op11 rows, read back from files in the session's shared folder: doc_id, start, n_tokens, ids_crc32."""
    path = f"{checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
