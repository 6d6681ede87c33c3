"""Alignment of two tokenizers' tokens over the same bytes: groups between common cuts, linked ids and their counts over the corpus.

A (byte-level BPE of the tokenizers library) encodes a space and the text, B (a sentencepiece model that puts the space itself) the text. Coarse cuts are
A's character offsets and the spans of B's proto; where a character is split over tokens, or B falls back to bytes, spans don't part the tokens, and the
lengths of the decoded bytes do. Each token's bytes must then be those under its span: if any aren't (B's space sign in the text), the document has no tokens.

Words are aligned once for each task and looked up from then on (units.py: both tokenizers part at single spaces, so every unit ends at a common cut).
Links of a document are folded to distinct id pairs with their occurrences, counts are summed over all documents by Spark, and each document's
pairs are looked up in them: in a broadcast table where it has at most BROADCAST_PAIRS rows by count, else by a join. Both ways give the same.

Defined results: a null or empty text has no tokens, zeros and empty groups; strings of special tokens are plain text; repeated and null doc_ids keep a row each and each counts;
an empty table gives no rows; other columns are ignored. A text is held whole in memory with its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .store import staged
from .units import Units, byte_tokenizer, place

A_VOCABULARY, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct id pairs whose counts are sent to all tasks (17 bytes each).
BROADCAST_PAIRS = 2_000_000


def _byte_of_sign() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others as the characters from 256 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {chr(b if b in printable else next(others)): b for b in range(256)}


def cuts(starts: np.ndarray, ends: np.ndarray, last: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes. Spans say so where the next one starts there; within a character, or around spans of no width, the tokens' own lengths (`decoded` ends) do."""
    wide = ends > starts
    meets = np.ones(len(ends), bool)
    meets[:-1] = (starts[1:] == ends[:-1]) & wide[1:]
    return np.where(wide & (meets | last), ends, decoded)


#: A word of plain letters and a stop.
_TAILED = re.compile("[ \\n][A-Za-zÀ-ÖØ-öø-ÿ]+[.,]")
#: In place of the number of A's tokens: some bytes differ.
_APART = -1


class Pairing:
    """Both tokenizers and what is known of units: per unit its numbers of tokens and groups, its linked pairs and its groups as text."""

    def __init__(self, a_vocabulary: str, b_model: str):
        import sentencepiece

        self.a = byte_tokenizer(a_vocabulary, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(b_model))
        sign = _byte_of_sign()
        self.a_bytes = {i: bytes(sign[c] for c in t) if all(c in sign for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in piece]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        #: No entry of B holds a letter before a full stop or a comma; A parts them anyway.
        self.stops = not any(re.search(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,]", p) for p in piece)
        self.units = Units(self.learn, self.forget)
        self.forget()

    def forget(self) -> None:
        self.sizes, self.texts, self.pairs, self.links, self.tails = np.zeros((1024, 4), np.int64), [], np.zeros(4096, np.int64), 0, {}

    def learn(self, units: list[str]) -> list[int]:
        """Aligns units (with the space or line feed that they start with) and gives them numbers."""
        if not self.stops:
            return self._aligned(units)
        tailed = {u: (u[:-1], u[-1]) for u in units if _TAILED.fullmatch(u)}
        bases = [w for w, _ in tailed.values()] + [u for u in units if u not in tailed]
        known = {u: n for u in bases if (n := self.units.known.get(u[1:] if u[0] == " " else u)) is not None}
        if new := [u for u in dict.fromkeys(bases) if u not in known]:
            known.update(zip(new, self._aligned(new), strict=True))
        if tails := sorted({t for _, t in tailed.values()} - self.tails.keys()):
            self.tails.update(zip(tails, self._aligned(tails, "a"), strict=True))
        return [self._both(known[tailed[u][0]], self.tails[tailed[u][1]]) if u in tailed else known[u] for u in units]

    def _aligned(self, units: list[str], letter: str = "") -> list[int]:
        """Aligns all units at once: tokens end to end over the units' joined bytes. letter: what stands before each unit, if it isn't encoded alone."""
        a = self.a.encode_batch([f" {letter}{u}" if letter else u for u in units], add_special_tokens=False)
        spaced = np.array([u[0] == " " for u in units])
        # B puts a space before each text: for units without one its token is taken off again, as is the letter's
        b = [y.pieces for y in self.b.encode([(letter + u[s:]).encode() for u, s in zip(units, spaced.tolist(), strict=True)], return_type="proto", num_threads=1)]
        joined = "".join(units)
        data = joined.encode()
        size = np.array([len(u.encode()) for u in units])
        base, head = np.cumsum(size) - size, len(letter)
        character = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # the byte at which each one starts
        character = np.concatenate((character, [len(data)]))
        count = np.array([len(u) for u in units])
        first = np.cumsum(count) - count
        a_skip, b_skip = int(bool(head)), np.where(spaced, 0, 1)
        a_ids, a_n = _flat([x.ids[a_skip:] for x in a])
        offsets, _ = _flat([[v for o in x.offsets[a_skip:] for v in o] for x in a])
        at = np.repeat(first - 2 * a_skip, a_n)
        a_cuts = self._cuts(character[offsets[::2] + at], character[offsets[1::2] + at], a_ids, a_n, self.a_size, base)
        pieces = [list(y)[k:] for y, k in zip(b, b_skip.tolist(), strict=True)] if not spaced.all() else b
        b_ids, b_n = _flat([[p.id for p in y] for y in pieces])
        spans, _ = _flat([[v for p in y for v in (p.begin, p.end)] for y in pieces])
        at = np.repeat(base + spaced - head, b_n)
        starts = spans[::2] + at
        starts[(np.cumsum(b_n) - b_n)[b_n > 0]] = base[b_n > 0]
        b_cuts = self._cuts(starts, spans[1::2] + at, b_ids, b_n, self.b_size, base)
        good = np.ones(len(units), bool)
        for ids, n, ends, sizes, words in ((a_ids, a_n, a_cuts, self.a_size, self.a_bytes), (b_ids, b_n, b_cuts, self.b_size, self.b_bytes)):
            # each token's bytes are those between its cuts
            owner, low = np.repeat(np.arange(len(units)), n), np.concatenate((ends[:0], ends))
            low[1:] = ends[:-1]
            low[(np.cumsum(n) - n)[n > 0]] = base[n > 0]
            wrong = ends - low != sizes[ids]
            if b"".join(map(words.__getitem__, ids.tolist())) != data or wrong.any():
                wrong |= np.array([data[x:y] != words[i] for x, y, i in zip(low.tolist(), ends.tolist(), ids.tolist(), strict=True)], bool)
            good &= np.bincount(owner, weights=wrong, minlength=len(units)) == 0
            total = np.bincount(owner, weights=sizes[ids], minlength=len(units))
            good &= total == size
        if not good.all():
            keep = np.repeat(good, a_n), np.repeat(good, b_n)
            a_ids, a_cuts, b_ids, b_cuts = a_ids[keep[0]], a_cuts[keep[0]], b_ids[keep[1]], b_cuts[keep[1]]
        # every stretch between two neighbouring cuts, whosever they are, is one link
        every = np.union1d(a_cuts, b_cuts)
        i, j = np.searchsorted(a_cuts, every), np.searchsorted(b_cuts, every)
        owner = np.searchsorted(base + size, every)
        common = (a_cuts[i] == every) & (b_cuts[j] == every)
        links = np.bincount(owner, minlength=len(units))
        groups = np.bincount(owner[common], minlength=len(units))
        texts = self._groups(a_ids, b_ids, i[common] + 1, j[common] + 1)
        number = len(self.texts)
        while number + len(units) > len(self.sizes):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        new = self.sizes[number : number + len(units)]
        new[:, 0], new[:, 1], new[:, 2], new[:, 3] = np.where(good, a_n, _APART), np.where(good, b_n, 0), groups, self.links + np.cumsum(links) - links
        ends = np.cumsum(groups).tolist()
        self.texts += [";".join(texts[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        self._link(a_ids[i] << 32 | b_ids[j])
        return list(range(number, number + len(units)))

    def _cuts(self, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
        behind = np.cumsum(n)
        last = np.zeros(len(ids), bool)
        last[behind[n > 0] - 1] = True
        total = np.cumsum(sizes[ids])
        before = np.concatenate(([0], total))[behind - n]
        return cuts(starts, ends, last, total + np.repeat(base - before, n))

    def _groups(self, a_ids: np.ndarray, b_ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[str]:
        """The text of each group; i, j: where they end."""
        a, b, out, x, y = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist())), [], 0, 0
        for u, v in zip(i.tolist(), j.tolist(), strict=True):
            out.append(f"{a[x]}|{b[y]}" if u == x + 1 and v == y + 1 else f"{','.join(a[x:u])}|{','.join(b[y:v])}")
            x, y = u, v
        return out

    def _link(self, links: np.ndarray) -> None:
        while self.links + len(links) > len(self.pairs):
            self.pairs = np.concatenate((self.pairs, np.zeros_like(self.pairs)))
        self.pairs[self.links : self.links + len(links)] = links
        self.links += len(links)

    def _both(self, first: int, second: int) -> int:
        """A number for two units on end."""
        at = [self.sizes[n].tolist() for n in (first, second)]
        sizes = [x + y for x, y in zip(*(s[:3] for s in at), strict=True)]
        links = np.concatenate([self.pairs[s[3] : s[3] + s[0] + s[1] - s[2]] for s in at])
        number = len(self.texts)
        if number == len(self.sizes):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        self.sizes[number] = (*sizes, self.links)
        self.texts.append(f"{self.texts[first]};{self.texts[second]}")
        self._link(links)
        return number

    def document(self, numbers: list[int]) -> tuple[list[int], str, np.ndarray, np.ndarray] | None:
        """(n_a, n_b, n_groups, n_links), the groups, distinct linked pairs and their occurrences; None if bytes differ."""
        which, times = np.unique(np.array(numbers, np.int64), return_counts=True)
        size = self.sizes[which]
        if (size[:, 0] == _APART).any():
            return None
        n_a, n_b, n_groups = (size[:, :3] * times[:, None]).sum(axis=0).tolist()
        count = size[:, 0] + size[:, 1] - size[:, 2]  # links of a unit
        at = np.repeat(size[:, 3] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pairs, own = np.unique(self.pairs[at], return_inverse=True)
        occurs = np.bincount(own, weights=np.repeat(times, count), minlength=len(pairs)).astype(np.int64)
        return [n_a, n_b, n_groups, n_a + n_b - n_groups], ";".join(map(self.texts.__getitem__, numbers)), pairs, occurs


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and how many each list has."""
    from itertools import chain

    return np.fromiter(chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)


_pairings: dict[tuple[str, str], Pairing] = {}
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"


def align(docs: DataFrame, a_vocabulary: str = A_VOCABULARY, b_model: str = B_MODEL) -> DataFrame:
    """Per document its tokens and groups (`a1,a2|b1;a3|b2,b3`), and its distinct linked pairs (a's id in the upper 32 bits, b's in the lower) with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_vocabulary, b_model)
        if key not in _pairings:
            _pairings[key] = Pairing(*key)
        both = _pairings[key]
        for chunk in arrays.chunks(batches):
            texts = chunk.column("text").to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            sizes, groups, ends = np.zeros((len(texts), 4), np.int64), [""] * len(texts), np.zeros(len(texts) + 1, np.int64)
            pairs, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, numbers in zip(full, both.units.values([texts[i] for i in full]), strict=True):
                if (got := both.document(numbers)) is not None:
                    sizes[i], groups[i], own, occurs = got
                    pairs.append(own)
                    times.append(occurs)
                    ends[i + 1] = len(own)
            offsets = pa.array(np.cumsum(ends).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
            columns = [chunk.column("doc_id"), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of all documents hold a pair, and whether that is the most that its B id has."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = staged(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def id_pairs(aligned: DataFrame) -> DataFrame:
    """pair_counts() as a_id, b_id, n, best: a translation table between the two vocabularies."""
    return pair_counts(aligned).select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n", "best")


def with_counts(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned (read from storage) without its pairs and with n_best and count_sum."""
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() > broadcast_pairs:
        rows = staged(aligned.withColumn("_row", F.monotonically_increasing_id()))
        each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        sums = each.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
        zero = F.lit(0).cast("bigint")
        return rows.join(sums, "_row", "left").select(*kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
    table = counts.orderBy("pair").toArrow()  # at most broadcast_pairs rows
    send = aligned.sparkSession.sparkContext.broadcast
    known = send(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            ends, times = lists.offsets.to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            total = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[ends - ends[0]]))  # noqa: B023, E731
            columns = [*(batch.column(c) for c in kept), total(best[at] * times), total(n[at] * times)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return aligned.mapInArrow(run, f"{schema}, n_best bigint, count_sum bigint")


def digest(docs: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The op13 rows: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    code = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = staged(align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", code.alias("groups_sha256"), "pairs", "times"))
    return with_counts(aligned, pair_counts(aligned), broadcast_pairs)
