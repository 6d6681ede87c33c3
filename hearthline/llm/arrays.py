"""Numpy views of Arrow string columns: words, hashes and sliding minima over many documents at once.

A batch's texts lie one after another in one UTF-8 buffer, so a whole chunk of documents is handled by a few array
operations. Chunks hold about CHUNK bytes; a longer document is a chunk of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
#: Bases of the hashes: of bytes in words, of words in windows, and of what surrounds a window.
_BASE, _STEP, CONTEXT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offset of each (one more than there are rows)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)), offsets - first


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `size` bytes; small neighbours are joined within a batch only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """A flag for each byte value: true in the given inclusive ranges."""
    flags = np.zeros(256, bool)
    for a, b in ranges:
        flags[a : b + 1] = True
    return flags


#: Bytes that part words: space and \x09-\x0D.
SPACE = table_of((0x20, 0x20), (0x09, 0x0D))
#: Bytes that aren't in [0-9a-z] or beyond ASCII (texts lower-cased before).
NOT_ALNUM = table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_bounds(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (one more than there are documents)."""
    n = len(data)
    inside = ~parting[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes are polynomials modulo this prime: modulo a power of two, sequences exist that agree whatever the base.
_PRIME = np.uint64((1 << 61) - 1)
#: Values whose sums are made in one go.
_BLOCK = 1 << 16
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduce(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    x -= _PRIME * (x >= _PRIME)
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it, by halves of 31 bits."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = ah * bl + al * bh
    return _reduce(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + al * bl)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = -(-n // (1 << 18)) << 18
        out, prime = [], int(_PRIME)
        for b in (base % prime, pow(base, -1, prime)):
            p, k = np.ones(size, np.uint64), 1
            while k < size:
                m = min(k, size - k)
                p[k : k + m] = _times(p[:m], np.uint64(pow(b, k, prime)))
                k += m
            out.append(p)
        if size > 4 * CHUNK:
            return out[0], out[1]
        have = _powers[base] = (out[0], out[1])
    return have


def prefix_hash(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of (values + 1) * base**i modulo the prime; see spans_hash. In blocks, so that what is held besides the sums is small."""
    n = len(values)
    power = _power(base, n + 1)[0]
    out = np.zeros(n + 1, np.uint64)
    for a in range(0, n, _BLOCK):
        value, p = values[a : a + _BLOCK].astype(np.uint64), power[a : min(a + _BLOCK, n)]
        if values.dtype == np.uint8:  # halves can be summed as they are
            value += np.uint64(1)
            low, high = value * (p & _LOW31), value * (p >> np.uint64(31))
        else:
            terms = _times(_reduce(_reduce(value) + np.uint64(1)), p)
            low, high = terms & _LOW31, terms >> np.uint64(31)
        high = _reduce(np.cumsum(high, out=high))
        sums = _reduce((((high << np.uint64(31)) & _PRIME) | (high >> np.uint64(30))) + _reduce(np.cumsum(low, out=low)))
        out[a + 1 : a + 1 + len(p)] = _reduce(sums + out[a])
    return out


def spans_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of spans, equal wherever the same values stand; others agree by chance alone (2**-61 for each value of the longer one, over all bases)."""
    inverse = _power(base, len(prefix))[1]
    return mix(_times(_reduce(prefix[ends] + (_PRIME - prefix[starts])), inverse[starts]) ^ (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(prefix_hash(data), starts, ends)


def window_prefix(hashes: np.ndarray, base: int = _STEP) -> np.ndarray:
    return prefix_hash(hashes, base)


def window_hash(prefix: np.ndarray, starts: np.ndarray, length: int | np.ndarray, base: int = _STEP) -> np.ndarray:
    return spans_hash(prefix, starts, starts + length, base)


def gram_ranks(values: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of `width` values that depends on them alone. Different runs may share one: it puts runs in an order and never tells them apart.

    Prefix sums modulo 2**64 do for that, as each run's number is its difference times the inverse power of an odd base.
    """
    n = len(values)
    power, inverse = (np.full(n + 1, pow(_STEP, k, 1 << 64), np.uint64) for k in (1, -1))
    power[0] = inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1])


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its least value, the first of equals. It depends on what stands in the window alone."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    if n >= 1 << 28:
        raise ValueError("a document of over 2**28 values")
    packed = (values >> np.uint64(28) << np.uint64(28)) | np.arange(n, dtype=np.uint64)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64((1 << 28) - 1)).astype(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
