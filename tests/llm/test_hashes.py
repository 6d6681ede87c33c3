"""Hashes against sequences that agree under every polynomial modulo a power of two."""

from __future__ import annotations

import random

import numpy as np

from hearthline.llm import arrays, decontam, doubling, lpf, simhash

PRIME = (1 << 61) - 1


def thue_morse(n: int) -> list[int]:
    return [bin(i).count("1") & 1 for i in range(n)]


def both(a: str, b: str, n: int, joint: str = "") -> tuple[str, str]:
    """A sequence and its complement."""
    t = thue_morse(n)
    return joint.join((a, b)[i] for i in t), joint.join((b, a)[i] for i in t)


def test_arithmetic_is_that_of_whole_numbers(monkeypatch):
    monkeypatch.setattr(arrays, "_BLOCK", 64)
    r = random.Random(1)
    x = [0, 1, PRIME - 1, *(r.randrange(PRIME) for _ in range(500))]
    y = [PRIME - 1, PRIME - 1, PRIME - 1, *(r.randrange(PRIME) for _ in range(500))]
    assert arrays._times(np.array(x, np.uint64), np.array(y, np.uint64)).tolist() == [a * b % PRIME for a, b in zip(x, y, strict=True)]
    base = arrays._BASE % PRIME
    for values in (np.array([r.randrange(256) for _ in range(300)], np.uint8), np.array([r.randrange(1 << 64) for _ in range(300)], np.uint64)):
        sums = [0]
        for i, v in enumerate(values.tolist()):
            sums.append((sums[-1] + (v % PRIME + 1) * pow(base, i, PRIME)) % PRIME)
        assert arrays.prefix_hash(values).tolist() == sums
    h = arrays.prefix_hash(np.tile(np.arange(7, dtype=np.uint8), 9))
    at = np.arange(0, 49, 7)
    assert len(set(arrays.spans_hash(h, at, at + 7).tolist())) == 1 and len(set(arrays.spans_hash(h, np.arange(7), np.arange(7) + 9).tolist())) == 7


def test_complements_of_words_windows_and_texts_differ(spark):
    word, other = both("a", "b", 4096)
    data = np.frombuffer((word + other).encode(), np.uint8)
    x = arrays.word_hashes(data, np.array([0, 4096]), np.array([4096, 8192]))
    assert x[0] != x[1]
    text, shifted = both("aa", "bb", 2048, " ")
    # (as sets of five-word shingles the two are alike; as texts they aren't)
    raw = f"{text} {shifted}".encode()
    words, _ = simhash._words(np.frombuffer(raw, np.uint8), np.array([0, len(text), len(raw)]))
    tids = simhash._text_hashes(words, np.array([0, 2048, 4096]))
    assert len(words) == 4096 and tids[0] != tids[1]
    docs = spark.createDataFrame([(1, text), (3, word)], "doc_id long, text string")
    items = spark.createDataFrame([("x", other)], "item_id string, text string")
    assert not any(r.contaminated for r in decontam.contaminated_documents(docs, items).collect())


def test_complements_of_long_strings_are_no_repeats(spark):
    # told apart at every length: random words stand between, so that nothing long comes twice
    r = random.Random(2)
    noise = [" ".join(str(r.randrange(10**9)) for _ in range(60)) for _ in range(4)]
    text, other = both("a", "b", 2048)
    docs = spark.createDataFrame([(1, f"{noise[0]} {text[:300]} {noise[1]}"), (2, f"{noise[2]} {other[:300]} {noise[3]}")], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in lpf.digest(docs).collect())
    words, others = both("k", "q", 49, " ")
    docs = spark.createDataFrame([(1, f"{noise[0]} {words} {noise[1]}"), (2, f"{noise[2]} {others} {noise[3]}")], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in doubling.digest(docs).collect())


def test_equal_rows_carry_what_one_carries(spark, monkeypatch):
    from hearthline.llm import repeats

    r = random.Random(3)
    text = " ".join(str(r.randrange(10**6)) for _ in range(300))
    seen = []

    def count(docs, rows, columns, how, real=repeats.with_lists):
        out = real(docs, rows, columns, how)
        seen.append(out.selectExpr("max(size(found))").first()[0] or 0)
        return out

    for module in (lpf, doubling):
        monkeypatch.setattr(module, "with_lists", count)
    for copies in (3, 200):
        docs = spark.createDataFrame([(1, text)] * copies + [(2, text + " end"), (None, text)], "doc_id long, text string")
        got = lpf.digest(docs).collect()
        assert all(x.n_removed == len(text) for x in got) and len(got) == copies + 2
        kept = doubling.digest(docs).collect()
        assert len(kept) == copies + 2 and sum(x.n_removed for x in kept) == 300
    half = len(seen) // 2
    assert max(seen[half:]) == max(seen[:half])
