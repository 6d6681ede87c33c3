"""Token files, ranked search and alignment of tokenizers against plain versions."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import alignment, ranked, tokenfile

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string"
PARTS = ["a", "B", "é", "日本", " ", "  ", "\n", " \n", "\t", "'s", "1", "23", ".", ",", " the", " ing", "\x1c", "𝔘", "\x00", "<|endoftext|>", "</s>", "\x85", "　", "straße", "foo", "​"]


def mixed(n: int, seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    rows: list = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(0, 25)))) for i in range(n)]
    rows += [(5, rows[5][1])] * 3 + [(None, "null id"), (None, None), (n, None), (n + 1, ""), (n + 2, "x" * 5000), (n + 3, "word " * 20000), (n + 4, "ab▁cd"), (-7, "first")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    """With columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, row long, ids string").repartition(5)


# -- op11


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 999])
def test_coding_of_numbers(n):
    r = random.Random(n)
    values = np.array([r.randrange(2 ** r.choice([1, 8, 9, 16, 17, 24, 25, 32])) for _ in range(n)], "<u4")
    control, data = tokenfile.encode(values)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert (tokenfile.decode(control, data, n) == values).all()


def plain_ids(texts):
    from hearthline.llm.units import byte_tokenizer

    return [e.ids + [tokenfile.END_ID] for e in byte_tokenizer(tokenfile.VOCABULARY, plain_specials=False).encode_batch(texts, add_special_tokens=False)]


def test_frequencies_count_batches_end_to_end():
    raw = [np.array(x, "<u2").tobytes() for x in ([1, 2, 2], [], [7], [65535, 2])]
    column = pa.array(raw, pa.binary())
    assert tokenfile.joined(column, 2).tolist() == [1, 2, 2, 7, 65535, 2]
    assert tokenfile.joined(column.slice(1, 2), 2).tolist() == [7]
    assert tokenfile.joined(column.slice(2), 2).tolist() == [7, 65535, 2]
    assert tokenfile.joined(column.slice(1, 1), 2).tolist() == tokenfile.joined(column.slice(0, 0), 2).tolist() == tokenfile.joined(pa.array([], pa.binary()), 4).tolist() == []


@pytest.mark.parametrize("shard_ids", [1 << 23, 2000])
def test_token_files_give_back_the_ids(spark, tmp_path, monkeypatch, shard_ids):
    rows = mixed(400)
    path = f"{tmp_path}/tokens"
    tokenfile.write_tokens(frame(spark, rows), path, shard_ids=shard_ids)
    got = tokenfile.read_tokens(spark, f"file:{path}").collect()
    want = Counter((doc, tuple(ids)) for (doc, _), ids in zip(rows, plain_ids([t or "" for _, t in rows]), strict=True))
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at, seen = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        assert seen is None or r.doc_id is not None and r.doc_id >= seen
        at, seen = at + r.n_tokens, r.doc_id
    names = sorted(os.listdir(path))
    shards = json.load(open(f"{path}/manifest.json"))["shards"]
    assert names == sorted([s["file"] for s in shards] + ["manifest.json", "ranks.bin"])
    assert (len(shards) > 5) == (shard_ids == 2000)
    for s in shards:
        content = open(f"{path}/{s['file']}", "rb").read()
        assert (len(content), zlib.crc32(content)) == (s["bytes"], s["crc32"])
    ranks = np.fromfile(f"{path}/ranks.bin", "<u4").tolist()
    counts = Counter(i for (_, ids), n in want.items() for i in ids * n)
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))


def test_token_digest_and_empty_table(spark):
    rows = [r for r in mixed(50) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: tuple(r) for r in tokenfile.round_trip(frame(spark, rows)).collect()}
    at = 0
    for (doc, _), ids in sorted(zip(rows, plain_ids([t or "" for _, t in rows]), strict=True), key=lambda x: x[0][0]):
        assert got[doc] == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


# -- op12


def plain_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(doc, Counter(find(t))) for doc, t in docs if find(t)]
    n_all, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        query = find(text)
        scored = []
        for doc, c in held:
            m = 100 - 75 + (75 * c.total() * n_all) // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(n, vocabulary, seed):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % vocabulary}" for _ in range(5000)]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 20, 60])))) for i in range(n)]


@pytest.mark.parametrize(("block_documents", "block_terms", "k"), [(1 << 16, 1 << 20, 10), (16, 40, 3)])
def test_search_is_exact(spark, block_documents, block_terms, k):
    docs = corpus(300, 60, 1) + [(7, "w1 W1 É é"), (7, "w1 W1 É é"), (None, "w2 w3"), (900, None), (901, ""), (902, "...!"), (903, "w4-w5_w6​x " * 3000)]
    r = random.Random(2)
    items = [(f"i{i}", " ".join(f"W{r.randrange(80)}" for _ in range(r.choice([1, 2, 5, 30])))) for i in range(25)]
    items += [("i3", "w1 w1 w1 w2"), (None, "w9 É"), ("none", None), ("empty", ""), ("absent", "zzz"), ("long", " ".join(f"w{i}" for i in range(200)))]
    table = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id string, text string, item long, rank int").repartition(3)
    got = ranked.search(frame(spark, docs), table, k, block_terms, block_documents)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, corpus(20, 20, 4)), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert ranked.search(docs.where("false"), items).collect() == []
    assert ranked.search(docs, items.where("false")).collect() == []


def test_masks_leave_most_documents_unscored():
    r = np.random.default_rng(1)
    n = 20000
    term = np.concatenate([np.full((r.random(n) < p).sum(), t) for t, p in enumerate((0.9, 0.5, 0.05, 0.01))])
    document = np.concatenate([np.sort(r.choice(n, (term == t).sum(), replace=False)) for t in range(4)])
    share = r.integers(100_000, 900_000, len(term))
    block = ranked.Postings(n, document, term, share)
    weights = np.array([10, 100, 3000, 5000])
    best = ranked.Best(10)
    scored = ranked.search_block(block, np.zeros(n, bool), np.arange(n), np.arange(4), weights, best)
    full = np.zeros(n, np.int64)
    np.add.at(full, document, weights[term] * share)
    assert best.score.tolist() == sorted(full.tolist(), reverse=True)[:10]
    assert scored < n // 10


# -- op13


def plain_alignment(text):
    """(a ids, b ids, groups, links) of whole texts by decoded bytes alone, or None."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain_alignment, "both"):
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        plain_alignment.both = t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t, s = plain_alignment.both
    if not text:
        return None
    table = {v: k for k, v in alignment._byte_of_sign().items()}
    assert len(table) == 256
    e = t.encode(f" {text}", add_special_tokens=False)
    a = [(i, bytes(alignment._byte_of_sign()[c] for c in token)) for i, token in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in s.encode(text):
        p = s.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()))
    whole = f" {text}".encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    spans = []
    for tokens in (a, b):
        ends = np.cumsum([len(x) for _, x in tokens]).tolist()
        spans.append([(i, end - len(x), end) for (i, x), end in zip(tokens, ends, strict=True)])
    common = sorted({z for *_, z in spans[0]} & {z for *_, z in spans[1]})
    groups, low = [], 0
    for cut in common:
        groups.append("|".join(",".join(str(i) for i, y, z in side if low <= y and z <= cut) for side in spans))
        low = cut
    links = [(i, j) for i, y, z in spans[0] for j, u, v in spans[1] if y < v and u < z]
    return [i for i, *_ in spans[0]], [i for i, *_ in spans[1]], ";".join(groups), links


@pytest.mark.parametrize("broadcast_pairs", [1 << 20, 0])
def test_alignment_of_tokenizers(spark, broadcast_pairs):
    rows = [(i, t if t is None or len(t) < 6000 else t[:3000]) for i, t in mixed(250)]
    plain = [(doc, plain_alignment(t)) for doc, t in rows]
    counts = Counter(x for _, p in plain if p for x in p[3])
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for doc, p in plain:
        a, b, groups, links = p or ([], [], "", [])
        best = sum(counts[x] == most[x[1]] for x in links)
        want.append((doc, len(a), len(b), len(groups.split(";")) if p else 0, len(links), best, sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if p else ""))
    got = alignment.digest(frame(spark, rows), broadcast_pairs)
    rows = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert sum(r[1] == 0 for r in rows) == sum(p is None for _, p in plain) > 3


def test_alignment_shows_pairs_and_groups(spark):
    rows = alignment.align(spark.createDataFrame([(1, "abc ▁"), (2, "the 日"), (3, None)], SCHEMA))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].groups == got[3].groups == "" and got[1].n_a == 0
    assert got[2].groups == plain_alignment("the 日")[2]
    pairs = {(r.a_id, r.b_id): r.n for r in alignment.id_pairs(rows).collect()}
    assert pairs == dict(Counter(plain_alignment("the 日")[3]))
    assert alignment.digest(spark.createDataFrame([], SCHEMA)).collect() == []


# -- the queries


def test_search_query_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows = sorted(map(tuple, entry.queries()["op12_ranked_search"](spark, SF).collect()))
    assert rows and rows == sorted(c.sql(f"select item_id, rank, doc_id, score from ({entry.oracle_sql()['op12_ranked_search']})").fetchall())


def test_known_words_with_a_new_stop_are_aligned_without_new_words():
    later, once = (alignment.Pairing(alignment.A_VOCABULARY, alignment.B_MODEL) for _ in range(2))
    later.units.values(["house tree"])
    texts = ["house. tree,"]  # all that is lacking are stops behind words that are known
    plain = lambda p: [(x[0], x[1], x[2].tolist(), x[3].tolist()) for x in map(p.document, p.units.values(texts))]
    assert plain(later) == plain(once)
