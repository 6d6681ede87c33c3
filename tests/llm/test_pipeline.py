"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_packing_keeps_few_words_in_a_worker():
    from hearthline.llm import packing

    words = packing.tokenizer(packing.VOCABULARY)
    text = " ".join(f"word{chr(97 + i)}" for i in range(20))
    whole, most = words.encode([text]), words.most
    try:
        words.most = 5
        assert words.encode([text]) == whole
        words.trim()
        assert len(words.cache) <= 5 and words.encode([text]) == whole
    finally:
        words.most = most
    assert corpus_pipeline.CACHED_WORDS < packing.CACHED_WORDS


def test_stages(spark, tmp_path):
    r = random.Random(3)
    words = {"en": ["the", "thing", "and", "with", "shall", "over"], "de": ["der", "und", "schön", "nicht", "auch", "über"]}
    text = lambda k, n: " ".join(r.choice(words[k]) + str(r.randint(0, 400)) * (r.random() < 0.4) for _ in range(n))
    rows = [(i, text(k, r.randint(30, 80)), k, "s", 1) for i, k in enumerate(["en", "de"] * 60)]
    leak = " ".join(f"q{i}" for i in range(20))
    rows += [
        (500, rows[0][1], "en", "s", 1), (501, rows[1][1] + " ", "de", "s", 1), (502, "123 !!", "en", "s", 1), (503, None, "en", "s", 1), (504, f"{text('en', 40)} {leak}", "en", "s", 1), (505, f"{text('en', 40)} token=abcdefghij0123456789", "en", "s", 1),
    ]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        seen[name] = {x.doc_id for x in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "secret scans":
            assert "abcdefghij0123456789" not in docs.where("doc_id = 505").first().text
    clean = set(range(120))
    assert seen["language ID"] == clean | {500, 501, 504, 505}
    assert seen["SimHash near-dedup"] == clean | {504, 505}
    assert seen["benchmark decontamination"] == clean | {505}
    assert seen["secret scans"] == seen["packing"] == clean | {505}
    assert {x.doc_id for x in corpus_pipeline.run(spark, sf).collect()} == clean | {505}
