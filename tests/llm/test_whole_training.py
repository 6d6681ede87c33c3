"""op4 learns from every training document."""

from __future__ import annotations

from hearthline.llm import mixing


def test_mixer_learns_from_all_training_documents(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('word', id % 97, ' and word', id % 89) as text")
    seen, train = [], mixing.train_mixer
    monkeypatch.setattr(mixing, "train_mixer", lambda docs, *rest: seen.append(docs.count()) or train(docs, *rest))
    assert mixing.score_documents(docs).count() == 4000
    assert seen == [docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 1").count()]


def test_equal_rows_teach_the_mixer_as_often_as_they_come(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word', id % 97, ' and word', id % 89) as text")
    docs = docs.union(spark.range(3000).selectExpr("2L as doc_id", "'quite another text of many more words than the others have' as text"))
    found, train = [], mixing.train_mixer
    monkeypatch.setattr(mixing, "train_mixer", lambda docs, *rest: found.append((train(docs, *rest).map, train(docs.distinct(), *rest).map)) or train(docs, *rest))
    assert mixing.score_documents(docs).count() == 6000
    every, once = found[0]
    assert abs(every - once).max() > 1e-6
