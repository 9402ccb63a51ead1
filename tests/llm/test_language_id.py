"""Language identification: the distance by hand, held-out accuracy, and edge cases."""

from pyspark.sql import functions as F

from marlstone.llm import language_id as lid
from marlstone.llm.registry import op1_language_id

DATA = "/root/testdata/sf0.001"


def test_ngrams():
    code = lambda *cs: sum((1 if c == " " else ord(c) + 2) << 21 * (len(cs) - 1 - i) for i, c in enumerate(cs))
    want = [code(*g) for g in ("a", "b", " a", "ab", "b ", " ab", "ab ")]
    assert sorted(lid.ngrams("A1b"[0] + "b!!")) == sorted(want)
    assert lid.ngrams(None).size == lid.ngrams("").size == lid.ngrams("12 %$").size == 0


def test_out_of_place(spark):
    df = spark.createDataFrame([("x", "aaaa bbbb"), ("y", "cccc dddd"), (None, "eeee"), ("z", None)], "lang string, text string")
    profiles = lid.learn_profiles(df)
    asked = spark.createDataFrame([(1, "aaaa"), (2, "dddd cccc"), (3, None), (4, "123"), (5, ""), (1, "aaaa"), (6, "日本")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.lang_pred): r.score for r in lid.identify(asked, profiles).collect()}
    assert set(got) == {(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "x")}
    assert got[(3, "und")] == 0 and all(0 <= s <= 1 for s in got.values()) and got[(1, "x")] > 0.5
    assert lid.identify(asked, profiles).count() == 7
    nothing = lid.identify(asked, lid.learn_profiles(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert lid.identify(asked.limit(0), profiles).count() == 0


def test_distance_matches_a_plain_one():
    size, docs = 5, {"x": "the cat and the hat", "y": "der hund und der rat"}
    ranks = {k: [int(c) for c in lid._top(*lid.counted(lid.ngrams(t)), size)] for k, t in docs.items()}
    import numpy as np

    p = lid.Profiles(["x", "y"], np.repeat([0, 1], size), np.tile(np.arange(size), 2), np.array(ranks["x"] + ranks["y"]), size)
    mine = [int(c) for c in lid._top(*lid.counted(lid.ngrams("the dog")), size)]
    plain = [sum(abs(i - ranks[k].index(g)) if g in ranks[k] else size for i, g in enumerate(mine)) / (len(mine) * size) for k in ("x", "y")]
    assert np.allclose(p.distances("the dog"), plain)


def test_held_out_accuracy(spark):
    found = op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0


def test_many_languages_take_several_blocks(spark, monkeypatch):
    docs = [(f"l{i}", f"{chr(97 + i)}{chr(98 + i)}{chr(99 + i)} " * 3) for i in range(12)]
    profiles = lid.learn_profiles(spark.createDataFrame(docs, "lang string, text string"), size=10)
    asked = spark.createDataFrame([*docs, ("none", "1 2"), ("long", docs[4][1] * 30_000)], "doc_id string, text string")
    one = {r.doc_id: r for r in lid.identify(asked, profiles, size=10).collect()}
    monkeypatch.setattr(lid, "MAX_LANGUAGES", 3)
    many = {r.doc_id: r for r in lid.identify(asked, profiles, size=10).collect()}
    assert one == many and all(one[k].lang_pred == k for k, _ in docs) and one["none"].lang_pred == "und" and one["long"].lang_pred == "l4"


def test_learned_counts_match_plain_ones(spark):
    from collections import Counter

    docs = [("x", "The cat, the hat"), ("x", "the dog"), ("y", "der hund"), ("y", None), (None, "skip")]
    got = {(r.lang, r.code): r.n for r in lid.learn_profiles(spark.createDataFrame(docs, "lang string, text string").repartition(3), size=10_000).collect()}
    want = Counter((k, int(c)) for k, t in docs if k and t for c in lid.ngrams(t))
    assert got == dict(want)
