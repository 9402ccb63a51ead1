"""One very long token through the text operators, and edge cases of single ones."""

import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe, divergence, exact_topk, language_id, ngram_jaccard
from marlstone.llm.registry import vocabulary
from marlstone.llm.storage import Scratch, prepare

LONG = "(" + "a" * 1_000_000 + ")"


@pytest.fixture(scope="module")
def texts(spark):
    prepare(spark)
    rows = [(1, LONG, "en", "s"), (2, "the cat and the dog", "en", "s"), (3, "der hund und die katze", "de", "s"), (4, "the cat and the dog", "en", "t"), (5, None, None, None), (6, "", "de", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", ["language", "jaccard", "bpe", "divergence"])
def test_a_very_long_token(spark, texts, name):
    began = time.perf_counter()
    if name == "language":
        found = language_id.identify(texts.select("doc_id", "text"), language_id.learn_profiles(texts.select("text", "lang")))
        assert {r.doc_id: r.lang_pred for r in found.collect()}[5] == language_id.UNDETERMINED
    elif name == "jaccard":
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_documents(texts.select("doc_id", "text"), Scratch(spark, "t")).collect()}
        assert found[1] == (1, 1) and found[4] == (1, 2) and found[5] == (0, 5)
    elif name == "bpe":
        path = vocabulary()
        found = bpe.decode(bpe.encode(texts.select("doc_id", F.substring("text", 1, 200_000).alias("text")), path), path).collect()
        whole = Tokenizer.from_file(path)
        for r in found:
            ids = whole.encode(r.text or "", add_special_tokens=False).ids
            assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == whole.decode(ids, skip_special_tokens=False)
    else:
        assert divergence.audit(texts.select("text", "lang", "source"), Scratch(spark, "t"), support=1).where("part = 'pair'").count() > 0
    assert time.perf_counter() - began < 90


def test_language_id_without_rows_and_with_clashing_names(spark, texts):
    profiles = language_id.learn_profiles(texts.select("text", "lang"))
    clash = texts.select("doc_id", "text", F.lit("x").alias("lang_pred"), F.lit("y").alias("score"), F.lit("z").alias("distance"))
    rows = language_id.identify(clash.unionByName(clash), profiles).collect()
    assert len(rows) == 12 and {r.lang_pred for r in rows if r.doc_id == 3} == {"de"} and all(0 <= r.score <= 1 for r in rows)
    assert language_id.identify(texts.select("doc_id", "text").limit(0), profiles).count() == 0
    nothing = language_id.learn_profiles(texts.select("text", "lang").limit(0))
    assert {r.lang_pred for r in language_id.identify(texts.select("doc_id", "text"), nothing).collect()} == {language_id.UNDETERMINED}
    same = language_id.learn_profiles(spark.createDataFrame([("abc abd", "b"), ("abc abd", "a")], "text string, lang string"))
    tie = spark.createDataFrame([(1, "abc abd")], "doc_id long, text string")
    assert language_id.identify(tie, same).first().lang_pred == "a"


def test_exact_topk_over_shards_with_ties_and_odd_widths(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0]), (101, [2.0, 2.0, 2.0]), (102, None), (103, [None, 1.0]), (104, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = exact_topk.top_k(df, F.col("vec_id") % 4 == 0, 5, Scratch(spark, "t"))
    prepare(spark)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    whole = {i: [int(256 * c // 1) for c in v] for i, v in rows if v and None not in v and v[0] == v[0]}
    for q in [i for i in whole if i % 4 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert [found.get((q, n)) for n in range(1, len(best) + 1)] == [(i, -s) for s, i in best]
