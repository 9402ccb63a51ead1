"""BPE against the tokenizers library, and a round trip through Spark."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bpe, memo

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAbBéÉßΣσςİıǅ\x00\x1c\x85​ 　 'sTREvem 0123٣½Ⅷ漢字かなé😀👍🏽�_-.,!?\t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return bpe.WordBpe(f.read()), Tokenizer.from_file(PATH)


def test_like_the_library(both):
    mine, library = both
    draw = random.Random(5)
    texts = ["", "a", "the the", "x" * 3000, "thin" * 500, "<|endoftext|>a<|startoftext|>b", "<|endoftext|"]
    for i in range(1500):
        x = "".join(draw.choice(ODD) for _ in range(draw.randint(0, 40)))
        if i % 5 == 0:
            x += draw.choice(["<|endoftext|>", ""]) + "".join(draw.choice("abcdethin") for _ in range(draw.randint(50, 300)))
        texts.append(x)
    for text, ids in zip(texts, mine.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_block_and_single_trees_agree(both):
    mine, _ = both
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghinorst") for _ in range(draw.randint(1, 64))).encode() for _ in range(500)]
    for size in (2, 4, 8, 16, 32, 64):
        group = [w for w in words if size // 2 < len(w) <= size]
        if group:
            assert mine.merge_block(group, size) == [mine.merge_long(w).astype("<u4").tobytes() for w in group]


def test_memo_keeps_what_is_used():
    memo = bpe.Memo(3)
    assert set(memo.missing({"a", "b"})) == {"a", "b"}
    memo.young.update(a=1, b=2)
    assert set(memo.missing({"a", "c", "d"})) == {"c", "d"}  # a new generation
    assert memo.young == {"a": 1} and memo.old["b"] == 2


def test_frames(spark):
    rows = [(1, "Hello World"), (2, None), (3, ""), (1, "Hello World")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as ids")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert {(r.doc_id, r.decoded) for r in out} == {(1, "hello</w> world</w>"), (2, ""), (3, "")} and len(out) == 4
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_round_trip_in_one_pass(spark):
    """The same as encode and then decode, with nulls, empty texts, repeats and clashing names."""
    rows = [(1, "Hello, World! naïve <|endoftext|> 日本語", "a"), (2, None, "b"), (3, "", "c"), (1, "Hello, World!", "d"), (None, "x" * 5_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _Coded string").withColumn("ids", F.lit(7)).withColumn("decoded", F.lit("old"))
    got = bpe.round_trip(df, PATH)
    want = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(got.columns) == sorted(want.columns)
    take = lambda rs: sorted((r._Coded, r.doc_id or -1, bytes(r.ids), r.decoded) for r in rs)
    assert take(got.collect()) == take(want.collect())
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_a_worker_keeps_one_operators_models():
    made = []
    one = memo.of_worker("one", lambda: made.append(1) or "first")
    assert memo.of_worker("one", lambda: made.append(2)) == one == "first" and made == [1]
    memo.of_worker("two")
    assert memo.of_worker("one", lambda: "again") == "again" and list(memo._kept) == ["one"]
