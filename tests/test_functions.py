"""Text, chunk and vector functions against the rules they state."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import chunk
from marlstone.functions import text as tx
from marlstone.functions import vector as vec


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_normalize(spark):
    assert [value(spark, t, tx.normalize_text) for t in ("  hello   world  ", "", None, "a　 b\n")] == ["hello world", "", "", "a b"]


def test_tokenize(spark):
    assert value(spark, "HRB400 钢筋 标准", tx.tokenize) == ["hrb400", "钢筋", "标准"]
    assert value(spark, "a b c", tx.tokenize) == []
    assert value(spark, None, tx.tokenize) == []
    assert len(value(spark, "贵州省装配式建筑评价标准", tx.tokenize)[0]) > 1


def test_complexity_and_weights(spark):
    short, long = value(spark, "HRB400", tx.query_complexity), value(spark, "陶粒墙板 在城市更新 项目中的 节能指标 是多少 dB50", tx.query_complexity)
    assert short["specificity"] > 0 and short["length_factor"] < 0.5
    assert long["length_factor"] > 0.3 and long["specificity"] > 0
    for text in ("HRB400", "标准", "贵州省装配式建筑评价标准编号是什么", "", "one two three four five six seven eight nine ten"):
        w = value(spark, text, tx.adaptive_weights)
        assert abs(w["dense"] + w["sparse"] + w["colbert"] - 1) < 1e-3
    code, words = value(spark, "HRB400", tx.adaptive_weights), value(spark, "one two three four five six seven eight nine ten", tx.adaptive_weights)
    assert code["sparse"] > code["dense"] and words["dense"] > words["sparse"]


def test_entropy_is_that_of_the_tokens(spark):
    tokens = ["aa", "bb", "aa", "cc"]
    got = value(spark, " ".join(tokens), tx.query_complexity)["entropy"]
    p = [0.5, 0.25, 0.25]
    assert got == round(-sum(x * math.log(x + 1e-9) for x in p) / math.log(4), 4)


def test_hybrid_metadata(spark):
    m = value(spark, "HRB400 钢筋 标准 钢筋", tx.hybrid_metadata)
    lexicon = value(spark, "HRB400 钢筋 标准 钢筋", lambda c: tx.lexicon(tx.tokenize(c)))
    assert lexicon["钢筋"] > lexicon["hrb400"] and "钢筋" in m["sparse_lexicon"] and m["colbert_tokens"].count("token") == 4


def test_links(spark):
    got = value(spark, "[[A]] [[A|alias]] [[A#h]] [[.hidden]] [t](note.md) [t](http://x) [t](#a) [](y)", tx.links)
    assert [(x["concept_id"], x["display"]) for x in got] == [("a", "A"), ("a", "alias"), ("a", "A#h"), ("t", "t"), ("y", "y")]


def test_front_matter_and_tags(spark):
    note = "---\ntitle: 'T'\nempty:\ntags:\n  - a\n  - \"b\"\n---\n# Head\nbody ![[e]] [[x|y]]"
    assert value(spark, note, tx.front_matter) == {"title": "T"}
    assert value(spark, note, tx.tags) == ["a", "b"]
    assert value(spark, "---\ntags: a，b, c\n---\n", tx.tags) == ["a", "b", "c"]
    assert value(spark, note, lambda c: tx.note_text(tx.body(c))) == "# Head\nbody  y"
    assert value(spark, note, lambda c: tx.note_links(tx.body(c))) == ["x"]
    assert value(spark, note, lambda c: tx.title(tx.body(c), F.lit("f"))) == "Head"
    assert value(spark, "plain", tx.front_matter) == {} and value(spark, None, tx.body) == ""
    assert value(spark, "---\nopen: 1\nno end", tx.body) == "---\nopen: 1\nno end"


def test_clean_markdown(spark):
    assert value(spark, "# T\n\n**b** *i* `c` [l](u) ![a](i.png) <b>x</b> [[p|q]] [[p#h]]\n- item\n\n\n\nend ", tx.clean_markdown) == "T\n\nb i c l a x q p > h\n• item\n\nend"


def test_vector(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(
        vec.cosine_distance(F.col("a"), F.col("b")), vec.cosine_distance(F.col("a"), F.col("a")), vec.cosine_distance(F.col("a"), F.col("z"))
    )
    assert tuple(row.first()) == (1.0, 0.0, 1.0)


@given(st.text(alphabet="ab。，. \n", max_size=400), st.integers(60, 120))
@settings(max_examples=200, deadline=None)
def test_recursive_chunks_keep_all_words(text, size):
    chunks = chunk.recursive_chunks(text, size, 10, 1)
    letters = re.sub(r"[^ab]", "", text)
    joined = re.sub(r"[^ab]", "", "".join(chunks))
    assert len(joined) >= len(letters) and set(joined) == set(letters)
    assert all(len(c) <= 1.8 * size + 2 for c in chunks)


def test_recursive_edges():
    assert chunk.recursive_chunks(None) == [] and chunk.recursive_chunks("x" * 49) == []
    assert chunk.recursive_chunks("x" * 450) == ["x" * 450]
    assert [len(c) for c in chunk.recursive_chunks("x" * 1000)] == [450, 450, 300]


def test_window_chunks(spark):
    for n in (0, 49, 50, 450, 451, 800, 801, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = value(spark, text, chunk.fixed)
        assert (got == []) == (n < 50)
        if got:
            assert got[0] + "".join(c[100:] for c in got[1:]) == text
            assert all(len(c) <= 450 for c in got)
    assert value(spark, None, chunk.fixed) == [] and value(spark, "", chunk.hard) == []


def test_heading_chunks():
    assert chunk.note_chunks("short") == [("(整篇)", "short")] and chunk.note_chunks("  ") == []
    body = "# A\nintro " + "x" * 300 + "\n## B\nb text\n### C\nc text\n# D\nafter"
    assert [p for p, _ in chunk.note_chunks(body)] == ["(前言)", "A/B", "A/B"]
    long = "## S\n" + "y" * 1000
    assert all(len(c) <= 450 for _, c in chunk.note_chunks(long)) and len(chunk.note_chunks(long)) == 3


def test_sections_by_hand():
    text = "intro\n## two\nb\n# One\nunder one\n### three\nc\n## \nd\n#### four\ne\n# Next\n### deep\nf"
    want = [("(前言)", "intro"), ("two", "## two\nb\n# One\nunder one"), ("One", "### three\nc"), ("One", "## \nd\n#### four\ne\n# Next"), ("Next", "### deep\nf")]
    assert chunk.sections(text) == want
    assert chunk.sections("### x") == [("(未命名)", "### x")] and chunk.sections("") == []
    long = "# T\n" + "p" * 500 + "\n## S\n" + "q" * 300
    cut = chunk.note_chunks(long, 450, 100)
    assert [(p, len(c)) for p, c in cut] == [("(前言)", 450), ("(前言)", 154), ("T/S", 305)]
    assert chunk.note_chunks("short") == [("(整篇)", "short")] and chunk.note_chunks(None) == []


def test_recursive_chunks_by_hand():
    cut = lambda t: chunk.recursive_chunks(t, 20, 5, 5)
    assert cut("abc") == [] and cut("a" * 20) == ["a" * 20]
    assert cut("first part.\n\nsecond part.\n\nthird part is longer") == ["first part.\n\nsecond part.", "third part is longer"]
    assert cut("x" * 50) == ["x" * 20, "x" * 20, "x" * 20]
    assert cut("one two. three four. five six seven") == ["one two. three four", "five six seven"]


def test_front_matter_lists(spark):
    note = "---\ntitle: 'A: b'\ntags:\n  - x\n  - \"y z\"\nlinks: [p, 'q']\nempty:\ntitle: again\n---\nbody"
    assert value(spark, note, tx.front_matter_lists) == {"title": ["A: b"], "tags": ["x", "y z"], "links": ["p", "q"], "empty": []}
    assert value(spark, None, tx.front_matter_lists) == {} and value(spark, "no head", tx.front_matter_lists) == {}


def test_iso_timestamps(spark):
    import datetime as dt

    assert value(spark, "2024-05-01T10:20:30.5", tx.timestamp) == dt.datetime(2024, 5, 1, 10, 20, 30, 500_000)
    assert value(spark, "soon", tx.timestamp) is None and value(spark, None, tx.timestamp) is None
