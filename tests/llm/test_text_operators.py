"""Token counts, URL filters and chat formatting against plain versions."""

import datetime as dt
import random

import public_tokenizers
from pyspark.sql import functions as F

from marlstone.llm import chat_format, token_counts, url_filters
from marlstone.llm.storage import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_trie_scores_match_plain_viterbi():
    with open(VOCABULARY, "rb") as f:
        model = token_counts.Unigram(f.read())
    words = [w.encode() for w in ["", "a", "the", " the", " there", " thereby", "theref", "日本語", " naïve", "x" * 300, "<|endoftext|>", "ab" * 40]]
    for word, n in model.terminal_counts(words).items():
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            best.append(min((best[s][0] + model.cost[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in model.cost))
        assert n == best[-1][1]


def test_token_counts(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (1, "the cat"), (4, "a" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id, r.n_tokens, r.n_pretokens) for r in token_counts.count_tokens(df, VOCABULARY).collect())
    assert got[:4] == [(1, 2, 2), (1, 2, 2), (2, 0, 0), (3, 0, 0)] and got[4][1] >= 1
    assert token_counts.count_tokens(df.limit(0), VOCABULARY).count() == 0


def test_url_filters(spark):
    day = dt.date(2024, 1, 10)
    entries = [
        ("domain", "bad.com", "block", "add", dt.date(2024, 1, 1)), ("domain", "bad.com", "block", "remove", day), ("domain", "bad.com", "block", "add", dt.date(2024, 1, 20)),
        ("domain", "ok.bad.com", "allow", "add", dt.date(2024, 1, 5)), ("path", "news.org/ads", "block", "add", dt.date(2024, 1, 1)), ("path", "news.org/ads", "block", "add", dt.date(2024, 1, 1)),
        ("domain", "same.net", "block", "add", day), ("domain", "same.net", "block", "remove", day), ("domain", None, "block", "add", day), ("domain", "later.io", "block", "add", dt.date(2025, 1, 1)),
    ]
    e = spark.createDataFrame(entries, "kind string, value string, verdict string, action string, day date")
    cases = [
        ("http://bad.com/x", dt.date(2024, 1, 9), True), ("http://bad.com/x", day, False), ("HTTP://U@WWW.Bad.com:80?q", dt.date(2024, 2, 1), True), ("https://a.ok.bad.com/", dt.date(2024, 1, 6), False),
        ("https://a.ok.bad.com/", dt.date(2024, 1, 4), True), ("https://news.org/ads/1#f", day, True), ("https://news.org/adsx", day, False), ("https://notbad.com/", day, False), ("https://same.net", day, False),
        ("https://later.io", day, False), (None, day, False), ("", day, False), ("no url", day, False), ("http://bad.com/x", None, False), ("http://bad.com/x", dt.date(2024, 1, 9), True),
    ]
    c = spark.createDataFrame([(i, u, d, b, "clash") for i, (u, d, b) in enumerate(cases)], "i int, url string, day date, want boolean, blocked string")
    got = url_filters.filter_urls(c, e).collect()
    assert len(got) == len(cases) and all(r.blocked == r.want for r in got), [r for r in got if r.blocked != r.want]
    assert {r.matched_value for r in got if r.i == 3} == {"ok.bad.com"}
    assert url_filters.filter_urls(c, e.limit(0)).where("blocked").count() == 0
    assert url_filters.filter_urls(c.limit(0), e).count() == 0


def test_url_filters_of_odd_hosts_and_long_lists(spark, monkeypatch):
    day = dt.date(2024, 1, 10)
    e = spark.createDataFrame([("domain", v, "block", "add", day) for v in ("bad.com", "[2001:db8::1]")], "kind string, value string, verdict string, action string, day date")
    urls = ["http://bad.com./x", "http://u@[2001:DB8::1]:80/", "http://[2001:db8::2]/", "http://com./", "http://./"]
    c = spark.createDataFrame([(u, day) for u in urls], "url string, day date")
    want = [True, True, False, False, False]
    found = lambda: {r.url: r.blocked for r in url_filters.filter_urls(c, e).collect()}
    assert found() == dict(zip(urls, want, strict=True))
    monkeypatch.setattr(url_filters, "LISTED", 1)  # the list is joined, not broadcast
    assert found() == dict(zip(urls, want, strict=True))


def test_a_full_trie_starts_anew(monkeypatch):
    with open(VOCABULARY, "rb") as f:
        raw = f.read()
    texts = ["the cat there thereby " * 3, None, "naïve naïvely 日本語", "x" * 500]
    whole = list(token_counts.Unigram(raw).count_batch(texts))
    monkeypatch.setattr(token_counts, "TRIE_NODES", 3)
    small = token_counts.Unigram(raw)
    assert [n for t in texts for n in small.count_batch([t])] == whole


def test_token_count_columns_of_clashing_names(spark):
    df = spark.createDataFrame([("a b", "x", "y")], "text string, n_pretokens string, _counts string")
    assert token_counts.count_tokens(df, VOCABULARY).first().n_pretokens == 2


def test_a_crowded_stretch_is_dealt(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.choice([None, None, 0, 5, 300]), draw.choice(["ann", "bob", "system", None]), draw.choice(["same", "same", "x", "", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = sorted(map(str, chat_format.rotate(df).collect()))
    monkeypatch.setattr(chat_format, "CROWD", 20)
    monkeypatch.setattr(chat_format, "PART_ROWS", 8)
    parts = chat_format._parts(df.selectExpr("conv_id as conv", "turn", "coalesce(role, 'unknown') as speaker", "coalesce(text, '') as body"), Scratch(spark, "t"))
    sizes = parts.groupBy("conv", "stretch", "part").count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) < 60 and parts.count() == 300
    assert sorted(map(str, chat_format.rotate(df, scratch=Scratch(spark, "t")).collect())) == whole


def test_chat_perspectives(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 300, "ann", "<|im_end|> trick"), (1, None, "cy d", "first"), (1, 2, "bob", None),
        (None, 1, None, "x"), (2, 0, "system", "alone"), (3, 5, "ann", "solo"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = chat_format.rotate(df).collect()
    dialogues: dict = {}
    for r in sorted(got, key=lambda r: (r.conv_id or -1, r.perspective, r.seq)):
        dialogues.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (1, "cy d"), (None, "unknown"), (3, "ann")}
    for (_, who), parts in dialogues.items():
        whole = "".join(r.piece for r in parts)
        assert [r.seq for r in parts] == list(range(1, len(parts) + 1))
        for r in parts:
            assert whole[r.start : r.end] == r.piece and r.learned == (r.speaker == who)
            words = whole[r.learned_from : r.end]
            assert (words != "") == r.learned and ("<|im_start|>" not in words)
    ann = "".join(r.piece for r in dialogues[(1, "ann")])
    assert ann.startswith("<|im_start|>user name=cy_d\nfirst<|im_end|>\n<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n") and "< |im_end| > trick" in ann
    assert ann.count("user name=bob") == 2 and chat_format.rotate(df.limit(0)).count() == 0
