"""Whitening against a plain eigendecomposition, the source audit against plain counts, rules against their trees."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from marlstone.llm import divergence, quality, token_counts, toxicity, whitening
from marlstone.llm.registry import BYTE_RANKS, op11_whitening, op13_quality, vocabulary
from marlstone.llm.storage import Scratch

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_rank_one_update(d):
    draw = np.random.default_rng(d)
    values, z = np.sort(draw.random(d)), draw.normal(size=d)
    if d > 4:
        values[2:5] = values[2]  # equal values and an entry of nothing: deflated
        z[1] = 0
    found, vectors = whitening.rank_one(values, z)
    whole = np.diag(values) + np.outer(z, z)
    assert np.allclose(found, np.linalg.eigvalsh(whole), atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    assert np.allclose(vectors * found @ vectors.T, whole, atol=1e-12)


def test_spectra_combine_to_the_spectrum_of_all():
    x = np.floor(64 * np.random.default_rng(2).normal(size=(500, 9)) * np.arange(1, 10))
    x[:, 3] = x[:, 2]
    parts = [whitening.Spectrum(9) for _ in range(4)]
    for i, row in enumerate(x):
        parts[min(3, i // 150)].add(row)
    for part in parts[1:]:
        parts[0].combine(part)
    parts[0].combine(whitening.Spectrum(9))
    whole = np.cov(x.T, bias=True) * 500
    assert parts[0].n == 500 and np.allclose(parts[0].mean, x.mean(0))
    assert np.allclose(parts[0].vectors * parts[0].values @ parts[0].vectors.T, whole, rtol=1e-9, atol=1e-6)
    parts[0].refresh()
    assert np.allclose(parts[0].vectors * parts[0].values @ parts[0].vectors.T, whole, rtol=1e-9, atol=1e-6)


def plain_whitening(x: np.ndarray):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (n * x - sums) / n @ vectors[:, :16] / np.sqrt(values[:16]), values / values.sum()


def test_whitening_of_the_given_embeddings(spark):
    got = op11_whitening(spark, DATA).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack([np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for v in rows["embedding"]])
    n, deviation, whitened, explained = plain_whitening(x)
    assert got["vec_id"].tolist() == np.repeat(rows["vec_id"], 16).tolist() and set(got["n"]) == {n}
    assert got["deviation"].tolist() == np.repeat(deviation, 16).tolist()
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(-1, 16)), np.abs(whitened), atol=1e-8)
    assert np.allclose(got["explained"].to_numpy()[:16], explained[:16], rtol=1e-9) and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10


def test_whitening_over_many_parts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FILE_ROWS", 20)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    monkeypatch.setattr(whitening, "REFRESH", 16)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 5)) @ draw.normal(size=(5, 5))
    x[:, 4] = 0.25  # without variance
    x[300:] = x[7]  # a hot vector
    rows = [(i if i else None, v.tolist(), "clash", "clash") for i, v in enumerate(x)]
    rows += [(900, None, "", ""), (901, [], "", ""), (902, [1.0, None], "", ""), (903, [float("nan")] * 5, "", ""), (904, [float("inf")] * 5, "", "")]
    rows += [(i, [float(i), float(i * i % 7)], "", "") for i in range(1000, 1008)] + [(2000, [1.0, 2.0, 3.0], "", "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, whitened string").repartition(6)
    got = whitening.whiten(df, Scratch(spark, "w")).toPandas()
    five = got[(got["vec_id"] < 900) | got["vec_id"].isna()].sort_values(["vec_id", "component"], na_position="first")
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, deviation, _, _ = plain_whitening(whole)
    values, vectors = np.linalg.eigh(np.cov(np.unique(whole, axis=0).T, bias=True))
    want = (n * whole - np.unique(whole, axis=0).sum(0)) / n @ vectors[:, :0:-1] / np.sqrt(values[:0:-1])
    assert len(five) == 400 * 4 and set(five["n"]) == {n} and five["deviation"].tolist() == np.repeat(deviation, 4).tolist()
    assert np.allclose(np.abs(five["whitened"].to_numpy().reshape(-1, 4)), np.abs(want), atol=1e-8)
    two = got[got["vec_id"].between(1000, 1007)]
    assert len(two) == 16 and set(two["n"]) == {8}  # another width is another space
    assert not got["vec_id"].isin([900, 901, 902, 903, 904, 2000]).any()
    assert whitening.whiten(df.limit(0), Scratch(spark, "w")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge, Scratch(spark, "w")).toPandas()
    assert got["deviation"].tolist().count((1 << 63) - 1) >= 2 and np.isfinite(got["whitened"]).all()


def plain_audit(rows, support, top):
    said = lambda text: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    docs = [(said(t), lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        held = Counter(t for words, *_ in mine for t in set(words))
        kept = sorted(t for t, n in held.items() if n >= support)

        def shares(some):
            n = Counter(t for words, *_ in some for t in words if t in set(kept))
            return n, {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        groups = {s: shares([d for d in mine if d[2] == s]) for s in {d[2] for d in mine}}
        whole = shares(mine)[1]
        for s, (n, p) in groups.items():
            pairs = [(sum(abs(p[t] - q[t]) for t in kept), other) for other, (_, q) in groups.items() if other != s]
            terms = [(p[t] - whole[t], t) for t in kept if n[t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def test_audit_of_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 64)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "_HELD", 50)
    monkeypatch.setattr(divergence, "_AND_WORDS", 8)
    draw = random.Random(4)
    vocabulary_of = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Ünder", "ÜNDER", "日本語", "𝄞𝄞", "i", "İ"]
    rows = []
    for _ in range(400):
        words = draw.choices(vocabulary_of, weights=[1 / (i + 1) for i in range(len(vocabulary_of))], k=draw.randint(0, 60))
        rows.append((draw.choice([" ", "\n", "-", "1", "_"]).join(words).title() if draw.random() < 0.3 else " ".join(words), draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "c", "d", "é", "", None])))
    rows += [(None, "en", "empty"), ("", "xx", "a"), ("lonely", "xx", "b"), ("one two", "yy", "only")] + [("wab wab wac", "en", "hot")] * 300
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, item string, n int").repartition(5)
    got = [tuple(r) for r in divergence.audit(df, Scratch(spark, "d"), support=5, top=20).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 5, 20)
    assert divergence.audit(df.limit(0), Scratch(spark, "d")).count() == 0


def test_a_pair_has_one_value_in_whatever_order_its_blocks_come(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 64)
    draw = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(" ".join(draw.choices(words, k=40)), "en", f"s{draw.randrange(12)}") for _ in range(200)]
    bound, joined = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(bound, "-1")  # sources are dealt by block, as in larger tables
    spark.conf.set(joined, "false")
    try:
        got = [tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"), Scratch(spark, "d"), support=5, top=20).collect()]
    finally:
        spark.conf.unset(bound)
        spark.conf.unset(joined)
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 5, 20)


def test_joint_cells_and_terms():
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 2, (5, 128), np.uint8), draw.integers(0, 2, (3, 128), np.uint8)
    words = lambda x: np.packbits(x, axis=1, bitorder="little").view(np.uint64)
    assert (divergence.joint_cells(words(a), words(b)) == a.astype(int) @ b.T.astype(int)).all()
    assert divergence.terms("Don't ÀB_c1x") == ["don".encode(), b"t", "Àb".encode(), b"c", b"x"] and divergence.terms(None) == []


def test_quality_on_held_out_rows(spark):
    got = op13_quality(spark, DATA).toPandas()
    known = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(got) == docs and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got.merge(known, on="doc_id")
    held = held[held["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.9 and (held[held["quality"] == 1]["predicted"] == 1).mean() >= 0.98


def test_rules_are_the_paths_of_trees_and_compile_to_columns(spark):
    draw = np.random.default_rng(6)
    x = draw.random((300, len(quality.STATISTICS)))
    rows = [(Vectors.dense(v), int(v[0] > 0.5 and v[3] < 0.4)) for v in x]
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1, featuresCol="features", labelCol="label").fit(spark.createDataFrame(rows, ["features", "label"]))
    for tree in forest.trees:
        rules = list(quality.paths(tree._java_obj.rootNode()))
        assert len(rules) == tree.numNodes - 1
        for v in x[:20]:
            holds = sum(all(v[i] <= bound if at_most else v[i] > bound for i, at_most, bound in r) for r in rules)
            assert holds == len(_path(tree._java_obj.rootNode(), v))
    rule = quality._tightest(((1, True, 0.7), (1, True, 0.5), (2, False, 0.1), (2, False, 0.3)))
    assert rule == ((1, True, 0.5), (2, False, 0.3))
    model = quality.RuleEnsemble([(rule, 2.0), (((0, True, 0.5),), -1.0)], 0.25)
    table = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], list(quality.STATISTICS)).select(F.struct(*quality.STATISTICS).alias("_statistics"))
    for v, r in zip(x, table.select(model.expression().alias("s")).collect(), strict=False):
        total = 0.25 + 2.0 * (v[1] <= 0.5 and v[2] > 0.3) - (v[0] <= 0.5)
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)))


def _path(node, v):
    found = []
    while node.subtreeDepth():
        split = node.split()
        node = node.leftChild() if v[split.featureIndex()] <= split.threshold() else node.rightChild()
        found.append(node)
    return found


def test_quality_edge_cases(spark):
    good = ["A plain sentence of some words stands here, and another one follows it. " * 3 + str(i) for i in range(150)]
    bad = [f"SPAM!! SPAM!! {i} ### *** " * 12 for i in range(150)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    rows += [(900, None, "", ""), (901, "", "", ""), (902, " \n\t", "", ""), (903, "x" * 1_000_000, "", ""), (904, "(" + "a-" * 200_000, "", ""), (None, good[0], "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, _row string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(df, labels, Scratch(spark, "q"))
    assert model.rules and len(model.rules) < 200
    got = {r.doc_id: r for r in model.score(df).collect()}
    assert len(got) == len(rows) and got[None].predicted == 1 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == 1 - i % 2 for i in range(300)) and got[900].score == got[901].score == got[902].score
    assert set(model.score(df).columns) == {"doc_id", "text", "score", "_row", "predicted"} and model.score(df.limit(0)).count() == 0
    assert {r.score for r in quality.train(df, labels.where("quality = 1"), Scratch(spark, "q")).score(df).collect()} == {1.0}
    assert {r.score for r in quality.train(df.limit(0), labels, Scratch(spark, "q")).score(df).collect()} == {0.0}


def test_statistics_by_plain_counts():
    describer = quality.Describer()
    describer.TOKENS = 3  # the table starts anew all the time
    for text in ("One two two THREE!!\none two\none two\n\n### 12 a1", "é É ß", "| | x", "A" * 50):
        got, tokens = dict(zip(quality.STATISTICS, describer.statistics(text), strict=True)), text.split()
        chars, lines = sum(map(len, tokens)), [x for x in text.split("\n") if x.strip()]
        assert got["word_length"] == chars / len(tokens) and got["distinct_words"] == len(set(tokens)) / len(tokens)
        runs = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
        assert got["distinct_runs"] == (len(set(runs)) / len(runs) if runs else 1.0) and got["commonest_word"] == max(Counter(tokens).values()) / len(tokens)
        letters = sum(map(str.isalpha, text))
        assert got["letters"] == letters / chars and got["capitals"] == sum(map(str.isupper, text)) / max(1, letters)
        assert got["marks"] == pytest.approx((chars - letters - sum(map(str.isdigit, text))) / chars) and got["repeated_lines"] == 1 - len(set(lines)) / len(lines)
        assert got["symbol_words"] == sum(not any(map(str.isalnum, t)) for t in tokens) / len(tokens)


#: What the linear scan for disguised words finds, as one pattern that goes over a run again from each of its letters.
TANGLED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._\-]+[^\W\d_]+)+|[^\W\d_]*[0-9@$]+[^\W\d_]+")


def test_tangled_words_in_one_pass():
    draw = random.Random(7)
    for _ in range(20_000):
        text = "".join(draw.choice("ab1@-(é_٣") for _ in range(draw.randint(0, 12)))
        assert toxicity.tangled(text) == TANGLED.findall(text)
    writing = toxicity.Writing({"aa": 1.0}, {})
    for token in ("(" + "a" * 1_000_000 + ")", "a@(" * 300_000, "@" * 1_000_000):
        began = time.perf_counter()
        writing.features(token)
        assert time.perf_counter() - began < 10


def test_a_long_word_needs_no_trie():
    with open(vocabulary(BYTE_RANKS), "rb") as f:
        model = token_counts.Unigram(f.read())
    draw = random.Random(8)
    for n in (1, 2, 37, 3_000):
        word = "".join(draw.choice("etaoin") for _ in range(n)).encode()
        assert model.long_count(word) == model.terminal_counts([word])[word]
    model._clear()
    (tokens, words), (_, one) = model.count_batch(["ab" * 1_000_000 + " x", "y"])
    assert words == 2 and one == 1 and tokens > 1_000 and len(model.score) < 10 and all(len(w) < 10 for w in model.memo.young)
