"""Toxicity, and the pipeline against what each stage promises."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import language_id, toxicity
from marlstone.llm.registry import op5_toxicity, vocabulary
from marlstone.llm.storage import Scratch

DATA = "/root/testdata/sf0.01"
#: disguised words as one pattern
TANGLED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._\-]+[^\W\d_]+)+|[^\W\d_]*[0-9@$]+[^\W\d_]+")


def labelled(n=600):
    draw = np.random.default_rng(8)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 5))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(20)], int(i % 3 == 0)
        if toxic:
            words[int(draw.integers(20))] = str(draw.choice(["zorkish", "blarg", "grumph"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_learns_its_lexicon(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(7000, None), (7001, ""), (7002, "You BLARG!!"), (7002, "You BLARG!!")], "doc_id long, text string").selectExpr("*", "'clash' as score", "1 as predicted")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, Scratch(spark, "t"))
    got = model.score(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = sum(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert right >= 0.95 * len(rows)
    assert {r.predicted for r in got if r.doc_id in (7000, 7001)} == {0}
    assert {("word", "blarg"), ("word", "grumph")} <= {e[:2] for e in model.lexicon}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    none = toxicity.train(docs, labels.limit(0), Scratch(spark, "t")).score(docs).collect()
    assert [r.score for r in none] == [0, 0]
    assert [r.score for r in toxicity.train(docs, labels, Scratch(spark, "t")).score(docs).collect()] == [1, 1]


def test_toxicity_features():
    words, stems = {"idiot": 5.0}, {"lowe": 3.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU idiot! loweichen id10t i-d-i-o-t", words, stems), strict=True))
    assert f["near_second_person"] > 0 and f["hidden_hits"] == np.log1p(2) and f["stem_peak"] == 3 and f["capitals"] > 0 and f["exclamations"] > 0
    assert toxicity.features(None, words, stems) == toxicity.features("", words, stems) and not any(toxicity.features("", words, stems))


def test_held_out_ranking(spark):
    found = op5_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = found[found.toxic == 1].score.to_numpy(), found[found.toxic == 0].score.to_numpy()
    auc = ((toxic[:, None] > clean).mean() + 0.5 * (toxic[:, None] == clean).mean()) if len(toxic) and len(clean) else 1
    assert auc >= 0.6  # few labels at this size


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    found = op5_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = found[found.toxic == 1]
    assert len(toxic) and (found.predicted == found.toxic).mean() >= 0.95 and toxic.predicted.mean() >= 0.9


def test_toxicity_of_odd_tables(spark):
    rows = [(r[0], r[1]) for r in labelled(300)]
    docs = spark.createDataFrame([*rows, (9000, "fine words " * 200_000), (9001, "grumph " * 100_000)], "doc_id long, text string")
    labels = [(r[0], r[2]) for r in labelled(300)]
    again = spark.createDataFrame([*labels, *labels[:50], (0, 0), (0, 1)], "doc_id long, toxic int")  # repeated, and one key with both
    model = toxicity.train(docs, again, Scratch(spark, "t"))
    got = {r.doc_id: r for r in model.score(docs).collect()}
    assert len(got) == 302 and got[9000].predicted == 0 and got[9001].predicted == 1
    assert model.score(docs.limit(0)).count() == 0
    assert toxicity.train(docs.limit(0), again, Scratch(spark, "t")).score(docs).where("score <> 0").count() == 0


def test_features_are_those_of_a_plain_count():
    words, stems = {"idiot": 5.0, "blarg": 2.5}, {"lowe": 3.0}
    writing = toxicity.Writing(words, stems)
    writing.TOKENS = 3  # the table starts anew all the time
    for text in ("you IDIOT, loweichen! id10t a_b x.y BLARG blarg.\x1cidiot", "é̂ ΑΣ Σas! İdiot", "..., 12 $a", "you " * 5 + "z " * 9 + "idiot"):
        tokens = toxicity._WORD.findall(text.lower())
        f = dict(zip(toxicity.FEATURES, writing.features(text), strict=True))
        hit = [i for i, t in enumerate(tokens) if t in words or (len(t) > 4 and t[:4] in stems)]
        near = sum(any(t in toxicity.SECOND_PERSON for t in tokens[max(0, i - 3) : i + 4]) for i in hit)
        assert f["log_words"] == np.log1p(len(tokens)) and f["word_hits"] == np.log1p(sum(t in words for t in tokens))
        assert f["near_second_person"] == near / max(1, len(hit)) and f["capitals"] == sum(map(str.isupper, text)) / max(1, len(text))
        assert f["disguised"] == len(TANGLED.findall(text.lower())) / max(1, len(tokens)) and f["punctuation"] == len(toxicity._MARKS.findall(text)) / max(1, len(text))
        assert f["shouted"] == sum(t.isupper() and len(t) > 2 for t in toxicity._WORD.findall(text)) / max(1, len(tokens))


def test_pipeline(spark, tmp_path):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()[:250]
    rows += [{**rows[3], "doc_id": 90_000}, {**rows[4]}, {**rows[5], "doc_id": 90_001, "text": None}, {**rows[6], "doc_id": 90_002, "text": "123 456"}, {**rows[7], "doc_id": None}]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        seen[name] = (docs, out)
        docs = out
    before, after = seen["language_id"]
    profiles = language_id.learn_profiles(before)
    known = language_id.identify(before, profiles).where("lang_pred <> 'und'").count()
    assert after.count() == known and 90_001 not in {r.doc_id for r in after.collect()}
    ids = [r.doc_id for r in seen["ngram_jaccard"][1].collect()]
    assert len(ids) == len(set(ids)) and 90_000 not in ids
    unmixed = {r.doc_id: r.text for r in seen["mixing"][0].collect()}
    mixed = seen["mixing"][1].collect()
    words = lambda t: len(t.split())
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * sum(map(words, unmixed.values()))) <= 20 * max(map(words, unmixed.values()))
    library = Tokenizer.from_file(vocabulary())
    coded = seen["bpe"][1].collect()
    assert len(coded) == len(mixed)
    for r in coded[:60]:
        want = library.encode(unmixed[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in coded)


def test_rows_without_or_with_shared_ids_stay(spark, tmp_path):
    """Stages decide by row: nothing clean goes for its id, and columns named like a model's output pass."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b").upper()), (5, text("c")), (5, text("d")), (6, text("d") + " more"), (7, text("e")), (7, text("e")), (8, text("e"))]
    docs = spark.createDataFrame([(*r, "en", "src0", 0.25) for r in rows], "doc_id long, text string, lang string, source string, score double")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), str(tmp_path))
    seen = sorted((r.doc_id or 0, r.text.split()[0].lower()) for r in kept.collect())
    assert kept.columns == docs.columns and seen == [(0, "a0"), (0, "b0"), (5, "c0"), (5, "d0"), (7, "e0")]
    mixed = [(r.doc_id or 0, r.text.split()[0]) for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()]
    assert 1.5 * 9 - 1 <= len(mixed) <= 1.5 * 9 + 1 and max(map(mixed.count, mixed)) <= 4  # two of each row, (7, e) is there twice
    assert {(0, "a0"), (0, "b0"), (5, "c0"), (5, "d0")} <= set(mixed)
    docs.select(docs.doc_id, "text").where("doc_id is not null").selectExpr("doc_id", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.score for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()} == {0.25}


def test_few_labels_and_empty_tables_drop_nothing(spark, tmp_path):
    rows = [(i, f"text number {i} with words of its own w{i}", "en", "src0", 9, 0.123, "x") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _text string")
    spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.count() == 8 and kept.columns == docs.columns
    known = corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path))
    assert known.columns == docs.columns and {(r.score, r._text) for r in known.collect()} == {(0.123, "x")}
    docs.drop("score", "_text").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_keep_columns_of_clashing_names(spark, tmp_path):
    rows = [(i, f"w{i} " * 9, "src0", "a", "b", "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _copies string, _key string")
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {(r._id, r._copies, r._key) for r in out.collect()} == {("a", "b", "c")}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.withColumn("_first", docs.doc_id), str(tmp_path))
    assert kept.count() == 20 and kept.columns == [*docs.columns, "_first"]
