"""Related concepts of hubs, the graph kept up by changes, and the index of names, each against the plain way."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, name_index
from marlstone.plans import graph_store, nightly
from marlstone.session import Store
from marlstone.sources import tables

LINKS = "source string, links array<struct<concept_id: string, display: string>>"


def plain_related(rows, k=5):
    by = {}
    for source, concept in set(rows):
        by.setdefault(source, set()).add(concept)
    shared = Counter((a, b) for held in by.values() for a in held for b in held if a != b)
    out = []
    for concept in {c for _, c in rows}:
        best = sorted(((-n, b) for (a, b), n in shared.items() if a == concept))[:k]
        out += [(concept, i, b, -n) for i, (n, b) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("hub", [2, 5, 9])
def test_related_concepts_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    draw = random.Random(hub)
    rows = [(f"s{draw.randint(0, 25)}", f"c{min(draw.randint(0, 40), draw.randint(0, 40))}") for _ in range(330)] + [("big", f"c{i}") for i in range(40)] + [("big2", f"c{i}") for i in range(20, 40)]
    edges = spark.createDataFrame(rows, "source string, concept_id string")
    want = plain_related(rows)
    assert sorted(map(tuple, graph.related(edges).collect())) == want
    some = spark.createDataFrame([("c1",), ("c33",), ("none",)], "concept_id string")
    assert sorted(map(tuple, graph.related(edges, of=some).collect())) == [r for r in want if r[0] in ("c1", "c33")]


def test_a_large_hub_isnt_written_out(spark, monkeypatch):
    n = 20_000
    rows = spark.range(n).select(F.lit("hub").alias("source"), F.format_string("c%05d", "id").alias("concept_id"))
    rows = rows.unionByName(spark.createDataFrame([("s1", "c19999"), ("s1", "c10000"), ("s2", "c00003"), ("s2", "c00004")], "source string, concept_id string"))
    counted = []
    monkeypatch.setattr(graph, "_class_pairs", lambda *a, f=graph._class_pairs: counted.append(tables.settle(f(*a))) or counted[-1])
    got = {(r.concept_id, r.rank): (r.related_id, r.shared) for r in graph.related(rows).where("concept_id in ('c19999', 'c00000', 'c00003')").collect()}
    assert got["c19999", 1] == ("c10000", 2) and got["c19999", 2] == ("c00000", 1) and got["c00000", 1] == ("c00001", 1) and got["c00003", 1] == ("c00004", 2) and len(got) == 15
    assert counted[0].count() == 1  # of 400 000 000 pairs: one pair of classes, ten partners for each concept


def plain_graph(notes):
    edges = Counter((source, c) for source, links in notes.items() for c, _ in links if c)
    shown = {}
    for source, links in notes.items():
        for c, display in links:
            shown.setdefault((source, c), display)
    return {c: (shown[min(s for s, d in edges if d == c), c], sum(n for (_, d), n in edges.items() if d == c), sum(d == c for _, d in edges)) for c in {c for _, c in edges}}


def test_the_stored_graph_is_the_one_built_anew(spark, tmp_path, monkeypatch):
    store, draw, notes = Store(str(tmp_path / "s")), random.Random(5), {}
    links = lambda: [(c, c.upper() + str(draw.randint(0, 3))) for c in draw.choices("abcdefghij", k=draw.randint(0, 6))]
    frame = lambda names: spark.createDataFrame([(s, notes[s]) for s in names], LINKS)
    state = lambda: {r.concept_id: (r.concept_name, r.total_mentions, r.n_sources) for r in graph_store.concepts(spark, store).collect()}
    for run in range(4):
        changed = {f"n{draw.randint(0, 12)}" for _ in range(12 if run == 0 else 3)}
        gone = {s for s in list(notes) if draw.random() < 0.15} - changed
        for s in changed:
            notes[s] = links()
        for s in gone:
            del notes[s]
        lost = spark.createDataFrame([(s,) for s in gone], "source string")
        if run == 2:  # ends after the edges, before the totals
            with monkeypatch.context() as m:
                m.setattr(graph_store, "_catch_up", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
                with pytest.raises(KeyboardInterrupt):
                    graph_store.update(spark, store, frame(changed), lost, f"r{run}")
        for _ in range(2 if run == 3 else 1):  # again changes nothing
            touched = graph_store.update(spark, store, frame(changed), lost, f"r{run}")
        assert state() == plain_graph(notes)
    assert touched.count() <= 10 and graph_store.edges(spark, store).count() == sum(len({c for c, _ in v}) for v in notes.values())


def test_a_change_reads_the_changed_sources(spark, tmp_path):
    store = Store(str(tmp_path / "s"))
    notes = spark.createDataFrame([(f"n{i}", [(f"c{i % 50}", "C")]) for i in range(400)], LINKS)
    graph_store.update(spark, store, notes, None, "r1")
    before = tables.version(spark, store.edges)["parts"]
    graph_store.update(spark, store, spark.createDataFrame([("n7", [("c8", "C"), ("new", "New")])], LINKS), None, "r2")
    after = tables.version(spark, store.edges)["parts"]
    assert sum(after[b] != before[b] for b in after) == 1  # one bucket of the edges
    got = {r.concept_id: (r.total_mentions, r.n_sources, r.concept_name) for r in graph_store.concepts(spark, store, spark.createDataFrame([("c7",), ("c8",), ("new",)], "concept_id string")).collect()}
    assert got == {"c7": (7, 7, "C"), "c8": (9, 9, "C"), "new": (1, 1, "New")}


def test_names_by_any_part(spark, tmp_path):
    draw = random.Random(6)
    names = {"".join(draw.choices("abcd é规", k=draw.randint(1, 9))).strip() or "x" for _ in range(300)}
    pages = spark.createDataFrame([(n, draw.choice([n.upper(), None, n + "X"])) for n in sorted(names)], "concept_id string, concept_name string")
    path = str(tmp_path / "i")
    name_index.build(pages, path)
    texts = ["a", "AB", "abc", "abcd", "规", "é", "zzz", "bX", "dx", "", None, *[n[1:6] for n in sorted(names)[::20]]]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {}
    for r in name_index.search(queries, path, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.concept_id)
    for i, text in enumerate(texts):
        want = [r.concept_id for r in graph.search(pages, text, 4).collect()] if text else []
        assert got.get(i, []) == want, text
    assert {r.query_id: r.concept_id for r in name_index.lookup(queries, path).collect()} == {i: c[0] for i, c in got.items()}
    assert name_index.candidates(queries.where("text = 'abcd'"), path).count() < 60


def test_nights_of_changes_and_whole_nights_agree(spark, tmp_path):
    by_changes, whole, draw, notes = Store(str(tmp_path / "a")), Store(str(tmp_path / "b")), random.Random(8), {}
    corpus = spark.createDataFrame([(f"c{i}", f"s{i % 3}", f"fact {i}", [1.0, i / 10]) for i in range(12)], "chunk_id string, source string, document string, embedding array<float>")
    encode = lambda c: F.array(F.lit(1.0), F.lit(0.0))
    frame = lambda names: spark.createDataFrame([(s, notes[s]) for s in names], LINKS)
    for night in range(1, 5):
        changed = [f"n{i}" for i in range(8)] if night == 1 else draw.sample([f"n{i}" for i in range(10)], 2)
        for s in changed:
            notes[s] = [(c, c.upper()) for c in draw.choices("abcdefgh", weights=[9, 6, 4, 3, 1, 1, 1, 1], k=6)]
        at = F.lit(f"2024-05-{night:02d}").cast("timestamp")
        told = nightly.run_changes(spark, frame(changed), None, corpus, by_changes, at, f"x{night}", encode)
        assert nightly.report_text(told, at).first().report.startswith(f"# Nightly report 2024-05-{night:02d}\n- concept pages: ")
        nightly.run(spark, frame(list(notes)), corpus, whole, at, f"y{night}", encode)
        state = lambda store: {r.concept_id: (r.concept_name, r.mention_count, r.enrichment_level, r.first_seen) for r in nightly.concepts(spark, store).collect()}
        assert state(by_changes) == state(whole)
    again = nightly.timeline(spark, by_changes).count()
    nightly.run_changes(spark, frame(changed), None, corpus, by_changes, at, "x4", encode)
    assert nightly.timeline(spark, by_changes).count() == again
    page = nightly.concepts(spark, by_changes).where("concept_id = 'a'")
    nightly.put_pages(spark, by_changes, page.withColumn("concept_name", F.lit("renamed")))
    nightly.drop_pages(spark, by_changes, spark.createDataFrame([("b",)], "concept_id string"))
    got = {r.concept_id: r.concept_name for r in nightly.concepts(spark, by_changes).collect()}
    assert got["a"] == "renamed" and "b" not in got
