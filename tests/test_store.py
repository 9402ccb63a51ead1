"""Tables that change, and the ingest that stands on them: versions, buckets, failures, resumption, copies."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from marlstone.plans import ingest
from marlstone.session import Store
from marlstone.sources import embed, files, tables

SCHEMA = "k string, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(spark, path):
    return sorted(((r.k, r.v) for r in tables.read(spark, path, SCHEMA).collect()), key=str)


def test_replace_and_change(spark, tmp_path):
    path = str(tmp_path / "t")
    assert held(spark, path) == [] and tables.version(spark, path)["number"] == 0
    for _ in range(2):
        tables.replace(tables.read(spark, path, SCHEMA).unionByName(rows(spark, ("a", 1))), path)
    assert held(spark, path) == [("a", 1), ("a", 1)]
    tables.change(spark, path, SCHEMA, "k", rows(spark, ("a", 2), ("b", 3), (None, 4)), buckets=8, notes={"by": "x"})
    assert held(spark, path) == sorted([("a", 2), ("b", 3), (None, 4)], key=str)
    for _ in range(2):  # idempotent
        tables.change(spark, path, SCHEMA, "k", rows(spark, (None, 5)), rows(spark, ("b", 0), ("nobody", 0)).select("k"))
    now = tables.version(spark, path)
    assert held(spark, path) == sorted([("a", 2), (None, 5)], key=str) and now["buckets"] == 8 and now["notes"] == {"by": "x"} and not os.listdir(tmp_path / "t" / "staged")
    tables.change(spark, path, SCHEMA, "k")
    tables.change(spark, path, SCHEMA, "k", gone=tables.read(spark, path, SCHEMA).select("k"))
    assert held(spark, path) == []
    tables.change(spark, path, SCHEMA, "k", spark.createDataFrame([("c", 1, "more")], "k string, v int, other string"))
    assert held(spark, path) == [("c", 1)]


def test_a_change_writes_and_reads_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.change(spark, path, SCHEMA, "k", rows(spark, *[(f"k{i}", i) for i in range(500)]), buckets=32)
    before = tables.version(spark, path)["parts"]
    tables.change(spark, path, SCHEMA, "k", rows(spark, ("k3", -3), ("k4", -4)))
    after = tables.version(spark, path)["parts"]
    moved = [b for b in after if after[b] != before[b]]
    assert len(before) == 32 and 1 <= len(moved) <= 2 and len(held(spark, path)) == 500 and ("k3", -3) in held(spark, path)
    few = tables.read_keys(spark, path, SCHEMA, rows(spark, ("k3", 0), ("k9", 0)), "k")
    assert sorted((r.k, r.v) for r in few.collect()) == [("k3", -3), ("k9", 9)] and len(few.inputFiles()) <= 4


def test_a_killed_writer_leaves_a_whole_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.change(spark, path, SCHEMA, "k", rows(spark, ("a", 1), ("b", 1)))
    for step in ("_apply", "_commit"):  # before anything is written, and after all is written but the version
        with monkeypatch.context() as m:
            m.setattr(tables, step, lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                tables.change(spark, path, SCHEMA, "k", rows(spark, ("a", 2), ("c", 2)))
        assert held(spark, path) == [("a", 1), ("b", 1)]
    with monkeypatch.context() as m:
        m.setattr(tables, "_commit", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            tables.replace(rows(spark, ("z", 9)), path)
    assert held(spark, path) == [("a", 1), ("b", 1)]
    runs = len(os.listdir(tmp_path / "t" / "data"))
    tables.vacuum(spark, path, orphans_after=-60)
    assert len(os.listdir(tmp_path / "t" / "data")) < runs and held(spark, path) == [("a", 1), ("b", 1)]


def test_readers_and_writers_side_by_side(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.change(spark, path, SCHEMA, "k", rows(spark, *[(f"k{i}", 0) for i in range(20)]), buckets=4)
    seen, stop = [], threading.Event()

    def reader():
        while not stop.is_set():
            seen.append({v for _, v in held(spark, path)})

    thread = threading.Thread(target=reader)
    thread.start()
    old = tables.read(spark, path, SCHEMA)  # a plan of a version stays good while later ones come
    for n in (1, 2):
        tables.change(spark, path, SCHEMA, "k", rows(spark, *[(f"k{i}", n) for i in range(20)]))
    assert {r.v for r in old.collect()} == {0}
    stop.set()
    thread.join()
    assert seen and all(len(values) == 1 for values in seen)  # never a mixture, never nothing


def test_of_two_writers_one_starts_over(spark, tmp_path, monkeypatch):
    path, commit, other = str(tmp_path / "t"), tables._commit, []

    def late(spark, path, before, parts, buckets, notes):
        if not other:  # somebody else is faster once
            other.append(1)
            tables.change(spark, path, SCHEMA, "k", rows(spark, ("b", 2)))
        return commit(spark, path, before, parts, buckets, notes)

    tables.change(spark, path, SCHEMA, "k", rows(spark, ("a", 0)))
    monkeypatch.setattr(tables, "_commit", late)
    tables.change(spark, path, SCHEMA, "k", rows(spark, ("a", 1)))
    assert held(spark, path) == [("a", 1), ("b", 2)]
    monkeypatch.setattr(tables, "_commit", commit)
    with pytest.raises(tables.Conflict):
        tables._commit(spark, path, {"number": 1, "notes": {}}, {}, 0, {})


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(tables.KEEP + 3):
        tables.change(spark, path, SCHEMA, "k", rows(spark, ("a", n)), buckets=2)
    assert len(os.listdir(tmp_path / "t" / "versions")) <= 2 * tables.KEEP and held(spark, path) == [("a", tables.KEEP + 2)]
    assert sum(len(found) > 0 and "bucket=" in d for d, _, found in os.walk(tmp_path / "t" / "data")) <= tables.KEEP


# ----- ingest


class Vault:
    """A vault with a store; ``run`` gives the status of every note, ``texts`` what holds."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.store, self.fails, self.log = spark, folder / "v", Store(str(folder / "s")), "nothing", str(folder / "log")
        self.folder.mkdir()
        self.none = (spark.createDataFrame([], "top_folder string, collection string"), spark.createDataFrame([], "match string, collection string, chunk_size int, overlap int"))

    def write(self, name, text):
        (self.folder / name).write_text(text)

    def run(self, lost="raise", **more):
        fails, log = self.fails, self.log

        def client(texts):
            with open(log, "a") as f:
                f.writelines(t.replace("\n", " ")[:40] + "\n" for t in texts)
            if any("down" in t for t in texts) and fails == "down":
                raise ConnectionError
            if any(fails in t for t in texts):
                raise ValueError
            return [[1.0, 2.0] for _ in texts]

        vectors = lambda c: embed.embed(c, client, batch=1, retries=0, lost=lost)
        found = ingest.ingest(self.spark, str(self.folder), self.store, *self.none, "notes", F.lit("2024-05-01").cast("timestamp"), embedding=vectors, **more)
        return {r.rel_path: r.status + ("!" if r.incomplete else "") for r in found.collect()}

    def texts(self, store=None):
        return sorted((r.source, r.document) for r in ingest.live_chunks(self.spark, store or self.store).collect())

    def asked(self):
        found = open(self.log).read().split("\n")[:-1] if os.path.exists(self.log) else []
        open(self.log, "w").close()
        return sorted(found)


def test_a_failed_embedding_loses_no_note(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.write("a.md", "first note")
    v.write("b.md", "bad note")
    v.fails = "bad"
    assert v.run() == {"a.md": "new", "b.md": "new!"} and v.texts() == [("a.md", "first note")]
    assert v.run() == {"a.md": "unchanged", "b.md": "new!"}  # asked for again, and again without luck
    v.fails = "nothing"
    assert v.run() == {"a.md": "unchanged", "b.md": "new"} and len(v.texts()) == 2
    v.write("a.md", "first note, now worse")
    v.fails = "worse"
    assert v.run()["a.md"] == "changed!" and ("a.md", "first note") in v.texts()  # what was there holds
    v.fails = "nothing"
    assert v.run()["a.md"] == "changed" and v.texts() == [("a.md", "first note, now worse"), ("b.md", "bad note")]
    assert set(v.run().values()) == {"unchanged"}


@pytest.mark.parametrize("kind", ["error", "lost"])
def test_a_note_goes_on_where_it_stopped(spark, tmp_path, kind):
    v = Vault(spark, tmp_path)
    parts = [f"## {name}\n" + f"{name} words " * 20 for name in ("one", "two", "down", "four")]
    v.write("long.md", "\n".join(parts))
    v.fails = "down"
    assert v.run(lost="null" if kind == "lost" else "raise") == {"long.md": "new!"} if kind == "lost" else True
    if kind == "error":
        v.fails = "two"
        assert v.run() == {"long.md": "new!"}
    assert v.texts() == []
    first = v.asked()
    v.fails = "nothing"
    assert v.run() == {"long.md": "new"} and len(v.texts()) == 4
    rest = v.asked()
    assert len(first) >= 3 and len(rest) == (2 if kind == "lost" else 1)  # all after the connection was lost, or what failed
    assert ingest.tables.read(spark, v.store.progress, ingest.schemas.PROGRESS).count() == 0
    v.write("long.md", "\n".join(parts[:2]) + " changed")  # another text is embedded anew
    assert v.run() == {"long.md": "changed"} and len(v.texts()) == 2


def test_a_lost_connection_ends_the_run(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.write("a.md", "down")
    v.fails = "down"
    with pytest.raises(Exception, match="ConnectionError"):
        v.run()
    assert v.texts() == [] and ingest.known_files(spark, v.store).count() == 0


def bytes_read(spark):
    return sum(e.totalInputBytes() for e in _executors(spark))


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return [found.apply(i) for i in range(found.size())]


def test_a_second_run_reads_what_has_changed(spark, tmp_path, monkeypatch):
    v = Vault(spark, tmp_path)
    for i in range(9):
        v.write(f"n{i}.md", f"note {i} " + "x" * 200_000)
    opened = []
    read = files.read_listed
    monkeypatch.setattr(files, "read_listed", lambda s, root, listed: opened.append(sorted(r.rel_path for r in listed.collect())) or read(s, root, listed))
    v.run()
    before = bytes_read(spark)
    assert set(v.run().values()) == {"unchanged"} and opened[-1] == []
    assert bytes_read(spark) - before < 700_000  # of 1 800 000 in the vault; the rest are the store's own tables
    v.write("n3.md", "another text")
    os.utime(v.folder / "n4.md", (1, 1))  # touched
    assert {k: s for k, s in v.run().items() if s != "unchanged"} == {"n3.md": "changed"} and opened[-1] == ["n3.md", "n4.md"]
    v.run()
    assert opened[-1] == []
    same = os.stat(v.folder / "n5.md")
    v.write("n5.md", "y" * same.st_size)
    os.utime(v.folder / "n5.md", ns=(same.st_atime_ns, same.st_mtime_ns))
    assert v.run()["n5.md"] == "unchanged" and v.run(by_hash=True)["n5.md"] == "changed"
    monkeypatch.setattr(files, "NAMED_FILES", 3)  # more are read with the whole folder
    assert set(v.run(full=True).values()) == {"new"} and len(v.texts()) >= 9
    v.write("od[d] {n}*?.md", "with marks of patterns")
    (v.folder / "n7.md").unlink()
    monkeypatch.setattr(files, "NAMED_FILES", 10_000)
    assert {k: s for k, s in v.run().items() if s != "unchanged"} == {"od[d] {n}*?.md": "new", "n7.md": "deleted"}
    (v.folder / "n8.md").unlink()
    v.run(full=True)
    assert "n8.md" not in {s for s, _ in v.texts()}


def test_copies_are_repaired(spark, tmp_path, monkeypatch):
    v, copy = Vault(spark, tmp_path), Store(str(tmp_path / "copy"))
    v.write("a.md", "one")
    v.write("b.md", "two")
    v.run(copies=[copy])
    assert v.texts(copy) == v.texts() == [("a.md", "one"), ("b.md", "two")]
    change = tables.change

    def broken(spark, path, *a, **b):
        if path == copy.ledger:
            raise OSError("the copy is away")
        return change(spark, path, *a, **b)

    v.write("a.md", "three")
    (v.folder / "b.md").unlink()
    monkeypatch.setattr(tables, "change", broken)
    with pytest.warns(UserWarning, match="behind"):
        assert v.run(copies=[copy]) == {"a.md": "changed", "b.md": "deleted"}
    assert v.texts() == [("a.md", "three")] and v.texts(copy) == [("a.md", "one"), ("b.md", "two")]  # whole, and of before
    monkeypatch.setattr(tables, "change", change)
    assert ingest.bring_up(spark, v.store, copy) == 1 and v.texts(copy) == v.texts() and ingest.bring_up(spark, v.store, copy) == 0
    v.write("c.md", "four")
    v.run()
    ingest.compact(spark, v.store)
    v.write("d.md", "five")
    assert v.run(copies=[copy])["d.md"] == "new" and v.texts(copy) == v.texts() and len(v.texts()) == 3
    fresh = Store(str(tmp_path / "fresh"))
    assert ingest.bring_up(spark, v.store, fresh) == 2 and v.texts(fresh) == v.texts()


def test_blank_notes_failed_runs_and_compaction(spark, tmp_path):
    v = Vault(spark, tmp_path)
    v.write("blank.md", "\n\n　\n")
    v.write("odd.md", "\x1c")
    v.write("a.md", "first note")
    assert v.run() == {"a.md": "new"} and set(v.run().values()) == {"unchanged"}
    # a run that ended before its ledger leaves rows that nothing names
    spark.read.parquet(v.store.chunks).drop("run").write.parquet(f"{v.store.chunks}/run=failed")
    assert len(v.texts()) == 1
    v.write("blank.md", "now with text")
    assert v.run()["blank.md"] == "new" and len(v.texts()) == 2
    ingest.compact(spark, v.store)
    assert len(v.texts()) == 2 and spark.read.parquet(v.store.chunks).count() == 2
    assert set(v.run().values()) == {"unchanged"} and set(v.run(full=True).values()) == {"new"} and len(v.texts()) == 2
