"""The stream of notes: what its state tells, and going on after failures."""

import json

from pyspark.sql import functions as F

from marlstone.sources import embed
from marlstone.streaming import notes


def test_notes_go_on_where_they_stopped(spark, tmp_path):
    inbox, root, log = tmp_path / "in", str(tmp_path / "out"), tmp_path / "log"
    inbox.mkdir()
    log.write_text("")
    fails = {"word": "two"}

    def event(name, **pairs):
        (inbox / name).write_text("\n".join(json.dumps({"rel_path": k, "text": v}) for k, v in pairs.items()))

    def run():
        word = fails["word"]

        def client(texts):
            with open(log, "a") as f:
                f.writelines(t[:3] + "\n" for t in texts)
            if word and any(word in t for t in texts):
                raise ValueError
            return [[1.0] for _ in texts]

        stream = spark.readStream.schema(notes.NOTE).json(str(inbox))
        notes.start(stream, root, lambda c: embed.embed(c, client, batch=1, retries=0)).awaitTermination()
        asked = sorted(t for t in log.read_text().split("\n") if t)
        log.write_text("")
        told = spark.read.parquet(f"{root}/statuses")
        last = told.agg(F.max("batch")).first()[0]
        return {r.rel_path: (r.status, r.chunk_count, r.first) for r in told.where(told.batch == last).collect()}, asked

    long = "\n".join(f"## {name}\n" + f"{name} words " * 20 for name in ("one", "two", "six", "ten"))
    event("1", a=long, b="short note")
    told, asked = run()
    assert told["a"] == ("new", 4, 1) and told["b"] == ("new", 1, 1) and len(asked) == 5
    fails["word"] = None
    event("2", a=long, b="short note")
    told, asked = run()
    assert told == {"a": ("resumed", 4, 2), "b": ("unchanged", 1, 2)} and len(asked) == 3  # from the chunk that failed
    assert notes.live(spark, root).where("rel_path = 'a'").count() == 4
    event("3", a=long, b="another short note", c="", d=None)
    told, asked = run()
    assert told["a"] == ("unchanged", 4, 5) and told["b"] == ("changed", 1, 1) and len(asked) == 1 + told["c"][1] + told["d"][1]
    assert [r.document for r in notes.live(spark, root).where("rel_path = 'b'").collect()] == ["another short note"]
    assert run()[1] == []  # nothing new
