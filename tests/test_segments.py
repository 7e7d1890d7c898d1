"""Segments of an index against an index built anew: random batches, replays, killed batches, streams."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import index, topk
from evidencelake.operators.segments import FANOUT, Segments

WORDS = [f"w{k}" for k in range(40)] + ["Été", "naïve"]


def bag(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def anew(spark, notes, path):
    docs = spark.createDataFrame(sorted(notes.items()), "doc_id long, text string")
    index.build(docs, path)
    return index.Index(spark, path)


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).glob("segments/*/*/*.parquet")}


def test_segments_equal_an_index_built_anew(spark, tmp_path):
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
    own, notes = Segments(spark, f"file://{tmp_path}/s"), {}
    sizes = []
    for number in range(10):
        batch = {}
        for _ in range(25 if not number else rng.randint(1, 6)):
            key = rng.randint(0, 30)
            batch[key] = None if number and rng.random() < 0.3 else say()
        if number == 5:
            batch[99] = ("line of words\n" * 900)  # several records
        before = files(f"{tmp_path}/s")
        own.apply(spark.createDataFrame(list(batch.items()), "doc_id long, text string"), number)
        after = files(f"{tmp_path}/s")
        assert before.items() <= after.items()  # nothing that was there is written anew
        notes = {k: v for k, v in {**notes, **batch}.items() if v is not None}
        sizes.append(len(own.state[1]))
        if number == 7:
            own.apply(spark.createDataFrame([(1, "again")], "doc_id long, text string"), number)  # comes again
    assert max(sizes) <= 2 * FANOUT and sizes[FANOUT - 1] == 1
    built = anew(spark, notes, f"file://{tmp_path}/anew")
    assert {r.doc_id for r in own.table("records").collect()} == set(notes)
    for name in ("records", "lengths", "record_postings", "record_terms"):
        a, b = own.table(name), built.table(name)
        assert bag(a.select(b.columns)) == bag(b)
    asked = spark.createDataFrame([(q, t) for q, ts in enumerate((["w1", "w2", "ete"], ["w7", "naive", "nowhere"])) for t in ts], "q int, term string")
    assert bag(topk.top_notes(own, asked, 5, "q")) == bag(topk.top_notes(built, asked, 5, "q"))
    names = {name for name, _ in own.state[1]}
    own.tidy()
    assert {p.name for p in Path(f"{tmp_path}/s/segments").iterdir()} == names
    assert bag(own.table("lengths")) == bag(built.table("lengths"))


def test_a_killed_batch_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    own = Segments(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id long, text string")
    own.apply(rows((1, "a b"), (2, "c")), 0)
    was = bag(own.table("records"))
    with monkeypatch.context() as m:
        m.setattr(Segments, "_commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            own.apply(rows((2, None), (3, "d")), 1)
    assert bag(own.table("records")) == was
    own.apply(rows((2, None), (3, "d")), 1)
    assert sorted(r.doc_id for r in own.table("records").collect()) == [1, 3]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    own, source = Segments(spark, f"file://{tmp_path}/s"), tmp_path / "in"
    source.mkdir()
    for turn, lines in enumerate((['{"doc_id": 1, "text": "a b"}', '{"doc_id": 2, "text": "b"}'], ['{"doc_id": 2}', '{"doc_id": 3, "text": "b c"}'])):
        (source / f"{turn}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema("doc_id long, text string").json(str(source))
        query = stream.writeStream.foreachBatch(own.each_batch()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.term: r.df for r in own.table("record_terms").collect()} == {"a": 1, "b": 2, "c": 1}
    assert own.manifest.select(F.col("notes")).first().notes == 2
