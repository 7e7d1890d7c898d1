"""Parsers of notes, sources and streams on made-up files."""

import json
import random

from evidencelake.operators import notes as tables
from evidencelake.parse import notes
from evidencelake.sources import files
from evidencelake.streaming import ledgers

NOTE = """---
aliases: [Keel, "The Keel"]
related: "[[harbor]]"
supersedes:
  - old-note
---
# Boat
See [[harbor#Quay|the quay]] and ![[chart.png]] or [text](sub/my%20note.md#Top).

```
[[not a link]]
```
`[[nor this]]` but [[deck#^b1]] and [web](https://example.org/) and [[#here]].
## Hull
Wood.
"""


def test_links_of_a_note():
    assert notes.links(NOTE) == [
        ("frontmatter", "harbor", "", "", 3), ("frontmatter", "old-note", "", "", 5), ("wikilink", "harbor", "Quay", "", 8), ("embed", "chart.png", "", "", 8),
        ("mdlink", "sub/my note.md", "Top", "", 8), ("wikilink", "deck", "", "b1", 13),
    ]
    assert notes.frontmatter(NOTE)[0]["aliases"] == ["Keel", "The Keel"]
    assert notes.headings(NOTE) == [(7, 1, "Boat"), (14, 2, "Hull")]


def test_chunks_give_the_text_back():
    rng = random.Random(1)
    for n in (0, 1, 5999, 6000, 6001, 20000):
        text = "".join(rng.choice("ab \n") for _ in range(n))
        parts = notes.chunks(text)
        assert "".join(parts) == text and all(len(p) <= 6000 for p in parts)
    assert [len(p) for p in notes.chunks("a" * 4000 + "\n" + "b" * 4000)] == [4000, 4001]


def test_blocks_keep_places_and_headings():
    found = notes.blocks(NOTE)
    assert all(NOTE[lo:hi] == body for lo, hi, _, body in found)
    assert [chain for *_, chain, _ in found] == ["", "", "", "Hull"][-len(found) :] and "aliases" not in found[0][3]
    long = "## A\n\n" + "x" * 3000 + "\nshort"
    assert "".join(b for *_, b in notes.blocks(long)).replace("\n", "") == long.replace("\n", "") and all(len(b) <= notes.BLOCK for *_, b in notes.blocks(long))


def test_rows_know_fences_quotes_lists_and_code():
    text = "> ```\n> [[a]]\n> ```\n- item\n\n    [[kept]]\n\nplain\n\n    [[code]]\n~~~\n[[b]]\n```\n~~~\n# Head #\n####### none"
    assert [r.kind for r in notes.rows(text)] == ["fence"] * 3 + ["text", "blank", "text", "blank", "text", "blank", "code"] + ["fence"] * 4 + ["heading", "text"]
    assert [x[1] for x in notes.links(text)] == ["kept"]
    assert notes.headings(text) == [(15, 1, "Head")]


def test_links_between_brackets():
    row = "[[a|b]] ``[[no]]`` ![[p.png]] [x](<my note.md> \"t\") [y](http://x.y/) [z](#here) [w](f/) [[c#h#^blk]] ![i](j.png) [u](v%20w.md#T%20U)"
    assert [tuple(x) for x in notes.scan(row)] == [
        ("wikilink", "a", "", ""), ("embed", "p.png", "", ""), ("mdlink", "my note.md", "", ""), ("wikilink", "c", "", "blk"), ("mdlink", "v w.md", "T U", ""),
    ]


def test_frontmatter_values_and_their_lines():
    text = "---\n# about\nrelated: ['it''s', \"a, \\\"b\\\"\", plain]  \nup: one # why\nodd line\nparent:\n  - x\n  - \"[[y]]\"\n---\n"
    assert notes.frontmatter_lines(text) == ({"related": [("it's", 3), ('a, "b"', 3), ("plain", 3)], "up": [("one", 4)], "parent": [("x", 7), ("[[y]]", 8)]}, 1)


def test_hard_tokens():
    claim = 'On 5 March 2024 Harbor Board paid $48,000 to foo.bar() at 10:30:15, see "north gate" on 2024-05-01 (ID-77), https://x.org/a'
    assert notes.hard_tokens(claim) == [
        ("date", "5 March 2024"), ("name", "Harbor Board"), ("number", "$48,000"), ("identifier", "foo.bar()"), ("time", "10:30:15"), ("quote", "north gate"),
        ("date", "2024-05-01"), ("identifier", "ID-77"), ("url", "https://x.org/a"),
    ]


def test_notes_as_tables(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "boat.md").write_text(NOTE)
    (tmp_path / "a" / "empty.md").write_text("")
    (tmp_path / "a" / "picture.png").write_bytes(b"x")
    (tmp_path / "a" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "a" / ".git" / "x.md").write_text("no")
    (tmp_path / "skipped").mkdir()
    (tmp_path / "skipped" / "x.md").write_text("no")
    found = files.scan_notes(spark, str(tmp_path), ("skipped",))
    assert {r.path: r.state for r in found.collect()} == {"a/boat.md": "ok", "a/picture.png": "unsupported_name", "a/bad.txt": "not_utf8", "skipped/x.md": "excluded"}
    ok = found.filter("state = 'ok'")
    assert tables.links(ok).count() == 6 and tables.chunks(ok).count() == 1 and tables.headings(ok).count() == 2


def test_ledger_lines_with_problems(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b", "n": 2}\n')
    got = files.scan_ledger(spark, str(tmp_path), "id string, n int").orderBy("line").collect()
    assert [(r.line, r.record.id if r.record else None, r.problem) for r in got] == [(1, "a", None), (2, None, "not a JSON object"), (3, "b", None)]


def test_capped_stream(spark, tmp_path):
    rows = [{"user_id": k % 2, "event_id": k} for k in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("user_id long, event_id long").json(str(tmp_path / "in"))
    query = ledgers.capped(stream, "user_id", 3).writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("capped").collect()
    assert sorted((r.session, r.event_id) for r in got if not r.overflow) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]
    assert sorted(r.session for r in got if r.overflow) == [0, 1]


def run(stream, folder, name, **options):
    query = stream.writeStream.format("memory").queryName(name).outputMode(options.get("mode", "append")).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_smallest_over_frames_in_any_order():
    import pandas as pd

    frames = [pd.DataFrame({"event_id": x}) for x in ([9, 3], [1], [], [7, 2])]
    assert ledgers._smallest(iter(frames), "event_id", 3) == ([1, 2, 3], 5)


def test_chained_stream(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps({"user_id": k % 2, "event_id": 9 - k}) for k in range(6)))
    stream = spark.readStream.schema("user_id long, event_id long").json(str(tmp_path / "in"))
    got = sorted((r.session, r.n, r.event_id, r.prev, r.sha) for r in run(ledgers.chained(stream, "user_id"), tmp_path, "chain"))
    want = []
    for session, events in ((0, (5, 7, 9)), (1, (4, 6, 8))):
        prev = ""
        for n, e in enumerate(events):
            sha = hashlib.sha256(f"{n}:{prev}:{e}".encode()).hexdigest()
            want.append((session, n, e, prev, sha))
            prev = sha
    assert got == want


def test_daily_counts_and_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"ts": f"2024-01-0{1 + k // 3}T0{k}:00:00", "event_type": "a", "event_id": k % 4} for k in range(6)]
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    stream = lambda: spark.readStream.schema("ts timestamp, event_type string, event_id long").json(str(tmp_path / "in"))
    got = run(ledgers.daily_counts(stream()), tmp_path, "daily", mode="complete")
    assert sorted((str(r.day), r.n) for r in got) == [("2024-01-01", 3), ("2024-01-02", 3)]
    assert sorted(r.event_id for r in run(ledgers.once(stream(), "event_id", "ts", "3 days"), tmp_path, "once")) == [0, 1, 2, 3]


def test_index_merger_replaces_changed_notes(spark, tmp_path):
    merge = ledgers.index_merger(str(tmp_path / "index"))
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "doc_id long, text string")
    second = spark.createDataFrame([(2, "deux"), (3, None)], "doc_id long, text string")
    merge(first, 0), merge(second, 1), merge(second, 1)
    got = spark.read.parquet(str(tmp_path / "index" / "1")).collect()
    assert sorted((r.doc_id, r.content) for r in got) == [(1, "one"), (2, "deux")]


def test_lines_of_a_ledger_are_numbered_over_splits(spark, tmp_path):
    want = {}
    for name, many in (("a.jsonl", 3000), ("b.jsonl", 1), ("c.jsonl", 700)):
        rows = [f'{{"id": "{name}{k}", "n": {k}}}' if k % 50 else ("" if k % 100 else "é\r broken") for k in range(many)]
        (tmp_path / name).write_bytes("\n".join(rows).encode() + (b"\n" if name != "c.jsonl" else b""))
        want |= {(name, k + 1): x for k, x in enumerate(rows)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        assert {(r.file, r.line): r.row for r in lines.collect()} == want
        got = files.scan_ledger(spark, str(tmp_path), "id string, n int").filter("problem is null").collect()
        assert {(r.file, r.line, r.record.n) for r in got} == {(f, k, k - 1) for (f, k), x in want.items() if x.startswith("{")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
