"""Queries: records that remember, supersede and close each other; sources, snapshots and outputs of jobs.

A conversation is a session: each of its rows is a record (``_records``), and documents are the source files it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators import ledger, memory

from .base import Tables, query

_M = """
c AS (SELECT conv_id, turn, role, text, sha256(concat(conv_id, ':', turn, ':', text)) AS id,
        CASE WHEN role = 'user' AND turn = 0 THEN 'task' WHEN role = 'user' THEN 'decision' WHEN role = 'assistant' THEN 'result' ELSE 'note' END AS kind FROM conversations),
m AS (SELECT a.*, CASE WHEN a.role = 'user' THEN b.id END AS supersedes, CASE WHEN a.role = 'assistant' THEN p.id END AS closes, a.conv_id * 3 + a.turn AS doc_id
      FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn + 2 LEFT JOIN c p ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND p.kind = 'task'),
fl AS (SELECT doc_id, concat(source, '/', lang, '/n', doc_id, '.md') AS path, text, sha256(text) AS sha FROM documents),
src AS (SELECT m.id, m.conv_id, m.turn, f.path, CASE WHEN f.doc_id % 11 = 0 THEN sha256(f.text || '!') ELSE f.sha END AS recorded, CASE WHEN f.doc_id % 13 <> 0 THEN f.sha END AS sha FROM m JOIN fl f USING (doc_id))"""


def _records(t: Tables) -> DataFrame:
    """conv_id, turn, role, text, id, kind, supersedes (the same role's record two rows before), closes (a task), doc_id."""
    user = F.col("role") == "user"
    kind = F.when(user & (F.col("turn") == 0), "task").when(user, "decision").when(F.col("role") == "assistant", "result").otherwise("note")
    own = t.conversations.select("conv_id", "turn", "role", "text", F.sha2(F.concat_ws(":", "conv_id", "turn", "text"), 256).alias("id"), kind.alias("kind"))
    before = own.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("id").alias("b_id"))
    task = own.filter("kind = 'task'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("id").alias("p_id"))
    out = own.join(before, ["conv_id", "turn"], "left").join(task, ["conv_id", "turn"], "left")
    assistant = F.when(F.col("role") == "assistant", F.col("p_id"))
    return out.select(*own.columns, F.when(user, F.col("b_id")).alias("supersedes"), assistant.alias("closes"), (F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"))


def _files(t: Tables) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.documents.select("doc_id", path.alias("path"), "text", F.sha2("text", 256).alias("sha"))


def _sources(t: Tables) -> DataFrame:
    """id, conv_id, turn, path, recorded (hash when the record was made), sha (now; null where the file is gone)."""
    f = _files(t)
    recorded = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("text_", F.lit("!")), 256)).otherwise(F.col("sha"))
    both = _records(t).select("id", "conv_id", "turn", "doc_id").join(f.withColumnRenamed("text", "text_"), "doc_id")
    return both.select("id", "conv_id", "turn", "path", recorded.alias("recorded"), F.when(F.col("doc_id") % 13 != 0, F.col("sha")).alias("sha"))


@query(
    f"WITH {_M}, i AS (SELECT id, conv_id, turn, text, kind, row_number() OVER (PARTITION BY id ORDER BY conv_id, turn) AS n FROM (SELECT * FROM m UNION ALL SELECT * FROM m WHERE turn % 3 = 0)) "
    "SELECT id, CASE WHEN length(text) < 20 THEN 'refused: short' WHEN length(text) > 1500 THEN 'refused: long' WHEN kind = 'note' THEN 'refused: kind' WHEN n > 1 THEN 'known' ELSE 'appended' END AS state, count(*) AS n FROM i GROUP BY ALL"
)
def memory_append(t: Tables) -> DataFrame:
    """Appending the same content twice adds it once; some records are refused."""
    rows = _records(t)
    incoming = rows.unionByName(rows.filter("turn % 3 = 0"))
    return memory.appended(incoming, least=20, most=1500, kinds=["task", "decision", "result"]).groupBy("id", "state").agg(F.count("*").alias("n"))


@query(
    f"WITH RECURSIVE {_M}, e AS (SELECT id, supersedes AS target FROM m WHERE supersedes IS NOT NULL), r(target, id) AS (SELECT target, id FROM e UNION SELECT r.target, e.id FROM r JOIN e ON e.target = r.id) "
    "SELECT r.target, count(*) AS heads, min(r.id) AS head FROM r WHERE r.id NOT IN (SELECT target FROM e) GROUP BY r.target"
)
def supersession_heads(t: Tables) -> DataFrame:
    """The records in force that finally replace a superseded one."""
    edges = _records(t).filter("supersedes is not null").select("id", F.col("supersedes").alias("target"))
    return memory.heads(edges).groupBy("target").agg(F.count("*").alias("heads"), F.min("id").alias("head"))


@query(
    "WITH o AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), e AS (SELECT id, id - 1 - id % 3 AS target FROM o), k AS (SELECT target, count(DISTINCT id) AS successors FROM e GROUP BY target), "
    "h AS (SELECT e.target, count(*) AS heads FROM e WHERE e.id NOT IN (SELECT target FROM e) GROUP BY e.target) SELECT k.target, successors, heads FROM k JOIN h USING (target) WHERE successors >= 2 AND heads >= 2"
)
def supersession_conflicts(t: Tables) -> DataFrame:
    """Records with several successors of which at least two are in force."""
    ids = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()
    edges = ids.select("id", (F.col("id") - 1 - F.col("id") % 3).alias("target"))
    direct = edges.groupBy("target").agg(F.countDistinct("id").alias("successors"))
    ends = edges.join(edges.select(F.col("target").alias("id")), "id", "left_anti").groupBy("target").agg(F.count("*").alias("heads"))
    return direct.join(ends, "target").filter("successors >= 2 and heads >= 2").select("target", "successors", "heads")


_RULES = """
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, CASE WHEN conv_id % 9 = 0 AND turn = 2 THEN 'gone' ELSE supersedes END AS sup, CASE WHEN conv_id % 7 = 0 AND turn = 3 THEN id ELSE closes END AS clo FROM m),
p AS (SELECT conv_id, line, 'text is empty' AS problem FROM v WHERE trim(text) = ''
 UNION ALL SELECT conv_id, line, 'kind is not known' FROM v WHERE kind NOT IN ('decision', 'task', 'result')
 UNION ALL SELECT conv_id, line, 'id is repeated' FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY conv_id, line) > 1
 UNION ALL SELECT conv_id, line, 'supersedes an unknown record' FROM v WHERE sup IS NOT NULL AND sup NOT IN (SELECT id FROM v)
 UNION ALL SELECT conv_id, line, 'closes itself' FROM v WHERE clo = id
 UNION ALL SELECT v.conv_id, v.line, 'closes what is no task' FROM v JOIN v w ON v.clo = w.id WHERE w.kind <> 'task'
 UNION ALL SELECT conv_id, line, 'rows are not numbered on' FROM v WHERE turn <> line - 1
 UNION ALL SELECT v.conv_id, v.line, 'source is gone' FROM v JOIN src USING (id) WHERE src.sha IS NULL
 UNION ALL SELECT v.conv_id, v.line, 'source has changed' FROM v JOIN src USING (id) WHERE src.sha <> src.recorded)"""


def _faulty(t: Tables) -> DataFrame:
    """The records with some faults, numbered within their session."""
    line = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    bad = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 2), "gone").otherwise(F.col("supersedes"))
    own = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 3), F.col("id")).otherwise(F.col("closes"))
    return _records(t).withColumns({"line": line, "supersedes": bad, "closes": own})


@query(f"WITH {_M}, {_RULES} SELECT conv_id, line, problem, count(*) AS n FROM p GROUP BY ALL")
def memory_verify(t: Tables) -> DataFrame:
    """The problems of a store of records, line by line."""
    return memory.problems(_faulty(t), _sources(t), ["decision", "task", "result"]).groupBy("conv_id", "line", "problem").agg(F.count("*").alias("n"))


@query(f"WITH {_M}, {_RULES} SELECT sup AS target, count(*) AS n FROM v WHERE sup IS NOT NULL AND sup NOT IN (SELECT id FROM v) GROUP BY sup")
def dangling_references(t: Tables) -> DataFrame:
    rows = _faulty(t)
    named = rows.filter("supersedes is not null").select(F.col("supersedes").alias("target"))
    return named.join(rows.select(F.col("id").alias("target")), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@query(
    f"WITH {_M}, f AS (SELECT * FROM m WHERE id NOT IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL)), s AS (SELECT id, count(*) FILTER (sha IS NULL OR sha <> recorded) AS stale FROM src GROUP BY id) "
    "SELECT f.conv_id, f.turn, f.kind, coalesce(s.stale, 0) AS stale, f.kind = 'task' AND f.id NOT IN (SELECT closes FROM f WHERE closes IS NOT NULL) AS open FROM f LEFT JOIN s USING (id) QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY f.turn DESC) <= 3"
)
def memory_resume(t: Tables) -> DataFrame:
    """The newest three records in force of each session, with stale sources and open tasks (three are the operator's)."""
    return memory.resume(_records(t), _sources(t), "conv_id", "turn", 3).select("conv_id", "turn", "kind", "stale", "open")


@query(
    f"WITH {_M}, g AS (SELECT sha, min(path) AS moved_to FROM (SELECT sha256(text) AS sha, concat('moved/', path) AS path FROM fl WHERE doc_id % 13 = 0) GROUP BY sha) "
    "SELECT s.id, s.path, g.moved_to, sha256(concat(s.id, ':', g.moved_to)) AS new_id FROM src s JOIN g ON s.recorded = g.sha WHERE s.sha IS NULL"
)
def rebind_moved(t: Tables) -> DataFrame:
    """Records whose source has moved are appended anew, with the new place."""
    manifest = _files(t).filter("doc_id % 13 = 0").select("sha", F.concat(F.lit("moved/"), "path").alias("path"))
    return memory.rebound(_sources(t), manifest)


@query(
    "WITH l AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id) THEN left(j, length(j) - 3) ELSE j END AS line, max(turn) OVER (PARTITION BY conv_id) AS last "
    "FROM (SELECT conv_id, turn, '{\"turn\":' || turn || ',\"role\":\"' || role || '\"}' AS j FROM conversations)) SELECT conv_id, count(*) AS lines, count(*) FILTER (NOT json_valid(line)) AS torn, count(*) FILTER (NOT json_valid(line) AND turn < last) AS inner_damage FROM l GROUP BY conv_id"
)
def torn_tails(t: Tables) -> DataFrame:
    """Ledgers whose last line was cut off while it was written; damage before the last line is another matter."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    line = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"role":"'), "role", F.lit('"}'))
    cut = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == last), F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    rows = t.conversations.select("conv_id", "turn", line.alias("line")).withColumns({"last": last, "line": cut})
    return memory.torn(rows, "conv_id", "turn", "line").select("conv_id", "lines", "torn", "inner_damage")


@query(f"WITH {_M} SELECT conv_id, count(*) AS checks, bool_or(sha IS NULL OR sha <> recorded) AS any_stale, count(DISTINCT path) AS sources FROM src GROUP BY conv_id")
def session_sources(t: Tables) -> DataFrame:
    """What a session relied on, and whether any of it has changed since."""
    stale = F.col("sha").isNull() | (F.col("sha") != F.col("recorded"))
    return _sources(t).groupBy("conv_id").agg(F.count("*").alias("checks"), F.bool_or(stale).alias("any_stale"), F.countDistinct("path").alias("sources"))


_T = "o AS (SELECT o_orderkey AS task_id, o_orderstatus AS verdict, o_custkey AS owner FROM orders), l AS (SELECT l_orderkey AS task_id, l_linenumber AS n, l_linestatus AS verdict, l_shipdate AS day FROM lineitem)"


@query(f"WITH {_T}, z AS (SELECT task_id, max({{'day': day, 'n': n, 'verdict': verdict}}) AS last FROM l GROUP BY task_id) SELECT o.task_id, o.verdict, z.last.verdict AS last_verdict, coalesce(o.verdict = z.last.verdict, false) AS agrees FROM o LEFT JOIN z USING (task_id)")
def task_verdicts(t: Tables) -> DataFrame:
    """Each task's verdict against the last line of its ledger."""
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.max_by("l_linestatus", F.struct("l_shipdate", "l_linenumber", "l_linestatus")).alias("last_verdict"))
    tasks = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("verdict"))
    return tasks.join(last, "task_id", "left").withColumn("agrees", F.coalesce(F.col("verdict") == F.col("last_verdict"), F.lit(False)))


@query(f"WITH {_T}, r AS (SELECT task_id, CASE WHEN count(*) FILTER (verdict = 'F') = count(*) THEN 'F' WHEN count(*) FILTER (verdict = 'O') = count(*) THEN 'O' ELSE 'P' END AS replayed FROM l GROUP BY task_id) SELECT o.task_id, o.verdict, r.replayed FROM o JOIN r USING (task_id) WHERE o.verdict <> r.replayed")
def ledger_replay(t: Tables) -> DataFrame:
    """Tasks whose verdict is not the one that a replay of their ledger gives."""
    n = lambda s: F.count_if(F.col("l_linestatus") == s)
    replayed = F.when(n("F") == F.count("*"), "F").when(n("O") == F.count("*"), "O").otherwise("P")
    again = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id")).agg(replayed.alias("replayed"))
    tasks = t.orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("verdict"))
    return tasks.join(again, "task_id").filter("verdict <> replayed")


@query("SELECT user_id, event_type, count(*) AS n, max_by(event_id, ts) AS head FROM events GROUP BY user_id, event_type")
def ledger_events(t: Tables) -> DataFrame:
    """The entries of each ledger by event, and the newest of each."""
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max_by("event_id", "ts").alias("head"))


@query(
    "WITH s AS (SELECT user_id, event_id, sum(60 + length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 60 - length(props) AS before FROM events) "
    "SELECT user_id, CAST(floor(before / 2048) AS BIGINT) AS segment, count(*) AS entries, min(event_id) AS first FROM s GROUP BY ALL"
)
def ledger_rotation(t: Tables) -> DataFrame:
    """Segments of each ledger: a new one starts with the entry before which the open one has reached its size."""
    size = F.lit(60) + F.char_length("props")
    return memory.rotated(t.events, "user_id", ["ts", "event_id"], size, 2048).groupBy("user_id", "segment").agg(F.count("*").alias("entries"), F.min("event_id").alias("first"))


@query(
    f"WITH {_M}, a AS (SELECT path, sha FROM fl WHERE doc_id % 6 <> 0), b AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN sha256(text || '+') ELSE sha END AS sha FROM fl WHERE doc_id % 4 <> 1), "
    "d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.sha IS DISTINCT FROM b.sha), "
    "w(prefix, owner) AS (VALUES ('src1', 'first'), ('src10/en', 'tenth'), ('src3/fr', 'third')) SELECT d.path, d.state, max_by(w.owner, length(w.prefix)) AS owner FROM d LEFT JOIN w ON d.path = w.prefix OR starts_with(d.path, w.prefix || '/') GROUP BY ALL"
)
def manifest_changes(t: Tables) -> DataFrame:
    """What a job created, deleted and changed, and whose folder it is in: the longest one."""
    f = _files(t)
    before = f.filter("doc_id % 6 <> 0").select("path", "sha")
    after = f.filter("doc_id % 4 <> 1").select("path", F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("+")), 256)).otherwise(F.col("sha")).alias("sha"))
    owners = t._spark.createDataFrame([("src1", "first"), ("src10/en", "tenth"), ("src3/fr", "third")], "prefix string, owner string")
    state = {"added": "created", "removed": "deleted"}
    changes = ledger.diff(before, after, "path", "sha").filter("state <> 'unchanged'").replace(state, subset="state")
    inside = (F.col("path") == F.col("prefix")) | F.startswith("path", F.concat("prefix", F.lit("/")))
    return changes.join(F.broadcast(owners), inside, "left").groupBy("path", "state").agg(F.max_by("owner", F.char_length("prefix")).alias("owner"))  # three owners


def _edited(n: Column) -> Column:
    return F.when(n % 5 == 0, F.regexp_replace("text", " ", "  ")).when(n % 3 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))


_ED = "e AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', '  ') WHEN doc_id % 3 = 0 THEN text || chr(10) || 'more' ELSE text END AS twin FROM documents)"


@query(
    f"WITH {_ED}, a AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS x FROM e), b AS (SELECT doc_id, unnest(range(1, len(string_split(twin, chr(10))) + 1)) AS line, unnest(string_split(twin, chr(10))) AS y FROM e) "
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, min(coalesce(a.line, b.line)) AS first_difference FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.line = b.line WHERE x IS DISTINCT FROM y GROUP BY 1"
)
def twin_parity(t: Tables) -> DataFrame:
    """The first line in which two copies of a file differ."""
    e = t.documents.select("doc_id", "text", _edited(F.col("doc_id")).alias("twin"))
    return memory.first_difference(e, "doc_id", "text", "twin")


@query(f"WITH {_ED} SELECT doc_id, sha256(left(twin, length(text))) = sha256(text) AS append_only FROM e")
def append_only(t: Tables) -> DataFrame:
    """Whether a file still starts with all that it had."""
    e = t.documents.select("doc_id", F.col("text").cast("binary").alias("old"), _edited(F.col("doc_id")).cast("binary").alias("new"))
    return e.select("doc_id", (F.sha2(F.substr("new", F.lit(1), F.octet_length("old")), 256) == F.sha2("old", 256)).alias("append_only"))


@query(f"WITH {_M} SELECT path, sha1(concat('blob ', strlen(text), chr(0), text)) AS blob, sha AS sha256 FROM fl")
def blob_digests(t: Tables) -> DataFrame:
    """The two hashes by which a cached file is checked: of its bytes, and of the blob that a revision store keeps."""
    head = F.concat(F.lit("blob "), F.octet_length("text").cast("string")).cast("binary")
    return _files(t).select("path", F.sha1(F.concat(head, F.unhex(F.lit("00")), F.col("text").cast("binary"))).alias("blob"), F.col("sha").alias("sha256"))


@query(f"WITH {_M} SELECT conv_id, turn, sha256('{{\"path\":\"' || path || '\",\"sha256\":\"' || recorded || '\"}}') AS delivery_id FROM src")
def delivery_ids(t: Tables) -> DataFrame:
    text = F.to_json(F.struct("path", F.col("recorded").alias("sha256")))
    return _sources(t).select("conv_id", "turn", F.sha2(text, 256).alias("delivery_id"))


@query(
    f"WITH {_ED}, a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM e), b AS (SELECT doc_id, unnest(string_split(twin, chr(10))) AS x FROM e), ca AS (SELECT doc_id, x, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY ALL) "
    "SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, CAST(sum(greatest(0, coalesce(ca.n, 0) - coalesce(cb.n, 0))) AS BIGINT) AS removed, CAST(sum(greatest(0, coalesce(cb.n, 0) - coalesce(ca.n, 0))) AS BIGINT) AS added FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id AND ca.x = cb.x GROUP BY 1"
)
def pin_diff(t: Tables) -> DataFrame:
    """Lines that went and came between the pinned and the new state of each file."""
    e = t.documents.select("doc_id", "text", _edited(F.col("doc_id")).alias("twin"))
    each = lambda c, n: e.select("doc_id", F.explode(F.split(c, "\n", -1)).alias("x"), F.lit(n).alias("d"))
    counts = each("text", -1).union(each("twin", 1)).groupBy("doc_id", "x").agg(F.sum("d").alias("d"))
    return counts.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), -F.col("d"))).alias("removed"), F.sum(F.greatest(F.lit(0), F.col("d"))).alias("added"))


@query(
    "WITH b AS (SELECT source, max(doc_id) FILTER (doc_id % 2 = 0) AS built, max(doc_id) AS newest FROM documents GROUP BY source) SELECT source, newest > built AS built_before_newest, newest - built AS age FROM b"
)
def index_age(t: Tables) -> DataFrame:
    """Whether the index of a source is older than its newest file (numbers of documents stand for times)."""
    b = t.documents.groupBy("source").agg(F.max(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("built"), F.max("doc_id").alias("newest"))
    return b.select("source", (F.col("newest") > F.col("built")).alias("built_before_newest"), (F.col("newest") - F.col("built")).alias("age"))


@query(
    f"WITH {_M}, w AS (SELECT DISTINCT path FROM fl WHERE doc_id % 10 = 0), k AS (SELECT path FROM src) SELECT DISTINCT w.path FROM w WHERE w.path IN (SELECT path FROM k)"
)
def modified_sources(t: Tables) -> DataFrame:
    """Files that a job wrote although they are sources."""
    written = _files(t).filter("doc_id % 10 = 0").select("path").distinct()
    return written.join(_sources(t).select("path"), "path", "left_semi")


@query(
    f"WITH {_M}, g AS (SELECT path, sha256(text || '+') AS now, sha FROM fl WHERE doc_id % 10 = 0), r AS (SELECT path FROM src) SELECT g.path FROM g WHERE g.now <> g.sha AND g.path NOT IN (SELECT path FROM r)"
)
def unrecorded_changes(t: Tables) -> DataFrame:
    """At the end of a session: files that changed although no record names them."""
    changed = _files(t).filter("doc_id % 10 = 0").filter(F.sha2(F.concat("text", F.lit("+")), 256) != F.col("sha")).select("path")
    return changed.join(_sources(t).select("path"), "path", "left_anti")


@query(
    "WITH o AS (SELECT o_orderkey AS job, o_custkey AS worker, o_totalprice AS budget FROM orders), p AS (SELECT l_orderkey AS job, count(*) AS files, count(*) FILTER (l_returnflag = 'R') AS changed, count(*) FILTER (l_returnflag = 'A') AS missing, sum(l_quantity) AS used FROM lineitem GROUP BY 1) "
    "SELECT o.job, coalesce(files, 0) AS files, coalesce(changed, 0) AS changed, coalesce(missing, 0) AS missing, coalesce(used, 0) * 1000 <= budget AS within FROM o LEFT JOIN p USING (job)"
)
def produced_outputs(t: Tables) -> DataFrame:
    """The outputs of each job: how many changed or went since, and whether the job kept to its budget."""
    flag = F.col("l_returnflag")
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("files"), F.count_if(flag == "R").alias("changed"), F.count_if(flag == "A").alias("missing"), F.sum("l_quantity").alias("used"))
    o = t.orders.select(F.col("o_orderkey").alias("job"), F.col("o_totalprice").alias("budget"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return o.join(p, "job", "left").select("job", zero("files"), zero("changed"), zero("missing"), (F.coalesce("used", F.lit(0)) * 1000 <= F.col("budget")).alias("within"))


_JOBS = [(1, "src1/en", "out/a", 4000, True), (2, "src1", "src1/en/x", 4000, True), (3, "src3/fr", "src3", 900, True), (4, "", "out/b", 0, False), (5, "src1/e", "src1/en", 100, True)]


@query(
    "WITH j(job, source, target, budget, hashed) AS (VALUES " + ", ".join(f"({a}, '{b}', '{c}', {d}, {str(e).lower()})" for a, b, c, d, e in _JOBS) + "), p AS ("
    "SELECT job, 'output overlaps a source' AS problem FROM j WHERE source <> '' AND (target = source OR starts_with(target, source || '/') OR starts_with(source, target || '/')) "
    "UNION ALL SELECT job, 'no source' FROM j WHERE source = '' UNION ALL SELECT job, 'no budget' FROM j WHERE budget <= 0 UNION ALL SELECT job, 'source without hash' FROM j WHERE NOT hashed) SELECT job, problem FROM p"
)
def job_contracts(t: Tables) -> DataFrame:
    """What is wrong with the contract of each job; folders overlap by whole components."""
    return memory.contract_problems(t._spark.createDataFrame(_JOBS, "job int, source string, target string, budget int, hashed boolean"))


@query(
    f"WITH {_M}, a AS (SELECT conv_id, sum(ceil(length(text) / 4.0)) AS tokens, count(*) AS n FROM m GROUP BY conv_id) SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, tokens <= 400 AS within, CAST(ceil(tokens / n) AS BIGINT) AS each, CAST(greatest(2, ceil(1200.0 / (tokens / n + 40))) AS BIGINT) AS break_even FROM a"
)
def payload_tokens(t: Tables) -> DataFrame:
    """Tokens of a session's payload against its budget, and from how many items on passing them to a worker pays: a
    fixed cost of 1200 tokens against what each item costs here and 40 tokens to hand it over."""
    a = _records(t).groupBy("conv_id").agg(F.sum(F.ceil(F.char_length("text") / 4)).alias("tokens"), F.count("*").alias("n"))
    each = F.col("tokens") / F.col("n")
    return a.select("conv_id", "tokens", (F.col("tokens") <= 400).alias("within"), F.ceil(each).alias("each"), F.greatest(F.lit(2), F.ceil(1200.0 / (each + 40))).cast("long").alias("break_even"))


@query(
    f"WITH {_M}, s AS (SELECT conv_id, turn, 1 AS part, '## ' || kind || ': ' || CASE WHEN length(text) > 160 THEN left(text, 157) || '...' ELSE text END AS line FROM m), "
    "u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM s) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS brief FROM u WHERE used <= 400 GROUP BY conv_id"
)
def session_brief(t: Tables) -> DataFrame:
    """The records of a session as lines of at most 160 characters of text, in order, as far as the brief's size goes."""
    text = F.when(F.char_length("text") > 160, F.concat(F.substring("text", 1, 157), F.lit("..."))).otherwise(F.col("text"))
    rows = _records(t).select("conv_id", "turn", F.concat(F.lit("## "), "kind", F.lit(": "), text).alias("line"))
    return memory.fitted(rows, "conv_id", "turn", "line", 400).withColumnRenamed("text", "brief")


@query(
    f"WITH {_M}, p AS (SELECT conv_id, string_agg(recorded, ',' ORDER BY turn, path) AS body, bool_and(sha IS NOT NULL AND sha = recorded) AS fresh, count(*) AS items FROM src GROUP BY conv_id) SELECT conv_id, sha256(body) AS packet_id, items, CASE WHEN fresh THEN 'SERVED' ELSE 'WITHHELD' END AS state FROM p"
)
def packet_store(t: Tables) -> DataFrame:
    """Packets by the hash of their content: served again whole, or, if any source has changed, not at all."""
    return memory.packets(_sources(t), "conv_id", ["turn", "path"], "recorded", "sha")


@query(f"WITH {_M} SELECT path, CASE WHEN count(DISTINCT recorded) > 1 THEN '' ELSE min(recorded) END AS sha256 FROM src GROUP BY path")
def legacy_sources(t: Tables) -> DataFrame:
    """The indexed files, where only rows are left to tell: a file with two hashes has none."""
    return _sources(t).groupBy("path").agg(F.when(F.countDistinct("recorded") > 1, "").otherwise(F.min("recorded")).alias("sha256"))


@query(
    "WITH a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 50 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 2 = 0) "
    "SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_current, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_previous, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS same"
)
def rollback_pair(t: Tables) -> DataFrame:
    """Whether going back to the generation before would change anything."""
    even = t.documents.filter("doc_id % 2 = 0")
    a = even.select("doc_id", F.sha2("text", 256).alias("sha"))
    b = even.select("doc_id", F.sha2(F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return memory.generations_differ(a, b)


@query(
    "WITH u AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi, count(*) AS events FROM events GROUP BY user_id), o AS (SELECT o_custkey AS user_id, o_orderdate AS at FROM orders) "
    "SELECT u.user_id, events, count(o.at) AS inside FROM u LEFT JOIN o ON u.user_id = o.user_id AND o.at >= date_trunc('day', lo) - INTERVAL 3650 DAY AND o.at <= hi + INTERVAL 1 SECOND GROUP BY ALL"
)
def session_window(t: Tables) -> DataFrame:
    """Entries of another ledger within the time of each session (here: and ten years before it)."""
    u = t.events.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("events"))
    o = t.orders.select(F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("at"))
    inside = (F.col("user_id") == F.col("user")) & (F.col("at") >= F.date_trunc("day", "lo") - F.expr("INTERVAL 3650 DAY")) & (F.col("at") <= F.col("hi") + F.expr("INTERVAL 1 SECOND"))
    return u.join(o, inside, "left").groupBy("user_id", "events").agg(F.count("at").alias("inside"))


@query(f"WITH {_M}, r AS (SELECT conv_id, string_agg('- [' || kind || '] ' || left(id, 8), chr(10) ORDER BY turn) AS body, count(*) AS n FROM m GROUP BY conv_id) SELECT conv_id, '# Session ' || conv_id || chr(10) || body AS page, n FROM r")
def markdown_mirror(t: Tables) -> DataFrame:
    """A page for each session, rendered from its records."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), F.substring("id", 1, 8))
    r = _records(t).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"), F.count("*").alias("n"))
    return r.select("conv_id", F.concat(F.lit("# Session "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join("x.line", "\n")).alias("page"), "n")


@query(
    f"WITH {_M}, s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (kind = 'task') AS tasks, max(turn) AS last FROM m GROUP BY conv_id), q AS (SELECT conv_id, count(*) AS sources, count(*) FILTER (sha IS NULL) AS gone FROM src GROUP BY conv_id) "
    "SELECT s.conv_id, n, tasks, last, coalesce(sources, 0) AS sources, coalesce(gone, 0) AS gone FROM s LEFT JOIN q USING (conv_id)"
)
def session_report(t: Tables) -> DataFrame:
    """One row a session from its records and its sources."""
    s = _records(t).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "task").alias("tasks"), F.max("turn").alias("last"))
    q = _sources(t).groupBy("conv_id").agg(F.count("*").alias("sources"), F.count_if(F.col("sha").isNull()).alias("gone"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.join(q, "conv_id", "left").select("conv_id", "n", "tasks", "last", zero("sources"), zero("gone"))


_HEALTH = (
    "f AS (SELECT doc_id, source, text, sha256(text) AS sha FROM documents), o AS (SELECT doc_id, source, CASE WHEN doc_id % 40 = 3 THEN sha256(text || '?') ELSE sha END AS sha FROM f WHERE doc_id % 60 <> 7), n AS (SELECT doc_id, source, sha, length(text) AS size FROM f WHERE doc_id % 90 <> 11), "
    "d AS (SELECT coalesce(o.source, n.source) AS source, o.sha AS old, n.sha AS new, n.size FROM o FULL JOIN n ON o.doc_id = n.doc_id)"
)


@query(
    f"WITH {_HEALTH}, a AS (SELECT source, count(old) AS indexed, count(*) FILTER (old <> new) AS changed, count(*) FILTER (new IS NULL) AS deleted, count(*) FILTER (old IS NULL AND size > 0) AS added, count(*) FILTER (size > 20000) AS skipped FROM d GROUP BY source) "
    "SELECT *, CASE WHEN indexed = 0 THEN 'missing' WHEN changed + deleted > 0 THEN 'degraded' WHEN added + skipped > 0 THEN 'stale' ELSE 'ok' END AS overall FROM a"
)
def source_health(t: Tables) -> DataFrame:
    """The index of each source against its files now: what changed, went, came or must be skipped, and the first rung that
    applies. Empty files are listed but never change the result."""
    f = t.documents.select("doc_id", "source", "text", F.sha2("text", 256).alias("sha"))
    old = f.filter("doc_id % 60 <> 7").select("doc_id", "source", F.when(F.col("doc_id") % 40 == 3, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.col("sha")).alias("sha"))
    new = f.filter("doc_id % 90 <> 11").select("doc_id", "source", "sha", F.char_length("text").alias("size"))
    return memory.health(old, new, "doc_id", "source", oversize=20000)


@query(
    "WITH c AS (SELECT conv_id, turn, sha256(text) AS sha, text FROM conversations), h AS (SELECT conv_id, turn, lag(turn) OVER w AS before, lag(sha256(conv_id || ':' || turn || ':' || text)) OVER w AS prev FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "
    "SELECT conv_id, count(*) AS entries, max(turn) AS last, count(prev) AS linked FROM h GROUP BY conv_id"
)
def chained_ledger(t: Tables) -> DataFrame:
    """Ledgers in which each entry carries the hash of the one before."""
    rows = ledger.chained(t.conversations, "conv_id", "turn", F.concat_ws(":", "conv_id", "turn", "text"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("entries"), F.max("turn").alias("last"), F.count("prev").alias("linked"))
