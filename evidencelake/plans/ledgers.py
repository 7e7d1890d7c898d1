"""Queries: append-only ledgers, sessions, costs, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators import ledger

from .base import Tables, query


@query(
    "WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events), n AS (SELECT *, CAST(user_id AS VARCHAR) || '|' || CAST(day AS VARCHAR) AS k FROM p) "
    "SELECT a.event_type AS a, b.event_type AS b, count(DISTINCT a.k) AS n, count(DISTINCT a.user_id) AS sessions, count(DISTINCT a.day) AS days FROM n a JOIN n b USING (k) WHERE a.event_type < b.event_type GROUP BY 1, 2"
)
def cooccurrence_pairs(t: Tables) -> DataFrame:
    """Kinds of events that a user has on one day: pairs by baskets, users and days."""
    day = F.to_date("ts")
    rows = t.events.select("user_id", day.alias("day"), "event_type", F.concat_ws("|", F.col("user_id").cast("string"), day.cast("string")).alias("k"))
    return ledger.pair_counts(rows, "k", "event_type", "user_id", "day")


@query(
    "WITH c AS (SELECT conv_id, turn, sha256(role || chr(10) || text) AS sha FROM conversations) SELECT conv_id, turn, sha, lag(sha) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM c"
)
def hash_chain(t: Tables) -> DataFrame:
    rows = ledger.chained(t.conversations, "conv_id", "turn", F.concat_ws("\n", "role", "text"))
    return rows.select("conv_id", "turn", "sha", "prev")


@query(
    "WITH c AS (SELECT conv_id, turn, sha256(text) AS sha FROM conversations), w AS (SELECT *, lag(sha) OVER (PARTITION BY conv_id ORDER BY turn) AS expected, "
    "CASE WHEN turn % 7 = 6 THEN sha256('torn') ELSE lag(sha) OVER (PARTITION BY conv_id ORDER BY turn) END AS prev FROM c) SELECT conv_id, min(turn) AS first_bad FROM w WHERE prev IS DISTINCT FROM expected GROUP BY conv_id"
)
def hash_chain_check(t: Tables) -> DataFrame:
    """The first entry of each ledger whose pointer is not the hash of the entry before."""
    rows = ledger.chained(t.conversations, "conv_id", "turn", F.col("text"))
    stored = F.when(F.col("turn") % 7 == 6, F.sha2(F.lit("torn"), 256)).otherwise(F.col("prev"))
    return rows.filter(~stored.eqNullSafe(F.col("prev"))).groupBy("conv_id").agg(F.min("turn").alias("first_bad"))


@query(
    "WITH g AS (SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 3600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) "
    "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total, arg_min(event_type, event_id) AS first_kind FROM s GROUP BY ALL"
)
def session_rollup(t: Tables) -> DataFrame:
    rows = ledger.sessions(t.events, "user_id", "ts", 60)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min_by("event_type", "event_id").alias("first_kind"))


@query(
    "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'signup') AS signup, "
    "count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, max(ts) AS last_at FROM events GROUP BY user_id"
)
def session_list(t: Tables) -> DataFrame:
    kinds = ["click", "view", "signup", "purchase", "error"]
    return t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.max("ts").alias("last_at"))


@query("SELECT conv_id, count(*) AS items, min(turn) AS first_turn, max(turn) AS last_turn, arg_min(left(text, 40), turn) AS first_cite FROM conversations GROUP BY conv_id")
def packet_rollup(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("items"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min_by(F.substring("text", 1, 40), "turn").alias("first_cite")
    )


@query(
    "SELECT event_type, round(sum(CASE WHEN event_id % 9 <> 0 THEN value END), 6) AS total, count(*) FILTER (event_id % 9 = 0 OR value IS NULL) AS unknown, "
    "sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type"
)
def cost_rollup(t: Tables) -> DataFrame:
    """Totals in which unknown counters are counted, not taken for zero."""
    value = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.groupBy("event_type").agg(*ledger.known_sum(value), F.sum(k).alias("k"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def open_tasks(t: Tables) -> DataFrame:
    """Orders as tasks that no returned line closes."""
    closers = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(closers, "o_orderkey", "left_anti")


@query(
    "WITH m AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 4 = 0), c AS (SELECT doc_id + 1000000 AS doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 6 = 0 UNION ALL "
    "SELECT doc_id, sha256(text || CASE WHEN doc_id % 8 = 0 THEN '!' ELSE '' END) FROM documents WHERE doc_id % 12 <> 0), "
    "j AS (SELECT m.doc_id, m.sha, c.sha AS now FROM m LEFT JOIN c ON m.doc_id = c.doc_id) "
    "SELECT j.doc_id, CASE WHEN now IS NULL THEN 'missing' WHEN now <> j.sha THEN 'changed' ELSE 'fresh' END AS state, (SELECT min(c.doc_id) FROM c WHERE c.sha = j.sha AND j.now IS NULL) AS moved_to FROM j"
)
def stale_sources(t: Tables) -> DataFrame:
    """Recorded sources against the current files: fresh, changed, or missing with the place of the same bytes."""
    d = t.documents
    noted = d.filter("doc_id % 4 = 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    moved = d.filter("doc_id % 6 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.sha2("text", 256).alias("now"))
    text = F.concat("text", F.when(F.col("doc_id") % 8 == 0, "!").otherwise(""))
    current = moved.union(d.filter("doc_id % 12 <> 0").select("doc_id", F.sha2(text, 256)))
    place = current.groupBy(F.col("now").alias("sha")).agg(F.min("doc_id").alias("place"))
    j = noted.join(current, "doc_id", "left").join(place, "sha", "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha"), "changed").otherwise("fresh")
    return j.select("doc_id", state.alias("state"), F.when(F.col("now").isNull(), F.col("place")).alias("moved_to"))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def delivered_semi(t: Tables) -> DataFrame:
    return t.labels.select("doc_id").distinct().join(t.documents.filter("lang = 'fr'").select("doc_id"), "doc_id", "left_semi")


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def undelivered_anti(t: Tables) -> DataFrame:
    return t.labels.select("doc_id").distinct().join(t.documents.filter("lang = 'fr'").select("doc_id"), "doc_id", "left_anti")


@query(
    "WITH c AS (SELECT doc_id AS cite, left(sha256(text), 10) AS prefix FROM documents WHERE doc_id % 50 = 0) SELECT c.cite, count(*) AS n, min(d.doc_id) AS first FROM c JOIN documents d ON starts_with(sha256(d.text), c.prefix) GROUP BY c.cite"
)
def cited_prefixes(t: Tables) -> DataFrame:
    """Cited hash prefixes against delivered hashes. All prefixes have ten digits, so the join is on those."""
    head = F.substring(F.sha2("text", 256), 1, 10)
    cites = t.documents.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("cite"), head.alias("prefix"))
    return cites.join(t.documents.select("doc_id", head.alias("prefix")), "prefix").groupBy("cite").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    "WITH g AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM g), "
    "m AS (SELECT conv_id, island, min(role) AS role, count(*) AS n, max(turn) AS last_turn FROM i GROUP BY ALL) SELECT conv_id, role, n, last_turn FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY island DESC) = 1"
)
def transcript_tail(t: Tables) -> DataFrame:
    """The last message of each conversation: neighbouring rows of one role are one message."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    islands = t.conversations.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    m = islands.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.max("turn").alias("last_turn"))
    return m.groupBy("conv_id").agg(*[F.max_by(c, "island").alias(c) for c in ("role", "n", "last_turn")])


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def newest_first(t: Tables) -> DataFrame:
    """The 25 newest entries (a limit of the report)."""
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "ts")


@query(
    "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM c) "
    "SELECT CASE WHEN k <= 8 THEN source ELSE 'Other' END AS region, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"
)
def region_topn_other(t: Tables) -> DataFrame:
    c = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.orderBy(F.desc("n"), "source"))  # a row a source
    return c.withColumn("k", k).groupBy(F.when(F.col("k") <= 8, F.col("source")).otherwise("Other").alias("region")).agg(F.sum("n").alias("n"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def daily_counts(t: Tables) -> DataFrame:
    """What the streaming query of the same name keeps up to date."""
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
