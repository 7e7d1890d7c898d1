"""Queries: from prompts (rows of users in conversations) to terms, routes, variants, candidates and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import index, routing, topk
from evidencelake.operators.segments import Segments
from evidencelake.operators.shards import shards
from evidencelake.operators.shared import generations

from .base import Tables, query

_STOP = ", ".join(f"'{w}'" for w in routing.STOPWORDS)
_P = r"""
u AS (SELECT conv_id, turn, text, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '/?[\p{L}\p{N}]+'), ' ') || ' ' AS said FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, unnest(range(0, len(k))) AS pos, unnest(k) AS term FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*') AS k FROM u)),
f AS (SELECT *, strip_accents(lower(term)) AS folded FROM w),
t AS (SELECT * FROM f WHERE folded NOT IN (""" + _STOP + r""") AND length(folded) > 1 AND NOT regexp_full_match(folded, '[0-9]+') QUALIFY row_number() OVER (PARTITION BY conv_id, turn, folded ORDER BY pos) = 1)"""
_KEYS = ["conv_id", "turn"]
_TRIGGERS = [("writing", "that is", 2), ("writing", "with the", 2), ("writing", "for", 2), ("history", "from", 1), ("history", "was", 1), ("terms", "/plan", 1), ("terms", "thing", 1), ("german", "nicht", 3), ("german", "die", 3), ("french", "dans", 1), ("french", "pour", 1)]
_FALLBACKS = [("the", "general", ["writing", "history"]), ("der", "german", ["terms"])]
_ALIASES = [("with", "along"), ("with", "beside"), ("and", "plus"), ("nicht", "kein"), ("dans", "dedans")]
_TRIGGER_SQL = "g(route, trigger, priority) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _TRIGGERS) + "), fb(term, route, unless) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c!r})" for a, b, c in _FALLBACKS) + ")"
_HAS = "(contains(said, ' ' || {x} || ' ') OR (length({x}) >= 5 AND NOT contains({x}, ' ') AND len(list_filter(string_split(trim(said), ' '), lambda z: starts_with(z, {x}) AND length(z) - length({x}) <= 12)) > 0))"
_ROUTES = (
    _TRIGGER_SQL
    + f", sc AS (SELECT conv_id, turn, route, CAST(sum(CASE WHEN starts_with(trigger, '/') THEN 4 ELSE len(string_split(trigger, ' ')) END) * max(priority) AS BIGINT) AS score FROM u JOIN g ON {_HAS.format(x='trigger')} GROUP BY ALL), "
    + "rs AS (SELECT conv_id, turn, list(route) AS routes FROM sc GROUP BY ALL), "
    + f"fx AS (SELECT DISTINCT u.conv_id, u.turn, fb.route FROM u LEFT JOIN rs USING (conv_id, turn) JOIN fb ON {_HAS.format(x='fb.term')} WHERE NOT list_has_any(coalesce(routes, []), unless) AND NOT list_contains(coalesce(routes, []), fb.route)), "
    + "al AS (SELECT * FROM sc UNION ALL SELECT conv_id, turn, route, 1 FROM fx), rt AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, route) AS rank FROM al QUALIFY rank <= 4)"
)


def _prompts(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", "text")


def _table(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t._spark.createDataFrame(rows, schema)


def _terms(t: Tables) -> DataFrame:
    return routing.terms(_prompts(t), _KEYS)


def _scored(t: Tables) -> DataFrame:
    triggers = _table(t, _TRIGGERS, "route string, trigger string, priority int")
    return routing.route_scores(_prompts(t), _KEYS, triggers, _table(t, _FALLBACKS, "term string, route string, unless array<string>"))


def _routes(t: Tables) -> DataFrame:
    return routing.best_routes(_scored(t), _KEYS, 4)


@query(f"WITH {_P} SELECT conv_id, turn, pos, term FROM w")
def prompt_words(t: Tables) -> DataFrame:
    each = _prompts(t).select(*_KEYS, F.posexplode(routing.words(F.col("text"))).alias("pos", "term"))
    return each.withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_P} SELECT conv_id, turn, pos, term, folded FROM t")
def prompt_terms(t: Tables) -> DataFrame:
    return _terms(t)


@query(f"WITH {_P}, p(phrase) AS (VALUES ('that is'), ('erent'), ('with'), ('ischt'), ('ation')) SELECT conv_id, turn, phrase FROM u JOIN p ON {_HAS.format(x='phrase')}")
def contains_phrase(t: Tables) -> DataFrame:
    """Phrases of whole words, and stems with a short ending."""
    phrases = _table(t, [("that is",), ("erent",), ("with",), ("ischt",), ("ation",)], "phrase string")
    own = _prompts(t).select(*_KEYS, routing.normal(F.col("text")).alias("said"))
    return own.join(F.broadcast(phrases), routing.has_stem(F.col("said"), F.col("phrase"))).select(*_KEYS, "phrase")  # five phrases


@query(f"WITH {_P}, {_ROUTES} SELECT conv_id, turn, route, score, rank FROM rt")
def route_score(t: Tables) -> DataFrame:
    """The best four routes of each prompt, by the triggers that it has; fallbacks where none of theirs was found."""
    return _routes(t)


_ALIAS_SQL = "ak(word, other) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ALIASES) + ")"


@query(f"WITH {_P}, {_ALIAS_SQL} SELECT conv_id, turn, word AS matched, other AS expanded_to FROM u JOIN ak ON contains(said, ' ' || word || ' ')")
def alias_expansion(t: Tables) -> DataFrame:
    aliases = _table(t, _ALIASES, "matched string, expanded_to string")
    own = _prompts(t).select(*_KEYS, routing.normal(F.col("text")).alias("said"))
    return own.join(F.broadcast(aliases), routing.has_phrase(F.col("said"), F.col("matched"))).select(*_KEYS, "matched", "expanded_to")  # five aliases


_FLAGS = (
    "fl AS (SELECT u.conv_id, u.turn, len(list_filter(['was', 'are'], lambda z: contains(said, ' ' || z || ' '))) > 0 AND len(list_filter(['that', 'by'], lambda z: contains(said, ' ' || z || ' '))) > 0 AS web, "
    "(count(t.folded) FILTER (t.folded NOT IN ('than', 'there', 'und')) = 0 AND count(rt.route) = 0) OR (count(rt.route) = 0 AND count(t.folded) FILTER (t.folded NOT IN ('than', 'there', 'und') AND length(t.folded) > 2) = 0) AS unclear "
    "FROM u LEFT JOIN t USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, min(route) AS route FROM rt GROUP BY ALL) rt USING (conv_id, turn) GROUP BY u.conv_id, u.turn, said)"
)


def _flags(t: Tables) -> DataFrame:
    """web: a time and a fact of the world are asked for; unclear: neither routes nor words to look for."""
    own = _prompts(t).select(*_KEYS, routing.normal(F.col("text")).alias("said"))
    some = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: routing.has_phrase(F.col("said"), x))
    vague = F.col("folded").isin("than", "there", "und")
    counts = _terms(t).groupBy(*_KEYS).agg(F.count_if(~vague).alias("meaning"), F.count_if(~vague & (F.char_length("folded") > 2)).alias("distinct_terms"))
    routes = _routes(t).select(*_KEYS).distinct().withColumn("routed", F.lit(True))
    full = own.join(counts, _KEYS, "left").join(routes, _KEYS, "left").fillna({"meaning": 0, "distinct_terms": 0, "routed": False})
    unclear = ~F.col("routed") & ((F.col("meaning") == 0) | (F.col("distinct_terms") == 0))
    return full.select(*_KEYS, (some(["was", "are"]) & some(["that", "by"])).alias("web"), unclear.alias("unclear"))


@query(f"WITH {_P}, {_ROUTES}, {_FLAGS} SELECT * FROM fl")
def prompt_flags(t: Tables) -> DataFrame:
    return _flags(t)


_VARIANTS = (
    _ALIAS_SQL + ", an AS (SELECT DISTINCT conv_id, turn, trigger AS phrase FROM u JOIN g ON contains(said, ' ' || trigger || ' ') WHERE starts_with(trigger, '/') OR contains(trigger, ' ')), "
    "lx AS (SELECT DISTINCT conv_id, turn, other FROM u JOIN ak ON contains(said, ' ' || word || ' ')), "
    "tt AS (SELECT conv_id, turn, list(folded ORDER BY pos) AS k FROM t GROUP BY ALL), "
    "vr AS (SELECT conv_id, turn, 'phrase' AS kind, phrase AS expression, 8.0 AS weight FROM an QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY phrase) <= 10 "
    "UNION ALL SELECT conv_id, turn, 'all', replace(phrase, ' ', ' AND '), 5.0 FROM an WHERE contains(phrase, ' ') QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY phrase) <= 10 "
    "UNION ALL SELECT conv_id, turn, 'alias', other, 5.0 FROM lx QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY other) <= 8 "
    "UNION ALL SELECT conv_id, turn, 'first', array_to_string(k[1:4], ' AND '), 4.0 FROM tt WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM an) AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM lx) "
    "UNION ALL SELECT conv_id, turn, 'any', array_to_string(k, ' OR '), 1.5 FROM tt WHERE len(k) <= 3 AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM an) AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM lx))"
)


@query(f"WITH {_P}, {_TRIGGER_SQL}, {_VARIANTS} SELECT conv_id, turn, kind, expression, CAST(weight AS DOUBLE) AS weight FROM vr")
def query_variants(t: Tables) -> DataFrame:
    """The queries that a prompt becomes, with weights: its phrases, all of a phrase's words, aliases; without those its
    first words."""
    own = _prompts(t).select(*_KEYS, routing.normal(F.col("text")).alias("said"))
    triggers = _table(t, _TRIGGERS, "route string, phrase string, priority int").filter("phrase like '/%' or phrase like '% %'")
    anchors = own.join(F.broadcast(triggers), routing.has_phrase(F.col("said"), F.col("phrase"))).select(*_KEYS, "phrase").distinct()
    aliases = own.join(F.broadcast(_table(t, _ALIASES, "matched string, other string")), routing.has_phrase(F.col("said"), F.col("matched"))).select(*_KEYS, F.col("other").alias("expression")).distinct()
    best = lambda rows, by, n: rows.withColumn("n", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(by))).filter(F.col("n") <= n).drop("n")
    made = lambda rows, kind, expression, weight: rows.select(*_KEYS, F.lit(kind).alias("kind"), expression.alias("expression"), F.lit(weight).alias("weight"))
    bare = _terms(t).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "folded"))).alias("k")).select(*_KEYS, F.col("k.folded").alias("k"))
    bare = bare.join(anchors.select(*_KEYS), _KEYS, "left_anti").join(aliases.select(*_KEYS), _KEYS, "left_anti")
    out = made(best(anchors, "phrase", 10), "phrase", F.col("phrase"), 8.0)
    out = out.union(made(best(anchors.filter("phrase like '% %'"), "phrase", 10), "all", F.replace("phrase", F.lit(" "), F.lit(" AND ")), 5.0))
    out = out.union(made(best(aliases, "expression", 8), "alias", F.col("expression"), 5.0))
    out = out.union(made(bare, "first", F.array_join(F.slice("k", 1, 4), " AND "), 4.0))
    return out.union(made(bare.filter(F.size("k") <= 3), "any", F.array_join("k", " OR "), 1.5))


_CHUNKS = r"""
cs(doc_id, chunk, start) AS (SELECT doc_id, 0, 0 FROM documents UNION ALL SELECT c.doc_id, c.chunk + 1, c.start + 6000 - instr(reverse(substring(d.text, c.start + 3001, 3000)), chr(10)) FROM cs c JOIN documents d USING (doc_id) WHERE c.start + 6000 < length(d.text)),
rc AS (SELECT c.doc_id, chunk, start, substring(text, start + 1, coalesce(lead(start) OVER (PARTITION BY c.doc_id ORDER BY chunk), length(text)) - start) AS content, sha256(text) AS sha256 FROM cs c JOIN documents d ON c.doc_id = d.doc_id),
tk AS (SELECT doc_id, chunk, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') AS k FROM rc)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(start AS BIGINT) AS start, sha256(content) AS digest FROM rc")
def index_records(t: Tables) -> DataFrame:
    """The stored records: chunks of texts, cut before line ends."""
    return t.index.records.select("doc_id", "chunk", "start", F.sha2("content", 256).alias("digest"))


@query(f"WITH RECURSIVE {_CHUNKS}, s AS (SELECT doc_id, string_agg(content, '' ORDER BY chunk) AS text, min(sha256) AS sha256 FROM rc GROUP BY doc_id) SELECT doc_id, sha256(text) = sha256 AS whole, CAST(length(text) AS BIGINT) AS n FROM s")
def stored_text(t: Tables) -> DataFrame:
    """Texts put together again from their records."""
    return index.stored_text(t.index.records).select("doc_id", "whole", F.char_length("text").cast("long").alias("n"))


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS records, count(DISTINCT sha256) AS hashes, CAST(min(chunk) AS BIGINT) AS first, CAST(max(chunk) AS BIGINT) AS last, count(DISTINCT sha256) = 1 AND max(chunk) - min(chunk) + 1 = count(*) AS usable FROM rc GROUP BY doc_id")
def read_base(t: Tables) -> DataFrame:
    return index.read_base(t.index.records)


@query(f"WITH RECURSIVE {_CHUNKS} SELECT (SELECT count(*) FROM documents) AS notes, count(*) AS records, count(*) AS lengths, true AS consistent FROM rc")
def index_checked(t: Tables) -> DataFrame:
    """Whether the tables of the index agree with its manifest."""
    return t.index.checked()


@query(
    f"WITH RECURSIVE {_CHUNKS} SELECT sum(CAST(doc_id % 7 <> 0 AND doc_id % 20 <> 3 AS BIGINT))::BIGINT AS kept, sum(CAST(doc_id % 7 = 0 OR doc_id % 20 = 3 AS BIGINT))::BIGINT AS rewritten, 0::BIGINT AS gone, sum(CAST(doc_id % 7 = 0 OR doc_id % 20 = 3 AS BIGINT)) > 0.4 * count(*) AS full, "
    "(SELECT count(*) FROM rc) + (SELECT count(*) FROM documents WHERE doc_id % 20 = 3 AND length(text) % 6000 = 0 AND length(text) > 0) * 0 AS records FROM documents"
)
def index_update(t: Tables) -> DataFrame:
    """An index of a generation that lacks a seventh of the notes and has others of another hash, brought up to date: rows
    that are still right are kept, and the result has the records of an index built anew."""
    old = t.index.records.filter("doc_id % 7 <> 0")
    old = old.withColumn("sha256", F.when(F.col("doc_id") % 20 == 3, F.lit("old")).otherwise(F.col("sha256")))
    rows, plan = index.updated(old, t.documents)
    return plan.crossJoin(rows.agg(F.count("*").alias("records")))  # one row each


@query(f"WITH RECURSIVE {_CHUNKS}, x AS (SELECT doc_id, chunk, unnest(k) AS term FROM tk) SELECT term, count(DISTINCT (doc_id, chunk)) AS df, count(*) AS cf FROM x GROUP BY term HAVING count(DISTINCT doc_id) > 1")
def record_terms(t: Tables) -> DataFrame:
    """Terms of more than one note: in how many records, and how often."""
    return t.index.table("record_terms").filter("notes > 1").drop("notes")


_FOUND = (
    _CHUNKS + ", x AS (SELECT doc_id, chunk, unnest(k) AS term FROM tk), tf AS (SELECT term, doc_id, chunk, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT doc_id, chunk, len(k) AS dl FROM tk), av AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), "
    "q AS (SELECT conv_id, folded AS term FROM t WHERE turn = 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos) <= 12), "
    "sr AS (SELECT q.conv_id, tf.doc_id, tf.chunk, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS n_terms FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id AND dl.chunk = tf.chunk CROSS JOIN av GROUP BY ALL), "
    "sn AS (SELECT conv_id, doc_id, round(max(score), 6) AS score, max(n_terms) AS n_terms FROM sr GROUP BY ALL), "
    "dc AS (SELECT doc_id, source, lang, sha256(text) AS sha256, length(text) AS size, md5(string_split(text, chr(10))[1]) AS title, max(doc_id) OVER (PARTITION BY text) AS last FROM documents), "
    "hit AS (SELECT s.*, d.source, d.lang, d.sha256, d.size, d.title, d.last FROM sn s JOIN dc d USING (doc_id) WHERE NOT (lower(d.source) = 'src3' OR lower(d.source) LIKE 'src7%')), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS rank FROM hit QUALIFY rank <= 10)"
)


def _asked(t: Tables) -> DataFrame:
    """(conv_id, term): all terms of the first prompt of each conversation."""
    return _terms(t).filter("turn = 0").select("conv_id", F.col("folded").alias("term"))


def _twelve(t: Tables) -> DataFrame:
    """(conv_id, term): the first twelve of these (the limit of the router's search)."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))
    return _terms(t).filter("turn = 0").withColumn("n", nth).filter("n <= 12").select("conv_id", F.col("folded").alias("term"))


def _notes(t: Tables) -> DataFrame:
    """The documents that a search may find: without excluded sources; same: equal for equal texts."""
    name = F.lower("source")
    return t.documents.filter(~((name == "src3") | name.startswith("src7"))).withColumn("same", F.sha2("text", 256))


def _described(t: Tables) -> DataFrame:
    """doc_id, source, lang, sha256, size, title (hash of the first line), last (the last document with this text)."""
    sha = F.sha2("text", 256).alias("sha256")
    last = t.documents.groupBy(sha).agg(F.max("doc_id").alias("last"))
    title = F.md5(F.split_part("text", F.lit("\n"), F.lit(1)))
    notes = t.documents.select("doc_id", "source", "lang", sha, F.char_length("text").cast("long").alias("size"), title.alias("title"))
    return notes.join(last, "sha256")


def _search(t: Tables) -> DataFrame:
    """conv_id, doc_id, score, n_terms, rank and what _described says: the ten best notes for the first prompt of each
    conversation, by their best record, without excluded sources. Made once a state of the two tables."""

    def make(folder: str) -> None:
        best = topk.top_notes(t.index, _twelve(t), 10, "conv_id", _notes(t).select("doc_id", "same"))
        best.join(_described(t), "doc_id").write.parquet(folder)

    return t.made("search", ["documents", "conversations"], make)


@query(f"WITH RECURSIVE {_P}, {_FOUND} SELECT conv_id, doc_id, score, n_terms, rank FROM top WHERE rank <= 3")
def fts_search(t: Tables) -> DataFrame:
    """Prompts against the stored index (three notes are the operator's limit)."""
    return _search(t).filter("rank <= 3").select("conv_id", "doc_id", "score", "n_terms", "rank")


@query(
    f"WITH RECURSIVE {_P}, {_FOUND}, {_ROUTES}, pin(route, source) AS (VALUES ('writing', 'src1'), ('german', 'src2'), ('french', 'src0'), ('history', 'src5')), "
    "pn AS (SELECT DISTINCT rt.conv_id, d.doc_id, rt.rank AS spot FROM rt JOIN pin USING (route) JOIN (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source) d USING (source) WHERE rt.turn = 0), "
    "al2 AS (SELECT conv_id, doc_id, spot FROM pn UNION ALL SELECT conv_id, doc_id, 100 + rank FROM top), mn AS (SELECT conv_id, doc_id, min(spot) AS spot FROM al2 GROUP BY ALL) "
    "SELECT conv_id, doc_id, spot <= 100 AS pinned, row_number() OVER (PARTITION BY conv_id ORDER BY spot, doc_id) AS rank FROM mn QUALIFY rank <= 6"
)
def canonical_search(t: Tables) -> DataFrame:
    """The sources that matched routes pin come first, then what the search has found, each once."""
    pinned = _pinned(t)
    every = pinned.union(_search(t).select("conv_id", "doc_id", F.col("rank") + 100)).groupBy("conv_id", "doc_id").agg(F.min("spot").alias("at"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "doc_id")).cast("long")
    return every.withColumn("rank", rank).filter("rank <= 6").select("conv_id", "doc_id", (F.col("at") <= 100).alias("pinned"), "rank")


#: Folders: canonical sources of routes, messages of users and of assistants, the archive, stored data, preferred ones.
_PINS = [("writing", "src1"), ("german", "src2"), ("french", "src0"), ("history", "src5")]
_USERS, _ASSISTANTS, _ARCHIVE = "src4", "src6", "src17"
_PIN_SQL = "pin(route, source) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _PINS) + "), pn AS (SELECT rt.conv_id, d.doc_id, min(rt.rank) AS spot FROM rt JOIN pin USING (route) JOIN (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source) d USING (source) WHERE rt.turn = 0 GROUP BY ALL)"
_CANDIDATES = (
    _ROUTES + ", " + _PIN_SQL + ", "
    "cu AS (SELECT conv_id, doc_id, rank, n_terms FROM top UNION ALL SELECT pn.conv_id, pn.doc_id, 10 + spot, 0 FROM pn LEFT JOIN top USING (conv_id, doc_id) WHERE top.doc_id IS NULL), "
    "cm AS (SELECT c.conv_id, c.doc_id, c.rank, c.n_terms, d.* EXCLUDE (doc_id), pn.doc_id IS NOT NULL AS mandatory, d.last > c.doc_id AS superseded, d.source = '" + _ARCHIVE + "' AS historical, CASE d.source WHEN '" + _USERS + "' THEN 'user' WHEN '" + _ASSISTANTS + "' THEN 'assistant' ELSE 'note' END AS kind, coalesce(l.toxic, 0) = 1 AS limited "
    "FROM cu c JOIN dc d USING (doc_id) LEFT JOIN pn USING (conv_id, doc_id) LEFT JOIN labels l USING (doc_id)), "
    "cd AS (SELECT *, round(8.0 / (40 + rank) + 0.8 * n_terms + CASE kind WHEN 'user' THEN 6 WHEN 'assistant' THEN 2.5 ELSE 0 END - CASE WHEN source LIKE 'src1%' THEN 3 ELSE 0 END + CASE WHEN source = 'src2' THEN 2.5 ELSE 0 END + CASE WHEN mandatory THEN 100 ELSE 0 END, 6) AS adjusted FROM cm)"
)


def _pinned(t: Tables) -> DataFrame:
    """(conv_id, doc_id, spot): the canonical source of each route that the first prompt matches."""
    pins = _table(t, _PINS, "route string, source string")
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return _routes(t).filter("turn = 0").join(F.broadcast(pins), "route").join(first, "source").groupBy("conv_id", "doc_id").agg(F.min("rank").alias("spot"))  # four pins


def _candidates(t: Tables) -> DataFrame:
    """What the search has found, and the canonical sources of matched routes behind it, with the marks of a candidate: mandatory
    (a canonical source), superseded (a later document has its text), historical (the archive's), kind (messages by their folder),
    limited (labelled toxic)."""
    pinned = _pinned(t)
    found = _search(t).select("conv_id", "doc_id", "rank", "n_terms")
    more = pinned.join(found, ["conv_id", "doc_id"], "left_anti").select("conv_id", "doc_id", (10 + F.col("spot")).alias("rank"), F.lit(0).cast("long").alias("n_terms"))
    rows = found.union(more).join(_described(t), "doc_id").join(pinned.withColumn("mandatory", F.lit(True)).drop("spot"), ["conv_id", "doc_id"], "left")
    rows = rows.join(t.labels.filter("toxic = 1").select("doc_id").distinct().withColumn("limited", F.lit(True)), "doc_id", "left").fillna(False, ["mandatory", "limited"])
    source = F.col("source")
    rows = rows.withColumns({"superseded": F.col("last") > F.col("doc_id"), "historical": source == _ARCHIVE, "kind": F.when(source == _USERS, "user").when(source == _ASSISTANTS, "assistant").otherwise("note")})
    score = 8.0 / (40 + F.col("rank")) + 0.8 * F.col("n_terms") + F.when(F.col("kind") == "user", 6).when(F.col("kind") == "assistant", 2.5).otherwise(0)
    score = score - F.when(source.startswith("src1"), 3).otherwise(0) + F.when(source == "src2", 2.5).otherwise(0) + F.when(F.col("mandatory"), 100).otherwise(0)
    return rows.withColumn("adjusted", F.round(score, 6))


@query(f"WITH RECURSIVE {_P}, {_FOUND}, {_CANDIDATES} SELECT conv_id, doc_id, CAST(adjusted AS DOUBLE) AS adjusted, row_number() OVER (PARTITION BY conv_id ORDER BY mandatory DESC, adjusted DESC, doc_id) AS place FROM cd")
def candidate_ranking(t: Tables) -> DataFrame:
    """Candidates by several keys: canonical ones, then the adjusted score, then the number."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mandatory"), F.desc("adjusted"), "doc_id")).cast("long")
    return _candidates(t).select("conv_id", "doc_id", "adjusted", place.alias("place"))


@query(
    f"WITH RECURSIVE {_P}, {_FOUND}, {_CANDIDATES} SELECT conv_id, doc_id, CASE WHEN mandatory THEN 'current_canonical_project_source' WHEN kind = 'user' THEN 'direct_user_statement' WHEN kind = 'assistant' THEN 'assistant_output_or_proposal' WHEN source LIKE 'src1%' THEN 'stored_evidence_or_data' WHEN lang = 'de' THEN 'textual_document_extraction' ELSE 'verbatim_project_or_archive_text' END AS authority FROM cd"
)
def authority_classes(t: Tables) -> DataFrame:
    lang, kind = F.col("lang"), F.col("kind")
    c = F.when(F.col("mandatory"), "current_canonical_project_source").when(kind == "user", "direct_user_statement").when(kind == "assistant", "assistant_output_or_proposal")
    c = c.when(F.col("source").startswith("src1"), "stored_evidence_or_data").when(lang == "de", "textual_document_extraction").otherwise("verbatim_project_or_archive_text")
    return _candidates(t).select("conv_id", "doc_id", c.alias("authority"))


@query(
    f"WITH RECURSIVE {_P}, {_FOUND}, {_CANDIDATES}, {_FLAGS}, ag AS (SELECT conv_id, count(*) FILTER (NOT mandatory AND NOT historical) AS ev, count(*) FILTER (mandatory) AS mand, count(*) FILTER (NOT mandatory AND NOT historical) AS ver, count(*) FILTER (NOT mandatory AND NOT historical AND kind = 'user') AS us, "
    "count(*) FILTER (NOT mandatory AND NOT historical AND kind = 'assistant') AS asst, count(*) FILTER (NOT mandatory AND NOT historical AND kind <> 'note') AS conv, bool_or(limited) AS lim FROM cd GROUP BY conv_id) "
    "SELECT u.conv_id, CASE WHEN web THEN 'EXTERNAL_RECHECK' WHEN unclear THEN 'NOT_FOUND' WHEN coalesce(ev, 0) = 0 AND coalesce(mand, 0) > 0 THEN 'PARTIAL' WHEN coalesce(ev, 0) = 0 THEN 'NOT_FOUND' WHEN lim THEN 'PARTIAL' WHEN ver < ev THEN 'PARTIAL' WHEN us > 0 THEN 'USER_STATED' WHEN conv > 0 AND asst = conv THEN 'PARTIAL' WHEN ver > 0 THEN 'SUPPORTED' ELSE 'PARTIAL' END AS status "
    "FROM u JOIN fl USING (conv_id, turn) LEFT JOIN ag ON u.conv_id = ag.conv_id WHERE u.turn = 0"
)
def evidence_gate(t: Tables) -> DataFrame:
    """The status of each first prompt, from what was found for it: verified are notes whose hash is still the indexed one, and a
    candidate that is labelled toxic is a known limit."""
    own, kind = ~F.col("mandatory") & ~F.col("historical"), F.col("kind")
    n = lambda c, name: F.count_if(c).alias(name)
    indexed = t.index.records.filter("chunk = 0").select("doc_id", F.col("sha256").alias("indexed"))
    rows = _candidates(t).join(indexed, "doc_id", "left")
    same = F.coalesce(F.col("indexed") == F.col("sha256"), F.lit(False))
    a = rows.groupBy("conv_id").agg(n(own, "ev"), n(F.col("mandatory"), "mand"), n(own & same, "ver"), n(own & (kind == "user"), "us"), n(own & (kind == "assistant"), "asst"), n(own & (kind != "note"), "conv"), F.bool_or("limited").alias("lim"))
    full = _flags(t).filter("turn = 0").join(a, "conv_id", "left").fillna(0).fillna(False, ["lim"])
    c = F.col
    return full.select("conv_id", routing.status(c("ev"), c("mand"), c("ver"), c("us"), c("asst"), c("conv"), c("web"), c("unclear"), c("lim")).alias("status"))


@query(
    f"WITH RECURSIVE {_P}, {_FOUND}, o AS (SELECT conv_id, rank, size, CASE WHEN size <= 3000 THEN size ELSE 0 END AS used, size <= 3000 AS inlined FROM top WHERE rank = 1 UNION ALL SELECT t.conv_id, t.rank, t.size, o.used + CASE WHEN o.used + t.size <= 3000 THEN t.size ELSE 0 END, o.used + t.size <= 3000 FROM o JOIN top t ON t.conv_id = o.conv_id AND t.rank = o.rank + 1) "
    "SELECT conv_id, rank, size, inlined FROM o"
)
def packet_overflow(t: Tables) -> DataFrame:
    """What of the results fits into a packet of 3000 characters, in order; what does not is listed only."""
    return routing.overflow(_search(t).select("conv_id", "rank", "size"), ["conv_id"], "rank", "size", 3000)


@query(
    f"WITH RECURSIVE {_P}, {_FOUND}, {_CANDIDATES} "
    "SELECT a.conv_id, a.doc_id FROM cd a JOIN cd b ON b.conv_id = a.conv_id AND b.doc_id = a.last WHERE a.superseded QUALIFY row_number() OVER (PARTITION BY a.conv_id ORDER BY a.rank, a.doc_id) <= 2"
)
def superseded_guard(t: Tables) -> DataFrame:
    """A superseded source enters only beside the one that replaced it, and at most two do."""
    c = _candidates(t)
    old = c.filter("superseded").join(c.select("conv_id", F.col("doc_id").alias("last")), ["conv_id", "last"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("rank", "doc_id"))
    return old.withColumn("n", nth).filter("n <= 2").select("conv_id", "doc_id")


_LIMIT = 6
_WALK = (
    "cr AS (SELECT conv_id, doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY mandatory DESC, adjusted DESC, doc_id) AS rank, source || '/' || lang AS path, title AS logical, sha256 AS hash, superseded, CASE WHEN historical THEN 'tail' WHEN mandatory THEN 'must' ELSE 'free' END AS kind FROM cd), "
    "ck AS (SELECT * FROM cr QUALIFY kind <> 'must' OR row_number() OVER (PARTITION BY conv_id, kind, path ORDER BY rank) = 1), "
    "cn AS (SELECT *, count(*) FILTER (kind = 'tail') OVER w AS h, count(*) FILTER (kind = 'must') OVER w AS m, count(*) FILTER (kind = 'free') OVER w AS f, row_number() OVER (PARTITION BY conv_id, kind ORDER BY kind = 'must' AND superseded, rank) AS nth FROM ck WINDOW w AS (PARTITION BY conv_id)), "
    f"cp AS (SELECT *, greatest(1, {_LIMIT} - least(2, h)) AS places FROM cn), cq AS (SELECT *, least(m, greatest(least(3, m, greatest(1, places - 1)), places - least(6, f))) AS quota FROM cp), "
    "wk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind = 'free', nth) AS step FROM cq WHERE kind = 'free' OR (kind = 'must' AND nth <= quota)), "
    "fo AS (SELECT DISTINCT conv_id, 0::BIGINT AS step, []::STRUCT(doc_id BIGINT, hash VARCHAR, logical VARCHAR, path VARCHAR, free BOOLEAN)[] AS taken FROM cq UNION ALL "
    "SELECT fo.conv_id, wk.step, CASE WHEN len(taken) < places AND len(list_filter(taken, lambda t: t.hash = wk.hash OR t.logical = wk.logical)) = 0 AND NOT (wk.kind = 'free' AND len(list_filter(taken, lambda t: t.free AND t.path = wk.path)) >= 4) "
    "THEN list_append(taken, {'doc_id': wk.doc_id, 'hash': wk.hash, 'logical': wk.logical, 'path': wk.path, 'free': wk.kind = 'free'}) ELSE taken END FROM fo JOIN wk ON wk.conv_id = fo.conv_id AND wk.step = fo.step + 1), "
    "fl2 AS (SELECT conv_id, arg_max(taken, step) AS taken FROM fo GROUP BY conv_id), "
    "ol AS (SELECT conv_id, doc_id, rank, len(taken) AS n FROM cq JOIN fl2 USING (conv_id) WHERE kind = 'tail' AND nth <= 2 AND NOT list_contains(list_transform(taken, lambda t: t.hash), hash) QUALIFY row_number() OVER (PARTITION BY conv_id, hash ORDER BY rank) = 1)"
)


@query(f"WITH RECURSIVE {_P}, {_FOUND}, {_CANDIDATES}, {_WALK} SELECT conv_id, unnest(range(1, len(taken) + 1))::BIGINT AS place, unnest(list_transform(taken, lambda t: t.doc_id)) AS doc_id FROM fl2 UNION ALL SELECT conv_id, n + row_number() OVER (PARTITION BY conv_id ORDER BY rank), doc_id FROM ol")
def choose_records(t: Tables) -> DataFrame:
    """The candidates of each prompt that enter its packet of six: quotas, one row a content and first line, two of the archive."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mandatory"), F.desc("adjusted"), "doc_id"))
    rows = _candidates(t).select(
        "conv_id", F.col("doc_id").alias("id"), rank.alias("rank"), F.concat("source", F.lit("/"), "lang").alias("path"), F.col("title").alias("logical"), F.col("sha256").alias("hash"), "mandatory", "superseded", "historical"
    )
    return routing.chosen(rows, ["conv_id"], _LIMIT).withColumnRenamed("id", "doc_id")


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 160 THEN 'brief' WHEN length(text) <= 600 THEN 'standard' ELSE 'full' END AS tier, CASE WHEN length(text) <= 160 THEN 18 WHEN length(text) <= 600 THEN 22 ELSE 28 END AS sources, CASE WHEN length(text) <= 160 THEN 40000 WHEN length(text) <= 600 THEN 60000 ELSE 86000 END AS characters FROM conversations WHERE role = 'user'")
def delivery_tiers(t: Tables) -> DataFrame:
    """How much a prompt may cost, by its length."""
    n = F.char_length("text")
    pick = lambda k: F.coalesce(*[F.when(n <= tier[1] if tier[1] else F.lit(True), F.lit(tier[k])) for tier in routing.TIERS])
    return _prompts(t).select(*_KEYS, pick(0).alias("tier"), pick(2).alias("sources"), pick(3).alias("characters"))


_CORRECT = "|".join(p.replace("'", "''") for p in routing.CORRECTIONS)


@query(
    "WITH e AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text || ' Correction: it.' WHEN conv_id % 5 = 0 THEN 'I do not want that. ' || text ELSE text END AS text FROM conversations WHERE role = 'user') "
    f"SELECT conv_id, min(turn) AS turn FROM e WHERE turn > (SELECT min(turn) FROM e x WHERE x.conv_id = e.conv_id) AND regexp_matches(regexp_replace(lower(text), '\\s+', ' ', 'g'), '{_CORRECT}') GROUP BY conv_id"
)
def corrections(t: Tables) -> DataFrame:
    """The first later row of a user that takes an earlier one back in so many words."""
    c = F.col("conv_id")
    said = F.when(c % 3 == 0, F.concat("text", F.lit(" Correction: it."))).when(c % 5 == 0, F.concat(F.lit("I do not want that. "), "text")).otherwise(F.col("text"))
    rows = _prompts(t).select(*_KEYS, F.regexp_replace(F.lower(said), r"\s+", " ").alias("said"))
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    later = rows.join(first, "conv_id").filter(F.col("turn") > F.col("first"))
    return later.filter(F.rlike("said", F.lit("|".join(routing.CORRECTIONS)))).groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query(
    f"WITH {_P}, cards AS (SELECT item_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS terms FROM benchmark), ok AS (SELECT DISTINCT item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), "
    "ct AS (SELECT item_id, unnest(terms) AS folded FROM cards JOIN ok USING (item_id)), mt AS (SELECT conv_id, turn, item_id, count(*) AS matches FROM t JOIN ct USING (folded) GROUP BY ALL) "
    "SELECT conv_id, turn, item_id, matches FROM mt WHERE matches >= 2 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY matches DESC, item_id) <= 3"
)
def fact_cards(t: Tables) -> DataFrame:
    """The three cards that share most terms with a prompt, two at least, of those whose quote stands in a document."""
    from evidencelake.operators import evals

    verified = evals.verbatim(t.documents, t.benchmark.select("item_id", F.col("text").alias("claim")), "doc_id", "item_id").select("item_id").distinct()
    terms = t.benchmark.join(verified, "item_id").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("folded"))
    matched = _terms(t).join(terms, "folded").groupBy(*_KEYS, "item_id").agg(F.count("*").alias("matches")).filter("matches >= 2")
    nth = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("matches"), "item_id"))
    return matched.withColumn("n", nth).filter("n <= 3").drop("n")


@query(
    f"WITH {_P}, doc AS (SELECT doc_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS k FROM documents WHERE doc_id < 7), pt AS (SELECT conv_id, turn, list(folded) AS q FROM t GROUP BY ALL), "
    "r AS (SELECT conv_id, turn, doc_id, len(list_intersect(k, q)) AS overlap FROM pt CROSS JOIN doc) SELECT conv_id, turn, doc_id, overlap FROM r WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, doc_id) <= 2"
)
def overlap_router(t: Tables) -> DataFrame:
    """A router over a fixture of seven documents: those that share most terms with the prompt."""
    seven = t.documents.filter("doc_id < 7").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("folded"))
    shared = _terms(t).join(seven, "folded").groupBy(*_KEYS, "doc_id").agg(F.count("*").alias("overlap"))
    nth = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc("overlap"), "doc_id"))
    return shared.withColumn("n", nth).filter("n <= 2").drop("n")


@query(
    r"WITH f AS (SELECT doc_id, source, source || '/' || lang || '/n' || doc_id || '.md' AS path FROM documents) SELECT doc_id, path FROM f WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND path <> 'src1/en/n1.md' AND path NOT LIKE 'src1/fr/%' AND NOT (contains(path, '/de/n') AND doc_id % 5 <> 0)"
)
def record_filters(t: Tables) -> DataFrame:
    """Sources of a list, without excluded names and prefixes, and without derived mirrors (a part of the name gives them
    away), but for exceptions."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = t.documents.select("doc_id", "source", path.alias("path"))
    mirror = F.contains("path", F.lit("/de/n")) & (F.col("doc_id") % 5 != 0)
    return rows.filter(F.col("source").isin("src1", "src2", "src3", "src4", "src5") & (F.col("path") != "src1/en/n1.md") & ~F.startswith("path", F.lit("src1/fr/")) & ~mirror).select("doc_id", "path")


_NAMES = "nm AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN 'Note' || event_type || 'Exports' || user_id WHEN 3 THEN strftime(ts, '%Y') || '-W' || lpad(CAST(user_id % 53 AS VARCHAR), 2, '0') WHEN 4 THEN 'generated_' || event_type ELSE event_type || ' plan' END AS name FROM events)"


@query(
    f"WITH {_NAMES}, k AS (SELECT event_id, name, string_split(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS parts FROM nm) "
    "SELECT event_id, regexp_full_match(name, '[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9]{4}-W[0-9]{2}') AS date_like, len(list_filter(parts, lambda z: regexp_full_match(z, '(export|generate|import|backup)(s|d|ed)?'))) > 0 AS generated FROM k"
)
def file_names(t: Tables) -> DataFrame:
    """Names that are dates, and names that say a machine made them: a marker among their parts, with plural or past end."""
    e, kind = F.col("event_id") % 6, F.col("event_type")
    week = F.concat(F.date_format("ts", "yyyy"), F.lit("-W"), F.lpad((F.col("user_id") % 53).cast("string"), 2, "0"))
    name = (
        F.when(e == 0, F.date_format("ts", "yyyy-MM-dd")).when(e == 1, F.date_format("ts", "yyyy-MM")).when(e == 2, F.concat(F.lit("Note"), kind, F.lit("Exports"), F.col("user_id").cast("string")))
        .when(e == 3, week).when(e == 4, F.concat(F.lit("generated_"), kind)).otherwise(F.concat(kind, F.lit(" plan")))
    )
    rows = t.events.select("event_id", name.alias("name"))
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace("name", "([a-z])([A-Z0-9])", "$1 $2"), "[^A-Za-z0-9]+", " ")), " ")
    dates = F.rlike("name", F.lit(r"^([0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9]{4}-W[0-9]{2})$"))
    return rows.select("event_id", dates.alias("date_like"), F.exists(parts, lambda x: F.rlike(x, F.lit("^(export|generate|import|backup)(s|d|ed)?$"))).alias("generated"))


@query(
    r"WITH k AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS term FROM documents), c AS (SELECT source, term, count(*) AS df FROM k WHERE length(term) > 3 GROUP BY ALL) "
    "SELECT source, term, df, row_number() OVER (PARTITION BY source ORDER BY df DESC, term) AS rank FROM c QUALIFY rank <= 5"
)
def inferred_routes(t: Tables) -> DataFrame:
    """What each top folder is about: the five terms that most of its notes have; ties by the term."""
    each = t.index.postings().join(t.documents.select("doc_id", "source"), "doc_id").filter(F.char_length("term") > 3)
    df = each.groupBy("source", "term").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("df"), "term")).cast("long")
    return df.withColumn("rank", rank).filter("rank <= 5")


@query(
    "WITH f AS (SELECT source, lang, count(*) AS n, count(*) FILTER (length(text) < 400) AS thin, count(*) FILTER (contains(text, 'http')) AS marked FROM documents GROUP BY ALL) SELECT source, lang, n, CASE WHEN thin >= 0.8 * n THEN 'noise: thin' WHEN marked > 0 THEN 'noise: marker' ELSE 'kept' END AS state FROM f"
)
def noise_folders(t: Tables) -> DataFrame:
    """Folders that are no notes: nearly all files of a kind, or a marker among them."""
    f = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.char_length("text") < 400).alias("thin"), F.count_if(F.contains("text", F.lit("http"))).alias("marked"))
    state = F.when(F.col("thin") >= 0.8 * F.col("n"), "noise: thin").when(F.col("marked") > 0, "noise: marker").otherwise("kept")
    return f.select("source", "lang", "n", state.alias("state"))


_PLAN = [("brief", True, "cache"), ("brief", False, "direct"), ("standard", True, "batch"), ("standard", False, "direct"), ("full", True, "batch"), ("full", False, "stream")]


@query(
    "WITH p(tier, again, route) AS (VALUES " + ", ".join(f"('{a}', {str(b).lower()}, '{c}')" for a, b, c in _PLAN) + "), x AS (SELECT conv_id, turn, CASE WHEN length(text) <= 160 THEN 'brief' WHEN length(text) <= 600 THEN 'standard' ELSE 'full' END AS tier, turn > 0 AS again FROM conversations) SELECT conv_id, turn, route FROM x JOIN p USING (tier, again)"
)
def api_routes(t: Tables) -> DataFrame:
    """A decision table: the route of a request by its size and whether it follows another."""
    n = F.char_length("text")
    x = t.conversations.select(*_KEYS, F.when(n <= 160, "brief").when(n <= 600, "standard").otherwise("full").alias("tier"), (F.col("turn") > 0).alias("again"))
    return x.join(F.broadcast(_table(t, _PLAN, "tier string, again boolean, route string")), ["tier", "again"]).select(*_KEYS, "route")  # six rows


@query(f"WITH RECURSIVE {_P}, {_FOUND}, ok AS (SELECT conv_id, doc_id, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE regexp_full_match(source || '/' || lang || '/n' || doc_id, 'src[0-9]/(en|de)/n.*') QUALIFY rank <= 2) SELECT conv_id, doc_id, rank FROM ok")
def task_packet(t: Tables) -> DataFrame:
    """The two best notes of those that a task's list of allowed names lets through, however far down the search they stand."""
    name = F.concat("source", F.lit("/"), "lang", F.lit("/n"), F.col("doc_id").cast("string"))
    allowed = _notes(t).filter(F.rlike(name, F.lit("^src[0-9]/(en|de)/n.*$"))).select("doc_id", "same")
    return topk.top_notes(t.index, _twelve(t), 2, "conv_id", allowed).select("conv_id", "doc_id", "rank")


@query(
    r'''WITH e AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'see "' || left(text, 12) || '" in notes/plan.md' ELSE 'use /plan then ' || text END AS text FROM conversations WHERE role = 'user'),
    x AS (SELECT conv_id, turn, 'quoted' AS kind, unnest(regexp_extract_all(text, '"([^"\n]{2,80})"', 1)) AS phrase FROM e UNION ALL SELECT conv_id, turn, 'command', unnest(regexp_extract_all(text, '(?:^|\s)(/[a-z]+)', 1)) FROM e
    UNION ALL SELECT conv_id, turn, 'file', unnest(regexp_extract_all(text, '[\p{L}\p{N}_/-]+\.(?:md|txt|json)')) FROM e) SELECT conv_id, turn, kind, phrase, count(*) AS n FROM x GROUP BY ALL'''
)
def exact_phrases(t: Tables) -> DataFrame:
    """Quoted strings, commands and file names of a prompt."""
    said = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('see "'), F.substring("text", 1, 12), F.lit('" in notes/plan.md'))).otherwise(F.concat(F.lit("use /plan then "), "text"))
    e = _prompts(t).select(*_KEYS, said.alias("text"))
    kinds = [("quoted", r'"([^"\n]{2,80})"', 1), ("command", r"(?:^|\s)(/[a-z]+)", 1), ("file", r"[\p{L}\p{N}_/-]+\.(?:md|txt|json)", 0)]
    all_ = F.flatten(F.array(*[_marked(*kind) for kind in kinds]))
    return e.select(*_KEYS, F.explode(all_).alias("x")).groupBy(*_KEYS, F.col("x.kind").alias("kind"), F.col("x.phrase").alias("phrase")).agg(F.count("*").alias("n"))


def _marked(kind: str, pattern: str, group: int):
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("phrase")))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 25")
def stimuli(t: Tables) -> DataFrame:
    """Rows of given values, the first twenty-five (the limit is the operator)."""
    return t.documents.filter(F.col("lang").isin("en", "de") & F.col("source").isin("src1", "src2")).orderBy("doc_id").limit(25).select("doc_id", "lang")


@query(f"WITH RECURSIVE {_P}, {_FOUND}, k AS (SELECT doc_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS k FROM documents) SELECT top.conv_id, doc_id, list_sort(list_intersect(list_distinct(list(q.term)), any_value(k.k)))::VARCHAR AS matched, len(list_distinct(list(q.term))) - len(list_intersect(list_distinct(list(q.term)), any_value(k.k))) AS uncovered FROM top JOIN q USING (conv_id) JOIN k USING (doc_id) WHERE rank <= 3 GROUP BY ALL")
def term_matches(t: Tables) -> DataFrame:
    """Which terms of its prompt each of the three best results has, and how many it lacks."""
    asked = _twelve(t).groupBy("conv_id").agg(F.collect_set("term").alias("q"))
    best = _search(t).filter("rank <= 3").select("conv_id", "doc_id")
    have = t.documents.join(best.select("doc_id").distinct(), "doc_id").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("k"))
    both = best.join(asked, "conv_id").join(have, "doc_id").withColumn("m", F.array_sort(F.array_intersect("q", "k")))
    return both.select("conv_id", "doc_id", F.concat(F.lit("["), F.array_join("m", ", "), F.lit("]")).alias("matched"), (F.size("q") - F.size("m")).cast("long").alias("uncovered"))


@query()
def porter_search(t: Tables) -> DataFrame:
    """The three best documents of each first prompt by stems of whole texts, the prompt's as well (no SQL: a test holds it against an engine that has
    the same stemmer)."""
    stored = t.made("stems", ["documents"], lambda folder: shards(t.documents, chunked=False, stemmed=True).write.option("compression", "zstd").parquet(folder))
    return topk.stem_notes(stored, _asked(t), 3, "conv_id").select("conv_id", "doc_id", "score", "rank")


@query(
    f"WITH RECURSIVE dz AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0), {_CHUNKS.replace('documents', 'dz')} "
    "SELECT doc_id, count(*) AS records, sum(len(k))::BIGINT AS tokens FROM tk GROUP BY doc_id"
)
def index_segments(t: Tables) -> DataFrame:
    """An index that took its notes in by three batches: two thirds; the rest and edited ones; some that are gone. Records and tokens
    of each note that is left."""

    def grow(folder: str) -> None:
        own, docs, d = Segments(t._spark, folder), t.documents, F.col("doc_id")
        text = F.when(d % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        own.apply(docs.filter(d % 3 != 0).select("doc_id", "text"), 0)
        own.apply(docs.filter((d % 3 == 0) | (d % 7 == 0)).select("doc_id", text.alias("text")), 1)
        own.apply(docs.filter(d % 11 == 0).select("doc_id", F.lit(None).cast("string").alias("text")), 2)

    lengths = Segments(t._spark, generations(t._spark, "segments", [f"{t._folder}/documents.parquet"], grow)).table("lengths")
    return lengths.groupBy("doc_id").agg(F.count("*").alias("records"), F.sum("dl").alias("tokens"))
