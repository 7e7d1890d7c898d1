"""Queries: index, ranking, delivery, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import ledger, search

from .base import Tables, query

TERMS = ["with", "les", "und", "tion"]
_TOK = r"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"
_D = _TOK.format(c="text")
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = f"""
p AS (SELECT doc_id, unnest({_D}) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM p WHERE term IN ({_LIST}) GROUP BY ALL),
dl AS (SELECT doc_id, len({_D}) AS dl FROM documents),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score,
      count(*) AS n_terms FROM tf JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN c GROUP BY tf.doc_id)"""


@query(f"WITH {_BM25} SELECT s.doc_id, round(score, 6) AS score, n_terms, sha256(text) AS sha256 FROM s JOIN documents USING (doc_id) ORDER BY s.score DESC, s.doc_id LIMIT 10")
def bm25_topk(t: Tables) -> DataFrame:
    best = search.top(t.index.scores(TERMS), 10)
    full = t.documents.join(F.broadcast(best), "doc_id")  # ten rows
    return full.select("doc_id", F.round("score", 6).alias("score"), "n_terms", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, n_terms FROM s")
def bm25_scores(t: Tables) -> DataFrame:
    return t.index.scores(TERMS).select("doc_id", F.round("score", 6).alias("score"), "n_terms")


@query(f"WITH {_BM25.replace(_LIST, chr(39) + 'of' + chr(39) + ', ' + chr(39) + 'the' + chr(39))} SELECT doc_id, round(score, 6) AS score FROM s WHERE n_terms = 2")
def bm25_all_terms(t: Tables) -> DataFrame:
    return t.index.scores(["of", "the"]).filter("n_terms = 2").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM s WHERE score >= 0.3 * (SELECT max(score) FROM s)")
def relevance_floor(t: Tables) -> DataFrame:
    return search.floor(t.index.scores(TERMS), 0.3).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_D}) AS term FROM documents) GROUP BY term")
def doc_freq(t: Tables) -> DataFrame:
    return t.index.table("terms")


@query(f"SELECT doc_id, CAST(len({_D}) AS BIGINT) AS dl FROM documents")
def doc_lengths(t: Tables) -> DataFrame:
    return t.index.table("text_lengths")


def _count(term: str) -> str:
    return f"CAST((length(f) - length(replace(f, '{term}', ''))) / {len(term)} AS BIGINT)"


@query(
    "WITH f AS (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents), "
    f"c AS (SELECT doc_id, {_count('heon')} AS a, {_count('les ')} AS b FROM f) "
    "SELECT doc_id, CAST(CAST(a > 0 AS BIGINT) + CAST(b > 0 AS BIGINT) AS BIGINT) AS n_terms, a + b AS total FROM c WHERE a > 0 OR b > 0 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50"
)
def grep_rank(t: Tables) -> DataFrame:
    return search.grep(t.documents, ["heon", "les "]).orderBy(F.desc("n_terms"), F.desc("total"), "doc_id").limit(50)


@query(
    f"WITH k AS (SELECT doc_id, {_D} AS t FROM documents) SELECT doc_id, CAST(len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS BIGINT) AS hits "
    "FROM k WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0"
)
def phrase_search(t: Tables) -> DataFrame:
    return t.index.phrase(["of", "the"])


def _rank_sql(terms: list[str]) -> str:
    return _BM25.replace(_LIST, ", ".join(f"'{x}'" for x in terms))


@query(
    f"WITH a AS (WITH {_rank_sql(['with', 'by'])} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM s ORDER BY pos LIMIT 80), "
    f"b AS (WITH {_rank_sql(['les', 'des'])} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM s ORDER BY pos LIMIT 80) "
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0 / (60 + a.pos), 0) + coalesce(1.0 / (60 + b.pos), 0), 6) AS rrf FROM a FULL JOIN b ON a.doc_id = b.doc_id"
)
def rrf_fusion(t: Tables) -> DataFrame:
    lists = [search.ranked(t.index.scores(terms), 80) for terms in (["with", "by"], ["les", "des"])]
    return search.rrf(*lists).select("doc_id", F.round("rrf", 6).alias("rrf"))


_URL, _HTML = _TOK.format(c="url"), _TOK.format(c="html")


@query(
    f"WITH k AS (SELECT page_id, {_URL} AS u, {_HTML} AS h FROM pages), f AS (SELECT page_id, 10.0 * len(list_filter(u, lambda x: x = 'html')) + len(list_filter(h, lambda x: x = 'html')) AS tf, "
    "len(u) + len(h) AS dl FROM k), c AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM f) "
    "SELECT page_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) AS score FROM f CROSS JOIN c WHERE tf > 0"
)
def weighted_fields_bm25(t: Tables) -> DataFrame:
    scored = search.bm25(t.pages, ["html"], key="page_id", weights={"url": 10.0, "html": 1.0})
    return scored.select("page_id", F.round("score", 9).alias("score"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) - 1 AS duplicates FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_exact(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first"), (F.count("*") - 1).alias("duplicates")).filter("duplicates > 0")


@query(
    "WITH r AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0), a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 3 = 1), "
    "rn AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS n FROM r), an AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS n FROM a) "
    "SELECT rn.doc_id, an.doc_id AS moved_to FROM rn JOIN an USING (sha, n)"
)
def moved_pairs(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return ledger.moved(rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 = 1"), "doc_id", "sha")


@query(
    "WITH o AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0) "
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id"
)
def index_diff(t: Tables) -> DataFrame:
    """Two generations of a source: some rows gone, some new, some changed."""
    old = t.documents.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    edited = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = t.documents.filter("doc_id % 5 <> 0").select("doc_id", F.sha2(edited, 256).alias("sha"))
    return ledger.diff(old, new, "doc_id", "sha")


@query("SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line, sha256(unnest(string_split(text, chr(10)))) AS sha256 FROM documents")
def line_hashes(t: Tables) -> DataFrame:
    each = t.documents.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "row"))
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.sha2("row", 256).alias("sha256"))


@query("SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS est_tokens, count(*) AS n FROM documents GROUP BY source")
def est_tokens_by_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(T.est_tokens(F.col("text"))).alias("est_tokens"), F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS span FROM documents) "
    "SELECT doc_id, CAST(strlen(span) AS BIGINT) AS n_bytes, CAST(length(span) AS BIGINT) AS n_chars, sha256(span) AS sha256 FROM s WHERE length(span) > 0"
)
def byte_spans(t: Tables) -> DataFrame:
    """Lines 2 to 3 of each document: bytes, characters and hash."""
    s = t.documents.select("doc_id", T.span(F.col("text"), F.lit(2), F.lit(3)).alias("span")).filter("span <> ''")
    return s.select("doc_id", F.octet_length("span").cast("long").alias("n_bytes"), F.char_length("span").cast("long").alias("n_chars"), F.sha2("span", 256).alias("sha256"))


@query("SELECT doc_id, sha256(substring(text, 101, 200)) AS sha256, CAST(length(text) AS BIGINT) AS total, CAST(length(substring(text, 101, 200)) AS BIGINT) AS n FROM documents WHERE length(text) > 100")
def read_window(t: Tables) -> DataFrame:
    """Characters 100 to 300 of each text that has them."""
    part = F.substring("text", 101, 200)
    rows = t.documents.filter(F.char_length("text") > 100)
    return rows.select("doc_id", F.sha2(part, 256).alias("sha256"), F.char_length("text").cast("long").alias("total"), F.char_length(part).cast("long").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || ' ... ' || right(text, 55) END AS bounded FROM conversations")
def bounded_prompt(t: Tables) -> DataFrame:
    text = F.col("text")
    cut = F.concat(F.substring(text, 1, 60), F.lit(" ... "), F.expr("right(text, 55)"))
    return t.conversations.select("conv_id", "turn", F.when(F.char_length(text) <= 120, text).otherwise(cut).alias("bounded"))


@query("SELECT doc_id, source FROM documents WHERE NOT (lower(source) IN ('src3', 'src7') OR lower(source) LIKE 'src1%')")
def exclusion_filter(t: Tables) -> DataFrame:
    name = F.lower("source")
    return t.documents.filter(~(name.isin("src3", "src7") | name.startswith("src1"))).select("doc_id", "source")


@query(
    "WITH r AS (SELECT unnest(['empty', 'oversize', 'unreadable', 'ok']) AS reason), c AS (SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN strlen(text) > 20000 THEN 'oversize' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1) "
    "SELECT r.reason, coalesce(n, 0) AS n FROM r LEFT JOIN c ON r.reason = c.reason"
)
def skip_counts(t: Tables) -> DataFrame:
    """Documents by the reason to skip them; reasons without documents have 0."""
    reason = F.when(F.char_length("text") == 0, "empty").when(F.octet_length("text") > 20000, "oversize").otherwise("ok")
    every = t._spark.createDataFrame([("empty",), ("oversize",), ("unreadable",), ("ok",)], "reason string")
    return every.join(t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")), "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"WITH {_BM25}, k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM s ORDER BY pos LIMIT 20) "
    "SELECT k.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'deleted' WHEN d.doc_id % 5 = 0 THEN 'changed since indexing' ELSE 'delivered' END AS state FROM k JOIN documents d USING (doc_id)"
)
def withheld(t: Tables) -> DataFrame:
    """The twenty best against a later generation in which some documents are gone or changed; no slot is filled again."""
    best = search.ranked(t.index.scores(TERMS), 20)
    indexed = t.documents.join(F.broadcast(best), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"))  # twenty rows
    now = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = t.documents.filter("doc_id % 4 <> 0").select("doc_id", F.sha2(now, 256).alias("now"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("sha"), "changed since indexing").otherwise("delivered")
    return indexed.join(current, "doc_id", "left").select("doc_id", state.alias("state"))


@query(
    f"WITH {_BM25}, k AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 30), l AS (SELECT k.doc_id, CAST(sum(length(text)) OVER (ORDER BY score DESC, k.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM k JOIN documents USING (doc_id)) "
    "SELECT doc_id, used FROM l WHERE used <= 20000"
)
def budget_cut(t: Tables) -> DataFrame:
    """Whole documents in rank order until the budget of characters is used up."""
    best = search.top(t.index.scores(TERMS), 30)
    rows = t.documents.join(F.broadcast(best.select("doc_id", "score")), "doc_id").select("doc_id", "score", F.char_length("text").alias("n"))
    order = Window.orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # thirty rows
    return rows.select("doc_id", F.sum("n").over(order).alias("used")).filter("used <= 20000")


@query(
    f"WITH {_BM25} SELECT (SELECT count(DISTINCT sha256(text)) FROM documents) AS distinct_texts, (SELECT count(*) FROM documents) AS indexed, (SELECT count(*) FROM s) AS matched, "
    "CASE WHEN (SELECT count(*) FROM s) = 0 THEN 'NOT_FOUND' ELSE 'FOUND' END AS status"
)
def coverage_receipt(t: Tables) -> DataFrame:
    sums = t.documents.agg(F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"), F.count("*").alias("indexed"))
    matched = t.index.scores(TERMS).agg(F.count("*").alias("matched"))
    return sums.crossJoin(matched).withColumn("status", F.when(F.col("matched") == 0, "NOT_FOUND").otherwise("FOUND"))  # one row each
