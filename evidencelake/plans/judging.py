"""Queries: runs of retrieval methods over cases, their scores, rubrics and gates; claims and contracts that are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import evals, routing, topk
from evidencelake.operators.shared import cut, forget

from .base import Tables, query
from .prompts import _CHUNKS, _STOP

_TOP = 3
_RUN = (
    _CHUNKS + r""",
bw AS (SELECT item_id, unnest(k) AS term, unnest(range(0, len(k))) AS pos FROM (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS k FROM benchmark)),
bt AS (SELECT item_id, term, min(pos) AS pos FROM bw WHERE term NOT IN (""" + _STOP + r""") AND length(term) > 1 AND NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL),
bq AS (SELECT item_id, term FROM bt QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 12),
bx AS (SELECT doc_id, chunk, unnest(k) AS term FROM tk), bp AS (SELECT term, doc_id, chunk, count(*) AS tf FROM bx GROUP BY ALL), bd AS (SELECT term, count(*) AS df FROM bp GROUP BY term), bl AS (SELECT doc_id, chunk, len(k) AS dl FROM tk), ba AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bl),
br AS (SELECT item_id, bp.doc_id, bp.chunk, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bq JOIN bp USING (term) JOIN bd USING (term) JOIN bl ON bl.doc_id = bp.doc_id AND bl.chunk = bp.chunk CROSS JOIN ba GROUP BY ALL),
bn AS (SELECT item_id, doc_id, round(max(score), 6) AS score FROM br GROUP BY ALL),
fd AS (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents),
gt AS (SELECT item_id, doc_id, count(*) AS n_terms, sum((length(f) - length(replace(f, term, ''))) // length(term)) AS total FROM bq JOIN fd ON contains(f, term) GROUP BY ALL),
rn AS (SELECT 'fts' AS method, item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bn UNION ALL SELECT 'grep', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_terms DESC, total DESC, doc_id) FROM gt),
k AS (SELECT item_id, doc_id, length(d.text) AS size FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
kn AS (SELECT item_id, CASE count(k.doc_id) WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'single' ELSE 'several' END AS kind FROM benchmark LEFT JOIN k USING (item_id) GROUP BY item_id),
me(method) AS (VALUES ('fts'), ('grep')),
pz AS (SELECT method, r.item_id, r.doc_id, rank, length(d.text) AS size, k.doc_id IS NOT NULL AS gold, coalesce(l.quality, 1) = 0 AS junk FROM rn r JOIN documents d USING (doc_id) LEFT JOIN k ON k.item_id = r.item_id AND k.doc_id = r.doc_id LEFT JOIN labels l ON l.doc_id = r.doc_id WHERE rank <= """ + str(_TOP) + r"""),
s0 AS (SELECT method, b.item_id, coalesce(bool_or(gold), false) AS found, count(pz.doc_id) AS passages, coalesce(bool_or(NOT gold AND junk), false) AS distracted,
       CAST(coalesce(sum(ceil(size / 4.0)), 0) AS BIGINT) AS tokens FROM benchmark b CROSS JOIN me LEFT JOIN pz USING (method, item_id) GROUP BY ALL),
sc AS (SELECT method, item_id, kind, passages = 0 AS failed, found AS complete, passages, distracted, tokens FROM s0 JOIN kn USING (item_id))"""
)


def _gold(t: Tables) -> DataFrame:
    """(item_id, doc_id): the documents that have the passage of an item, word for word. Found once a state of the tables."""
    claims = t.benchmark.select("item_id", F.col("text").alias("claim"))
    return t.made("gold", ["documents", "benchmark"], lambda folder: topk.holding(t.index, t.documents, claims, "item_id").distinct().write.parquet(folder))


def _passages(t: Tables) -> DataFrame:
    """method, item_id, doc_id, rank, size, gold, junk: the three best documents of both methods for the first twelve terms of each
    item, run over all documents; gold: it has the passage asked for; junk: it is labelled so. Run once a state of the tables."""

    def run(folder: str) -> None:
        each = t.benchmark.select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))
        some = each.filter(~F.col("term").isin(routing.STOPWORDS) & (F.char_length("term") > 1) & ~F.rlike("term", F.lit("^[0-9]+$")))
        nth = F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))
        asked = cut(some.groupBy("item_id", "term").agg(F.min("pos").alias("pos")).withColumn("n", nth).filter("n <= 12").select("item_id", "term"))
        fts = topk.top_notes(t.index, asked, _TOP, "item_id").select(F.lit("fts").alias("method"), "item_id", "doc_id", "rank")
        grep = topk.grep_notes(t.index, asked, _TOP, "item_id").select(F.lit("grep").alias("method"), "item_id", "doc_id", "rank")
        rows = fts.union(grep).join(t.documents.select("doc_id", F.char_length("text").alias("size")), "doc_id")
        rows = rows.join(_gold(t).withColumn("gold", F.lit(True)), ["item_id", "doc_id"], "left").join(t.labels.select("doc_id", (F.col("quality") == 0).alias("junk")), "doc_id", "left")
        rows.fillna(False, ["gold", "junk"]).write.parquet(folder)
        forget(asked)

    return t.made("runs", ["documents", "benchmark", "labels"], run)


def _kinds(t: Tables) -> DataFrame:
    """(item_id, kind) by how many documents have the passage."""
    n = t.benchmark.select("item_id").join(_gold(t).groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left")
    return n.select("item_id", F.when(F.col("n").isNull(), "unanswerable").when(F.col("n") == 1, "single").otherwise("several").alias("kind"))


def _scored(t: Tables) -> DataFrame:
    """A row a case and method. A case for which a method delivers nothing has failed and is not complete."""
    cases = _kinds(t).withColumn("method", F.explode(F.array(F.lit("grep"), F.lit("fts"))))
    both = cases.join(_passages(t), ["method", "item_id"], "left")
    a = both.groupBy("method", "item_id", "kind").agg(
        F.coalesce(F.bool_or("gold"), F.lit(False)).alias("complete"),
        F.count("doc_id").alias("passages"),
        F.coalesce(F.bool_or(~F.col("gold") & F.col("junk")), F.lit(False)).alias("distracted"),
        F.coalesce(F.sum(F.ceil(F.col("size") / 4)), F.lit(0)).alias("tokens"),
    )
    return a.withColumn("failed", F.col("passages") == 0)


@query(f"WITH RECURSIVE {_RUN} SELECT method, item_id, complete, passages, tokens, distracted AND NOT complete AS misled FROM sc")
def score_cases(t: Tables) -> DataFrame:
    """Whether each case is complete, what it cost, and whether a distractor stands in an incomplete one."""
    return _scored(t).select("method", "item_id", "complete", "passages", "tokens", (F.col("distracted") & ~F.col("complete")).alias("misled"))


_Z = "1.959963984540054"
_AGG = (
    "count(*) AS n, count(*) FILTER (complete) AS done, count(*) FILTER (failed) AS errors, count(*) FILTER (distracted AND NOT complete) AS misled, round(avg(tokens) FILTER (NOT failed), 6) AS mean_tokens, "
    "CAST(median(tokens) FILTER (NOT failed) AS DOUBLE) AS median_tokens, max(tokens) FILTER (NOT failed) AS most_tokens"
)


def _aggregates() -> list[Column]:
    ok = F.when(~F.col("failed"), F.col("tokens"))
    misled = F.col("distracted") & ~F.col("complete")
    return [
        F.count("*").alias("n"), F.count_if("complete").alias("done"), F.count_if("failed").alias("errors"), F.count_if(misled).alias("misled"),
        F.round(F.avg(ok), 6).alias("mean_tokens"), F.median(ok).alias("median_tokens"), F.max(ok).alias("most_tokens"),
    ]


@query(
    f"WITH RECURSIVE {_RUN}, a AS (SELECT method, {_AGG} FROM sc GROUP BY method), p AS (SELECT *, CAST(done AS DOUBLE) / n AS p FROM a) SELECT method, n, done, errors, misled, mean_tokens, median_tokens, most_tokens, "
    f"round(greatest(0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS low, round(least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS high FROM p"
)
def run_summary(t: Tables) -> DataFrame:
    """Each method's run: errors stay in the count of cases but out of the means of tokens."""
    a = _scored(t).groupBy("method").agg(*_aggregates())
    low, high = evals.wilson(F.col("done"), F.col("n"))
    return a.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


@query(f"WITH RECURSIVE {_RUN} SELECT method, coalesce(kind, 'all') AS kind, {_AGG} FROM sc GROUP BY ROLLUP (method, kind) HAVING method IS NOT NULL")
def summary_by_kind(t: Tables) -> DataFrame:
    """The same for each kind of case, and for all kinds."""
    a = _scored(t).rollup("method", "kind").agg(*_aggregates()).filter("method is not null")
    return a.withColumn("kind", F.coalesce("kind", F.lit("all")))


_ARMS = [("brief", 400), ("standard", 1500), ("wide", 20000)]


@query(f"WITH RECURSIVE {_RUN}, ar(arm, budget) AS (VALUES " + ", ".join(f"('{a}', {b})" for a, b in _ARMS) + ") SELECT arm, method, count(*) AS n, count(*) FILTER (tokens <= budget) AS within, count(*) FILTER (complete AND tokens <= budget) AS complete_within FROM sc CROSS JOIN ar GROUP BY ALL")
def budget_arms(t: Tables) -> DataFrame:
    """How many cases each budget of tokens would have allowed."""
    arms = t._spark.createDataFrame(_ARMS, "arm string, budget int")
    fits = F.col("tokens") <= F.col("budget")
    each = _scored(t).crossJoin(F.broadcast(arms))  # three arms
    return each.groupBy("arm", "method").agg(F.count("*").alias("n"), F.count_if(fits).alias("within"), F.count_if(fits & F.col("complete")).alias("complete_within"))


@query(
    f"WITH RECURSIVE {_RUN}, a AS (SELECT item_id, any_value(kind) AS kind, bool_or(method = 'grep' AND complete) AS x, bool_or(method = 'fts' AND complete) AS y FROM sc GROUP BY item_id) SELECT kind, count(*) AS n, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_grep, count(*) FILTER (y AND NOT x) AS only_fts FROM a GROUP BY kind"
)
def paired_methods(t: Tables) -> DataFrame:
    """Cases that both methods or one alone completes."""
    won = lambda m: F.bool_or((F.col("method") == m) & F.col("complete"))
    a = _scored(t).groupBy("item_id").agg(F.first("kind").alias("kind"), won("grep").alias("x"), won("fts").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_grep"), F.count_if(y & ~x).alias("only_fts"))


_FILES = "fp AS (SELECT doc_id, concat(source, '/', lang, '/n', doc_id, '.md') AS path FROM documents)"


def _path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))


@query(f"WITH RECURSIVE {_RUN}, {_FILES} SELECT item_id || ' 0 ' || url_encode(path) || ' 1' AS line FROM k JOIN fp USING (doc_id)")
def trec_qrels(t: Tables) -> DataFrame:
    """Judgements in the format of evaluation tools; names are percent-encoded."""
    named = _gold(t).join(t.documents.select("doc_id", _path().alias("path")), "doc_id")
    return named.select(F.concat(F.col("item_id").cast("string"), F.lit(" 0 "), F.url_encode("path"), F.lit(" 1")).alias("line"))


@query(f"WITH RECURSIVE {_RUN}, {_FILES} SELECT item_id || ' Q0 ' || url_encode(path) || ' ' || rank || ' ' || (100 - rank) || ' ' || method AS line FROM pz JOIN fp USING (doc_id)")
def trec_run(t: Tables) -> DataFrame:
    """The ranked results of both methods in the format of evaluation tools."""
    best = _passages(t).join(t.documents.select("doc_id", _path().alias("path")), "doc_id")
    s = lambda c: c.cast("string")
    return best.select(F.concat(s(F.col("item_id")), F.lit(" Q0 "), F.url_encode("path"), F.lit(" "), s(F.col("rank")), F.lit(" "), s(100 - F.col("rank")), F.lit(" "), "method").alias("line"))


@query(f"WITH RECURSIVE {_RUN}, {_FILES}, e AS (SELECT item_id, 'src' || item_id % 20 AS folder, 'n' || item_id || '.md' AS base FROM benchmark) SELECT method, e.item_id, coalesce(bool_or(path LIKE e.folder || '/%'), false) AS folder_hit, coalesce(bool_or(path LIKE '%/' || e.base), false) AS name_hit FROM e CROSS JOIN me LEFT JOIN pz USING (method, item_id) LEFT JOIN fp USING (doc_id) GROUP BY ALL")
def expected_sources(t: Tables) -> DataFrame:
    """Whether what was delivered has a name, or the folder, that the case expects."""
    cases = t.benchmark.select("item_id").withColumn("method", F.explode(F.array(F.lit("grep"), F.lit("fts"))))
    named = _passages(t).join(t.documents.select("doc_id", _path().alias("path")), "doc_id")
    folder = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/"))
    base = F.concat(F.lit("/n"), F.col("item_id").cast("string"), F.lit(".md"))
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return cases.join(named, ["method", "item_id"], "left").groupBy("method", "item_id").agg(hit(F.startswith("path", folder)).alias("folder_hit"), hit(F.endswith("path", base)).alias("name_hit"))


_GATE = [("lang", "en", 0.3), ("lang", "de", 0.3), ("lang", "fr", 0.9), ("source", "src1", 0.2), ("source", "absent", 0.5)]


@query(
    "WITH g(facet, value, least) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _GATE) + "), j AS (SELECT quality, lang, source FROM labels JOIN documents USING (doc_id)), f AS (SELECT 'lang' AS facet, lang AS value, avg(quality) AS rate FROM j GROUP BY lang UNION ALL SELECT 'source', source, avg(quality) FROM j GROUP BY source) "
    "SELECT g.facet, g.value, round(rate, 6) AS rate, coalesce(rate >= least, false) AS passes, bool_and(coalesce(rate >= least, false)) OVER () AS promoted FROM g LEFT JOIN f USING (facet, value)"
)
def gate_facets(t: Tables) -> DataFrame:
    """Thresholds by facet; a facet without rows fails, and one that fails holds the run back."""
    gate = t._spark.createDataFrame(_GATE, "facet string, value string, least double")
    rates = evals.facets(t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id"), ["lang", "source"], F.avg("quality").alias("rate"))
    passes = F.coalesce(F.col("rate") >= F.col("least"), F.lit(False))
    out = F.broadcast(gate).join(rates, ["facet", "value"], "left").select("facet", "value", F.round("rate", 6).alias("rate"), passes.alias("passes"))
    return out.withColumn("promoted", F.bool_and("passes").over(Window.partitionBy()))  # as many rows as thresholds


_RUBRIC = (
    "x AS (SELECT doc_id, lower(text) AS b, lang, doc_id % 9 = 0 AS blank FROM documents), r AS (SELECT doc_id, lang, blank, list_filter(['tion', 'ment', 'ung'], lambda z: contains(b, z)) AS had, contains(b, ' was ') OR contains(b, 'sch') AS cur, contains(b, ' were ') OR contains(b, 'eux') AS stale, contains(b, ' from ') AS fixed, "
    "regexp_matches(b, 'hethe') AND NOT contains(b, 'perhaps') AS sprung, length(b) > 500 AS sourced FROM x), "
    "a AS (SELECT doc_id, lang, CASE WHEN blank THEN NULL WHEN len(had) = 3 THEN 2 WHEN len(had) = 0 THEN 0 ELSE 1 END AS facts, CASE WHEN cur AND (fixed OR NOT stale) THEN 2 WHEN stale AND NOT fixed THEN 0 END AS timely, CASE WHEN sourced THEN 2 ELSE 1 END AS sourcing, sprung FROM r), "
    "z AS (SELECT doc_id, lang, CASE WHEN facts IS NOT NULL AND sprung THEN 0 ELSE facts END AS facts, CASE WHEN timely IS NOT NULL AND sprung THEN 0 ELSE timely END AS timely, CASE WHEN sprung THEN 0 ELSE sourcing END AS sourcing, sprung FROM a)"
)


def _rubric(t: Tables) -> DataFrame:
    """doc_id, lang, and axes from 0 to 2, null where an axis does not apply. A sprung trap makes all that apply 0."""
    b = F.lower("text")
    has = lambda s: F.contains(b, F.lit(s))
    n = sum((has(s).cast("int") for s in ("tion", "ment", "ung")), F.lit(0))
    current, stale, fixed = has(" was ") | has("sch"), has(" were ") | has("eux"), has(" from ")
    facts = F.when(F.col("doc_id") % 9 != 0, F.when(n == 3, 2).when(n == 0, 0).otherwise(1))
    timely = F.when(current & (fixed | ~stale), 2).when(stale & ~fixed, 0)
    sourcing = F.when(F.char_length("text") > 500, 2).otherwise(1)
    sprung = has("hethe") & ~has("perhaps")
    zero = lambda c: F.when(c.isNotNull() & F.col("sprung"), 0).otherwise(c)
    raw = t.documents.select("doc_id", "lang", facts.alias("facts"), timely.alias("timely"), sourcing.alias("sourcing"), sprung.alias("sprung"))
    return raw.select("doc_id", "lang", *[zero(F.col(c)).alias(c) for c in ("facts", "timely", "sourcing")], "sprung")


@query(f"WITH {_RUBRIC} SELECT doc_id, facts, timely, sourcing, sprung FROM z")
def rubric_axes(t: Tables) -> DataFrame:
    return _rubric(t).drop("lang")


@query(f"WITH {_RUBRIC}, u AS (SELECT lang, unnest(['facts', 'timely', 'sourcing']) AS axis, unnest([facts, timely, sourcing]) AS points FROM z) SELECT lang, axis, count(points) AS applicable, CAST(coalesce(sum(points), 0) AS BIGINT) AS points, round(sum(points) / (2.0 * count(points)), 6) AS share FROM u GROUP BY ALL")
def rubric_summary(t: Tables) -> DataFrame:
    """Points of each axis over the cases to which it applies."""
    each = _rubric(t).unpivot(["lang"], ["facts", "timely", "sourcing"], "axis", "points")
    return each.groupBy("lang", "axis").agg(F.count("points").alias("applicable"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.round(F.sum("points") / (2.0 * F.count("points")), 6).alias("share"))


@query("SELECT d.doc_id, l.doc_id IS NULL AS missing, coalesce(l.quality, 0) AS score FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_packets(t: Tables) -> DataFrame:
    """A case without a packet scores 0 and stays in the count."""
    judged = t.labels.select("doc_id", "quality", F.lit(True).alias("there"))
    return t.documents.select("doc_id").join(judged, "doc_id", "left").select("doc_id", F.col("there").isNull().alias("missing"), F.coalesce("quality", F.lit(0)).alias("score"))


@query(
    "WITH a AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 4 = 0 THEN ' There is not enough evidence.' WHEN conv_id % 6 = 1 THEN ' See src1/en/n' || conv_id || '.md here.' ELSE '' END AS text FROM conversations WHERE role = 'assistant') "
    r"SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z])(not enough evidence|cannot be answered|no record)([^a-z]|$)') AS abstains, regexp_extract(text, '(?:^|\s)(src[0-9]+/[a-z]+/n[0-9]+\.md)(?:\s|$)', 1) AS cited FROM a"
)
def answer_signs(t: Tables) -> DataFrame:
    """Whether an answer abstains, and which file it names, at word boundaries."""
    c = F.col("conv_id")
    more = F.when(c % 4 == 0, F.lit(" There is not enough evidence.")).when(c % 6 == 1, F.concat(F.lit(" See src1/en/n"), c.cast("string"), F.lit(".md here."))).otherwise(F.lit(""))
    a = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.concat("text", more).alias("text"))
    abstains = F.rlike(F.lower("text"), F.lit("(^|[^a-z])(not enough evidence|cannot be answered|no record)([^a-z]|$)"))
    return a.select("conv_id", "turn", abstains.alias("abstains"), F.regexp_extract("text", r"(?:^|\s)(src[0-9]+/[a-z]+/n[0-9]+\.md)(?:\s|$)", 1).alias("cited"))


_ANSWERS = (
    "an AS (SELECT user_id AS case_id, event_type AS arm, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events), la AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY case_id, arm ORDER BY ts DESC, event_id DESC) = 1), "
    "jd AS (SELECT case_id, arm, CASE k % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'wrong' ELSE 'abstained' END AS verdict FROM la WHERE case_id % 3 <> 0)"
)


def _answers(t: Tables) -> DataFrame:
    """The latest answer of each case and arm."""
    last = F.row_number().over(Window.partitionBy("case_id", "arm").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = t.events.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("arm"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return rows.withColumn("n", last).filter("n = 1").drop("n")


def _judged(t: Tables) -> DataFrame:
    k = F.col("k") % 4
    verdict = F.when(k == 0, "correct").when(k == 1, "partial").when(k == 2, "wrong").otherwise("abstained")
    own = _answers(t).filter("case_id % 3 <> 0")
    return own.select("case_id", "arm", F.when(F.col("k").isNull(), "abstained").otherwise(verdict).alias("verdict"))


@query(f"WITH {_ANSWERS} SELECT la.case_id, la.arm, la.event_id, coalesce(jd.verdict, 'unjudged') AS verdict FROM la LEFT JOIN jd USING (case_id, arm)")
def judged_answers(t: Tables) -> DataFrame:
    """The latest answer of each case and arm with its judgement, if there is one."""
    return _answers(t).join(_judged(t), ["case_id", "arm"], "left").select("case_id", "arm", "event_id", F.coalesce("verdict", F.lit("unjudged")).alias("verdict"))


@query(
    f"WITH {_ANSWERS} SELECT la.arm, count(*) AS n, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict IS NULL) AS unjudged, round(avg(value), 6) AS mean_cost, round(avg(value) FILTER (verdict = 'correct'), 6) AS mean_cost_correct FROM la LEFT JOIN jd USING (case_id, arm) GROUP BY la.arm"
)
def arm_summary(t: Tables) -> DataFrame:
    both = _answers(t).join(_judged(t), ["case_id", "arm"], "left")
    right = F.col("verdict") == "correct"
    return both.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(F.col("verdict").isNull()).alias("unjudged"), F.round(F.avg("value"), 6).alias("mean_cost"), F.round(F.avg(F.when(right, F.col("value"))), 6).alias("mean_cost_correct")
    )


_USAGE = "us AS (SELECT l_orderkey AS run, l_shipdate AS day, 'm' || l_suppkey % 4 AS model, CAST(l_quantity AS BIGINT) AS input, CAST(floor(l_quantity / 3) AS BIGINT) AS cached, CAST(l_linenumber * 7 AS BIGINT) AS output, CASE WHEN l_linenumber <> 4 THEN CAST(floor(l_extendedprice / 100) AS BIGINT) END AS cost FROM lineitem)"


def _usage(t: Tables) -> DataFrame:
    li = t.lineitem
    cost = F.when(F.col("l_linenumber") != 4, F.floor(F.col("l_extendedprice") / 100))
    return li.select(
        F.col("l_orderkey").alias("run"), F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"), F.col("l_quantity").cast("long").alias("input"),
        F.floor(F.col("l_quantity") / 3).alias("cached"), (F.col("l_linenumber") * 7).cast("long").alias("output"), cost.alias("cost"),
    )


@query(f"WITH {_USAGE} SELECT run, CAST(sum(input - cached) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(output) AS BIGINT) AS output, CAST(sum(input + output) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost, count(*) FILTER (cost IS NULL) AS unknown FROM us GROUP BY run")
def usage_rows(t: Tables) -> DataFrame:
    """Events of a run folded into one row: cached tokens are part of the input and counted once; unknown is not zero."""
    total = lambda c, name: F.sum(c).alias(name)
    i, c, o = F.col("input"), F.col("cached"), F.col("output")
    return _usage(t).groupBy("run").agg(total(i - c, "input"), total(c, "cached"), total(o, "output"), total(i + o, "tokens"), total("cost", "cost"), F.count_if(F.col("cost").isNull()).alias("unknown"))


@query(f"WITH {_USAGE}, m AS (SELECT run, model, sum(input + output) AS n FROM us GROUP BY ALL) SELECT model, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS runs FROM m GROUP BY model")
def model_usage(t: Tables) -> DataFrame:
    """Maps of tokens by model, one a run, added up model by model."""
    maps = _usage(t).groupBy("run", "model").agg(F.sum(F.col("input") + F.col("output")).alias("n"))
    maps = maps.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("model", "n"))).alias("by_model"))
    return maps.select(F.explode("by_model").alias("model", "n")).groupBy("model").agg(F.sum("n").alias("tokens"), F.count("*").alias("runs"))


@query(
    f"WITH {_USAGE}, r AS (SELECT run, count(*) AS workers, sum(input) AS own, max(input) AS shared FROM us GROUP BY run) SELECT workers, count(*) AS runs, CAST(sum(own + 20 * workers) AS BIGINT) AS naive, CAST(sum(own / 2) AS DOUBLE) AS lean, CAST(sum(shared + 10 * workers) AS BIGINT) AS lean_shared FROM r GROUP BY workers"
)
def orchestration_arms(t: Tables) -> DataFrame:
    """What handing work to several workers costs: each with all of it, with half of its own, or with one shared part."""
    r = _usage(t).groupBy("run").agg(F.count("*").alias("workers"), F.sum("input").alias("own"), F.max("input").alias("shared"))
    w = F.col("workers")
    return r.groupBy("workers").agg(F.count("*").alias("runs"), F.sum(F.col("own") + 20 * w).alias("naive"), F.sum(F.col("own") / 2).alias("lean"), F.sum(F.col("shared") + 10 * w).alias("lean_shared"))


_CLAIMS = (
    "ln AS (SELECT doc_id, string_split(text, chr(10)) AS r, text FROM documents), "
    "cl AS (SELECT doc_id, r, text, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 2 END AS a, CASE WHEN doc_id % 11 = 0 THEN 40 WHEN doc_id % 13 = 0 THEN 1 ELSE 2 END AS b, CASE WHEN doc_id % 7 = 0 THEN left(r[2], 8) WHEN doc_id % 5 = 0 THEN r[1] WHEN doc_id % 17 = 0 THEN replace(r[2], ' ', '  ') WHEN doc_id % 19 = 0 THEN 'never said so at all' ELSE r[2] END AS quote FROM ln WHERE len(r) >= 3), "
    "sp AS (SELECT doc_id, a, b, quote, text, array_to_string(r[a:b], chr(10)) AS span FROM cl), "
    r"pb AS (SELECT doc_id, CASE WHEN b < a THEN 'lines are out of order' WHEN b - a + 1 > 21 THEN 'span is too long' WHEN length(quote) < 12 THEN 'quote is too short' WHEN contains(span, quote) THEN 'ok' WHEN contains(regexp_replace(span, '\s+', ' ', 'g'), regexp_replace(quote, '\s+', ' ', 'g')) THEN 'ok but for white space' WHEN contains(text, quote) THEN 'stands elsewhere' ELSE 'not found' END AS state FROM sp)"
)


def _claims(t: Tables) -> DataFrame:
    """doc_id, a, b (lines), quote, text: what is said to stand in lines a to b, with faults of all kinds."""
    d = F.col("doc_id")
    rows = t.documents.select("doc_id", "text", F.split("text", "\n", -1).alias("r")).filter(F.size("r") >= 3)
    second = F.element_at("r", 2)
    quote = F.when(d % 7 == 0, F.substring(second, 1, 8)).when(d % 5 == 0, F.element_at("r", 1)).when(d % 17 == 0, F.replace(second, F.lit(" "), F.lit("  "))).when(d % 19 == 0, F.lit("never said so at all")).otherwise(second)
    first, last = F.when(d % 11 == 0, 1).otherwise(2), F.when(d % 11 == 0, 40).when(d % 13 == 0, 1).otherwise(2)
    return rows.select("doc_id", first.alias("a"), last.alias("b"), quote.alias("quote"), "text")


def _spans(t: Tables) -> DataFrame:
    return evals.span_states(_claims(t)).select("doc_id", "state")


@query(f"WITH {_CLAIMS} SELECT doc_id, state FROM pb")
def span_problems(t: Tables) -> DataFrame:
    """The first thing that is wrong with each quoted span."""
    return _spans(t)


@query(
    f"WITH {_CLAIMS}, d AS (SELECT CAST(doc_id / 4 AS BIGINT) AS record, doc_id, state FROM pb), x AS (SELECT *, count(*) OVER (PARTITION BY doc_id % 97, state) > 1 AND doc_id % 29 = 0 AS doubled FROM d) "
    "SELECT source, count(*) AS claims, count(*) FILTER (state LIKE 'ok%' AND NOT doubled) AS passed, count(*) FILTER (doubled) AS doubled, bool_and(state LIKE 'ok%' AND NOT doubled) AS accepted FROM x JOIN documents USING (doc_id) GROUP BY source"
)
def handback_check(t: Tables) -> DataFrame:
    """A hand-back is accepted if every claim of it passes; repeated ones fail, all of them."""
    twice = F.count("*").over(Window.partitionBy(F.col("doc_id") % 97, "state")) > 1
    x = _spans(t).withColumn("doubled", twice & (F.col("doc_id") % 29 == 0)).join(t.documents.select("doc_id", "source"), "doc_id")
    good = F.col("state").startswith("ok") & ~F.col("doubled")
    return x.groupBy("source").agg(F.count("*").alias("claims"), F.count_if(good).alias("passed"), F.count_if("doubled").alias("doubled"), F.bool_and(good).alias("accepted"))


@query(
    "WITH RECURSIVE g AS (SELECT source, count(*) AS total, greatest(1, count(*) FILTER (lang = 'de')) AS bad FROM documents GROUP BY source), s AS (SELECT source, total, bad, 0 AS n, CAST(1.0 AS DOUBLE) AS p FROM g UNION ALL SELECT source, total, bad, n + 1, p * (total - bad - n) / (total - n) FROM s WHERE p > 0.05) SELECT source, total, bad, CAST(max(n) AS BIGINT) AS n FROM s GROUP BY ALL"
)
def least_sample(t: Tables) -> DataFrame:
    """How many must be drawn so that none of the bad ones is among them with 5 % at most."""
    g = t.documents.groupBy("source").agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.count_if(F.col("lang") == "de")).alias("bad"))
    return g.select("source", "total", "bad", evals.least_sample(F.col("total"), F.col("bad"), 0.05).alias("n"))


@query(
    "WITH c AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' of ' || o_custkey || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS claim, 'on ' || strftime(o_orderdate, '%Y-%m-%d') || ' customer ' || CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END || ' placed ' || o_orderkey AS span FROM orders), "
    r"h AS (SELECT id, span, unnest(list_distinct(regexp_extract_all(claim, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+'))) AS token FROM c) SELECT id, token FROM h WHERE NOT regexp_matches(span, '(^|[^0-9])' || token || '([^0-9]|$)')"
)
def claim_problems(t: Tables) -> DataFrame:
    """Numbers and dates of a claim that its span does not have."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    s = lambda c: c.cast("string")
    claim = F.concat(F.lit("Order "), s(F.col("o_orderkey")), F.lit(" of "), s(F.col("o_custkey")), F.lit(" on "), day)
    who = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    span = F.concat(F.lit("on "), day, F.lit(" customer "), s(who), F.lit(" placed "), s(F.col("o_orderkey")))
    tokens = F.array_distinct(F.regexp_extract_all("claim", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]+"), F.lit(0)))
    h = t.orders.select(F.col("o_orderkey").alias("id"), claim.alias("claim"), span.alias("span")).select("id", "span", F.explode(tokens).alias("token"))
    return h.filter(~F.rlike("span", F.concat(F.lit("(^|[^0-9])"), "token", F.lit("([^0-9]|$)")))).select("id", "token")


@query(
    r"WITH k AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS term FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS term FROM documents), "
    "df AS (SELECT term, count(*) AS df FROM d GROUP BY term), j AS (SELECT item_id, coalesce(df, 0) AS df FROM k LEFT JOIN df USING (term)) SELECT item_id, count(*) FILTER (df BETWEEN 1 AND 4) AS distinctive, count(*) FILTER (df BETWEEN 1 AND 4) > 0 AS sealed FROM j GROUP BY item_id"
)
def sealed_cases(t: Tables) -> DataFrame:
    """Cases whose passage has a term that at most four notes have."""
    from evidencelake.functions import text as T

    k = t.benchmark.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    df = t.index.table("terms").select("term", "df")
    j = k.join(df, "term", "left").withColumn("rare", F.coalesce(F.col("df").between(1, 4), F.lit(False)))
    return j.groupBy("item_id").agg(F.count_if("rare").alias("distinctive"), F.bool_or("rare").alias("sealed"))


@query(
    "WITH g AS (SELECT l_orderkey AS query, l_linenumber % 2 AS grp, bool_or(l_returnflag = 'N') AS met FROM lineitem GROUP BY ALL) SELECT query, count(*) AS groups, count(*) FILTER (met) AS met, bool_and(met) AS complete FROM g GROUP BY query"
)
def evidence_contract(t: Tables) -> DataFrame:
    """All groups of required evidence, of each any one: the groups of a query that some evidence meets."""
    return evals.contract(t.lineitem.select(F.col("l_orderkey").alias("query"), (F.col("l_linenumber") % 2).alias("grp"), (F.col("l_returnflag") == "N").alias("there")))


@query(
    "WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '-3' WHEN 3 THEN 'many' WHEN 4 THEN '' ELSE '12.0' END AS given FROM events) "
    "SELECT event_id, coalesce(regexp_full_match(given, '[0-9]+'), false) AS whole, coalesce(TRY_CAST(given AS DOUBLE) >= 0, false) AS amount FROM s"
)
def numeric_fields(t: Tables) -> DataFrame:
    """Which given values are whole numbers, and which are amounts (finite and not negative)."""
    e = F.col("event_id") % 6
    given = F.when(e == 0, F.col("user_id").cast("string")).when(e == 1, F.col("value").cast("string")).when(e == 2, "-3").when(e == 3, "many").when(e == 4, "").otherwise("12.0")
    s = t.events.select("event_id", given.alias("given"))
    number = F.expr("try_cast(given as double)")
    amount = (number >= 0) & (number < float("inf"))
    return s.select("event_id", F.coalesce(F.rlike("given", F.lit("^[0-9]+$")), F.lit(False)).alias("whole"), F.coalesce(amount, F.lit(False)).alias("amount"))


@query(
    "WITH a AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_linenumber AS DOUBLE) / 7 AS yes, CASE WHEN l_linenumber = 5 THEN 0.9 ELSE 1 - CAST(l_linenumber AS DOUBLE) / 7 END AS no, CASE WHEN l_returnflag = 'R' THEN 'maybe' WHEN l_returnflag = 'A' THEN 'yes' ELSE 'no' END AS said FROM lineitem) "
    "SELECT id, n, CASE WHEN said NOT IN ('yes', 'no') THEN 'not a choice' WHEN abs(yes + no - 1) > 1e-6 THEN 'does not sum to one' WHEN yes < 0 OR no < 0 THEN 'negative' ELSE 'ok' END AS state, count(*) AS rows FROM a GROUP BY ALL"
)
def bounded_decisions(t: Tables) -> DataFrame:
    """Answers to a bounded choice: one of the choices, with probabilities that sum to one."""
    yes = F.col("l_linenumber").cast("double") / 7
    no = F.when(F.col("l_linenumber") == 5, 0.9).otherwise(1 - yes)
    said = F.when(F.col("l_returnflag") == "R", "maybe").when(F.col("l_returnflag") == "A", "yes").otherwise("no")
    state = F.when(~said.isin("yes", "no"), "not a choice").when(F.abs(yes + no - 1) > 1e-6, "does not sum to one").when((yes < 0) | (no < 0), "negative").otherwise("ok")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), state.alias("state")).agg(F.count("*").alias("rows"))


@query(
    "WITH i AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(gap) AS intervals, round(avg(gap) FILTER (gap <= 43200), 3) AS mean_gap, count(*) FILTER (gap > 14400 AND gap <= 43200) AS long_gaps, count(*) FILTER (gap > 43200) AS interruptions FROM i GROUP BY user_id"
)
def frame_intervals(t: Tables) -> DataFrame:
    """Times between frames: their mean, long ones, and interruptions, which are no intervals at all."""
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    i = t.events.withColumn("gap", s - F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    gap = F.col("gap")
    return i.groupBy("user_id").agg(F.count("gap").alias("intervals"), F.round(F.avg(F.when(gap <= 43200, gap)), 3).alias("mean_gap"), F.count_if((gap > 14400) & (gap <= 43200)).alias("long_gaps"), F.count_if(gap > 43200).alias("interruptions"))


@query(
    "WITH r AS (SELECT CAST(floor(doc_id / 256) AS BIGINT) AS part, doc_id, sha256(doc_id || ':' || sha256(text)) AS h FROM documents), p AS (SELECT part, sha256(string_agg(h, ',' ORDER BY doc_id)) AS d FROM r GROUP BY part) SELECT sha256(string_agg(d, ',' ORDER BY part)) AS digest, count(*) AS parts FROM p"
)
def table_digest(t: Tables) -> DataFrame:
    """One hash for a table in its order: of the hashes of parts of 256 rows each, so that no task has all rows."""
    h = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)), 256)
    rows = t.documents.select(F.floor(F.col("doc_id") / 256).alias("part"), "doc_id", h.alias("h"))
    joined = lambda by, of: F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(by, of)))[of], ","), 256)
    parts = rows.groupBy("part").agg(joined("doc_id", "h").alias("d"))
    return parts.agg(joined("part", "d").alias("digest"), F.count("*").alias("parts"))


@query(
    "SELECT conv_id, CASE WHEN bool_or(text LIKE '%<|%') THEN 'ERROR' WHEN count(*) FILTER (role = 'user') = 0 THEN 'ERROR' WHEN max(length(text)) > 16000 THEN 'REFUSED' ELSE 'READY' END AS state, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'no prompt' WHEN max(length(text)) > 16000 THEN 'prompt is too long' ELSE '' END AS reason FROM conversations GROUP BY conv_id"
)
def preflight(t: Tables) -> DataFrame:
    """What stops a request before it runs, as a status of its own."""
    users, most = F.count_if(F.col("role") == "user"), F.max(F.char_length("text"))
    marked = F.bool_or(F.contains("text", F.lit("<|")))
    state = F.when(marked | (users == 0), "ERROR").when(most > 16000, "REFUSED").otherwise("READY")
    reason = F.when(users == 0, "no prompt").when(most > 16000, "prompt is too long").otherwise("")
    return t.conversations.groupBy("conv_id").agg(state.alias("state"), reason.alias("reason"))
