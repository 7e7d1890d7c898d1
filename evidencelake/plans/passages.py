"""Queries: lines and windows of texts, links and what they lead to, suggestions, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import graph, ledger, passages

from . import prompts
from .base import Tables, query
from .links import _LINKS
from .prompts import _FOUND, _P

_TERMS = ["the", "und", "les", "of"]
_LN = r"""
l0 AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line, string_split(text, chr(10))[1] AS head FROM documents),
ln AS (SELECT doc_id, pos, line, length(line) AS size, list_filter(['the', 'und', 'les', 'of'], lambda z: list_contains(regexp_extract_all(strip_accents(lower(line)), '[\p{L}\p{N}]+'), z)) AS matched, list_filter(['the', 'und', 'les', 'of'], lambda z: list_contains(regexp_extract_all(strip_accents(lower(head)), '[\p{L}\p{N}]+'), z)) AS title FROM l0)"""
_ISLANDS = "g0 AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 1 THEN 0 ELSE 1 END AS new FROM {rows}), g1 AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g0) SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM g1 GROUP BY doc_id, run"


def _lines(t: Tables) -> DataFrame:
    return passages.matched_lines(t.documents, _TERMS)


@query(f"WITH {_LN} SELECT doc_id, pos, round((len(matched) + 0.5 * len(list_filter(title, lambda z: NOT list_contains(matched, z)))) / 4, 6) AS score FROM ln WHERE len(matched) > 0")
def match_candidates(t: Tables) -> DataFrame:
    """Lines that have a term of the query: their own terms, and half of those of the heading alone."""
    some = _lines(t).filter(F.size("matched") > 0)
    return some.select("doc_id", "pos", F.round(passages.relevance(F.col("matched"), F.col("title"), len(_TERMS)), 6).alias("score"))


@query(f"WITH {_LN} SELECT doc_id, len(list_distinct(flatten(list(matched)))) AS covered, 4 - len(list_distinct(flatten(list(matched)))) AS uncovered FROM ln GROUP BY doc_id")
def covered_terms(t: Tables) -> DataFrame:
    """How many terms of the query the lines of a text have together."""
    n = F.size(F.array_distinct(F.flatten(F.collect_list("matched")))).cast("long")
    return _lines(t).groupBy("doc_id").agg(n.alias("covered"), (len(_TERMS) - n).alias("uncovered"))


_PICK = (
    "rk AS (SELECT doc_id, pos, size, row_number() OVER (PARTITION BY doc_id ORDER BY len(matched) DESC, pos) AS k FROM ln WHERE len(matched) > 0), "
    "pk AS (SELECT doc_id, k, pos, size <= 300 AS taken, CASE WHEN size <= 300 THEN size ELSE 0 END AS used, CASE WHEN size <= 300 THEN 1 ELSE 0 END AS n FROM rk WHERE k = 1 "
    "UNION ALL SELECT r.doc_id, r.k, r.pos, p.used + r.size <= 300 AND p.n < 3, p.used + CASE WHEN p.used + r.size <= 300 AND p.n < 3 THEN r.size ELSE 0 END, p.n + CASE WHEN p.used + r.size <= 300 AND p.n < 3 THEN 1 ELSE 0 END FROM pk p JOIN rk r ON r.doc_id = p.doc_id AND r.k = p.k + 1), tk AS (SELECT doc_id, pos FROM pk WHERE taken)"
)


@query(f"WITH RECURSIVE {_LN}, {_PICK}, {_ISLANDS.format(rows='tk')}")
def delivery_windows(t: Tables) -> DataFrame:
    """What is delivered of a long text: three lines at most, within 300 characters (limits of the operator)."""
    return passages.windows(_lines(t), 300)


@query(f"WITH {_LN}, nr AS (SELECT DISTINCT doc_id, unnest([pos - 1, pos, pos + 1]) AS pos FROM ln WHERE len(matched) > 0), nb AS (SELECT nr.doc_id, nr.pos FROM nr JOIN (SELECT doc_id, max(pos) AS last FROM ln GROUP BY doc_id) x USING (doc_id) WHERE pos BETWEEN 1 AND last), {_ISLANDS.format(rows='nb')}")
def focus_blocks(t: Tables) -> DataFrame:
    """Matching lines with their neighbours, merged."""
    return passages.focus(_lines(t))


@query(
    "WITH c AS (SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN contains(left(text, 500), chr(10)) THEN left(text, 500 - instr(reverse(left(text, 500)), chr(10))) ELSE left(text, 500) END AS head FROM documents) SELECT doc_id, CAST(length(head) AS BIGINT) AS n, sha256(head) AS digest FROM c"
)
def cut_lines(t: Tables) -> DataFrame:
    head = t.documents.select("doc_id", passages.cut_lines(F.col("text"), 500).alias("head"))
    return head.select("doc_id", F.char_length("head").cast("long").alias("n"), F.sha2("head", 256).alias("digest"))


@query(
    "WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents), c AS (SELECT doc_id, 1 AS i, r[1] AS now, CAST([] AS VARCHAR[]) AS done FROM p UNION ALL SELECT c.doc_id, i + 1, CASE WHEN length(now) + 1 + length(r[i + 1]) <= 900 THEN now || chr(10) || r[i + 1] ELSE right(now, 100) || chr(10) || r[i + 1] END, "
    "CASE WHEN length(now) + 1 + length(r[i + 1]) <= 900 THEN done ELSE list_append(done, now) END FROM c JOIN p USING (doc_id) WHERE i < len(r)), z AS (SELECT c.doc_id, list_append(done, now) AS all_ FROM c JOIN p USING (doc_id) WHERE i = len(r)) SELECT doc_id, len(all_) AS chunks, sha256(array_to_string(all_, chr(12))) AS digest FROM z"
)
def paragraph_chunks(t: Tables) -> DataFrame:
    """Chunks of 900 characters that overlap by 100."""
    all_ = t.documents.select("doc_id", passages.packed_paragraphs(F.col("text"), 900, 100).alias("all"))
    return all_.select("doc_id", F.size("all").cast("long").alias("chunks"), F.sha2(F.array_join("all", "\f"), 256).alias("digest"))


@query(
    "WITH e AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT doc_id, min(pos) AS first FROM e WHERE contains(line, 'tion') GROUP BY doc_id), "
    "s AS (SELECT e.doc_id, pos, first, sum(CASE WHEN pos >= first THEN length(line) + 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS after, sum(CASE WHEN pos < first THEN length(line) + 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS before FROM e JOIN f USING (doc_id)), "
    "r AS (SELECT doc_id, max(pos) AS hi, max(after) AS used FROM s WHERE pos >= first AND (after <= 400 OR pos = first) GROUP BY doc_id) SELECT s.doc_id, min(pos) AS lo, min(hi) AS hi FROM s JOIN r USING (doc_id) WHERE pos <= first AND (pos = first OR used + before <= 400) GROUP BY s.doc_id"
)
def excerpts(t: Tables) -> DataFrame:
    """Around the first line with the term, as much as 400 characters hold."""
    return passages.excerpt(t.documents, "tion", 400)


@query(f"WITH RECURSIVE {_P}, {_FOUND}, c AS (SELECT conv_id, rank, sum(size) OVER (PARTITION BY conv_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM top) SELECT conv_id, count(*) FILTER (used <= 6000) AS shown, count(*) FILTER (used > 6000) AS omitted FROM c GROUP BY conv_id")
def hook_context(t: Tables) -> DataFrame:
    """Whole results in order until the first that does not fit; the rest is counted only."""
    used = F.sum("size").over(Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    c = prompts._search(t).withColumn("used", used)
    return c.groupBy("conv_id").agg(F.count_if(F.col("used") <= 6000).alias("shown"), F.count_if(F.col("used") > 6000).alias("omitted"))


@query(f"WITH RECURSIVE {_P}, {_FOUND} SELECT conv_id, source, min(rank) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY min(rank)) AS place FROM top GROUP BY conv_id, source")
def delivered_sources(t: Tables) -> DataFrame:
    """The different sources of the results, in the order in which they come."""
    first = prompts._search(t).groupBy("conv_id", "source").agg(F.min("rank").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("first")).cast("long"))


@query(f"WITH RECURSIVE {_P}, {_FOUND} SELECT conv_id, doc_id, source, rank FROM top QUALIFY row_number() OVER (PARTITION BY conv_id, source ORDER BY rank) = 1")
def first_of_source(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id", "source").orderBy("rank"))
    return prompts._search(t).withColumn("n", nth).filter("n = 1").select("conv_id", "doc_id", "source", "rank")


@query(
    f"WITH RECURSIVE {_P}, {_FOUND}, k AS (SELECT doc_id, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS k FROM documents), z AS (SELECT conv_id, list_distinct(list(term)) AS q FROM q GROUP BY conv_id), "
    "c AS (SELECT conv_id, any_value(q) AS q, list_distinct(flatten(list(k) FILTER (rank = 1))) AS one, list_distinct(flatten(list(k) FILTER (rank <= 3))) AS three FROM top JOIN k USING (doc_id) JOIN z USING (conv_id) WHERE rank <= 3 GROUP BY conv_id) "
    "SELECT conv_id, CASE WHEN len(list_intersect(q, one)) = len(q) THEN 'seeds_cover_query' WHEN len(list_intersect(q, three)) = len(q) THEN 'linked_notes_cover' ELSE 'coverage_incomplete' END AS decision, len(q) - len(list_intersect(q, three)) AS uncovered FROM c"
)
def coverage_decisions(t: Tables) -> DataFrame:
    """Whether the first result has all terms of its prompt, or the first three together."""
    own = prompts._terms(t).filter("turn = 0").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))).filter("n <= 12")
    asked = own.groupBy("conv_id").agg(F.collect_set("folded").alias("q"))
    best = prompts._search(t).filter("rank <= 3").select("conv_id", "doc_id", "rank")
    have = t.documents.join(best.select("doc_id").distinct(), "doc_id").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("k"))
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    c = best.join(have, "doc_id").groupBy("conv_id").agg(joined(F.when(F.col("rank") == 1, F.col("k"))).alias("one"), joined("k").alias("three")).join(asked, "conv_id")
    missing = lambda x: F.size(F.array_except("q", x))
    decision = F.when(missing("one") == 0, "seeds_cover_query").when(missing("three") == 0, "linked_notes_cover").otherwise("coverage_incomplete")
    return c.select("conv_id", decision.alias("decision"), missing("three").cast("long").alias("uncovered"))


@query(f"WITH {_P}, {_LINKS}, tn AS (SELECT conv_id, turn, unnest(list_distinct(string_split(trim(said), ' '))) AS name FROM u) SELECT conv_id, turn, name, page FROM tn JOIN k USING (name) WHERE length(name) >= 4 AND n = 1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) <= 3")
def named_notes(t: Tables) -> DataFrame:
    """Notes whose name a prompt has: the three longest names of at least four letters that only one note has."""
    from evidencelake.operators import routing

    said = prompts._prompts(t).select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.trim(routing.normal(F.col("text"))), " "))).alias("name"))
    one = graph.page_names(t.pages).groupBy("name").agg(F.min("page_id").alias("page"), F.count("*").alias("n")).filter("n = 1").drop("n")
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc(F.char_length("name")), "name"))
    return said.filter(F.char_length("name") >= 4).join(one, "name").withColumn("nth", nth).filter("nth <= 3").select("conv_id", "turn", "name", "page")


@query("WITH s AS (SELECT page_id AS node, CAST(length(html) AS DOUBLE) AS strength FROM pages WHERE page_id % 10 = 0) SELECT node, round(greatest(0.05, least(1.0, strength / (SELECT max(strength) FROM s))), 6) AS activation FROM s")
def seed_strengths(t: Tables) -> DataFrame:
    """Strengths of seeds as shares of the strongest, 0.05 at least."""
    s = t.pages.filter("page_id % 10 = 0").select(F.col("page_id").alias("node"), F.char_length("html").cast("double").alias("strength"))
    top = s.agg(F.max("strength").alias("most"))
    share = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("strength") / F.col("most")))
    return s.crossJoin(F.broadcast(top)).select("node", F.round(share, 6).alias("activation"))  # one row


_REL = r"rl AS (SELECT src, line, len(list_filter(['the', 'und', 'les', 'of'], lambda z: list_contains(regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(row, '<a [^>]*>[^<]*</a>', ' ', 'g'), '<[^>]*>', ' ', 'g'))), '[\p{L}\p{N}]+'), z))) / 4.0 AS rel FROM l)"


def _relevance(t: Tables) -> DataFrame:
    """src, line, rel: the share of the query's terms on a line, without the text of links and other markup."""
    plain = F.regexp_replace(F.regexp_replace("row", "<a [^>]*>[^<]*</a>", " "), "<[^>]*>", " ")
    each = t.pages.select(F.col("page_id").alias("src"), F.posexplode(F.split("html", "\n")).alias("at", "row"))
    found = F.size(F.array_intersect(F.array(*map(F.lit, _TERMS)), T.tokens(plain)))
    return each.select("src", (F.col("at") + 1).alias("line"), (found / len(_TERMS)).alias("rel"))


@query(f"WITH {_LINKS}, {_REL} SELECT e.src, e.dst, max(rel) AS rel FROM e JOIN rl ON e.src = rl.src AND e.line = rl.line GROUP BY ALL")
def link_relevance(t: Tables) -> DataFrame:
    """How much of the query stands around the links from one page to another."""
    return t.links.table("edges").join(_relevance(t), ["src", "line"]).groupBy("src", "dst").agg(F.max("rel").alias("rel"))


_SEEDS = [(0, 1.0), (10, 0.6), (20, 0.3), (30, 0.05)]


def _traced_sql(hops: int) -> str:
    steps = [
        "wr AS (SELECT e.src, e.dst, max(rel) AS rel FROM e JOIN rl ON e.src = rl.src AND e.line = rl.line GROUP BY ALL)",
        "ways AS (SELECT u, v, max(w) AS w FROM (SELECT src AS u, dst AS v, 1 + 2 * rel AS w FROM wr UNION ALL SELECT dst, src, 0.8 * (1 + 2 * rel) FROM wr) GROUP BY ALL)",
        "sd(node, activation) AS (VALUES " + ", ".join(f"({a}, CAST({b} AS DOUBLE))" for a, b in _SEEDS) + ")",
        "a0 AS (SELECT node, activation, 0 AS hop, CAST(node AS VARCHAR) AS via FROM sd)",
        "f0 AS (SELECT * FROM a0)",
    ]
    for k in range(1, hops + 1):
        steps += [
            f"c{k} AS (SELECT v, f.via, activation * 0.5 * w / greatest(du.degree, 1) / sqrt(greatest(dv.degree, 1)) AS c, u FROM f{k - 1} f JOIN ways ON f.node = u JOIN dg du ON du.node = u JOIN dg dv ON dv.node = v WHERE greatest(du.degree, 1) <= 24)",
            f"g{k} AS (SELECT v AS node, sum(c) AS gain, max_by(via || '>' || v, c) AS via FROM c{k} WHERE c >= 0.005 GROUP BY v)",
            f"n{k} AS (SELECT node, least(1.0, gain) AS activation, {k} AS hop, via FROM g{k} WHERE node NOT IN (SELECT node FROM a{k - 1}))",
            f"ok{k} AS (SELECT (SELECT count(*) FROM a{k - 1}) + (SELECT count(*) FROM n{k}) <= 64 AS fits)",
            f"f{k} AS (SELECT n{k}.* FROM n{k}, ok{k} WHERE fits)",
            f"a{k} AS (SELECT x.node, CASE WHEN fits THEN least(1.0, x.activation + coalesce(gain, 0)) ELSE x.activation END AS activation, x.hop, x.via FROM a{k - 1} x CROSS JOIN ok{k} LEFT JOIN g{k} g ON x.node = g.node UNION ALL SELECT * FROM f{k})",
        ]
    return f"WITH {_LINKS}, {_REL}, {', '.join(steps)}"


@query(_traced_sql(2) + " SELECT node, round(activation, 6) AS activation, hop, via FROM a2")
def spread_traced(t: Tables) -> DataFrame:
    """Activation over two steps from four seeds, links weighted by what stands around them, with the way to each node."""
    seeds = t._spark.createDataFrame(_SEEDS, "node long, activation double")
    rel = link_relevance(t)
    return graph.spread_traced(seeds, rel, t.links.table("degrees"), 2).select("node", F.round("activation", 6).alias("activation"), "hop", "via")


@query(_traced_sql(1) + " SELECT (SELECT count(*) FROM f0 JOIN dg USING (node) WHERE greatest(degree, 1) > 24) AS hubs, (SELECT count(*) FROM c1 WHERE c < 0.005) AS below_threshold, (SELECT count(*) FROM n1) AS reached, (SELECT fits FROM ok1) AS fits")
def spread_counters(t: Tables) -> DataFrame:
    """Why a step did not go further: hubs, contributions below the threshold, the limit of nodes."""
    seeds = t._spark.createDataFrame(_SEEDS, "node long, activation double")
    return graph.spread_counters(seeds, link_relevance(t), t.links.table("degrees"))


@query(
    _traced_sql(2) + ", tn AS (SELECT node, activation, hop, row_number() OVER (ORDER BY round(activation, 6) DESC, node) AS place FROM a2 QUALIFY place <= 20) SELECT a.node, a.place, a.hop, count(q.dst) AS links FROM tn a LEFT JOIN q ON q.src = a.node AND q.dst IN (SELECT node FROM tn) GROUP BY ALL"
)
def activation_trace(t: Tables) -> DataFrame:
    """The twenty most active nodes and the links among them (limits of the trace)."""
    active = spread_traced(t)
    top = active.orderBy(F.desc("activation"), "node").limit(20)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("activation"), "node")).cast("long")).select("node", "place", "hop")  # twenty rows
    pairs = t.links.table("edges").select(F.col("src").alias("node"), "dst").distinct().join(F.broadcast(top.select(F.col("node").alias("dst"))), "dst")
    return top.join(pairs, "node", "left").groupBy("node", "place", "hop").agg(F.count("dst").alias("links"))


@query(f"WITH {_LINKS}, al AS (SELECT lower(regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]+([\\p{{L}}\\p{{N}}]+)', 1)) AS alias, page_id FROM pages), "
    "au AS (SELECT alias, min(page_id) AS hint FROM al WHERE alias <> '' GROUP BY alias HAVING count(*) = 1), un AS (SELECT DISTINCT src, href, tail FROM h WHERE (src, href) IN (SELECT src, href FROM r WHERE candidates = 0)) SELECT src, href, hint FROM un JOIN au ON un.tail = au.alias")  # fmt: skip
def alias_hints(t: Tables) -> DataFrame:
    """Links that lead nowhere but name another name (here: the second word of the title) that one page alone has."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    second = F.lower(F.regexp_extract(title, r"[\p{L}\p{N}]+[^\p{L}\p{N}]+([\p{L}\p{N}]+)", 1))
    one = t.pages.select(second.alias("tail"), "page_id").filter("tail <> ''").groupBy("tail").agg(F.min("page_id").alias("hint"), F.count("*").alias("n")).filter("n = 1").drop("n")
    path = F.regexp_replace(F.regexp_replace("href", r"[?#].*$", ""), "/+$", "")
    tail = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"[^\p{L}\p{N}]+$", ""))
    lost = t.links.table("resolved").filter("candidates = 0").select("src", "href", tail.alias("tail")).distinct()
    return lost.join(one, "tail").select("src", "href", "hint")


@query(f"WITH {_LINKS} SELECT DISTINCT a.url AS from_url, b.url AS to_url FROM e JOIN pages a ON a.page_id = e.src JOIN pages b ON b.page_id = e.dst")
def edge_urls(t: Tables) -> DataFrame:
    """Edges by the addresses of both ends."""
    nodes = t.links.table("nodes")
    pairs = t.links.table("edges").select("src", "dst").distinct()
    return pairs.join(nodes.select(F.col("node").alias("src"), F.col("url").alias("from_url")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("url").alias("to_url")), "dst").select("from_url", "to_url").distinct()


_BASKETS = "bk AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, user_id || '|' || CAST(ts AS DATE) AS k, event_id * 7 % (SELECT count(*) FROM pages) AS page FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) <= 16)"


@query(
    f"WITH {_LINKS}, {_BASKETS}, pr AS (SELECT a.page AS a, b.page AS b, count(DISTINCT a.k) AS n, count(DISTINCT a.day) AS days, count(DISTINCT a.user_id) AS sessions FROM bk a JOIN bk b ON a.k = b.k WHERE a.page < b.page GROUP BY ALL) "
    "SELECT a, b, n, days, sessions FROM pr WHERE n >= 2 AND (a, b) NOT IN (SELECT least(src, dst), greatest(src, dst) FROM q) ORDER BY n DESC, days DESC, sessions DESC, a, b LIMIT 20"
)
def link_suggestions(t: Tables) -> DataFrame:
    """The twenty pairs of pages most often used together (16 a row at most) that no link connects (limits of the operator)."""
    day = F.to_date("ts")
    first = F.row_number().over(Window.partitionBy("user_id", day).orderBy("event_id"))
    total = t.pages.agg(F.count("*").alias("pages"))
    rows = t.events.withColumn("nth", first).filter("nth <= 16").crossJoin(F.broadcast(total))  # one row
    rows = rows.select("user_id", day.alias("day"), F.concat_ws("|", F.col("user_id").cast("string"), day.cast("string")).alias("k"), (F.col("event_id") * 7 % F.col("pages")).alias("page"))
    pairs = ledger.pair_counts(rows, "k", "page", "user_id", "day").filter("n >= 2")
    linked = t.links.table("edges").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.join(linked, ["a", "b"], "left_anti").orderBy(F.desc("n"), F.desc("days"), F.desc("sessions"), "a", "b").limit(20).select("a", "b", "n", "days", "sessions")


@query("WITH p AS (SELECT least(user_id, event_id % 40) AS a, greatest(user_id, event_id % 40) AS b, value, event_type, event_id % 3 AS hop FROM events WHERE user_id <> event_id % 40) SELECT a, b, max(value) AS weight, min(hop) AS hop, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM p GROUP BY a, b")
def overlay_merge(t: Tables) -> DataFrame:
    """Several traces laid over each other: of each pair the strongest weight, the fewest hops, and all kinds."""
    o = F.col("event_id") % 40
    p = t.events.filter(F.col("user_id") != o).select(F.least("user_id", o).alias("a"), F.greatest("user_id", o).alias("b"), "value", "event_type", (F.col("event_id") % 3).alias("hop"))
    return p.groupBy("a", "b").agg(F.max("value").alias("weight"), F.min("hop").alias("hop"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query(r"WITH k AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS term FROM documents) SELECT term, count(*) AS df FROM k GROUP BY term ORDER BY df DESC, term LIMIT 50")
def top_terms(t: Tables) -> DataFrame:
    """The fifty terms that most notes have; ties by the term (the limit is the operator)."""
    return t.index.table("terms").select("term", "df").orderBy(F.desc("df"), "term").limit(50)


@query(
    "WITH p AS (SELECT conv_id, '# Log' || chr(10) || string_agg('## ' || turn || ' ' || role || chr(10) || left(text, 20), chr(10) ORDER BY turn) AS page FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, unnest(string_split(page, chr(10))) AS line, unnest(range(1, len(string_split(page, chr(10))) + 1)) AS pos FROM p) "
    "SELECT conv_id, substring(line, 4) AS entry FROM l WHERE starts_with(line, '## ') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= 2"
)
def log_entries(t: Tables) -> DataFrame:
    """The last two entries of each log, found by their headings."""
    entry = F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), F.substring("text", 1, 20))
    p = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))).alias("x")).select("conv_id", F.concat(F.lit("# Log\n"), F.array_join("x.e", "\n")).alias("page"))
    headings = F.filter(F.split("page", "\n", -1), lambda line: F.startswith(line, F.lit("## ")))
    last = F.slice(headings, F.greatest(F.lit(1), F.size(headings) - 1), F.lit(2))
    return p.select("conv_id", F.explode(last).alias("line")).select("conv_id", F.substr("line", F.lit(4)).alias("entry"))


@query(
    "WITH p AS (SELECT conv_id, '| turn | state |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || turn || ' | ' || CASE WHEN turn % 3 = 0 THEN 'open' WHEN turn % 3 = 1 THEN 'Done' ELSE 'blocked' END || ' |', chr(10) ORDER BY turn) AS page FROM conversations GROUP BY conv_id), "
    "l AS (SELECT conv_id, unnest(string_split(page, chr(10))) AS line FROM p), c AS (SELECT conv_id, list_transform(string_split(trim(line, '|'), '|'), lambda z: trim(z)) AS k FROM l WHERE starts_with(line, '|') AND NOT regexp_full_match(line, '[|\\s:-]+')) SELECT conv_id, CAST(k[1] AS BIGINT) AS turn, lower(k[2]) AS state FROM c WHERE k[1] <> 'turn' AND lower(k[2]) <> 'done'"
)
def backlog_rows(t: Tables) -> DataFrame:
    """Rows of a Markdown table whose state is not done."""
    n = F.col("turn") % 3
    row = F.concat(F.lit("| "), F.col("turn").cast("string"), F.lit(" | "), F.when(n == 0, "open").when(n == 1, "Done").otherwise("blocked"), F.lit(" |"))
    p = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("e")))).alias("x")).select("conv_id", F.concat(F.lit("| turn | state |\n|---|---|\n"), F.array_join("x.e", "\n")).alias("page"))
    each = p.select("conv_id", F.explode(F.split("page", "\n", -1)).alias("line")).filter(F.startswith("line", F.lit("|")) & ~F.rlike("line", F.lit(r"^[|\s:-]+$")))
    k = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda z: F.trim(z))
    rows = each.select("conv_id", k.alias("k")).filter(F.element_at("k", 1) != "turn")
    return rows.select("conv_id", F.element_at("k", 1).cast("long").alias("turn"), F.lower(F.element_at("k", 2)).alias("state")).filter("state <> 'done'")


@query(
    "WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), a AS (SELECT conv_id, turn, 'as in sha256:' || left(sha256(d2.text), 8 + conv_id % 20) || ' and sha256:' || left(sha256(c.text), 12) AS said FROM conversations c JOIN documents d2 ON d2.doc_id = c.conv_id * 3 + c.turn WHERE role = 'assistant'), "
    "h AS (SELECT conv_id, turn, unnest(regexp_extract_all(said, 'sha256:([0-9a-f]{8,64})', 1)) AS prefix FROM a) SELECT conv_id, turn, prefix, count(d.doc_id) AS delivered FROM h LEFT JOIN d ON starts_with(d.sha, h.prefix) GROUP BY ALL"
)
def cited_hashes(t: Tables) -> DataFrame:
    """Cited beginnings of hashes, eight digits or more, against the whole hashes that were delivered: joined by the first
    eight digits, then compared."""
    d = t.documents.select(F.sha2("text", 256).alias("sha"), "doc_id")
    own = t.conversations.filter("role = 'assistant'").withColumn("doc_id", F.col("conv_id") * 3 + F.col("turn")).join(d, "doc_id")
    said = F.concat(F.lit("as in sha256:"), F.substr("sha", F.lit(1), (8 + F.col("conv_id") % 20).cast("int")), F.lit(" and sha256:"), F.substring(F.sha2("text", 256), 1, 12))
    h = own.select("conv_id", "turn", F.explode(F.regexp_extract_all(said, F.lit("sha256:([0-9a-f]{8,64})"), F.lit(1))).alias("prefix")).withColumn("eight", F.substring("prefix", 1, 8))
    full = d.select(F.substring("sha", 1, 8).alias("eight"), "sha", "doc_id")
    met = h.join(full, (h["eight"] == full["eight"]) & F.startswith("sha", F.col("prefix")), "left")
    return met.groupBy("conv_id", "turn", "prefix").agg(F.count("doc_id").alias("delivered"))


@query(
    "WITH p AS (SELECT conv_id, string_agg('### ' || CASE WHEN role = 'user' THEN 'Card' ELSE 'Evidence' END || ' ' || turn || chr(10) || 'source: n' || turn || chr(10) || left(text, 15), chr(10) ORDER BY turn) AS packet FROM conversations GROUP BY conv_id), "
    r"b AS (SELECT conv_id, unnest(string_split(chr(10) || packet, chr(10) || '### ')) AS block FROM p) SELECT conv_id, regexp_extract(block, '^([A-Za-z]+) ([0-9]+)', 1) AS kind, CAST(regexp_extract(block, '^([A-Za-z]+) ([0-9]+)', 2) AS BIGINT) AS n, regexp_extract(block, 'source: (\S+)', 1) AS source FROM b WHERE block <> ''"
)
def packet_blocks(t: Tables) -> DataFrame:
    """The blocks of a packet in Markdown, by their headings, with the source that each names."""
    kind = F.when(F.col("role") == "user", "Card").otherwise("Evidence")
    turn = F.col("turn").cast("string")
    one = F.concat(F.lit("### "), kind, F.lit(" "), turn, F.lit("\nsource: n"), turn, F.lit("\n"), F.substring("text", 1, 15))
    p = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("e")))).alias("x")).select("conv_id", F.concat(F.lit("\n"), F.array_join("x.e", "\n")).alias("packet"))
    b = p.select("conv_id", F.explode(F.split("packet", "\n### ", -1)).alias("block")).filter("block <> ''")
    head = r"^([A-Za-z]+) ([0-9]+)"
    return b.select("conv_id", F.regexp_extract("block", head, 1).alias("kind"), F.regexp_extract("block", head, 2).cast("long").alias("n"), F.regexp_extract("block", r"source: (\S+)", 1).alias("source"))


@query(
    "WITH f AS (SELECT doc_id, concat(CASE WHEN doc_id % 11 = 0 THEN '.git/' WHEN doc_id % 13 = 0 THEN 'Private/' ELSE '' END, source, '/n', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.PDF' WHEN doc_id % 5 = 0 THEN '.MD' ELSE '.md' END) AS path FROM documents) "
    "SELECT path, CASE WHEN len(list_filter(string_split(path, '/'), lambda z: starts_with(z, '.'))) > 0 OR lower(path) = 'private' OR starts_with(lower(path), 'private/') THEN 'excluded' WHEN NOT regexp_matches(lower(path), '\\.(md|txt)$') THEN 'unsupported' ELSE 'ok' END AS state FROM f"
)
def walked_names(t: Tables) -> DataFrame:
    """Each name of a walk: excluded (a part with a dot, or below an excluded folder, by whole parts and whatever the case),
    unsupported by its ending, or ok."""
    d = F.col("doc_id")
    path = F.concat(F.when(d % 11 == 0, ".git/").when(d % 13 == 0, "Private/").otherwise(""), "source", F.lit("/n"), d.cast("string"), F.when(d % 7 == 0, ".PDF").when(d % 5 == 0, ".MD").otherwise(".md"))
    low = F.lower("path")
    hidden = F.exists(F.split("path", "/"), lambda z: F.startswith(z, F.lit(".")))
    state = F.when(hidden | (low == "private") | low.startswith("private/"), "excluded").when(~F.rlike(low, F.lit(r"\.(md|txt)$")), "unsupported").otherwise("ok")
    return t.documents.select(path.alias("path")).select("path", state.alias("state"))
