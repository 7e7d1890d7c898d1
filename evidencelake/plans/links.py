"""Queries: the link graph of pages and of records that supersede each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators import graph, ledger

from .base import Tables, query

_LINKS = r"""
l AS (SELECT page_id AS src, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line, unnest(string_split(html, chr(10))) AS row FROM pages),
h0 AS (SELECT src, line, unnest(regexp_extract_all(row, 'href="([^"]*)"', 1)) AS href FROM l),
h AS (SELECT *, lower(regexp_replace(list_last(string_split(regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', ''), '/')), '[^\p{L}\p{N}]+$', '')) AS tail FROM h0),
nm AS (SELECT DISTINCT page_id, unnest([url, lower(regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^[\p{L}\p{N}]+'))]) AS name FROM pages),
k AS (SELECT name, min(page_id) AS page, count(*) AS n FROM nm WHERE name <> '' GROUP BY name),
r AS (SELECT h.src, h.href, h.line, coalesce(u.n, t.n, 0) AS candidates, CASE WHEN coalesce(u.n, t.n, 0) = 1 THEN coalesce(u.page, t.page) END AS dst
      FROM h LEFT JOIN k u ON h.href = u.name LEFT JOIN k t ON h.tail = t.name),
e AS (SELECT src, dst, line FROM r WHERE dst IS NOT NULL AND src <> dst),
q AS (SELECT DISTINCT src, dst FROM e),
b AS (SELECT src AS node, dst AS o, 1 AS way FROM q UNION ALL SELECT dst, src, 2 FROM q),
dg AS (SELECT p.page_id AS node, count(*) FILTER (way = 1) AS out_degree, count(*) FILTER (way = 2) AS in_degree, count(DISTINCT o) AS degree FROM pages p LEFT JOIN b ON p.page_id = b.node GROUP BY 1)"""


def _resolved(t: Tables) -> DataFrame:
    return t.links.table("resolved")


def _edges(t: Tables) -> DataFrame:
    return t.links.table("edges")


def _nodes(t: Tables) -> DataFrame:
    return t.links.table("nodes").select("node")


@query(f"WITH {_LINKS} SELECT src, dst, CAST(line AS INT) AS line FROM e")
def link_edges(t: Tables) -> DataFrame:
    return _edges(t)


@query(f"WITH {_LINKS} SELECT CASE WHEN candidates = 0 THEN 'missing' WHEN candidates > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason, count(*) AS n FROM r GROUP BY 1")
def unresolved_reasons(t: Tables) -> DataFrame:
    return _resolved(t).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT * FROM dg")
def link_degrees(t: Tables) -> DataFrame:
    return t.links.table("degrees")


@query(f"WITH {_LINKS} SELECT node FROM dg WHERE degree = 0")
def orphans(t: Tables) -> DataFrame:
    return t.links.table("degrees").filter("degree = 0").select("node")


@query(f"WITH {_LINKS} SELECT node, o AS other, CASE way WHEN 1 THEN 'out' ELSE 'in' END AS way FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY way, o) <= 25")
def link_neighbors(t: Tables) -> DataFrame:
    """Up to 25 neighbours of each page, those it links to first (a limit of the report)."""
    pairs = _edges(t).select("src", "dst").distinct()
    both = pairs.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way")).union(pairs.select("dst", "src", F.lit("in")))
    first = Window.partitionBy("node").orderBy(F.desc("way"), "other")
    return both.withColumn("n", F.row_number().over(first)).filter("n <= 25").drop("n")


@query(f"WITH {_LINKS} SELECT dst, count(*) AS links, count(DISTINCT src) AS pages FROM e GROUP BY dst")
def backlinks(t: Tables) -> DataFrame:
    return _edges(t).groupBy("dst").agg(F.count("*").alias("links"), F.countDistinct("src").alias("pages"))


@query(f"WITH {_LINKS} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e")
def undirected_edges(t: Tables) -> DataFrame:
    return _edges(t).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _spread_sql(hops: int) -> str:
    steps = ["ways AS (SELECT u, v, max(w) AS w FROM (SELECT src AS u, dst AS v, 1.0 AS w FROM q UNION ALL SELECT dst, src, 0.8 FROM q) GROUP BY ALL)",
             "a0 AS (SELECT page_id AS node, CAST(1.0 AS DOUBLE) AS activation FROM pages WHERE page_id % 10 = 0)", "f0 AS (SELECT * FROM a0)"]
    for k in range(1, hops + 1):
        steps.append(
            f"g{k} AS (SELECT v AS node, sum(c) AS gain FROM (SELECT v, activation * 0.5 * w / greatest(du.degree, 1) / sqrt(greatest(dv.degree, 1)) AS c FROM f{k - 1} JOIN ways ON f{k - 1}.node = u "
            f"JOIN dg du ON du.node = u JOIN dg dv ON dv.node = v WHERE greatest(du.degree, 1) <= 24) WHERE c >= 0.005 GROUP BY v)"
        )
        steps.append(f"f{k} AS (SELECT node, least(1.0, gain) AS activation FROM g{k} WHERE node NOT IN (SELECT node FROM a{k - 1}))")
        steps.append(f"a{k} AS (SELECT coalesce(x.node, g.node) AS node, least(1.0, coalesce(activation, 0) + coalesce(gain, 0)) AS activation FROM a{k - 1} x FULL JOIN g{k} g ON x.node = g.node)")
    return f"WITH {_LINKS}, {', '.join(steps)} SELECT node, round(activation, 6) AS activation FROM a{hops}"


def _spread(t: Tables, hops: int) -> DataFrame:
    seeds = t.pages.filter("page_id % 10 = 0").select(F.col("page_id").alias("node"), F.lit(1.0).alias("activation"))
    edges = _edges(t)
    return graph.spread(seeds, edges, t.links.table("degrees"), hops).select("node", F.round("activation", 6).alias("activation"))


@query(_spread_sql(1))
def spread_one_hop(t: Tables) -> DataFrame:
    return _spread(t, 1)


@query(_spread_sql(2))
def spread_two_hop(t: Tables) -> DataFrame:
    return _spread(t, 2)


_SUPER = "o AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), s AS (SELECT id, id - 1 - id % 3 AS supersedes FROM o)"


def _supersedes(t: Tables) -> DataFrame:
    """Each record of a chain names an earlier one; several may name the same (a fork). A record for each order."""
    ids = t.lineitem.select(F.col("l_orderkey").alias("id")).distinct()
    return ids.select("id", (F.col("id") - 1 - F.col("id") % 3).alias("supersedes"))


@query(f"WITH {_SUPER} SELECT id FROM s WHERE id NOT IN (SELECT supersedes FROM s)")
def supersession_in_force(t: Tables) -> DataFrame:
    edges = _supersedes(t)
    return ledger.in_force(edges.select("id"), edges)


@query(f"WITH {_SUPER} SELECT supersedes AS target, count(DISTINCT id) AS successors FROM s GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def supersession_forks(t: Tables) -> DataFrame:
    return ledger.successors(_supersedes(t)).filter("n >= 2").withColumnRenamed("n", "successors")


_CYCLE = "c AS (SELECT p_partkey AS src, p_partkey - p_partkey % 8 + (p_partkey * 3 + p_size) % 8 AS dst FROM part)"


@query(
    f"WITH RECURSIVE {_CYCLE}, r(src, dst) AS (SELECT src, dst FROM c UNION SELECT r.src, c.dst FROM r JOIN c ON r.dst = c.src) "
    "SELECT a.src AS node, min(a.dst) AS cycle FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1"
)
def supersedes_cycles(t: Tables) -> DataFrame:
    """Records that supersede each other in a ring, more than one together; every part is a record."""
    p, size = F.col("p_partkey"), F.col("p_size")
    return graph.strong_components(t.part.select(p.alias("src"), (p - p % 8 + (p * 3 + size) % 8).alias("dst")))


@query(
    f"WITH RECURSIVE {_LINKS}, c(node, other) AS (SELECT page_id, page_id FROM pages UNION SELECT c.node, b.o FROM c JOIN b ON c.other = b.node) "
    "SELECT node, min(other) AS component FROM c GROUP BY node"
)
def link_components(t: Tables) -> DataFrame:
    return graph.components(_nodes(t), _edges(t))
