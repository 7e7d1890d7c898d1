"""Queries: verification of claims and scores of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators import evals

from .base import Tables, query


def _judged(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "text"), "doc_id")


@query(
    "WITH j AS (SELECT l.quality, l.toxic, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)), f AS (SELECT 'lang' AS facet, lang AS value, quality, toxic FROM j UNION ALL SELECT 'source', source, quality, toxic FROM j) "
    "SELECT facet, value, count(*) AS n, CAST(sum(quality) AS BIGINT) AS hits, round(avg(quality), 6) AS rate FROM f GROUP BY ALL"
)
def facet_breakdown(t: Tables) -> DataFrame:
    return evals.facets(_judged(t), ["lang", "source"], F.count("*").alias("n"), F.sum("quality").alias("hits"), F.round(F.avg("quality"), 6).alias("rate"))


_Z = "1.959963984540054"


@query(
    "WITH g AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS DOUBLE) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (SELECT *, k / n AS p FROM g) "
    f"SELECT lang, n, round(greatest(0, (p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS low, "
    f"round(least(1, (p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) AS high FROM p"
)
def wilson_interval(t: Tables) -> DataFrame:
    g = _judged(t).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = evals.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "WITH j AS (SELECT l.doc_id, quality = 1 AS x, toxic = 0 AND length(text) > 500 AS y FROM labels l JOIN documents d USING (doc_id)) "
    "SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (NOT x AND y) AS only_b, count(*) FILTER (NOT x AND NOT y) AS neither FROM j"
)
def paired_outcomes(t: Tables) -> DataFrame:
    j = _judged(t)
    a = j.select("doc_id", (F.col("quality") == 1).alias("ok"))
    b = j.select("doc_id", ((F.col("toxic") == 0) & (F.char_length("text") > 500)).alias("ok"))
    return evals.paired(a, b, "doc_id")


@query(
    "WITH c AS (SELECT source, count(*) FILTER (length(text) > 1200) AS w, count(*) FILTER (length(text) <= 1200) AS l FROM documents GROUP BY source), s AS (SELECT *, unnest(range(0, least(w, l) + 1)) AS i FROM c) "
    "SELECT source, w, l, round(least(1.0, 2 * sum(exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2)))), 9) AS p FROM s GROUP BY source, w, l"
)
def sign_test(t: Tables) -> DataFrame:
    longer = F.char_length("text") > 1200
    c = t.documents.groupBy("source").agg(F.count_if(longer).alias("w"), F.count_if(~longer).alias("l"))
    return c.select("source", "w", "l", F.round(evals.sign_test(F.col("w"), F.col("l")), 9).alias("p"))


@query(
    "WITH g AS (SELECT lang, avg(quality) AS rate, avg(length(text)) AS cost FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT bool_and(rate >= 0.2) AS rate_ok, bool_and(cost <= 5000) AS cost_ok, bool_and(rate >= 0.2 AND cost <= 5000) AS promoted FROM g"
)
def promotion_gate(t: Tables) -> DataFrame:
    g = _judged(t).groupBy("lang").agg(F.avg("quality").alias("rate"), F.avg(F.char_length("text")).alias("cost"))
    rate, cost = F.col("rate") >= 0.2, F.col("cost") <= 5000
    return g.agg(F.bool_and(rate).alias("rate_ok"), F.bool_and(cost).alias("cost_ok"), F.bool_and(rate & cost).alias("promoted"))


@query(
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, CAST(p AS DOUBLE) AS p, value FROM r CROSS JOIN (VALUES (0.5), (0.95), (0.99), (1.0)) v(p) WHERE r.r = greatest(1, CAST(ceil(CAST(p AS DOUBLE) * n) AS BIGINT))"
)
def nearest_rank_percentiles(t: Tables) -> DataFrame:
    return evals.nearest_rank(t.events.select("event_type", "value"), "event_type", "value", [0.5, 0.95, 0.99, 1.0])


@query("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price, avg(l_quantity) AS mean_quantity, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
def median_values(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.median("l_extendedprice").alias("median_price"), F.avg("l_quantity").alias("mean_quantity"), F.max("l_extendedprice").alias("most"))


@query("SELECT doc_id, sha256('seed-7:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents ORDER BY digest, doc_id LIMIT 40")
def deterministic_sample(t: Tables) -> DataFrame:
    """A sample of forty that everybody draws alike (the limit is the operator)."""
    return evals.sample(t.documents, "doc_id", "seed-7", 40).select("doc_id", "digest")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('q:' || CAST(doc_id AS VARCHAR)), doc_id) <= 6")
def quota_sample(t: Tables) -> DataFrame:
    """Six documents a language, by hash (the quota is the operator)."""
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("q:"), F.col("doc_id").cast("string")), 256), "doc_id")
    return t.documents.select("doc_id", "lang", F.row_number().over(w).alias("n")).filter("n <= 6").drop("n")


@query(
    "SELECT item_id, doc_id, CAST(instr(d.text, b.text) AS BIGINT) AS at, CAST(length(b.text) AS BIGINT) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)"
)
def claim_spans(t: Tables) -> DataFrame:
    return evals.verbatim(t.documents, t.benchmark.select("item_id", F.col("text").alias("claim")), "doc_id", "item_id")


#: Vectors a block: a task holds one block of queries and one of rows.
_BLOCK = 1024


@query(
    "WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 4) AS cosine FROM embeddings CROSS JOIN q WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) > 0.2"
)
def vector_similar(t: Tables) -> DataFrame:
    """Vectors near those whose number is divisible by 100: blocks of queries against blocks of all rows."""

    def blocks(rows: DataFrame, n: int, ids: str, vectors: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n))
        each = rows.filter("embedding is not null").select(block.alias("block"), F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")).alias("v"))
        return each.groupBy("block").agg(F.collect_list("v").alias("v")).select(F.col("v.vec_id").alias(ids), F.col("v.e").alias(vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda v: (m := np.array(v, np.float64)) / np.sqrt((m * m).sum(axis=1, keepdims=True))
        for batch in batches:
            for a, x, b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cosine = unit(x) @ unit(y).T
                i, j = np.nonzero(cosine > 0.2)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[i], pa.int64()), pa.array(np.array(b)[j], pa.int64()), pa.array(cosine[i, j])], ["query_id", "vec_id", "cosine"])

    rows, queries = t.embeddings, t.embeddings.filter("vec_id % 100 = 0")
    n, m = (-(-x.count() // _BLOCK) or 1 for x in (rows, queries))
    pairs = blocks(queries, m, "a", "x").crossJoin(blocks(rows, n, "b", "y"))
    found = pairs.mapInArrow(score, "query_id long, vec_id long, cosine double")
    return found.select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"))


@query(
    r"WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS hit FROM documents) SELECT doc_id, hit, count(*) AS n FROM h GROUP BY ALL"
)
def text_audit(t: Tables) -> DataFrame:
    """Mail addresses in texts."""
    hits = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    return t.documents.select("doc_id", F.explode(hits).alias("hit")).groupBy("doc_id", "hit").agg(F.count("*").alias("n"))


@query(
    "WITH b AS (SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT count(*) AS bins, max(n) AS most, round(stddev_pop(n) / avg(n), 6) AS cv FROM b"
)
def density_bins(t: Tables) -> DataFrame:
    b = t.events.filter("value is not null").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))
    return b.agg(F.count("*").alias("bins"), F.max("n").alias("most"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("cv"))
