"""The inverted index and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions.text import fold, occurrences, tokens

#: BM25 constants, the floor of idf, and the constant of reciprocal-rank fusion (fixed values).
K1, B, IDF_LEAST, RRF_K = 1.2, 0.75, 1e-6, 60


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term): every token."""
    return docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf)."""
    return positions(docs, key, text).groupBy("term", key).agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl): zero for texts without tokens."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def doc_freq(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return postings(docs, key, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(IDF_LEAST))


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score, n_terms): documents with any of the terms. weights: of several text columns whose term frequencies
    are added; the length counts all of them. The text is tokenised once; only rows with a term are aggregated."""
    columns = weights or {text: 1.0}
    parts = [(tokens(F.col(c)), w) for c, w in columns.items()]
    listed = docs.select(key, *[p.alias(f"t{k}") for k, (p, _) in enumerate(parts)])
    length = sum((F.size(f"t{k}") for k in range(len(parts))), F.lit(0))
    often = lambda k, term: F.size(F.filter(f"t{k}", lambda x: x == term))
    tf = [sum((often(k, t) * w for k, (_, w) in enumerate(parts)), F.lit(0.0)).alias(f"tf{j}") for j, t in enumerate(terms)]
    counted = listed.select(key, length.alias("dl"), *tf)
    hit = lambda j: (F.col(f"tf{j}") > 0).cast("long")
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(hit(j)).alias(f"df{j}") for j in range(len(terms))])
    any_term = sum((hit(j) for j in range(len(terms))), F.lit(0))
    joined = counted.withColumn("n_terms", any_term.cast("long")).filter("n_terms > 0").crossJoin(F.broadcast(corpus))  # one row
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = sum((idf(F.col("n"), F.col(f"df{j}")) * F.col(f"tf{j}") * (K1 + 1) / (F.col(f"tf{j}") + norm) for j in range(len(terms))), F.lit(0.0))
    return joined.select(key, score.alias("score"), "n_terms")


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def phrase_docs(docs: DataFrame, phrase: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits): where the tokens stand one after the other. Tokens are set in blanks of their own, so that a
    zero-width match finds each place once, overlaps included."""
    row = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), "  "), F.lit(" "))
    hits = F.regexp_count(row, F.lit(f"(?= {'  '.join(phrase)} )"))
    return docs.select(key, hits.cast("long").alias("hits")).filter("hits > 0")


def grep(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_terms, total): substring counts; the more different terms, then the more hits, the better."""
    folded = docs.select(key, fold(F.col(text)).alias("folded"))  # once a text
    rows = folded.select(key, *[occurrences(F.col("folded"), t).alias(f"n{k}") for k, t in enumerate(terms)])
    counts = [F.col(f"n{k}") for k in range(len(terms))]
    n = sum(((c > 0).cast("long") for c in counts), F.lit(0).cast("long"))
    return rows.select(key, n.alias("n_terms"), sum(counts, F.lit(0).cast("long")).alias("total")).filter("n_terms > 0")


def ranked(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(key, pos) of the k best."""
    best = top(scored, k, key)
    return best.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, "pos")  # k rows


def rrf(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rrf) of two rankings (key, pos)."""
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = a.withColumnRenamed("pos", "pa").join(b.withColumnRenamed("pos", "pb"), key, "full_outer")
    return both.select(key, (part("pa") + part("pb")).alias("rrf"))


def floor(scored: DataFrame, share: float) -> DataFrame:
    """Rows with at least ``share`` of the best score."""
    best = scored.agg(F.max("score").alias("best_of_all"))
    return scored.crossJoin(F.broadcast(best)).filter(F.col("score") >= share * F.col("best_of_all")).drop("best_of_all")  # one row
