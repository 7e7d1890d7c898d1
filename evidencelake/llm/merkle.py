"""Document fingerprints: Merkle trees over paragraphs and sections.  DataFrame operations only.

A text is cut into sections at blank lines, sections into paragraphs at line ends, and paragraphs into leaves of
``LEAF`` words (parts between single spaces, so nothing is lost).  A leaf's digest is the MD5 of its text, a paragraph's
that of its leaves' digests, a section's that of its paragraphs', and the root is the SHA-256 of the sections'.  Equal
roots mean equal texts; where roots differ, only branches with differing digests need to be looked at.

The fingerprint is ``root:section=leaf.leaf.leaf;section=...`` with the first ``SHORT`` hex digits of sections and
leaves.  The likeness of two fingerprints is 1 for equal roots, else the share of their distinct leaves that both have.

Neighbours by doc_id need no global order in one task: doc_id is cut into buckets at approximate quantiles, the next row
is found within the bucket, and the first row of each bucket goes to the bucket before.

Defined results: null is the empty text (one section, one paragraph, one empty leaf); rows that repeat a doc_id follow
each other by text; a null doc_id comes first; in a table of one row the next document is the row itself; an empty table
returns no rows; extra columns are ignored; of equal doc_ids the lesser text comes first; very long texts are read whole, in
time that grows with their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, did

#: Words of a leaf; hex digits of a leaf or section in the fingerprint; bytes of text in a bucket of neighbours.
LEAF, SHORT = 8, 8
BUCKET, BUCKETS_MOST = 8 << 20, 1 << 14


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, also within its own lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _leaves(paragraph: Column) -> Column:
    def cut(words: Column) -> Column:
        turns = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / LEAF).cast("int"))
        return F.transform(turns, lambda i: F.md5(F.array_join(F.slice(words, i * LEAF + 1, LEAF), " ").cast("binary")))

    return _let(F.split(paragraph, " "), cut)


def tree(text: Column) -> Column:
    """array of sections, each (digest, leaves): leaves are the digests of its paragraphs' leaves, in order."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n")

    def joined(paragraphs: Column) -> Column:
        nodes = F.transform(paragraphs, lambda leaves: F.md5(F.array_join(leaves, "").cast("binary")))
        return F.struct(F.md5(F.array_join(nodes, "").cast("binary")).alias("digest"), F.flatten(paragraphs).alias("leaves"))

    def section(s: Column) -> Column:
        return _let(F.transform(F.split(s, "\n"), _leaves), joined)

    return F.transform(sections, section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), "").cast("binary"), 256)


def fingerprint(sections: Column) -> Column:
    short = lambda s: F.concat(
        F.substring(s["digest"], 1, SHORT), F.lit("="), F.array_join(F.transform(s["leaves"], lambda x: F.substring(x, 1, SHORT)), ".")
    )
    return _let(sections, lambda x: F.concat(root(x), F.lit(":"), F.array_join(F.transform(x, short), ";")))


def leaves(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    sections = F.split(F.substring_index(print_, ":", -1), ";")
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "=", -1), r"\."))))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    share = _let(F.struct(leaves(a).alias("x"), leaves(b).alias("y")), lambda p: F.size(F.array_intersect(p["x"], p["y"])) / F.size(F.array_union(p["x"], p["y"])))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(share)


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of fingerprint a that b does not have at the same place: where an edit is."""
    x, y = (F.split(F.substring_index(c, ":", -1), ";") for c in (a, b))
    mark = F.transform(x, lambda s, i: F.when(~s.eqNullSafe(F.get(y, i)), i))
    return F.filter(mark, lambda i: i.isNotNull())


def _bucket(ids: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below ids, by binary search."""
    if not cuts:
        return F.lit(0)
    wide = 1 << (len(cuts)).bit_length()
    table = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(wide >> k) for k in range(1, wide.bit_length())])

    def step(at: Column, by: Column) -> Column:
        reach = at + by
        return F.when((reach <= len(cuts)) & (F.get(table, reach - 1) <= ids), reach).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame) -> DataFrame:
    """did, text and print (its fingerprint), and next_text and next_print: those of the next row by doc_id; after the last
    comes the first. Each text's tree is made once, before rows move."""
    keys = docs.select(did().alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    size, low = keys.agg(F.sum(F.octet_length("text") + 16), F.min("did")).first()
    rows = keys.withColumn("print", fingerprint(tree(F.col("text"))))
    wanted = min(BUCKETS_MOST, int(size or 0) // BUCKET + 1)
    points = [k / wanted for k in range(1, wanted)]
    cuts = keys.agg(F.percentile_approx("did", points, 20_000)).first()[0] if points else []
    cuts = sorted({c for c in cuts or [] if c > low})
    rows = rows.withColumn("bucket", _bucket(F.col("did"), cuts))
    order = Window.partitionBy("bucket").orderBy("did", "text")
    inside = rows.withColumn("next", F.lead(F.struct("text", "print")).over(order))
    # The first row of each bucket: its least doc_id (a number a bucket), and of the rows that have it the least text.
    least = keys.withColumn("bucket", _bucket(F.col("did"), cuts)).groupBy("bucket").agg(F.min("did").alias("did"))
    # BUCKETS_MOST rows at most
    first = rows.join(F.broadcast(least), ["bucket", "did"]).groupBy("bucket").agg(F.min(F.struct("text", "print")).alias("first"))
    everyone = Window.orderBy("bucket")  # a row a bucket
    turn = F.coalesce(F.lag("bucket").over(everyone), F.max("bucket").over(Window.partitionBy()))
    ahead = first.select(turn.alias("bucket"), "first")
    out = inside.join(ahead, "bucket").withColumn("next", F.coalesce("next", "first"))
    return out.select("did", "text", "print", F.col("next.text").alias("next_text"), F.col("next.print").alias("next_print"))


def edited(text: Column, next_text: Column) -> Column:
    """text with its last quarter (code points, rounded down) replaced by as many of the next text, or all it has."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(next_text, F.lit(1), cut))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs."""
    rows = with_next(docs)
    own = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    prints = own.select(
        F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        fingerprint(tree(F.col("edited"))).alias("edited_fingerprint"),
        "next_print",
    )
    a = F.col("fingerprint")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(a, F.col("edited_fingerprint")).alias("near_edited"), likeness(a, F.col("next_print")).alias("near_next"),
    )


def sql() -> str:
    """The rows of digest() in DuckDB's SQL."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS k FROM documents
), n AS (
  SELECT doc_id, k, text, coalesce(lead(text) OVER (ORDER BY k), first_value(text) OVER (ORDER BY k)) AS nxt FROM d
), e AS (
  SELECT *, left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4) AS edited FROM n
), x AS (
  SELECT k, 1 AS kind, text AS t FROM e UNION ALL SELECT k, 2, edited FROM e UNION ALL SELECT k, 3, nxt FROM e
), s AS (
  SELECT k, kind, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(range(0, (len(string_split(p, ' ')) - 1) // {LEAF} + 1),
      lambda i: md5(array_to_string(string_split(p, ' ')[i * {LEAF} + 1 : i * {LEAF} + {LEAF}], ' '))))) AS tree FROM x
), g AS (
  SELECT k, kind, tree, list_transform(tree, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))) AS dig FROM s
), f AS (
  SELECT k, kind, sha256(array_to_string(dig, '')) AS root, array_to_string(list_transform(range(1, len(dig) + 1), lambda i: left(dig[i], {SHORT}) || '=' ||
    array_to_string(list_transform(flatten(tree[i]), lambda x: left(x, {SHORT})), '.')), ';') AS body,
    list_distinct(list_transform(flatten(flatten(tree)), lambda x: left(x, {SHORT}))) AS leaves FROM g
)
SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.root || ':' || a.body AS fingerprint, b.root || ':' || b.body AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE len(list_intersect(a.leaves, b.leaves)) / len(list_distinct(list_concat(a.leaves, b.leaves))) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0::DOUBLE ELSE len(list_intersect(a.leaves, c.leaves)) / len(list_distinct(list_concat(a.leaves, c.leaves))) END AS near_next
FROM e JOIN f a ON a.k = e.k AND a.kind = 1 JOIN f b ON b.k = e.k AND b.kind = 2 JOIN f c ON c.k = e.k AND c.kind = 3"""
