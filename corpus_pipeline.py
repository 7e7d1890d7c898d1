"""A pipeline from raw documents to packed training sequences: five operators, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage before has written. All but
the last return the columns of ``documents``.

Defined results, of every stage: an empty table gives an empty one; a null doc_id ranks below all
others; texts are read whole, however long; columns beside those of ``documents`` are kept, whatever their names. What
becomes of null and empty texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidencelake.llm import bin_completion, langid, mixing, parity_join, suffix_dedup
from evidencelake.llm.common import bounded_batches, released, stored, texts
from evidencelake.llm.queries import MIX


def _row(docs: DataFrame) -> Column:
    """All columns as one, so that their names meet none of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter (language ``und``) go; repeated rows are judged alike."""
    bounded_batches(spark)
    model = langid.train(docs.filter(langid.in_training()))
    found = langid.identify(docs.select(_row(docs), "text"), model)
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word Jaccard similarity of 0.75 exactly one row stays: the one with the
    smallest doc_id, then the least hash of its text, then any of equal rows. Texts without words stay, each of them."""
    bounded_batches(spark)
    return parity_join.one_of_each(docs, words=5, percent=75)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that starts earlier are cut out of the texts; documents left empty by that go,
    null and empty texts stay as they are. A character of which only a part is left goes too. n_chars is counted anew."""
    bounded_batches(spark)
    spanned = suffix_dedup.dedup_spans(docs.select(_row(docs), "doc_id", "text")).select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, spans = batch.column(1).cast(pa.string()), batch.column(2).to_pylist()
            left = [
                suffix_dedup.kept(data.tobytes(), s).decode("utf-8", "ignore") if s else x.as_py()
                for x, data, s in zip(old, texts(batch.column(1)), spans, strict=True)
            ]
            gone = [bool(s) and not x for x, s in zip(left, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string()), pa.array(gone, pa.bool_())], ["row", "text", "gone"])

    schema = T.StructType([spanned.schema["row"], T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType())])
    out = spanned.mapInArrow(released(cut), schema).filter("not gone")
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return out.select([new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; repeated rows are documents of their own, a null source is a source."""
    bounded_batches(spark)
    return mixing.repeated(docs, **MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens; null and empty texts are one end id."""
    bounded_batches(spark)
    return bin_completion.pack(docs, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
