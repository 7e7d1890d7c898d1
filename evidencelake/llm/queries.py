"""The queries of the operators of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, ball_tree, histogram_shards, id_matrices, langid, lexical, license_scan, media, merkle, mixing
from .bin_completion import pack
from .common import bounded_batches
from .parity_join import jaccard_components
from .suffix_dedup import digest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Sources in order weigh 3, 1, 2, repeating, and share 150 % of all words; none is read more than twice.
MIX = {"weights": [3.0, 1.0, 2.0], "share": 1.5, "epochs": 2.0, "seed": 17}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_documents(spark, sf_dir), **MIX)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.digest(_documents(spark, sf_dir), order=3)


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.digest(_documents(spark, sf_dir), shards=8, tolerance=0.01)


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_matrices.id_matrices(_documents(spark, sf_dir), capacity=4096)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), words=5, percent=75)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), capacity=4096)


def op6_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(_documents(spark, sf_dir))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, rows=ball_tree.TREE)
    return ball_tree.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_matrices": op2_token_matrices,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_backoff_lm": op4_backoff_lm,
    "op5_histogram_sharding": op5_histogram_sharding,
    "op6_media_column": op6_media_column,
    "op7_merkle_fingerprint": op7_merkle_fingerprint,
    "op8_language_id": op8_language_id,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {"op1_source_mixing": mixing.sql(**MIX), "op7_merkle_fingerprint": merkle.sql(), "op11_ranked_search": lexical.sql(k=50), "op12_centroid_clusters": ball_tree.sql(k=16, rounds=3)}
