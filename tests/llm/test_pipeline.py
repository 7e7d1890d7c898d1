"""The stages of the pipeline on a small table."""

import corpus_pipeline
from test_operators import SCHEMA, dedup_brute, jaccard_brute, small_rows


def test_stages(spark):
    docs = spark.createDataFrame(small_rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in small_rows() if r[1] and any(c.isalpha() for c in r[1])}
    once = corpus_pipeline.near_duplicates(spark, kept, "")
    rows = [tuple(r) for r in kept.collect()]
    assert {r.doc_id for r in once.collect()} == {i for i, (_, c) in jaccard_brute(rows).items() if c == i}
    cut = corpus_pipeline.repeated_passages(spark, once, "")
    want = dedup_brute([tuple(r) for r in once.collect()])
    assert {r.doc_id for r in cut.collect()} == {i for i, w in want.items() if w[0] > w[1]}
    mixed = corpus_pipeline.mix_sources(spark, cut, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids
    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert packed.count() >= mixed.count()
