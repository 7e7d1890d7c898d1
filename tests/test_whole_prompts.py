"""The search by stems uses prompts and texts to their ends."""

from evidencelake.plans import QUERIES


def test_porter_search_uses_the_last_word_of_a_long_prompt_and_of_a_long_text(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    said = " ".join(f"wordling{chr(97 + k)}" for k in range(40)) + " harbours"
    docs = [(k, "plain filler\n" * 5, "en", "src1") for k in range(8)] + [(9, "filler row\n" * 20_000 + "the harbour", "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 0, "user", said)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    assert [(r.conv_id, r.doc_id, r["rank"]) for r in QUERIES["porter_search"](spark, folder).collect()] == [(4, 9, 1)]
