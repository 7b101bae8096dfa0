"""The stages in order, each on what its predecessor kept."""

import corpus_pipeline

from .conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixing", "bpe"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settled(stage(spark, docs, SMALL))
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
    assert counts[0] == counts[1] >= counts[2] and counts[3] == counts[4]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
