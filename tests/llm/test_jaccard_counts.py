"""All documents count towards the order of shingles and the boundary, however many there are."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join
from tidemark.sources.stage import clear_stages

N = 40_400  # twice the documents of which one in 1,250 makes a shingle one of wide use, and some


class Counted(Exception):
    pass


def counted(spark, monkeypatch, run):
    """What the join knows of the uses of shingles in `N` texts of six words, of which every fourth has a passage."""
    real = jaccard_join.wide_shingles

    def stop(docs, rows):
        raise Counted(rows, *real(docs, rows))

    monkeypatch.setattr(jaccard_join, "wide_shingles", stop)
    own = F.concat_ws(" ", *[F.concat(F.lit(c), F.col("doc_id")) for c in "abcdef"])
    shared = F.concat(F.lit("one common passage of words x"), F.col("doc_id").cast("string"))
    docs = spark.range(N, numPartitions=4).select(F.col("id").alias("doc_id")).withColumn("text", F.when(F.col("doc_id") % 4 == 0, shared).otherwise(own))
    with pytest.raises(Counted) as found:
        run(docs.withColumn("n_chars", F.char_length("text").cast("long")))
    clear_stages(spark)
    return found.value.args


def test_every_document_is_counted(spark, monkeypatch):
    rows, _, uses, sizes, narrow = counted(spark, monkeypatch, jaccard_join.link_groups)
    assert rows == N and sizes == {2: N}
    assert N / 4 <= uses.max() < N / 4 + 50  # all of them; few shingles of other texts share the counter
    assert 0.9 < narrow < 1.1  # all other shingles are used once


def test_near_copies_of_the_pipeline_count_every_document(spark, monkeypatch):
    rows, _, uses, sizes, _ = counted(spark, monkeypatch, lambda docs: corpus_pipeline.dedup_near_copies(spark, docs, ""))
    assert rows == N and sizes == {2: N} and uses.max() >= N / 4
