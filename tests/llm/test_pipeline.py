"""The pipeline's stages against what they promise."""

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import sentence_pieces
from tidemark.sources.stage import clear_stages, stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def tidy(spark):
    yield
    clear_stages(spark)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, "123 456", "en", "s", 7), (900_002, None, None, "s", 0), (None, "the and of to", None, "s", 13)], docs.schema)
    now, names = docs.unionByName(extra), docs.columns
    kept = {}
    for name, step in pipeline.STAGES:
        now = stage(step(spark, now, SF), name)
        kept[name] = now.collect()
        assert name == "pieces" or now.columns == names
    ids = lambda name: {x.doc_id for x in kept[name]}
    assert ids("language") == {x.doc_id for x in docs.collect()} | {None} and ids("lines") == ids("language")
    assert all(x.n_chars == len(x.text) for x in kept["lines"])
    assert ids("near_copies") <= ids("lines") and len(kept["near_copies"]) == len(ids("near_copies"))
    assert ids("mix") <= ids("near_copies") and ids("pieces") == ids("mix") and len(kept["pieces"]) == len(kept["mix"])
    own = sentence_pieces.Vocabulary(pipeline.PIECES)
    texts = {x.doc_id: x.text for x in kept["near_copies"]}
    assert all(x.round_trip and own.decode(np.array(x.ids)) == texts[x.doc_id] for x in kept["pieces"][:50])


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.where(F.col("round_trip")).count() == out.count() > 0


def test_empty(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in pipeline.STAGES:
        now = stage(step(spark, now, SF), name)
        assert now.count() == 0
