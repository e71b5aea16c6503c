"""What a task holds at once does not grow with its partition."""

import tracemalloc

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard_join, language_id, sentence_pieces, words


@pytest.fixture
def unset(spark):
    before = spark.conf.get(common.BATCH_SETTING)
    spark.conf.set(common.BATCH_SETTING, common.BATCH_DEFAULT)
    yield
    spark.conf.set(common.BATCH_SETTING, before)


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])


def test_batches_are_small(spark, unset):
    docs = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    n, most = common.map_batches(docs, sizes, "n long, bytes long").agg(F.sum("n"), F.max("bytes")).first()
    assert n == 3000 and most < 2 * common.BATCH


@pytest.mark.parametrize("step", [
    lambda docs: jaccard_join.documents(docs.select("doc_id", "text")), lambda docs: language_id.predict(docs, {}), lambda docs: sentence_pieces.encode(docs, corpus_pipeline.PIECES),
])
def test_operators_ask_for_small_batches(spark, unset, step):
    step(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert int(spark.conf.get(common.BATCH_SETTING)) == common.BATCH


def test_a_size_of_the_session_stays(spark, unset):
    spark.conf.set(common.BATCH_SETTING, "1234567")
    jaccard_join.documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert spark.conf.get(common.BATCH_SETTING) == "1234567"


def test_hashing_holds_little():
    texts = [f"some words of text {i} " * 50 for i in range(4000)]  # 4 MB
    list(words.word_hashes(texts[:1]))  # the powers stay
    tracemalloc.start()
    found = sum(len(x) for x in words.word_hashes(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000 * 250 and peak < 40e6


def test_few_words_are_remembered():
    own = sentence_pieces.Vocabulary(corpus_pipeline.PIECES)
    texts = [" ".join(f"w{i}" for i in range(a, a + 40_000)) for a in range(0, 800_000, 40_000)]
    first = own.encode(texts[:1])[0].tolist()
    for text in texts[1:]:
        own.encode([text])
    assert len(own.words) + len(own.older) <= 600_000
    assert own.encode(texts[:1])[0].tolist() == first and own.decode(own.encode(texts[:1])[0]) == texts[0]
