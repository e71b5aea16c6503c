"""A corpus pipeline out of the operators of `tidemark.llm`, stage by stage.

All stages but the last return the columns of `documents`, with `n_chars` of the text as it then is. Each decision takes effect:
documents without a language go, repeated passages are cut out, one document of each group of near copies stays, documents are
repeated or left out by their mixing rate, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, language_id, line_dedup, mixing, sentence_pieces
from tidemark.llm.common import table
from tidemark.sources.stage import stage_result

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
WEIGHTS = {"high": 0.93, "low": 0.05, "toxic": 0.02}
KEEP = ("high",)  # domains that the mix does not shrink
MIN_SCORE = 0.03  # cosine with the nearest language under which a text is in none of them


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts far from every language. A language that is null is filled in."""
    prototypes = language_id.learn(docs.where(language_id.fold() != 0))
    found = language_id.predict(docs, prototypes, pred_col="__lang", score_col="__score")
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out repeated passages of several lines. All documents stay."""
    return line_dedup.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document by its mixing rate; the total is the least with which high quality need not shrink."""
    labelled = mixing.domains_of(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labelled, WEIGHTS, keep=KEEP)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies")))).where("__copy > 0").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes all texts, decodes them again, and returns ids, token count and whether the round trip gives the text."""
    coded = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"), PIECES, check_col="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language", identify_language), ("lines", dedup_lines), ("near_copies", dedup_near_copies), ("mix", mix_sources), ("pieces", encode_pieces),
]
ORACLE_SQL = None  # learned stages have no SQL form; tests hold each stage against a plain reading of it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; each result is written as Parquet and read again as the next one's input.

    What a stage staged on its way is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        last, given = i == len(STAGES) - 1, docs
        docs = step(spark, given, sf_dir) if last else stage_result(spark, lambda step=step, given=given: step(spark, given, sf_dir), name)
    return docs
