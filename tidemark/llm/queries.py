"""The queries of this package, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, exact_dedup, fingerprint, html_text, jaccard_join, language_id, line_dedup, minhash, mixing, periodic_runs, pii, sentence_pieces, whitening
from tidemark.llm.common import table
from tidemark.llm.registry import QUERIES, SQL, query  # noqa: F401

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_exact_dedup",
    f"""
    WITH n AS (SELECT doc_id, {ASCII_LOWER} AS norm FROM documents),
         k AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM k
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    counts = [count(kind) for kind in range(len(pii.BASE))]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query(
    "op3_chat_format",
    """
    WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
         c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
         p AS (SELECT DISTINCT c.turns[1:i] AS turns FROM c, range(1, 100000) r(i) WHERE i < len(c.turns)),
         e AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, turns FROM c GROUP BY turns)
    SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies,
           array_to_string(['<|im_start|>' || replace(s.r, '<|', '<\\|') || chr(10) || replace(s.x, '<|', '<\\|') || '<|im_end|>' || chr(10) for s in turns], '') AS text
    FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = e.turns)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse(table(spark, sf_dir, "conversations"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(language_id.fold() != 0))
    found = language_id.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", (language_id.fold() == 0).alias("held_out"), "lang_pred", "score")


PIECES = "/opt/tokenizers/piece_bpe_32k.model"  # must be at this path on every executor


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, check_col="round_trip")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_fingerprint")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


WEIGHTS = {"high": 0.93, "low": 0.05, "toxic": 0.02}


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domains_of(table(spark, sf_dir, "labels"))
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), labelled, WEIGHTS)
    shown = {"p": "posteriors", "wanted": "wanted", "reached": "reached"}
    p, wanted, reached = ([F.get(c, F.lit(i)).alias(f"{k}_{d}") for i, d in enumerate(sorted(WEIGHTS))] for k, c in shown.items())
    return found.select("doc_id", "n_tokens", *p, "rate", "copies", *wanted, *reached)


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_groups(table(spark, sf_dir, "documents"))


@query("op11_minhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    best = F.aggregate("runs", F.struct(*[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")]), lambda b, r: F.when(b["length"].isNull() | (r["length"] > b["length"]), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    digests = [F.sha2(x.cast("binary"), 256).alias(name) for x, name in ((lines, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    shown = found.withColumn("best", best)
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return shown.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, *digests)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
