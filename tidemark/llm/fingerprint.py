"""I-Match fingerprints: hashes of a text's terms inside an inverse-document-frequency band, over randomised lexicon subsets.

The lexicon holds the terms that stand in at least `low` and at most `high` of all documents. A text keeps its distinct terms
of the lexicon, sorted. Their joint hash is the classical signature, which one changed term destroys, so signatures over small
random subsets of the lexicon stand beside it. A subset of level L holds one in 2**L terms, drawn by a hash; a text uses the
levels at which a subset meets about one of its terms, so that a signature survives an edit with a fair chance, whatever the
length of the text. The likeness of two fingerprints is the share of equal signatures at a level that both have.

Only DataFrame functions are used. The lexicon is bounded by (terms per document) / `low`, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import count_cuts, double_array
from tidemark.llm.common import ascii_lower, whole
from tidemark.session import shuffle_width
from tidemark.sources.stage import stage

SUBSETS = 16
LOW, HIGH = 0.002, 0.2
BROADCAST_ROWS = 1_000_000
SPACES = "[ \\t-\\r]+"
NONE = 0  # a term number that every text has, so that texts without terms of the lexicon stay in the join


def terms(text: Column) -> Column:
    """Distinct lower-cased words of a text."""
    return F.array_distinct(F.filter(F.split(ascii_lower(text), SPACES), lambda w: w != ""))


def numbers(text: Column) -> Column:
    """The terms as 64-bit numbers."""
    return F.transform(terms(text), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Term numbers whose document frequency, counted over all rows, is within the band; at least two rows must have a term."""
    total = docs.count()
    # outer: for a plain explode Spark filters on the array's size first and computes the array a second time for that
    counts = docs.select(F.explode_outer(numbers(whole(text_col))).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") >= max(2, low * total)) & (F.col("df") <= high * total)).select("term")


def add_fingerprint(rows: DataFrame, kept: str, own: str, out: str) -> DataFrame:
    """`rows` with a fingerprint of the sorted lexicon terms in `kept`: `level|signature|subsets of level|subsets of level - 1`,
    or `|hash of the text` if there are none. A subset's signature hashes its sorted terms; it is `-` if it has none.

    Every step has a column of its own, as an expression inside a lambda is computed anew for every item.
    """
    level = F.floor(F.log2(F.size(kept).cast("double") + 0.5)).cast("int") + 1
    rows = rows.withColumn("__level", F.when(F.size(kept) > 0, level))
    rows = rows.withColumns({f"__mask{i}": F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__level") - i) - 1 for i in (0, 1)})

    def cells(mask: str) -> Column:
        placed = F.transform(kept, lambda x: F.struct(F.xxhash64(x, F.lit("subset")).bitwiseAND(F.col(mask)).alias("c"), x.alias("x")))
        return F.filter(placed, lambda z: z["c"] < SUBSETS)

    rows = rows.withColumns({f"__few{i}": cells(f"__mask{i}") for i in (0, 1)})

    def signatures(few: str) -> Column:
        def one(j: Column) -> Column:
            own_terms = F.transform(F.filter(few, lambda z: z["c"] == j), lambda z: z["x"])
            return F.when(~F.exists(few, lambda z: z["c"] == j), "-").otherwise(F.right(F.lpad(F.hex(F.xxhash64(own_terms)), 16, "0"), F.lit(8)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one), ",")

    full = F.lpad(F.hex(F.xxhash64(kept)), 16, "0")
    text = F.when(F.size(kept) == 0, F.concat(F.lit("|"), own)).otherwise(F.concat_ws("|", F.col("__level").cast("string"), full, signatures("__few0"), signatures("__few1")))
    return rows.withColumn(out, text).drop("__level", "__mask0", "__mask1", "__few0", "__few1")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the share of equal signatures among the subsets that either has terms of."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    m, n = F.get(x, F.lit(0)).try_cast("int"), F.get(y, F.lit(0)).try_cast("int")
    common = F.least(m, n)

    def at(parts: Column, level: Column) -> Column:
        return F.split(F.when(level == common, F.get(parts, F.lit(2))).when(level == common + 1, F.get(parts, F.lit(3))), ",")

    pairs = F.arrays_zip(at(x, m).alias("p"), at(y, n).alias("q"))
    used = F.filter(pairs, lambda z: (z["p"] != "-") | (z["q"] != "-"))
    same = F.size(F.filter(used, lambda z: z["p"] == z["q"]))
    return F.when(a == b, 1.0).when(m.isNull() | n.isNull() | (F.abs(m - n) > 1) | (F.size(used) <= 0), 0.0).otherwise(same / F.size(used))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows in buckets of descending ids, each bucket followed by a copy (`halo`) of the row that comes after its last one.

    Buckets are ranges of ids cut at quantiles, so no task sorts more than its share. The row after the very last is the first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t"))
    buckets = 4 * shuffle_width(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("double"), double_array([(i + 1) / buckets for i in range(buckets - 1)]), 100_000)).first()[0] or []
    place = count_cuts(double_array(sorted(set(cuts))), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))), len(set(cuts)), True)
    rows = rows.withColumn("bucket", place.cast("int"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.col("tie"))
    heads = rows.groupBy("bucket").agg(F.max(order).alias("head"))  # one row per bucket
    known = sorted(heads.collect(), key=lambda r: r["bucket"])
    spark = docs.sparkSession
    after = [(r["head"]["id"], r["head"]["tie"], known[(i + 1) % len(known)]["bucket"]) for i, r in enumerate(known)]
    targets = spark.createDataFrame(after, "id long, head_tie long, target int")
    joined = rows.join(F.broadcast(targets), (order["id"] == F.col("id")) & (F.col("tie") == F.col("head_tie")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    copy = F.struct(F.col("target").alias("bucket"), F.lit(True).alias("halo"))
    spread = joined.withColumn("at", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    spread = spread.select("doc_id", "t", "tie", F.col("at.bucket").alias("bucket"), F.col("at.halo").alias("halo"))
    return spread, Window.partitionBy("bucket").orderBy("halo", F.desc_nulls_last("doc_id"), F.desc("tie"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of all texts and of their edited forms.

    The edited text is the text whose last third (rounded down) is replaced by as many characters of the next document in
    descending order of ids, or all if that is shorter; after the last document comes the first. Returns `doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`. A null text counts as empty. Equal ids are put in
    order of a hash of their texts, null ids come last. Repeated rows each count as a document. Other columns are not read, and
    an empty table gives no rows.
    """
    words = stage(lexicon(docs, text_col, low, high), "lexicon")
    words = words.unionByName(docs.sparkSession.range(NONE, NONE + 1).select(F.col("id").alias("term"))).distinct()
    spread, order = in_order(docs, id_col, text_col)
    n = F.char_length("t")
    cut = F.floor(n / 3).cast("int")
    rows = spread.withColumn("next", F.lead("t").over(order)).withColumn("seq", F.row_number().over(order))
    rows = rows.withColumn("edited", F.when(~F.col("halo"), F.concat(F.substring("t", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)))).withColumn("n_chars", n)

    def sided(text: str, side: int) -> Column:
        has = F.coalesce(numbers(F.col(text)), F.array().cast("array<bigint>"))
        return F.transform(has, lambda x: F.struct(F.lit(side).alias("side"), x.alias("term")))

    always = F.array(F.struct(F.lit(2).alias("side"), F.lit(NONE).cast("long").alias("term")))
    each = rows.select(
        "bucket", "halo", "seq", "doc_id", "tie", "n_chars", F.md5(F.col("t").cast("binary")).alias("own"), F.md5(F.col("edited").cast("binary")).alias("edited_own"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.concat(sided("t", 0), sided("edited", 1), always).alias("xs"),
    )
    each = each.withColumn("x", F.explode_outer("xs")).drop("xs").select("*", F.col("x.side").alias("side"), F.col("x.term").alias("term")).drop("x")
    small = words.count() <= BROADCAST_ROWS
    met = each.join(F.broadcast(words) if small else words, "term")
    info = ["halo", "doc_id", "tie", "n_chars", "own", "edited_own", "edited_sha256"]
    sets = met.groupBy("bucket", "seq").agg(
        F.first(F.struct(*info)).alias("row"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("term")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("term")))).alias("b"),
    )
    marked = add_fingerprint(sets.select("bucket", "seq", "row.*", "a", "b"), "a", "own", "fingerprint")
    marked = add_fingerprint(marked, "b", "edited_own", "edited_fingerprint").drop("a", "b")
    following = marked.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("seq"))).where(~F.col("halo"))
    return following.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
