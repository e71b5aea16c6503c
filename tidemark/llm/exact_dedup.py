"""Exact deduplication by an extendible-hash index on shared files.

Every normalised text gets a 64-bit key. A directory of key prefixes doubles until no bucket holds more than `capacity`
distinct keys, so buckets follow the data at any size. The texts are grouped by (bucket owner, key, text): owners are
contiguous ranges of the directory, copies collapse before they travel, and the grouping compares whole texts. Rows of one key
with different texts form a chain. The index (bucket, key, chain, digest, kept id, size) is written to the session's shared
folder; documents then look up their group by key and digest, which the grouping has shown to name one text only. Where it
does not (digests that collide), the lookup falls back to the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, whole, with_share
from tidemark.sources.stage import stage

SPAN = 10  # a bucket covers 2 ** SPAN slots at most, so no row of the directory grows with the data


def text_key(text: Column, bits: int = 64) -> Column:
    """Key of a text: the top `bits` bits of a 64-bit hash, in the high end of a long."""
    h = F.xxhash64(text)
    return h if bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def prefix(key: Column, depth: int) -> Column:
    """The first `depth` bits of a key as a non-negative number."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, capacity: int = 4096, bits: int = 64, start: int = 4) -> tuple[DataFrame, int]:
    """Directory over distinct keys: `slot -> bucket, local_depth, n_keys`, and its global depth.

    A slot is a key's first `depth` bits. Starting at `start`, the depth doubles the directory (one more bit) while some slot is
    overfull. A bucket is the shortest prefix that holds at most `capacity` keys, so several slots may share one bucket. At
    depth `bits` nothing can be split any more; what is left there is chained. Empty input gives an empty directory.
    """
    depth = min(start, bits, 62)
    while True:
        slots = stage(keys.groupBy(prefix(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "slots")
        stat = slots.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if not stat["most"] or stat["most"] <= capacity or depth >= min(bits, 62):
            break
        # as many doublings at once as the fullest slot certainly needs
        depth = min(bits, 62, depth + max(1, (int(stat["most"]) // capacity).bit_length() - 1))
    up = slots.withColumn("d", F.explode(F.sequence(F.lit(max(0, depth - SPAN)), F.lit(depth)))).withColumn(
        "bucket", F.expr(f"shiftright(slot, {depth} - d)")
    )
    filled = up.groupBy("d", "bucket").agg(F.sum("n").alias("n_keys"), F.collect_list("slot").alias("slots"))
    fits = filled.where((F.col("n_keys") <= capacity) | (F.col("d") == depth)).select(
        F.explode("slots").alias("slot"), F.struct("d", "bucket", "n_keys").alias("b")
    )
    leaf = fits.groupBy("slot").agg(F.min("b").alias("b"))
    return leaf.select("slot", F.col("b.bucket").alias("bucket"), F.col("b.d").alias("local_depth"), F.col("b.n_keys").alias("n_keys")), depth


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int = 4096, bits: int = 64, digest_bits: int = 256) -> tuple[DataFrame, DataFrame]:
    """`entries` (id, key, digest of every row) and `index` (one row per distinct text), both staged in the shared folder."""
    text = ascii_lower(whole(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm"))
    cut = max(1, digest_bits // 4)
    keyed = base.withColumn("key", text_key(F.col("norm"), bits)).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    keyed = keyed.withColumn("digest", F.substring("sha", 1, cut))
    entries = stage(keyed.select("doc_id", "key", "digest", "sha"), "entries")
    leaves, depth = directory(entries.select("key").distinct(), capacity, bits)
    # Same text, same row: copies collapse in the map tasks. Owners are ranges of keys, and the grouping compares whole texts.
    owner = prefix(F.col("key"), min(depth, 10)).alias("owner")
    groups = keyed.groupBy(owner, "key", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("sha").alias("sha"), F.first("digest").alias("digest")
    )
    groups = stage(groups.drop("norm"), "groups")
    chains = groups.groupBy("key").agg(F.sort_array(F.collect_list("sha")).alias("shas"))  # one item per different text of a key
    slotted = groups.join(chains, "key").withColumn("chain", F.array_position("shas", F.col("sha"))).withColumn("slot", prefix(F.col("key"), depth))
    index = slotted.join(leaves, "slot").select("bucket", "local_depth", "key", "chain", "digest", "sha", "keep_id", "group_size")
    return entries, stage(index.repartitionByRange("bucket", "key"), "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, bits: int = 64, digest_bits: int = 256) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256`.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest id stays. A null text counts as empty. A
    null id never stays where an id is known; in a group of null ids only, `keep_id` is null and all its rows are kept. Rows that
    repeat id and text are one document written twice: each is returned, with the same values. Other columns are not read, and
    an empty table gives no rows. `capacity` is the number of distinct keys in a bucket. `bits` and `digest_bits` shorten keys
    and digests, so that tests can make them collide; results do not depend on them.
    """
    entries, index = build_index(docs, id_col, text_col, capacity, bits, digest_bits)
    total = entries.count()
    names = index.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    found = with_share(entries, names, ["key", "digest"], "group_size", total)
    if digest_bits >= 256:  # the comparison of texts has found two of one key and one SHA-256: nobody knows such a pair
        found = found.withColumn("keep_id", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long")).otherwise(F.col("keep_id")))
    if digest_bits < 256:  # digests of another length may name several texts: those are told apart by the full digest
        full = index.select("key", "sha", F.col("keep_id").alias("k"), F.col("group_size").alias("g"))
        split = with_share(found.where("texts > 1"), full, ["key", "sha"], "g", total)
        found = found.where("texts = 1").unionByName(split.select(*[c for c in found.columns if c not in ("keep_id", "group_size")], F.col("k").alias("keep_id"), F.col("g").alias("group_size")))
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
