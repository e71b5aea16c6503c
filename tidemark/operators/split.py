"""Row positions, train/validation splits, anomaly surroundings, strides and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.ordered import (
    SPAN,
    Running,
    bucket_by_index,
    bucket_by_value,
    digest_rank,
    framed,
    nearest_marks,
    null_safe,
    running,
    running_by_value,
    spread_join,
)
from tidemark.sources.stage import stage


# ---------------------------------------------------------------- positions

def row_index(
    df: DataFrame,
    keys: Sequence[str],
    us: str = "us",
    tie: str = "event_id",
    carry_prev: dict[str, str] | None = None,
) -> DataFrame:
    """Dense 0-based `idx` per series in (`us`, `tie`) order, the series length `n`, and values of the previous row.

    `carry_prev` maps a new column to a column that never decreases in the order (its previous value is a running max).
    """
    specs = {"idx": Running("count", F.lit(1), exclusive=True)}
    for name, col in (carry_prev or {}).items():
        specs[name] = Running("max", F.col(col), exclusive=True)
    return running_by_value(df, keys, us, tie, specs, {"n": ("count", F.lit(1))})


# ---------------------------------------------------------------- chunk split

def _chunk_candidates(n: Column, ratio: float, max_chunks: int, min_chunk: int, tolerance: float) -> Column:
    """Admissible chunk counts for a series of n rows. `ratio` is the validation share."""
    def fits(c: Column) -> Column:
        share = F.ceil(c.cast("double") * F.lit(ratio)).cast("double") / c.cast("double")
        return (F.floor(n / c) >= min_chunk) & (F.abs(share - F.lit(ratio)) <= tolerance)

    return F.filter(F.sequence(F.lit(1), F.lit(max_chunks)), fits)


def chunk_plan(
    df: DataFrame,
    keys: Sequence[str],
    split: float = 0.8,
    max_chunks: int = 200,
    min_chunk: int = 3200,
    tolerance: float = 0.01,
    on_missing: str = "error",
) -> DataFrame:
    """Largest admissible chunk count per series: `n, chunks, val_chunks, chunk_size`.

    A series without an admissible count fails the job; with `on_missing='null'` it gets NULLs and `chunk_split` marks its rows.
    """
    ratio = 1 - split
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    best = F.array_max(_chunk_candidates(F.col("n"), ratio, max_chunks, min_chunk, tolerance))
    if on_missing == "error":
        best = F.coalesce(best, F.raise_error(F.lit("no valid chunk count; lower min_chunk")).cast("int"))
    return sizes.withColumn("chunks", best).withColumns({
        "val_chunks": F.ceil(F.col("chunks").cast("double") * F.lit(ratio)).cast("int"),
        "chunk_size": F.floor(F.col("n") / F.col("chunks")).cast("long"),
    })


def fixed_chunk_plan(df: DataFrame, keys: Sequence[str], chunks: int, ratio: float) -> DataFrame:
    """Plan with a given chunk count and `int(chunks * ratio)` validation chunks."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumns({
        "chunks": F.lit(chunks),
        "val_chunks": F.lit(int(chunks * ratio)),
        "chunk_size": F.floor(F.col("n") / F.lit(chunks)).cast("long"),
    })


def choose_val_chunks(plan: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Seeded choice of the validation chunks: one row per chosen (keys, chunk). At most `max_chunks` rows per series."""
    listed = plan.where(F.col("chunks").isNotNull()).select(
        *keys, "val_chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    order = Window.partitionBy(*keys).orderBy(hashing.digest(seed, "chunk", *keys, "chunk"), "chunk")
    return listed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("val_chunks")).select(*keys, "chunk")


def chunk_split(
    df: DataFrame, plan: DataFrame, chosen: DataFrame, keys: Sequence[str], idx: str = "idx", span: int = SPAN
) -> DataFrame:
    """Add `chunk` (the last one absorbs the remainder) and `split` = train/val.

    A series of fewer rows than chunks is all in its last chunk. Rows of a series without a plan stay: their chunk is null and
    their split is `unsplit`.
    """
    val = chosen.withColumn("_k", null_safe(keys)).groupBy("_k").agg(F.collect_set("chunk").alias("_val"))
    packed = plan.where(F.col("chunks").isNotNull()).withColumn("_k", null_safe(keys)).join(val, "_k", "left").select(
        *keys, "chunks", "chunk_size", "_val"
    )
    rows = spread_join(df, packed, keys, idx, span, "left")
    last = F.col("chunks") - 1
    chunk = F.when(F.col("chunk_size") == 0, last).otherwise(F.least(F.floor(F.try_divide(F.col(idx), F.col("chunk_size"))), last)).cast("int")
    held = F.coalesce(F.array_contains("_val", F.col("chunk")), F.lit(False))
    return (
        rows.withColumn("chunk", chunk)
        .withColumn("split", F.when(F.col("chunk").isNull(), "unsplit").when(held, "val").otherwise("train"))
        .drop("chunks", "chunk_size", "_val")
    )


def ordered_split(df: DataFrame, keys: Sequence[str], train_share: float, step: int, idx: str = "idx", span: int = SPAN) -> DataFrame:
    """Every `step`-th position; the first `floor(share * count)` of them train, the rest val."""
    picked = df.where(F.col(idx) % step == 0)
    out = running(
        bucket_by_index(picked, idx, span),
        keys,
        [F.col(idx)],
        {"rn": Running("count", F.lit(1), exclusive=True)},
        {"picked": ("count", F.lit(1))},
    )
    return out.withColumn(
        "split", F.when(F.col("rn") < F.floor(F.lit(train_share) * F.col("picked")), "train").otherwise("val")
    ).drop("picked")


# ---------------------------------------------------------------- anomalies and their surroundings

def label_present(df: DataFrame, label: str | Sequence[str]) -> bool:
    """Whether the label column, or every column of a list, exists."""
    names = [label] if isinstance(label, str) else list(label)
    return bool(names) and all(c in df.columns for c in names)


def anomaly_starts(
    df: DataFrame, keys: Sequence[str], length: int, label: str = "is_anomaly", idx: str = "idx", n: str = "n", span: int = SPAN
) -> DataFrame:
    """Starts (`keys, start_idx`) of all complete windows that contain an anomaly: rows with one among the next `length` ones."""
    rows = df.select(*keys, idx, label, n)
    seen = nearest_marks(rows, keys, idx, {"_a": F.col(label) == 1}, length - 1, span)
    return seen.where(F.col("_a_after").isNotNull() & (F.col(idx) + length <= F.col(n))).select(*keys, F.col(idx).alias("start_idx"))


def anomaly_windows(
    df: DataFrame, keys: Sequence[str], length: int, label: str = "is_anomaly", idx: str = "idx", span: int = SPAN
) -> DataFrame:
    """Starts of all complete windows that contain an anomaly, each with its 0/1 `labels` array.

    Only rows that some such window holds go into frames; all others leave after one running value.
    """
    marked = nearest_marks(df.select(*keys, idx, label), keys, idx, {"_a": F.col(label) == 1}, length - 1, span)
    held = marked.where(F.coalesce("_a_before", "_a_after").isNotNull()).drop("_a_before", "_a_after")
    out = framed(held, keys, idx, {"labels": (F.collect_list(label), 0, length - 1)}, span)
    return out.where((F.size("labels") == length) & F.exists("labels", lambda x: x == 1)).select(
        *keys, F.col(idx).alias("start_idx"), "labels"
    )


def anomaly_covered_rows(
    df: DataFrame,
    keys: Sequence[str],
    length: int,
    label: str = "is_anomaly",
    idx: str = "idx",
    n: str = "n",
    span: int = SPAN,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add `covered` = 1 on rows that lie in some complete window containing an anomaly (within length - 1 of one)."""
    out = nearest_marks(df, keys, idx, {"_a": F.col(label) == 1}, length - 1, span, keep_bucket)
    near = (F.col(n) >= length) & F.coalesce("_a_before", "_a_after").isNotNull()
    return out.withColumn("covered", F.coalesce(near, F.lit(False)).cast("int")).drop("_a_before", "_a_after")


def mark_normal(
    df: DataFrame,
    keys: Sequence[str],
    length: int,
    label: str | Sequence[str] = "is_anomaly",
    idx: str = "idx",
    n: str = "n",
    span: int = SPAN,
) -> DataFrame:
    """Add `normal` = 1 on rows not covered by an anomaly of their own split.

    `label` is a column or a list of columns, of which any can mark an anomaly. Without the column, or where one of the list is missing,
    all rows are normal.
    """
    if not label_present(df, label):
        return df.withColumn("normal", F.lit(1))
    names = [label] if isinstance(label, str) else list(label)
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.col(c) == 1, F.lit(False))
    parts = ("train", "val")
    out = nearest_marks(df, keys, idx, {f"_{s}": hit & (F.col("split") == s) for s in parts}, length - 1, span)
    near = F.when(F.col("split") == "train", F.coalesce("_train_before", "_train_after")).otherwise(F.coalesce("_val_before", "_val_after"))
    is_normal = (F.col(n) < length) | near.isNull()
    return out.withColumn("normal", is_normal.cast("int")).drop(*[f"_{s}_{side}" for s in parts for side in ("before", "after")])


def normal_rows(df: DataFrame, keys: Sequence[str], length: int, **names) -> DataFrame:
    """The rows `mark_normal` marks."""
    return mark_normal(df, keys, length, **names).where("normal = 1").drop("normal")


def scaler_fit_rows(normal: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of the normal training rows."""
    return normal.where(F.col("split") == "train").select(*features)


def extract_anomalous_rows(df: DataFrame, keys: Sequence[str], length: int, **names) -> tuple[DataFrame, DataFrame]:
    """(rows near anomalies, the rest)."""
    flagged = anomaly_covered_rows(df, keys, length, **names)
    return flagged.where("covered = 1").drop("covered"), flagged.where("covered = 0").drop("covered")


# ---------------------------------------------------------------- strides

def stride_step(length: int, overlap: float) -> int:
    """Step between starts inside a run."""
    return max(1, int(length * (1 - overlap)))


def global_step(length: int, overlap: float) -> int:
    """Step of the older rule, which ignores runs."""
    return max(1, length - int(length * overlap))


def run_stride(
    df: DataFrame,
    keys: Sequence[str],
    length: int,
    overlap: float,
    boundary: str = "strict",
    idx: str = "idx",
    n: str = "n",
    span: int = SPAN,
) -> DataFrame:
    """Every step-th position of each contiguous run of positions.

    `strict` keeps starts whose whole window lies in the run; `open` only asks for `idx <= n - length`.
    """
    step = stride_step(length, overlap)
    edges = framed(
        df,
        keys,
        idx,
        {"_prev": (F.max(F.col(idx)), -1, -1), "_foll": (F.max(F.col(idx)), 1, 1)},
        span,
        keep_bucket=True,
    )
    runs = running(
        edges,
        keys,
        [F.col(idx)],
        {
            "run_start": Running("max", F.when(F.col("_prev").isNull(), F.col(idx))),
            "run_end": Running("min", F.when(F.col("_foll").isNull(), F.col(idx)), backward=True),
        },
    ).drop("_prev", "_foll")
    last = F.col("run_end") if boundary == "strict" else F.col(n) - 1
    return runs.where(
        ((F.col(idx) - F.col("run_start")) % step == 0) & (F.col(idx) + F.lit(length - 1) <= last)
    )


def global_stride(
    df: DataFrame, keys: Sequence[str], length: int, overlap: float, idx: str = "idx", span: int = SPAN
) -> DataFrame:
    """Every step-th of the sorted positions, ignoring gaps."""
    step = global_step(length, overlap)
    ranked = running(
        bucket_by_index(df, idx, span), keys, [F.col(idx)], {"_r": Running("count", F.lit(1), exclusive=True)}
    )
    return ranked.where(F.col("_r") % step == 0).drop("_r")


# ---------------------------------------------------------------- orders, sets, samples

def shuffle_order(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int = 42, name: str = "ord") -> DataFrame:
    """Explicit 1-based random order per key, the same for any partitioning."""
    return digest_rank(df, keys, hashing.digest(seed, "shuffle", *keys, *ids), ids, name).drop(f"{name}_n")


def set_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Positions of `a` that are not in `b`."""
    return a.select(*on).distinct().join(b.select(*on).distinct(), list(on), "left_anti")


def set_intersect(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Positions in both."""
    return a.select(*on).distinct().intersect(b.select(*on).distinct())


def set_union(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Positions in either."""
    return a.select(*on).union(b.select(*on)).distinct()


def _hash_cut(k: int, n: int) -> int:
    """Under this head of a digest lie `k` of `n` rows and some to spare, but for a few in 10^9 cases."""
    return int(min(1.0, (k + 6 * k**0.5 + 20) / max(1, n)) * 2**32)


def take_ranked(df: DataFrame, ids: Sequence[str], k: Column | int, seed: int, purpose: str) -> DataFrame:
    """Seeded sample without replacement: the first `k` rows in random order, with `rank`; `k` may use `rank_n`, the row count.

    Only ids are ordered, and only those whose hash is below a cut: from the count it is set where about `k` rows lie below it and some
    to spare, and raised until `k` do. Of the rows with their other columns, too, only those below the cut meet the chosen ids; rows
    that share ids go together.
    """
    spark = df.sparkSession
    digest = hashing.digest(seed, purpose, *ids)
    known = stage(df.select(*ids), "ids")
    n = known.count()
    wanted = k if isinstance(k, int) else spark.range(1).select(F.lit(n).cast("long").alias("rank_n")).select(k.cast("long").alias("k")).first()["k"]
    wanted = max(0, min(wanted or 0, n))
    cut = _hash_cut(wanted, n)
    while True:
        below = hashing.head32(digest) < F.lit(cut)
        low = known.where(below)
        if cut >= 2**32 or low.count() >= wanted:
            break
        cut = min(2**32, 2 * cut)
    ranked = digest_rank(low, [], digest, ids, below=cut).where(F.col("rank") <= wanted)
    chosen = ranked.groupBy(null_safe(ids).alias("_k")).agg(F.min("rank").alias("rank"))
    return df.where(below).withColumn("_k", null_safe(ids)).join(chosen, "_k").drop("_k")


def balance_ratio(
    df: DataFrame, ids: Sequence[str], label: str, ratio: float, seed: int = 42, anomalies_only: bool = False
) -> DataFrame:
    """Trim normals (label 0) and anomalies (label 1) to `ratio` normals per anomaly; see the branch comments.

    The rows are written once. A class that stays whole is not ordered, and of one that is trimmed only the rows whose hash is below
    a cut that its size gives, so what is shuffled follows the rows that stay.
    """
    if anomalies_only:
        return df.where(F.col(label) == 1)
    rows = stage(df, "balance")
    normal, anomalous = F.col(label).eqNullSafe(0), F.col(label).eqNullSafe(1)
    digest = hashing.digest(seed, "balance", *ids)
    normals, anomalies = rows.agg(F.count_if(normal), F.count_if(anomalous)).first()
    if ratio == 1:
        keep_a = keep_n = min(normals, anomalies)
    else:
        wanted, fallback = int(normals / float(ratio)), int(anomalies * float(ratio))
        if ratio < 1:
            fallback = max(1, fallback)
        enough = anomalies >= wanted
        keep_a = wanted if enough else anomalies
        keep_n = normals if enough else fallback
    whole = F.lit(False)
    if keep_a >= anomalies:
        whole = whole | anomalous
    if keep_n >= normals:
        whole = whole | normal
    cuts = [_hash_cut(keep_a, anomalies), _hash_cut(keep_n, normals)]
    while True:
        # a label that is neither is ranked in full, as one of a class of its own
        cut = F.when(anomalous, F.lit(cuts[0])).when(normal, F.lit(cuts[1])).otherwise(F.lit(1 << 32))
        low = rows.where(~whole & (hashing.head32(digest) < cut))
        held = low.agg(F.count_if(anomalous), F.count_if(normal)).first()
        short = [h < min(k, n) < n for h, k, n in zip(held, (keep_a, keep_n), (anomalies, normals), strict=True)]
        if not any(short):
            break
        cuts = [min(1 << 32, 2 * c) if s else c for c, s in zip(cuts, short, strict=True)]
    ranked = digest_rank(low, [label], digest, ids, below=cut)
    trimmed = ranked.where(F.when(F.col(label) == 1, F.col("rank") <= keep_a).otherwise(F.col("rank") <= keep_n))
    return trimmed.drop("rank", "rank_n").unionByName(rows.where(whole))


def sample_normals(
    normals: DataFrame, anomalies: DataFrame, ids: Sequence[str], ratio: float = 1.0, seed: int = 42
) -> DataFrame:
    """Seeded sample of `min(int(N_anomalous * ratio), N_normal)` normal windows."""
    wanted = int(anomalies.count() * float(ratio))
    return take_ranked(normals, ids, wanted, seed, "normals").drop("rank")
