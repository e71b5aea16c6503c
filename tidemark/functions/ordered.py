"""Ordered computation without a one-task sort.

A plain `Window.partitionBy(series).orderBy(ts)` puts a whole series in one task, which fails when one series holds a
large share of the rows. Here every ordered step works on bounded pieces:

* `bucket_by_value`, `bucket_by_index`, `bucket_by_digest` cut the order into buckets of about equal row count;
* `running` computes running aggregates inside each bucket and adds the total of the earlier buckets, taken from a small
  table with one row per (key, bucket); `running_by_value` cuts only the keys that hold many rows;
* `with_halo` copies the rows near a bucket border into the neighbour, so fixed-size frames are exact at borders;
* `exact_quantiles` is a running count over distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashing
from tidemark.session import shuffle_width
from tidemark.sources.stage import stage

SAMPLE_PER_BUCKET = 64
GROUP = 1 << 12  # bucket numbers whose totals are ordered in one piece
SPAN = 1 << 14  # positions per bucket: halos stay under a percent, bucket totals stay few


# ---------------------------------------------------------------- buckets

def double_array(values: Sequence[float]) -> Column:
    """A constant array of doubles; one literal, however long."""
    if len(values) == 0:
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def orderable(df: DataFrame, col: str) -> Column:
    """The column in the type it is compared in: numbers and times as double, anything else as text."""
    kind = df.schema[col].dataType
    number = isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
    if isinstance(kind, T.TimestampNTZType):
        return F.col(col).cast("timestamp").cast("double")
    return F.col(col).cast("double") if number else F.col(col).cast("string")


def _cut_points(source: DataFrame, cols: Sequence[str], buckets: int) -> list[Column]:
    """Per column an array of ascending cut values, at most `buckets - 1`.

    They come from `SAMPLE_PER_BUCKET` random rows per bucket, found in one pass and fetched once, so every branch of the plan
    sees the same ones. The sample is of rows, so it does not matter how often a value repeats; it only decides where to cut.
    """
    values = [orderable(source, c).alias(f"v{i}") for i, c in enumerate(cols)]
    sample = source.select(*values, F.rand(42).alias("h")).orderBy("h").limit(buckets * SAMPLE_PER_BUCKET).collect()
    found = []
    for i in range(len(cols)):
        known = sorted(r[i] for r in sample if r[i] is not None and r[i] == r[i])
        cuts = [known[(k + 1) * len(known) // buckets] for k in range(buckets - 1)] if known else []
        found.append(F.array(*[F.lit(x) for x in cuts]) if cuts and isinstance(cuts[0], str) else double_array(cuts))
    return found


def count_cuts(cuts: Column, value: Column, n_cuts: int, inclusive: bool) -> Column:
    """How many cuts are <= value (or < value): binary search by descending powers of two."""
    steps, s = [], 1
    while s <= n_cuts:
        steps.insert(0, s)
        s *= 2

    def advance(acc: Column, step: Column) -> Column:
        probe = F.get(cuts, acc + step - 1)  # NULL past the end, which counts as no hit
        hit = probe <= value if inclusive else probe < value
        return F.when(hit, acc + step).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), advance)


def bucket_by_value(
    df: DataFrame,
    key: str,
    tie: str | None = None,
    *,
    descending: bool = False,
    buckets: int | None = None,
    name: str = "_b",
    cuts_from: DataFrame | None = None,
) -> DataFrame:
    """Add a bucket number that follows the order of (`key`, `tie`); buckets hold about equal row counts.

    A value so frequent that it covers whole buckets gets buckets of its own, cut further by `tie`. `cuts_from` may name
    a cheaper table with the same columns and a like distribution to take the cuts from.
    """
    source = df if cuts_from is None else cuts_from
    buckets = buckets or shuffle_width(df.sparkSession)
    n_cuts = buckets - 1
    value = orderable(df, key)
    cuts, *tie_cuts = _cut_points(source, [key, tie] if tie else [key], buckets)
    out = df
    upto = count_cuts(cuts, value, n_cuts, True)
    if tie is None:
        number = upto.cast("long")
    else:
        out = out.withColumn("_le", upto).withColumn("_lt", count_cuts(cuts, value, n_cuts, False))
        heavy = F.col("_le") - F.col("_lt") >= 2
        sub = F.when(heavy, count_cuts(tie_cuts[0], orderable(df, tie), n_cuts, True)).otherwise(0)
        number = F.when(heavy, F.col("_lt") + 1).otherwise(F.col("_le")).cast("long") * F.lit(buckets) + sub
    out = out.withColumn(name, -number if descending else number)
    return out.drop("_le", "_lt")


def bucket_by_index(df: DataFrame, idx: str, span: int = SPAN, name: str = "_b") -> DataFrame:
    """Bucket of a dense position: `span` rows each."""
    return df.withColumn(name, F.floor(F.col(idx) / F.lit(span)).cast("long"))


def bucket_by_digest(df: DataFrame, hexdigest: str, buckets: int | None = None, name: str = "_b", below: Column | int = 1 << 32) -> DataFrame:
    """Bucket of a hex digest in text order; digests are uniform, so equal width gives equal counts.

    Where only digests with a head under `below` are left, the buckets part that stretch.
    """
    buckets = buckets or shuffle_width(df.sparkSession)
    top = F.lit(below) if isinstance(below, int) else below
    return df.withColumn(name, F.floor(hashing.head32(F.col(hexdigest)) * F.lit(buckets) / top.cast("double")).cast("long"))


# ---------------------------------------------------------------- running aggregates

@dataclass(frozen=True)
class Running:
    """One running aggregate. `agg` is sum, count, min or max; `exclusive` leaves the current row out."""

    agg: str
    value: Column
    exclusive: bool = False
    backward: bool = False


_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _merge(agg: str, a: Column, b: Column) -> Column:
    if agg in ("sum", "count"):
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    pick = F.least if agg == "min" else F.greatest
    return pick(a, b)


def null_safe(keys: Sequence[str]) -> Column:
    """The keys as one struct: it is never null itself and joins by equality where a key is null."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k"))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    specs: dict[str, Running],
    totals: dict[str, tuple[str, Column]] | None = None,
    bucket: str = "_b",
) -> DataFrame:
    """Running aggregates of each key in `order`, and aggregates over the whole key (`totals`), exact over all buckets.

    `order` is ascending and `bucket` must follow it. Rows move once, by (key, bucket); the table of earlier totals has
    one row per (key, bucket), and is summed up in groups of `GROUP` buckets and over the groups, so no task orders all of a
    key's. Backward aggregates run over the reversed order, since a frame that reaches from the current row to the end is
    recomputed for every row. `bucket` is dropped from the result.
    """
    totals = totals or {}
    columns = [c for c in df.columns if c != bucket]
    df = df.withColumn("_k", null_safe(keys))
    per_bucket = df.groupBy("_k", bucket).agg(
        *[_AGG[s.agg](s.value).alias(f"_p_{n}") for n, s in specs.items()],
        *[_AGG[a](v).alias(f"_t_{n}") for n, (a, v) in totals.items()],
    )
    again = {"count": F.sum}
    per_bucket = per_bucket.withColumn("_s", F.floor(F.col(bucket) / F.lit(GROUP)).cast("long"))
    per_group = per_bucket.groupBy("_k", "_s").agg(
        *[again.get(s.agg, _AGG[s.agg])(f"_p_{n}").alias(f"_p_{n}") for n, s in specs.items()],
        *[again.get(a, _AGG[a])(f"_t_{n}").alias(f"_t_{n}") for n, (a, _) in totals.items()],
    )

    def earlier(parts: list[str], by: str, s: Running, n: str) -> Column:
        order = F.col(by).desc() if s.backward else F.col(by).asc()
        return again.get(s.agg, _AGG[s.agg])(f"_p_{n}").over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    whole = Window.partitionBy("_k")
    groups = per_group.select(
        "_k", "_s", *[earlier(["_k"], "_s", s, n).alias(f"_g_{n}") for n, s in specs.items()],
        *[again.get(a, _AGG[a])(f"_t_{n}").over(whole).alias(n) for n, (a, _) in totals.items()],
    )
    inside = per_bucket.select("_k", "_s", bucket, *[earlier(["_k", "_s"], bucket, s, n).alias(f"_i_{n}") for n, s in specs.items()])
    offsets = inside.join(groups, ["_k", "_s"]).select(
        "_k", bucket, *[_merge(s.agg, F.col(f"_g_{n}"), F.col(f"_i_{n}")).alias(f"_o_{n}") for n, s in specs.items()], *totals
    )

    def local(s: Running) -> Column:
        way = [c.desc() if s.backward else c.asc() for c in order]
        inside = Window.partitionBy("_k", bucket).orderBy(*way)
        return _AGG[s.agg](s.value).over(inside.rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0))

    rows = df.select("*", *[local(s).alias(f"_l_{n}") for n, s in specs.items()])
    joined = rows.join(offsets, ["_k", bucket], "left")
    return joined.select(
        *[F.col(c) for c in columns],
        *[_merge(s.agg, F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n, s in specs.items()],
        *totals,
    )


def running_by_value(
    df: DataFrame,
    keys: Sequence[str],
    key: str,
    tie: str,
    specs: dict[str, Running],
    totals: dict[str, tuple[str, Column]] | None = None,
    span: int = SPAN,
) -> DataFrame:
    """`running` in the order of (`key`, `tie`), where only keys of more than `span` rows are cut in buckets.

    A key of few rows needs no table of earlier totals, which would have about as many rows as the data when many short series
    meet many buckets; it is ordered in one piece.
    """
    totals = totals or {}
    sizes = df.groupBy(null_safe(keys).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    hot = stage(sizes.where(F.col("_n") > span).select("_k"), "hot")  # (rows) / span at most
    order = [F.col(key), F.col(tie)]
    if hot.isEmpty():
        return _running_whole(df, keys, order, specs, totals)
    keyed = df.withColumn("_k", null_safe(keys))
    long = keyed.join(F.broadcast(hot), "_k", "left_semi").drop("_k")
    cut = running(bucket_by_value(long, key, tie), keys, order, specs, totals)
    return cut.unionByName(_running_whole(keyed.join(F.broadcast(hot), "_k", "left_anti").drop("_k"), keys, order, specs, totals))


def _running_whole(df: DataFrame, keys: Sequence[str], order: Sequence[Column], specs: dict[str, Running], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """What `running` gives, for keys that fit a task."""
    parts = Window.partitionBy("_k")

    def local(s: Running) -> Column:
        way = parts.orderBy(*[c.desc() if s.backward else c.asc() for c in order])
        value = _AGG[s.agg](s.value).over(way.rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0))
        return F.coalesce(value, F.lit(0)) if s.agg in ("sum", "count") else value

    found = [*[local(s).alias(n) for n, s in specs.items()], *[_AGG[a](v).over(parts).alias(n) for n, (a, v) in totals.items()]]
    return df.withColumn("_k", null_safe(keys)).select(*[F.col(c) for c in df.columns], *found)


def digest_rank(
    df: DataFrame, keys: Sequence[str], hexdigest: Column, ids: Sequence[str], name: str = "rank", below: Column | int = 1 << 32
) -> DataFrame:
    """1-based rank of the rows of each key in the random order of `hexdigest`; also the key's row count `<name>_n`."""
    hashed = bucket_by_digest(df.withColumn("_d", hexdigest), "_d", below=below)
    ranked = running(
        hashed,
        keys,
        [F.col("_d"), *[F.col(i) for i in ids]],
        {name: Running("count", F.lit(1))},
        {f"{name}_n": ("count", F.lit(1))},
    )
    return ranked.drop("_d")


# ---------------------------------------------------------------- frames

def with_halo(df: DataFrame, idx: str, back: int, ahead: int, span: int = SPAN) -> DataFrame:
    """Add `_b` (bucket of positions) and `_own`, copying rows into every bucket whose frames reach them.

    Frames of at most `back` positions before and `ahead` after, partitioned by (key, `_b`), are then exact on the rows
    with `_own`; drop the others afterwards. The copies are (back + ahead) / span of the rows.
    """
    span = max(span, back + ahead, 1)
    pos = F.col(idx)
    first = F.greatest(F.lit(0), F.floor((pos - F.lit(ahead)) / F.lit(span)))
    last = F.floor((pos + F.lit(back)) / F.lit(span))
    spread = df.withColumn("_b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return spread.withColumn("_own", F.col("_b") == F.floor(pos / F.lit(span)))


def framed(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    frames: dict[str, tuple[Column, int, int]],
    span: int = SPAN,
    keep_bucket: bool = False,
) -> DataFrame:
    """Add frame aggregates `name -> (aggregate, from, to)` over positions `from..to` around each row.

    Positions missing from `idx` stay missing: a frame only sees rows whose position lies inside it. `keep_bucket` leaves
    `_b` in place so that a following `running` over the same span needs no further shuffle.
    """
    back = max([0, *[-f for _, f, _ in frames.values()]])
    ahead = max([0, *[t for _, _, t in frames.values()]])
    haloed = with_halo(df, idx, back, ahead, span)
    w = Window.partitionBy(*keys, "_b").orderBy(idx)
    out = haloed.select("*", *[agg.over(w.rangeBetween(f, t)).alias(n) for n, (agg, f, t) in frames.items()])
    return out.where("_own").drop("_own", *([] if keep_bucket else ["_b"]))


def nearest_marks(
    df: DataFrame, keys: Sequence[str], idx: str, marks: dict[str, Column], reach: int, span: int = SPAN, keep_bucket: bool = False
) -> DataFrame:
    """Add `<name>_before` and `<name>_after`: the last marked position up to, and the first one from each row on, as far as `reach`.

    Both are running values of a bucket with `reach` rows of its neighbours, so the work of a row does not depend on `reach`. A
    position beyond `reach` is null.
    """
    haloed = with_halo(df, idx, reach, reach, span)
    parts = Window.partitionBy(*keys, "_b")
    up, down = (parts.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(idx).asc(), F.col(idx).desc()))
    at = {n: F.when(m, F.col(idx)) for n, m in marks.items()}
    out = haloed.select("*", *[F.max(c).over(up).alias(f"{n}_before") for n, c in at.items()])
    out = out.select("*", *[F.min(c).over(down).alias(f"{n}_after") for n, c in at.items()]).where("_own")
    near = {f"{n}_before": F.when(F.col(idx) - F.col(f"{n}_before") <= reach, F.col(f"{n}_before")) for n in marks}
    near |= {f"{n}_after": F.when(F.col(f"{n}_after") - F.col(idx) <= reach, F.col(f"{n}_after")) for n in marks}
    return out.withColumns(near).drop("_own", *([] if keep_bucket else ["_b"]))


def spread_join(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], idx: str, span: int = SPAN, how: str = "inner"
) -> DataFrame:
    """Join one `small` row per key to all rows of the key, without sending a hot key's rows to one task.

    `small` is first joined to the distinct (key, bucket of `idx`) pairs, then rows meet it on (key, bucket). A null key meets
    a null key.
    """
    keys = list(keys)
    cut = bucket_by_index(rows, idx, span).withColumn("_k", null_safe(keys))
    pairs = cut.select("_k", "_b").distinct().join(small.withColumn("_k", null_safe(keys)).drop(*keys), "_k", "inner")
    joined = cut.join(pairs, ["_k", "_b"], how)
    return joined.select(*rows.columns, *[c for c in small.columns if c not in keys])


# ---------------------------------------------------------------- quantiles

def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], staged: bool = True, parts: dict[str, tuple[Column, Sequence[float]]] | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per (keys, p) with `q` and the count `n`, and what `q` lies between.

    Equal values collapse into one counted row first; the rank of each distinct value is a running count. `q` is
    `low + (high - low) * fraction` of two neighbours in the order. With `parts` (name -> condition, probs) there is one row per
    (keys, `part`, p) over the rows where the condition holds: all parts share one order, so overlapping ones do not copy rows.
    """
    keys = list(keys)
    found = parts or {"": (F.lit(True), probs)}
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        *[F.count_if(condition).alias(f"_c{i}") for i, (condition, _) in enumerate(found.values())]
    )
    if staged:
        counts = stage(counts, "quantile")
    ranked = running(
        bucket_by_value(counts, "_v"),
        keys,
        [F.col("_v")],
        {f"_u{i}": Running("sum", F.col(f"_c{i}")) for i in range(len(found))},
        {f"_n{i}": ("sum", F.col(f"_c{i}")) for i in range(len(found))},
    )

    def target(i: int, name: str, p: float) -> Column:
        rank = F.lit(float(p)) * (F.col(f"_n{i}") - 1)
        first, past = F.col(f"_u{i}") - F.col(f"_c{i}"), F.col(f"_u{i}")
        held = lambda at: (at >= first) & (at < past)
        return F.struct(
            F.lit(name).alias("part"), F.lit(float(p)).alias("p"), F.col(f"_n{i}").alias("n"), (rank - F.floor(rank)).alias("f"),
            held(F.floor(rank)).alias("lo"), held(F.ceil(rank)).alias("hi"),
        )

    targets = F.array(*[target(i, name, p) for i, (name, (_, some)) in enumerate(found.items()) for p in some])
    hits = ranked.select(*keys, "_v", F.explode(F.filter(targets, lambda t: t["lo"] | t["hi"])).alias("t"))
    ends = hits.groupBy(*keys, *([F.col("t.part").alias("part")] if parts else []), F.col("t.p").alias("p")).agg(
        F.max("t.n").alias("n"),
        F.max(F.when(F.col("t.lo"), F.col("_v"))).alias("low"),
        F.max(F.when(F.col("t.hi"), F.col("_v"))).alias("high"),
        F.max("t.f").alias("fraction"),
    )
    return ends.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * F.col("fraction"))
