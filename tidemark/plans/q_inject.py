"""Queries: synthetic anomalies and evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, inject, joins, scale, windows
from tidemark.plans import views as v
from tidemark.plans.registry import joined, query, r
from tidemark.sources.stage import stage

_RANK = """row_number() OVER (ORDER BY md5(concat_ws('|', '123', 'pick', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx)"""


@query("pick_windows", v.sql(f"""
    SELECT series_id, start_idx, rank FROM (SELECT *, {_RANK} AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT series_id, start_idx FROM wl))
    WHERE rank <= trunc(total * 0.3::DOUBLE)""", "wl"))
def pick_windows(spark, sf):
    return inject.pick_windows(v.user_windows(spark, sf).select(*v.WIN), v.WIN, 0.3, v.INJECT_SEED)


@query("pick_type_channel", v.sql(f"""
    SELECT series_id, start_idx, ['gwn', 'step', 'impulse'][1 + floor({v.u_sql('type', 'series_id', 'start_idx')} * 3)::INTEGER] AS anomaly_type,
           ['value', 'gap_s'][1 + floor({v.u_sql('channel', 'series_id', 'start_idx')} * 2)::INTEGER] AS channel
    FROM (SELECT DISTINCT series_id, start_idx FROM wl)""", "wl"))
def pick_type_channel(spark, sf):
    starts = v.user_windows(spark, sf).select(*v.WIN)
    return inject.pick_type_channel(starts, v.WIN, inject.known_types(["gwn", "step", "clipping", "impulse"], "warn"), v.CH, ["value", "gap_s"], v.INJECT_SEED)


@query("injector_fit", v.sql("""
    SELECT 'value' AS channel, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS steps FROM wl
    UNION ALL SELECT 'k', round(avg(k), 4), round(stddev_pop(k), 4), count(*) FROM wl
    UNION ALL SELECT 'gap_s', round(avg(gap_s), 4), round(stddev_pop(gap_s), 4), count(*) FROM wl""", "wl"))
def injector_fit(spark, sf):
    out = inject.injector_fit(v.user_windows(spark, sf), v.CH)
    return out.select("channel", r("mean", 4).alias("mean"), r("std", 4).alias("std"), "steps")


def _target(prefix=""):
    return F.coalesce(*[F.when(F.col("channel") == c, F.col(prefix + c)) for c in v.CH])


def _injected(kind):
    def run(spark, sf):
        out = v.corrupted_windows(spark, sf, [kind]).withColumn("x", _target())
        long = windows.explode_positions(out, [*v.WIN, "channel"], ["x"], ["labels"])
        return long.select(*v.WIN, "channel", F.col("pos").cast("long").alias("pos"), r("x").alias("x"), F.col("labels").alias("label"))

    return run


for _kind in ("gwn", "constant", "step", "impulse", "narrowband"):
    query(f"inject_{_kind}", v.sql(f"SELECT series_id, start_idx, channel, pos, round(x, 6) AS x, label FROM cz_{_kind}", f"cz_{_kind}"))(_injected(_kind))

query("inject_subspace")(_injected("subspace"))


@query("change_mask", v.sql("""
    SELECT series_id, start_idx, string_agg(label::VARCHAR, ',' ORDER BY pos) AS labels FROM cz GROUP BY series_id, start_idx""", "cz"))
def change_mask(spark, sf):
    good = v.scaled_windows(spark, sf)
    pairs = joins.join_pairs(v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good).drop("labels"), good.drop("labels"), v.WIN)
    mask = inject.change_mask(_target("clean_"), _target())
    return pairs.select(*v.WIN, joined(mask, 1).alias("labels"))


@query("keep_normal_values", v.sql("""
    SELECT series_id, start_idx, pos, round(CASE WHEN c.label = 1 THEN c.x * s.sv + s.mv ELSE w.value END, 4) AS value
    FROM cz c JOIN wl w USING (series_id, start_idx, pos), (SELECT avg(value) mv, stddev_pop(value) sv FROM wc) s
    WHERE c.channel = 'value'""", "cz"))
def keep_normal_values(spark, sf):
    """Corrupted windows back in original units; untouched steps carry the original values."""
    every = stage(v.user_windows(spark, sf), "windows")
    good = clean.filter_windows_by_label(every, anomalous=False)
    fitted = scale.standard_fit(windows.explode_positions(good, [], v.CH), v.CH)
    bad = v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=scale.scale_windows(good, fitted, v.CH)).where("channel = 'value'")
    back = scale.scale_windows(bad, fitted, v.CH, inverse=True)
    pairs = joins.join_pairs(back, good.select(*v.WIN, "value"), v.WIN)
    kept = pairs.withColumn("value", inject.keep_normal_values(F.col("value"), F.col("clean_value"), F.col("labels")))
    long = windows.explode_positions(kept, v.WIN, ["value"])
    return long.select(*v.WIN, F.col("pos").cast("long").alias("pos"), r("value", 4).alias("value"))


@query("really_changed", v.sql("SELECT series_id, start_idx, max(rank) AS rank FROM cz GROUP BY series_id, start_idx HAVING max(label) = 1", "cz"))
def really_changed(spark, sf):
    return inject.really_changed(v.corrupted_windows(spark, sf, list(v.MIXED))).select(*v.WIN, "rank")


_CLEAN_SQL = "SELECT series_id, start_idx, 'clean' AS kind, 'normal' AS anomaly_type, 'none' AS channel, 0 AS ones, round(sum(value), 5) AS total FROM wz GROUP BY series_id, start_idx"
_BAD_SQL = """SELECT series_id, start_idx, 'corrupted' AS kind, max(c.anomaly_type) AS anomaly_type, max(c.channel) AS channel, sum(c.label) AS ones,
    round(sum(CASE WHEN c.channel = 'value' THEN c.x ELSE w.value END), 5) AS total
    FROM cz c JOIN wz w USING (series_id, start_idx, pos) GROUP BY series_id, start_idx HAVING max(c.label) = 1"""


def _summary(sets):
    ones = F.aggregate("labels", F.lit(0).cast("long"), lambda a, y: a + y)
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return sets.select(*v.WIN, "kind", "anomaly_type", "channel", ones.alias("ones"), r(total, 5).alias("total"))


@query("clean_plus_corrupted", v.sql(f"SELECT series_id, start_idx, kind, anomaly_type, channel, CAST(ones AS BIGINT) AS ones, total FROM ({_CLEAN_SQL} UNION ALL {_BAD_SQL})", "cz"))
def clean_plus_corrupted(spark, sf):
    good = v.scaled_windows(spark, sf)
    bad = v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good)
    return _summary(inject.clean_plus_corrupted(good, bad, v.L))


@query("corruption_map", v.sql("SELECT series_id, start_idx, max(rank) AS corrupted_rank FROM cz GROUP BY series_id, start_idx HAVING max(label) = 1", "cz"))
def corruption_map(spark, sf):
    return inject.corruption_map(v.corrupted_windows(spark, sf, list(v.MIXED)), v.WIN)


@query("original_anomaly_set", v.sql("""
    SELECT series_id, start_idx, CASE WHEN max(label) = 1 THEN 'original' ELSE 'clean' END AS kind,
           CASE WHEN max(label) = 1 THEN 'original' ELSE 'normal' END AS anomaly_type,
           CASE WHEN max(label) = 1 THEN 'unknown' ELSE 'none' END AS channel, round(sum(label) / 16.0::DOUBLE, 6) AS density
    FROM az GROUP BY series_id, start_idx""", "az"))
def original_anomaly_set(spark, sf):
    every = v.scaled_windows(spark, sf, clean_only=False)
    out = inject.original_anomaly_set(
        clean.filter_windows_by_label(every, anomalous=False), clean.filter_windows_by_label(every), v.L
    )
    return out.select(*v.WIN, "kind", "anomaly_type", "channel", r("density").alias("density"))


@query("evaluation_set_both", v.sql(f"""
    SELECT kind, count(*) AS windows, CAST(sum(ones) AS BIGINT) AS ones FROM (
      SELECT series_id, start_idx, CASE WHEN max(label) = 1 THEN 'original' ELSE 'clean' END AS kind, sum(label) AS ones FROM az GROUP BY series_id, start_idx
      UNION ALL SELECT series_id, start_idx, kind, ones FROM ({_BAD_SQL})) GROUP BY kind""", "az", "cz"))
def evaluation_set_both(spark, sf):
    every = v.scaled_windows(spark, sf, clean_only=False)
    good = clean.filter_windows_by_label(every, anomalous=False)
    bad = v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good)
    both = inject.evaluation_set("both", good, bad, clean.filter_windows_by_label(every), v.L)
    ones = F.aggregate("labels", F.lit(0).cast("long"), lambda a, y: a + y)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("windows"), F.sum(ones).alias("ones"))


@query("injection_stats", v.sql(f"""
    SELECT anomaly_type, count(*) AS windows, count(*) FILTER (ones > 0) AS anomalous_windows, CAST(sum(ones) AS BIGINT) AS anomalous_steps,
           round(sum(ones) / (count(*) * 16.0::DOUBLE), 6) AS share FROM ({_CLEAN_SQL} UNION ALL {_BAD_SQL}) GROUP BY anomaly_type""", "cz"))
def injection_stats(spark, sf):
    good = v.scaled_windows(spark, sf)
    bad = v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good)
    stats = inject.injection_stats(inject.clean_plus_corrupted(good, bad, v.L), "anomaly_type")
    return stats.withColumn("share", r("share"))


@query("injection_stats_channel", v.sql(f"SELECT channel, count(*) AS windows, CAST(sum(ones) AS BIGINT) AS anomalous_steps FROM ({_BAD_SQL}) GROUP BY channel", "cz"))
def injection_stats_channel(spark, sf):
    bad = inject.really_changed(v.corrupted_windows(spark, sf, list(v.MIXED)))
    return inject.injection_stats(bad, "channel").select("channel", "windows", "anomalous_steps")


@query("check_untouched", v.sql("""
    SELECT channel, count(*) AS pairs, 0.0::DOUBLE AS max_other_change, count(*) AS one_channel_pairs
    FROM (SELECT series_id, start_idx, max(channel) AS channel FROM cz GROUP BY series_id, start_idx HAVING max(label) = 1) GROUP BY channel""", "cz"))
def check_untouched(spark, sf):
    good = v.scaled_windows(spark, sf)
    bad = inject.really_changed(v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good))
    return inject.check_untouched(joins.join_pairs(bad, good.drop("labels"), v.WIN), v.CH)


@query("join_pairs", v.sql("""
    SELECT c.series_id, c.start_idx, c.channel, round(sum(c.x - c.z), 5) AS moved FROM cz c GROUP BY ALL""", "cz"))
def join_pairs(spark, sf):
    good = v.scaled_windows(spark, sf)
    pairs = joins.join_pairs(v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good), good.drop("labels"), v.WIN)
    moved = F.aggregate(F.zip_with(_target(), _target("clean_"), lambda a, b: a - b), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select(*v.WIN, "channel", r(moved, 5).alias("moved"))


def _label_runs_sql(series: str) -> str:
    """Runs of 8 to 64 over a tenth of each series with `n` rows in `series` (columns series_id, n)."""
    u = lambda purpose: v.u_sql(purpose, "series_id", "run", seed=42)
    return f"""
    SELECT series_id, run, g + coalesce(sum(length + 1) OVER (PARTITION BY series_id ORDER BY g, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length
    FROM (
      SELECT *, 8 + x + least(greatest(t - m * 8 - total - more, 0), 56 - x) - least(greatest(total - t + m * 8 - less, 0), x) AS length FROM (
        SELECT *, sum(x) OVER (PARTITION BY series_id) AS total, coalesce(sum(56 - x) OVER o, 0) AS more, coalesce(sum(x) OVER o, 0) AS less FROM (
          SELECT *, floor({u('len')} * 57)::BIGINT AS x, floor({u('gap')} * (n - t - m + 2))::BIGINT AS g, md5(concat_ws('|', '42', 'fill', series_id::VARCHAR, run::VARCHAR)) AS d
          FROM (SELECT *, unnest(range(0, m)) AS run FROM (
            SELECT *, least(greatest(round(t / 36.0::DOUBLE)::BIGINT, ceil(t / 64.0::DOUBLE)::BIGINT), t // 8, n - t + 1) AS m
            FROM (SELECT series_id, n, trunc(n * 0.1::DOUBLE)::BIGINT AS t FROM ({series})) WHERE t = 0 OR ceil(t / 64.0::DOUBLE) <= least(t // 8, n - t + 1))))
        WINDOW o AS (PARTITION BY series_id ORDER BY d, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query("random_label_runs", v.sql(f"""
    SELECT idx, CAST(r.series_id IS NOT NULL AS INTEGER) AS label
    FROM sl LEFT JOIN ({_label_runs_sql('SELECT DISTINCT series_id, n FROM sl')}) r ON sl.idx >= r.start AND sl.idx < r.start + r.length""", "sl"))
def random_label_runs(spark, sf):
    rows = v.series(spark, sf, long=True, staged=True)
    return inject.random_label_runs(rows, v.KEY, 0.1, 8, 64, v.SPLIT_SEED).select("idx", "label")


@query("random_label_runs_series", v.sql(_label_runs_sql("SELECT series_id, n FROM su GROUP BY ALL"), "su"))
def random_label_runs_series(spark, sf):
    """Runs for every user; series too short for a run of the least length get none."""
    sizes = v.keyed(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return inject.label_runs(sizes, v.KEY, 0.1, 8, 64, v.SPLIT_SEED, on_impossible="none")
