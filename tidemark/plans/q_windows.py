"""Queries: windows, timelines and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import resample, split, windows
from tidemark.plans import views as v
from tidemark.plans.registry import joined, query, r
from tidemark.sources.stage import stage

_TEXT = lambda c, order="pos", scale=100: f"string_agg(CAST(round({c} * {scale}) AS BIGINT)::VARCHAR, ',' ORDER BY {order})"


@query("slide_windows", v.sql("""
    SELECT start_idx, array_to_string([CAST(round(x * 100) AS BIGINT) for x in vs], ',') AS value,
           array_to_string([CAST(round(x) AS BIGINT) for x in gs], ',') AS gap_s FROM (
      SELECT idx AS start_idx, list(value) OVER f AS vs, list(gap_s) OVER f AS gs FROM sl
      WINDOW f AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
    WHERE start_idx % 8 = 0 AND len(vs) = 16""", "sl"))
def slide_windows(spark, sf):
    rows = v.series(spark, sf, long=True)
    out = windows.slide_windows(rows, v.KEY, v.CH, v.L, F.col("idx") % 8 == 0)
    return out.select("start_idx", joined("value").alias("value"), joined("gap_s", 1).alias("gap_s"))


@query("slide_windows_splits", v.sql("""
    SELECT split, idx AS start_idx, vs AS total FROM (
      SELECT split, idx, round(sum(value) OVER f, 4) AS vs, max(idx) OVER f - idx AS reach, row_number() OVER g AS rk
      FROM nr WINDOW f AS (PARTITION BY split ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING), g AS (PARTITION BY split ORDER BY idx))
    WHERE reach = 15""", "nr"))
def slide_windows_splits(spark, sf):
    """Every complete window inside a run of normal rows, for both splits in one pass."""
    normal = stage(split.normal_rows(v.split_long(spark, sf), v.KEY, v.L), "normal")
    starts = split.run_stride(normal, ["series_id", "split"], v.L, 1 - 1 / v.L)
    marked = windows.mark_starts(normal, starts, ["series_id", "split"])
    out = windows.slide_windows(marked, ["series_id", "split"], ["value"], v.L, F.col("is_start"))
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return out.select("split", "start_idx", r(total, 4).alias("total"))


@query("whole_table_windows", v.sql(f"SELECT series_id, start_idx, {_TEXT('value')} AS value FROM wl GROUP BY series_id, start_idx", "wl"))
def whole_table_windows(spark, sf):
    out = windows.whole_table_windows(v.series(spark, sf), v.KEY, v.CH, v.L)
    return out.select(*v.WIN, joined("value").alias("value"))


@query("slide_windows_labelled", v.sql("SELECT series_id, start_idx, string_agg(is_anomaly::VARCHAR, ',' ORDER BY pos) AS labels, CAST(sum(is_anomaly) AS BIGINT) AS ones FROM wl GROUP BY series_id, start_idx", "wl"))
def slide_windows_labelled(spark, sf):
    ones = F.aggregate("labels", F.lit(0).cast("long"), lambda a, y: a + y)
    return v.user_windows(spark, sf).select(*v.WIN, joined("labels", 1).alias("labels"), ones.alias("ones"))


@query("clamp_tail", v.sql("SELECT DISTINCT series_id, least(idx, n - 16) AS start_idx FROM su WHERE idx % 10 = 0 AND n >= 16", "su"))
def clamp_tail(spark, sf):
    rows = v.series(spark, sf)
    starts = windows.clamp_starts(rows.where("idx % 10 = 0").select("series_id", "idx", "n"), v.KEY, v.L)
    return starts.withColumnRenamed("idx", "start_idx")


@query("clamp_tail_windows", v.sql("""
    SELECT w.series_id, w.start_idx, string_agg(CAST(round(s.value * 100) AS BIGINT)::VARCHAR, ',' ORDER BY s.idx) AS value
    FROM (SELECT DISTINCT series_id, least(idx, n - 16) AS start_idx FROM su WHERE idx % 10 = 0 AND n >= 16) w
    JOIN su s ON s.series_id = w.series_id AND s.idx BETWEEN w.start_idx AND w.start_idx + 15 GROUP BY w.series_id, w.start_idx""", "su"))
def clamp_tail_windows(spark, sf):
    rows = v.series(spark, sf, staged=True)
    starts = windows.clamp_starts(rows.where("idx % 10 = 0").select("series_id", "idx", "n"), v.KEY, v.L)
    out = windows.slide_windows(windows.mark_starts(rows, starts, v.KEY), v.KEY, ["value"], v.L, F.col("is_start"))
    return out.select(*v.WIN, joined("value").alias("value"))


@query("target_reconstruct", v.sql(f"""
    SELECT series_id, start_idx, {_TEXT('value')} AS x, string_agg(CAST(round(value * 100) AS BIGINT)::VARCHAR, ',' ORDER BY pos) FILTER (pos >= 12) AS y
    FROM wl GROUP BY series_id, start_idx""", "wl"))
def target_reconstruct(spark, sf):
    out = windows.target_reconstruct(v.user_windows(spark, sf), ["value"], 4)
    return out.select(*v.WIN, joined("value").alias("x"), joined("y_value").alias("y"))


@query("target_forecast", v.sql("""
    SELECT series_id, idx AS start_idx, array_to_string([CAST(round(x * 100) AS BIGINT) for x in ys], ',') AS y, lastx AS last_k FROM (
      SELECT series_id, idx, n, list(value) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 16 FOLLOWING AND 19 FOLLOWING) AS ys,
             lead(k, 15) OVER (PARTITION BY series_id ORDER BY idx) AS lastx FROM su)
    WHERE len(ys) = 4 AND idx % 4 = 0""", "su"))
def target_forecast(spark, sf):
    out = windows.slide_windows(
        v.series(spark, sf), v.KEY, ["k"], v.L, F.col("idx") % 4 == 0, ahead=4, target_channels=["value"]
    )
    return out.select(*v.WIN, joined("y_value").alias("y"), F.element_at("k", -1).alias("last_k"))


@query("infer_period", v.sql("""
    SELECT series_id, round(quantile_cont(d, 0.5), 3) AS period_us FROM (
      SELECT series_id, CAST(us - lag(us) OVER (PARTITION BY series_id ORDER BY idx) AS DOUBLE) AS d FROM su) WHERE d IS NOT NULL GROUP BY series_id""", "su"))
def infer_period(spark, sf):
    return windows.infer_period(v.series(spark, sf), v.KEY).select("series_id", r("period_us", 3).alias("period_us"))


@query("tumble_windows_wide", v.sql(f"""
    SELECT series_id, (us // 86400000000) * 86400000000 AS tile, {_TEXT('value', 'us, event_id')} AS value, {_TEXT('k', 'us, event_id', 1)} AS k
    FROM su GROUP BY series_id, tile HAVING count(*) = 4""", "su"))
def tumble_windows_wide(spark, sf):
    out = windows.tumble_windows_wide(v.keyed(spark, sf), v.KEY, ["value", "k"], 4, 6 * v.HOUR)
    return out.select("series_id", "tile", joined("value").alias("value"), joined("k", 1).alias("k"))


@query("tumble_windows_inferred", v.sql(f"""
    SELECT series_id, us // (4 * p) * (4 * p) AS tile, {_TEXT('value', 'us, event_id')} AS value FROM su JOIN (
      SELECT series_id, CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS p FROM (
        SELECT series_id, CAST(us - lag(us) OVER (PARTITION BY series_id ORDER BY idx) AS DOUBLE) AS d FROM su) WHERE d IS NOT NULL GROUP BY series_id)
      USING (series_id) GROUP BY series_id, tile HAVING count(*) = 4""", "su"))
def tumble_windows_inferred(spark, sf):
    """The period of each series is its median step."""
    out = windows.tumble_windows_wide(v.series(spark, sf, staged=True), v.KEY, ["value"], 4)
    return out.select("series_id", "tile", joined("value").alias("value"))


@query("tumble_windows_gaps", v.sql(f"""
    WITH w AS (SELECT series_id, (us // 86400000000) * 86400000000 AS tile, {_TEXT('value', 'us, event_id')} AS value
               FROM su GROUP BY series_id, tile HAVING count(*) = 4),
         e AS (SELECT series_id, min(tile) a, max(tile) z FROM w GROUP BY series_id),
         g AS (SELECT series_id, unnest(range(a, z + 1, 86400000000)) AS tile FROM e)
    SELECT g.series_id, g.tile, w.value FROM g LEFT JOIN w USING (series_id, tile)""".replace("WITH w AS", "SELECT * FROM (WITH w AS") + ")", "su"))
def tumble_windows_gaps(spark, sf):
    """Complete tumbling windows on a regular grid; tiles without one are shown as missing."""
    tiles = windows.tumble_windows_wide(v.keyed(spark, sf), v.KEY, ["value"], 4, 6 * v.HOUR).select(
        "series_id", "tile", joined("value").alias("value")
    )
    return resample.regular_grid(tiles, v.KEY, ["value"], 24 * v.HOUR, "tile")


@query("multi_length_windows", v.sql(f"""
    SELECT length, series_id, tile, {_TEXT('value', 'us, event_id')} AS value FROM (
      SELECT length, series_id, us, event_id, value, (us // (length * 21600000000)) * (length * 21600000000) AS tile
      FROM su, (VALUES (2), (3), (4)) t(length)) GROUP BY length, series_id, tile HAVING count(*) = length""", "su"))
def multi_length_windows(spark, sf):
    out = windows.multi_length_windows(v.keyed(spark, sf), v.KEY, ["value"], [2, 3, 4], 6 * v.HOUR)
    return out.select("length", "series_id", "tile", joined("value").alias("value"))


@query("transpose_window", """
    SELECT vec_id, f AS channel, string_agg(CAST(round(embedding[p * 8 + f + 1]::DOUBLE * 1000000) AS BIGINT)::VARCHAR, ',' ORDER BY p) AS x
    FROM embeddings, range(0, 8) a(f), range(0, 8) b(p) GROUP BY vec_id, f""")
def transpose_window(spark, sf):
    wide = v.vectors(spark, sf)
    flipped = windows.transpose_window(windows.as_matrix([f"c{c}" for c in range(8)]), 8)
    long = wide.select("vec_id", F.posexplode(flipped).alias("channel", "x"))
    return long.select("vec_id", F.col("channel").cast("long").alias("channel"), joined("x", 1e6).alias("x"))


@query("concat_windows_sets", v.sql("""
    SELECT kind, series_id, start_idx, CASE WHEN kind = 'user' THEN ones END AS ones, CASE WHEN kind = 'user' THEN 1 ELSE 0 END AS known FROM (
      SELECT 'user' AS kind, series_id, start_idx, CAST(sum(is_anomaly) AS BIGINT) AS ones FROM wl GROUP BY series_id, start_idx
      UNION ALL SELECT 'long', 0, idx, 0 FROM sl WHERE idx % 16 = 0 AND idx + 16 <= n)""", "wl", "sl"))
def concat_windows_sets(spark, sf):
    a = v.user_windows(spark, sf).withColumn("kind", F.lit("user"))
    b = windows.whole_table_windows(v.series(spark, sf, long=True), v.KEY, v.CH, v.L).withColumn("kind", F.lit("long"))
    both = windows.concat_windows_sets(a, b)
    ones = F.aggregate("labels", F.lit(0).cast("long"), lambda acc, y: acc + y)
    return both.select("kind", *v.WIN, ones.alias("ones"), F.col("labels").isNotNull().cast("int").alias("known"))


_RANKED = "SELECT *, (dense_rank() OVER (ORDER BY series_id, start_idx) - 1) AS rank FROM wl"


@query("windows_to_timeline", v.sql(f"SELECT t, round(value, 6) AS value, k FROM (SELECT rank * 16 + pos AS t, value, k FROM ({_RANKED}))", "wl"))
def windows_to_timeline(spark, sf):
    ranked = windows.window_rank(v.user_windows(spark, sf))
    return windows.windows_to_timeline(ranked, v.L, ["value", "k"]).select("t", r("value").alias("value"), "k")


@query("timeline_blocks", v.sql(f"""
    SELECT t // 800 AS block, count(*) AS steps, min(t) AS first_t, max(t) AS last_t, round(sum(value), 4) AS total
    FROM (SELECT rank * 16 + pos AS t, value FROM ({_RANKED})) GROUP BY block""", "wl"))
def timeline_blocks(spark, sf):
    ranked = windows.window_rank(v.user_windows(spark, sf))
    blocks = windows.timeline_blocks(windows.windows_to_timeline(ranked, v.L, ["value"]), v.L, 50)
    return blocks.groupBy("block").agg(
        F.count(F.lit(1)).alias("steps"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), r(F.sum("value"), 4).alias("total")
    )


@query("window_stats", v.sql("SELECT count(*) // 16 AS windows, 16 AS length, 3 AS channels, 1 AS has_labels, count(*) * 24 AS bytes FROM wl", "wl"))
def window_stats(spark, sf):
    return windows.window_stats(v.user_windows(spark, sf), v.CH)


# ---------------------------------------------------------------- resampling

_ENDS = "SELECT series_id, idx, us, value, k, n, min(us) OVER p AS x0, max(us) OVER p AS xn FROM su WINDOW p AS (PARTITION BY series_id)"
_POINTS = f"""SELECT series_id, n, idx * 4 + j AS g, x0 + (idx * 4 + j)::DOUBLE * (xn - x0)::DOUBLE / greatest((n - 1) * 4, 1)::DOUBLE AS x
    FROM ({_ENDS}), range(0, 4) q(j) WHERE idx < n - 1 OR j = 0"""
_AROUND = """SELECT * FROM (SELECT series_id, idx, us::DOUBLE AS us, value, lag(us::DOUBLE) OVER o AS xp, lag(value) OVER o AS vp,
    lead(us::DOUBLE) OVER o AS x1, lead(value) OVER o AS v1, lead(us::DOUBLE, 2) OVER o AS x2, lead(value, 2) OVER o AS v2
    FROM su WINDOW o AS (PARTITION BY series_id ORDER BY idx)) WHERE x1 IS NULL OR x1 > us"""
_LINE = """CASE WHEN x1 IS NOT NULL THEN value + (v1 - value) * (x - us) / (x1 - us)
    WHEN xp < us THEN vp + (value - vp) * (x - xp) / (us - xp) ELSE value END"""


def _asof(expr: str) -> str:
    return v.sql(f"""
    SELECT p.series_id, p.g, round({expr}, 4) AS value
    FROM ({_POINTS}) p ASOF JOIN ({_AROUND}) a ON p.series_id = a.series_id AND p.x >= a.us""", "su")


@query("upsample_grid", v.sql(f"SELECT series_id, g, round(x, 1) AS x FROM ({_POINTS})", "su"))
def upsample_grid(spark, sf):
    return resample.upsample_grid(v.series(spark, sf, staged=True), v.KEY, 4).select("series_id", "g", r("x", 1).alias("x"))


def _upsampled(spark, sf, method):
    rows = v.series(spark, sf, staged=True)
    return resample.upsample(rows, v.KEY, ["value"], 4, method).select("series_id", "g", r("value", 4).alias("value"))


@query("upsample_linear", _asof(_LINE))
def upsample_linear(spark, sf):
    return _upsampled(spark, sf, "linear")


@query("upsample_previous", _asof("value"))
def upsample_previous(spark, sf):
    return _upsampled(spark, sf, "previous")


@query("upsample_step", _asof("CASE WHEN x1 IS NOT NULL AND x - us > x1 - x THEN v1 ELSE value END"))
def upsample_step(spark, sf):
    return _upsampled(spark, sf, "nearest")


@query("upsample_next", _asof("CASE WHEN x = us OR x1 IS NULL THEN value ELSE v1 END"))
def upsample_next(spark, sf):
    return _upsampled(spark, sf, "next")


@query("upsample_cubic_local", _asof(f"""CASE WHEN xp < us AND x1 < x2 AND n >= 4 THEN
    vp * (x - us) / (xp - us) * (x - x1) / (xp - x1) * (x - x2) / (xp - x2)
    + value * (x - xp) / (us - xp) * (x - x1) / (us - x1) * (x - x2) / (us - x2)
    + v1 * (x - xp) / (x1 - xp) * (x - us) / (x1 - us) * (x - x2) / (x1 - x2)
    + v2 * (x - xp) / (x2 - xp) * (x - us) / (x2 - us) * (x - x1) / (x2 - x1)
    ELSE {_LINE} END"""))
def upsample_cubic_local(spark, sf):
    return _upsampled(spark, sf, "cubic_local")


# the spline through a whole series: forward elimination and back substitution of its tridiagonal system, one sample a step
_SPLINE = """
    SELECT * FROM (WITH RECURSIVE d AS (
        SELECT series_id, idx, n, us::DOUBLE AS us, value AS y, (us - lag(us) OVER o)::DOUBLE AS hb, (lead(us) OVER o - us)::DOUBLE AS h,
               value - lag(value) OVER o AS db, lead(value) OVER o - value AS da
        FROM su WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
      e AS (
        SELECT series_id, idx, n, CASE WHEN idx = 1 THEN 0 WHEN idx = n - 2 THEN hb - h ELSE hb END AS a,
               CASE WHEN idx = 1 THEN 2 * h + hb WHEN idx = n - 2 THEN 2 * hb + h ELSE 2 * (hb + h) END AS b,
               CASE WHEN idx = 1 THEN h - hb WHEN idx = n - 2 THEN 0 ELSE h END AS c,
               6 * (da / h - db / hb) * CASE WHEN idx = 1 THEN h / (hb + h) WHEN idx = n - 2 THEN hb / (hb + h) ELSE 1 END AS q
        FROM d WHERE n >= 4 AND idx BETWEEN 1 AND n - 2),
      f AS (
        SELECT series_id, idx, n, c / b AS c, q / b AS q FROM e WHERE idx = 1 UNION ALL
        SELECT e.series_id, e.idx, e.n, e.c / (e.b - e.a * f.c), (e.q - e.a * f.q) / (e.b - e.a * f.c)
        FROM f JOIN e ON e.series_id = f.series_id AND e.idx = f.idx + 1),
      m AS (
        SELECT series_id, idx, q AS m FROM f WHERE idx = n - 2 UNION ALL
        SELECT f.series_id, f.idx, f.q - f.c * m.m FROM m JOIN f ON f.series_id = m.series_id AND f.idx = m.idx - 1),
      w AS (
        SELECT d.*, CASE WHEN idx = 0 THEN lead(m) OVER o - h / lead(h) OVER o * (lead(m, 2) OVER o - lead(m) OVER o)
                         WHEN idx = n - 1 THEN lag(m) OVER o + hb / lag(hb) OVER o * (lag(m) OVER o - lag(m, 2) OVER o) ELSE m END AS m
        FROM d LEFT JOIN m USING (series_id, idx) WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
      s AS (
        SELECT *, lead(us) OVER o AS u1, lead(y) OVER o AS y1, lead(m) OVER o AS m1 FROM w WINDOW o AS (PARTITION BY series_id ORDER BY idx))
    SELECT p.series_id, p.g, round(CASE WHEN u1 IS NULL THEN y WHEN s.n < 4 THEN y + (y1 - y) * (x - us) / h ELSE
             (y * (u1 - x) + y1 * (x - us)) / h + m * (u1 - x) / 6 * ((u1 - x) * (u1 - x) / h - h) + m1 * (x - us) / 6 * ((x - us) * (x - us) / h - h) END, 4) AS value
    FROM (%s) p ASOF JOIN s ON p.series_id = s.series_id AND p.x >= s.us)"""


@query("upsample_cubic", v.sql(_SPLINE % _POINTS, "su"))
def upsample_cubic(spark, sf):
    return _upsampled(spark, sf, "cubic")


def _without_key(rows):
    """The rows with one series in three merged under a null key."""
    return rows.withColumn("series_id", F.expr("CASE WHEN series_id % 3 <> 0 THEN series_id END"))


_NO_KEY = """(SELECT *, row_number() OVER (PARTITION BY s ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY s) AS m
    FROM (SELECT *, CASE WHEN series_id % 3 <> 0 THEN series_id END AS s FROM su))"""


@query("upsample_null_key", v.sql(f"""
    SELECT p.s AS series_id, p.g, round(CASE WHEN u1 IS NULL THEN a.value ELSE a.value + (v1 - a.value) * (x - a.us) / (u1 - a.us) END, 4) AS value
    FROM (SELECT s, coalesce(s, -1) AS k, m, i * 4 + j AS g, min(us) OVER w + (i * 4 + j)::DOUBLE * (max(us) OVER w - min(us) OVER w)::DOUBLE / greatest((m - 1) * 4, 1) AS x
          FROM {_NO_KEY}, range(0, 4) q(j) WHERE i < m - 1 OR j = 0 WINDOW w AS (PARTITION BY s)) p
    ASOF JOIN (SELECT coalesce(s, -1) AS k, us::DOUBLE AS us, value, lead(us::DOUBLE) OVER o AS u1, lead(value) OVER o AS v1
               FROM {_NO_KEY} WINDOW o AS (PARTITION BY s ORDER BY i)) a ON p.k = a.k AND p.x >= a.us""", "su"))
def upsample_null_key(spark, sf):
    rows = stage(split.row_index(_without_key(v.keyed(spark, sf)), v.KEY), "rows")
    return resample.upsample(rows, v.KEY, ["value"], 4).select("series_id", "g", r("value", 4).alias("value"))


@query("regular_grid_null_key", v.sql("""
    SELECT * FROM (WITH d AS (
        SELECT CASE WHEN series_id % 3 <> 0 THEN series_id END AS series_id, (us // 86400000000) * 86400000000 AS us, round(sum(value), 6) AS value FROM su GROUP BY 1, 2),
      g AS (SELECT series_id, unnest(range(min(us), max(us) + 1, 86400000000)) AS us FROM d GROUP BY series_id)
    SELECT g.series_id, g.us, d.value FROM g LEFT JOIN d ON g.series_id IS NOT DISTINCT FROM d.series_id AND g.us = d.us)""", "su"))
def regular_grid_null_key(spark, sf):
    day = (F.floor(F.col("us") / (24 * v.HOUR)) * (24 * v.HOUR)).cast("long")
    daily = _without_key(v.keyed(spark, sf)).groupBy("series_id", day.alias("us")).agg(F.sum("value").alias("value"))
    return resample.regular_grid(daily, v.KEY, ["value"], 24 * v.HOUR).select("series_id", "us", r("value").alias("value"))


@query("slide_windows_null_key", v.sql(f"""
    SELECT a.s AS series_id, a.i AS start_idx, CAST(count(*) AS INTEGER) AS length, round(sum(b.value), 4) AS total
    FROM {_NO_KEY} a JOIN {_NO_KEY} b ON a.s IS NOT DISTINCT FROM b.s AND b.i BETWEEN a.i AND a.i + 15
    WHERE a.i % 5 = 2 AND a.i + 16 <= a.m GROUP BY 1, 2""", "su"))
def slide_windows_null_key(spark, sf):
    rows = stage(split.row_index(_without_key(v.keyed(spark, sf)), v.KEY), "rows")
    marked = windows.mark_starts(rows, rows.where("idx % 5 = 2"), v.KEY)
    out = windows.slide_windows(marked, v.KEY, ["value"], v.L, F.col("is_start"))
    return out.select("series_id", "start_idx", F.size("value").alias("length"), r(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("propagate_labels", v.sql("""
    SELECT series_id, g, f.is_anomaly AS forward, b.is_anomaly AS backward FROM (
      SELECT series_id, idx * 4 + j AS g, n FROM su, range(0, 4) q(j) WHERE idx < n - 1 OR j = 0) p
    JOIN su f USING (series_id) JOIN su b USING (series_id)
    WHERE f.idx = g // 4 AND b.idx = CASE WHEN g = 0 THEN 0 ELSE (g - 1) // 4 END""", "su"))
def propagate_labels(spark, sf):
    rows = v.series(spark, sf, staged=True)
    fwd = resample.propagate_labels(rows, v.KEY, ["is_anomaly"], 4).withColumnRenamed("is_anomaly", "forward")
    bwd = resample.propagate_labels(rows, v.KEY, ["is_anomaly"], 4, "backward").withColumnRenamed("is_anomaly", "backward")
    return fwd.join(bwd, ["series_id", "g"])


_U = lambda purpose, *ids: f"('0x' || substr(md5(concat_ws('|', '42', '{purpose}', {', '.join(i + '::VARCHAR' for i in ids)})), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


@query("jitter_augment", v.sql(f"""
    SELECT series_id, idx, round(value * (0.995::DOUBLE + 0.010000000000000009::DOUBLE * {_U('scale.value', 'series_id')})
      + 0.001::DOUBLE * CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END
        * sqrt(-2 * ln(1 - {_U('jitter.value.r', 'series_id', 'idx')})) * cos(2 * pi() * {_U('jitter.value.a', 'series_id', 'idx')}), 5) AS value
    FROM (SELECT *, stddev_pop(value) OVER (PARTITION BY series_id) AS sd FROM su)""", "su"))
def jitter_augment(spark, sf):
    rows = v.series(spark, sf, staged=True)
    out = resample.jitter_augment(rows, rows, v.KEY, ["value"], seed=v.SPLIT_SEED, g="idx")
    return out.select("series_id", "idx", r("value", 5).alias("value"))


@query("regular_grid", v.sql("""
    WITH d AS (SELECT series_id, (us // 86400000000) * 86400000000 AS us, round(sum(value), 6) AS value FROM su GROUP BY 1, 2),
         g AS (SELECT series_id, unnest(range(min(us), max(us) + 1, 86400000000)) AS us FROM d GROUP BY series_id)
    SELECT series_id, us, d.value FROM g LEFT JOIN d USING (series_id, us)""".replace("WITH d AS", "SELECT * FROM (WITH d AS") + ")", "su"))
def regular_grid(spark, sf):
    day = (F.floor(F.col("us") / (24 * v.HOUR)) * (24 * v.HOUR)).cast("long")
    daily = v.keyed(spark, sf).groupBy("series_id", day.alias("us")).agg(F.sum("value").alias("value"))
    return resample.regular_grid(daily, v.KEY, ["value"], 24 * v.HOUR).select("series_id", "us", r("value").alias("value"))
