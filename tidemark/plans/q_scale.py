"""Queries: scalers and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scale, split
from tidemark.plans import views as v
from tidemark.plans.registry import query, r

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(template: str, columns=NUM) -> str:
    return " UNION ALL ".join(template.replace("@", c) for c in columns)


def _shown(scaler):
    return scaler.select("feature", r("center", 4).alias("center"), r("scale", 4).alias("scale"), "n")


def _lineitem(spark, sf):
    return v.table(spark, sf, "lineitem").select(*NUM)


@query("standard_fit", _per_column("SELECT '@' AS feature, round(avg(@), 4) AS center, round(stddev_pop(@), 4) AS scale, count(@) AS n FROM lineitem"))
def standard_fit(spark, sf):
    return _shown(scale.standard_fit(_lineitem(spark, sf), NUM))


@query("robust_fit", _per_column("SELECT '@' AS feature, round(quantile_cont(@, 0.5), 4) AS center, round(quantile_cont(@, 0.75) - quantile_cont(@, 0.25), 4) AS scale, count(@) AS n FROM lineitem"))
def robust_fit(spark, sf):
    return _shown(scale.fit_named(_lineitem(spark, sf), NUM, "RobustScaler"))


@query("robust_fit_wide", _per_column("SELECT '@' AS feature, round(quantile_cont(@, 0.5), 4) AS center, round(quantile_cont(@, 0.95) - quantile_cont(@, 0.05), 4) AS scale, count(@) AS n FROM lineitem"))
def robust_fit_wide(spark, sf):
    return _shown(scale.fit_named(_lineitem(spark, sf), NUM, "RobustScaler-0.05-0.95"))


@query("minmax_fit", _per_column("SELECT '@' AS feature, round(min(@), 4) AS center, round(max(@) - min(@), 4) AS scale, count(@) AS n FROM lineitem"))
def minmax_fit(spark, sf):
    return _shown(scale.fit_named(_lineitem(spark, sf), NUM, "MinMaxScaler"))


@query("scale_apply", v.sql("""
    SELECT idx, round((value - mv) / sv, 6) AS value, round((k - mk) / sk, 6) AS k, round((gap_s - mg) / sg, 6) AS gap_s, is_anomaly
    FROM sl, (SELECT avg(value) mv, stddev_pop(value) sv, avg(k) mk, stddev_pop(k) sk, avg(gap_s) mg, stddev_pop(gap_s) sg
              FROM nr WHERE split = 'train') f""", "nr"))
def scale_apply(spark, sf):
    rows = v.series(spark, sf, long=True, staged=True)
    normal = split.normal_rows(v.split_long(spark, sf, rows), v.KEY, v.L)
    fitted = scale.fit_named(split.scaler_fit_rows(normal, v.CH), v.CH, "StandardScaler")
    out = scale.scale_apply(rows, fitted, v.CH)
    return out.select("idx", *[r(c).alias(c) for c in v.CH], "is_anomaly")


@query("scale_split_tables", v.sql("""
    SELECT split, near, count(*) AS rows, round(avg((value - m) / s), 6) AS mean_value, round(max((value - m) / s), 6) AS max_value FROM (
      SELECT *, coalesce(max(is_anomaly) OVER (ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 0) AS near FROM sp) t,
      (SELECT avg(value) m, stddev_pop(value) s FROM nr WHERE split = 'train') f
    GROUP BY split, near""", "nr"))
def scale_split_tables(spark, sf):
    """One scaled table with `split` and the near-anomaly flag, fitted on the clean training part."""
    rows = v.split_long(spark, sf)
    fitted = scale.standard_fit(split.scaler_fit_rows(split.normal_rows(rows, v.KEY, v.L), ["value"]), ["value"])
    flagged = split.anomaly_covered_rows(rows, v.KEY, v.L)
    return scale.scale_apply(flagged, fitted, ["value"]).groupBy("split", F.col("covered").alias("near")).agg(
        F.count(F.lit(1)).alias("rows"), r(F.avg("value")).alias("mean_value"), r(F.max("value")).alias("max_value")
    )


@query("scale_inverse", v.sql("SELECT event_id, round(value, 4) AS value, round(k, 4) AS k FROM ev", "ev"))
def scale_inverse(spark, sf):
    rows = v.events(spark, sf)
    fitted = scale.standard_fit(rows, ["value", "k"])
    back = scale.scale_inverse(scale.scale_apply(rows, fitted, ["value", "k"]), fitted, ["value", "k"])
    return back.select("event_id", r("value", 4).alias("value"), r("k", 4).alias("k"))


@query("scale_windows_inverse", v.sql("SELECT series_id, start_idx, round(sum(value), 4) AS total, round(sum((value - 10) / 2.5::DOUBLE), 4) AS scaled FROM wl GROUP BY series_id, start_idx", "wl"))
def scale_windows_inverse(spark, sf):
    rows = v.series(spark, sf, staged=True)
    win = v.user_windows(spark, sf, rows=rows)
    fixed = scale.standard_fit(rows, ["value"]).withColumns({"center": F.lit(10.0), "scale": F.lit(2.5)})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    there = scale.scale_windows(win, fixed, ["value"]).withColumn("scaled", total("value"))
    back = scale.scale_windows(there, fixed, ["value"], inverse=True)
    return back.select(*v.WIN, r(total("value"), 4).alias("total"), r("scaled", 4).alias("scaled"))


@query("fit_on_windows_rows", v.sql("""
    SELECT 'value' AS feature, round(avg(value), 4) AS center, round(stddev_pop(value), 4) AS scale, count(*) AS n FROM (
      SELECT value, max(CASE WHEN idx % 20 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS inside FROM su)
    WHERE inside = 1""", "su"))
def fit_on_windows_rows(spark, sf):
    return _shown(scale.fit_on_windows_rows(v.series(spark, sf), v.KEY, ["value"], v.L, F.col("idx") % 20 == 0))


@query("fit_on_windows", v.sql("""
    SELECT 'value' AS feature, round(avg(value), 4) AS center, round(stddev_pop(value), 4) AS scale, count(*) AS n
    FROM (SELECT s.value FROM su w JOIN su s ON s.series_id = w.series_id AND s.idx BETWEEN w.idx AND w.idx + 15
          WHERE w.idx % 4 = 0 AND w.idx + 16 <= w.n)""", "su"))
def fit_on_windows(spark, sf):
    return _shown(scale.fit_on_windows(v.series(spark, sf, staged=True), v.KEY, ["value"], v.L, F.col("idx") % 4 == 0))


@query("zscore_sample", v.sql("SELECT event_id, round((value - m) / s, 6) AS z FROM ev, (SELECT avg(value) m, stddev_samp(value) s FROM ev) f", "ev"))
def zscore_sample(spark, sf):
    rows = v.events(spark, sf)
    return scale.scale_apply(rows, scale.standard_fit(rows, ["value"], sample=True), ["value"]).select("event_id", r("value").alias("z"))


@query("profile_features", "SELECT l_returnflag, * EXCLUDE (l_returnflag) FROM (" + _per_column(
    "SELECT l_returnflag, '@' AS feature, count(@) AS count, round(avg(@), 4) AS mean, round(stddev_samp(@), 4) AS std, min(@) AS min, max(@) AS max FROM lineitem GROUP BY l_returnflag") + ")")
def profile_features(spark, sf):
    out = scale.profile_features(v.table(spark, sf, "lineitem"), NUM, ["l_returnflag"])
    return out.withColumns({"mean": r("mean", 4), "std": r("std", 4)})
