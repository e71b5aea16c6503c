"""Queries: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, scale
from tidemark.plans import views as v
from tidemark.plans.registry import joined, query, r


@query("project_features", v.sql("""
    SELECT series_id, us, event_id, round(value, 6) AS value, k, is_anomaly FROM su""", "su"))
def project_features(spark, sf):
    out = clean.project_features(
        v.keyed(spark, sf), ["value"], ["k", "value"], remove=["user_id"], label="is_anomaly", keys=["series_id", "us", "event_id"]
    )
    return out.withColumn("value", r("value"))


@query("remove_target", v.sql("SELECT series_id, us, event_id, user_id, event_type, round(value, 6) AS value FROM (SELECT *, series_id AS user_id FROM su)", "su"))
def remove_target(spark, sf):
    return clean.remove_target(v.keyed(spark, sf), ["k"], ["is_anomaly"]).withColumn("value", r("value"))


_GRID_SQL = ",".join(f"sum(value) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
TYPES = ["click", "error", "purchase", "signup", "view"]


def user_hours(spark, sf):
    """Hourly sums per user and event type; an event type that did not occur in the hour is missing."""
    hour = (F.floor(F.col("us") / v.HOUR) * v.HOUR).cast("long").alias("us")
    rows = v.events(spark, sf).select(F.col("user_id").alias("series_id"), hour, "event_type", "value")
    return rows.groupBy("series_id", "us").pivot("event_type", TYPES).agg(F.sum("value"))


@query("drop_missing", v.sql(f"""
    SELECT series_id, us, round(click, 6) AS click, round("view", 6) AS "view" FROM (
      SELECT user_id AS series_id, (us // 3600000000) * 3600000000 AS us, {_GRID_SQL} FROM ev GROUP BY 1, 2)
    WHERE click IS NOT NULL AND "view" IS NOT NULL""", "ev"))
def drop_missing(spark, sf):
    out = clean.drop_missing(user_hours(spark, sf), ["click", "view"])
    return out.select("series_id", "us", r("click").alias("click"), r("view").alias("view"))


@query("head_rows", v.sql("SELECT series_id, idx, event_id FROM su WHERE idx < 20", "su"))
def head_rows(spark, sf):
    return clean.head_rows(v.series(spark, sf), 20).select("series_id", "idx", "event_id")


@query("time_slice", v.sql("SELECT event_id, round(value, 6) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'"))
def time_slice(spark, sf):
    rows = v.table(spark, sf, "events")
    kind = rows.schema["ts"].dataType
    at = lambda s: F.lit(s).cast(kind)
    return clean.time_slice(rows, at("2024-01-05"), at("2024-01-12")).select("event_id", r("value").alias("value"))


@query("time_slice_from", v.sql("""
    SELECT s.series_id, s.idx FROM su s JOIN (SELECT series_id, us FROM su WHERE idx = 10) o USING (series_id)
    WHERE s.us BETWEEN o.us AND o.us + 7 * 86400000000""", "su"))
def time_slice_from(spark, sf):
    return clean.time_slice_from(v.series(spark, sf), 10, 7 * 24 * v.HOUR, v.KEY).select("series_id", "idx")


@query("calendar_split", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-24' THEN 'trainval' ELSE 'test' END AS part FROM events")
def calendar_split(spark, sf):
    rows = v.table(spark, sf, "events")
    cutoff = F.lit("2024-01-24").cast(rows.schema["ts"].dataType)
    return clean.calendar_split(rows, cutoff).select("event_id", "part")


def _rules():
    units = {f"u{i}": (F.col("user_id") % 4 == i) & (F.col("k") > 90) for i in range(4)}
    return {"helper": F.col("value") > 250, "mode": F.col("event_type") == "error", **units}


@query("rule_labels", v.sql("""
    SELECT event_id, helper, mode, u0, u1, u2, u3, greatest(helper, mode, u0, u1, u2, u3) AS irregular FROM (
      SELECT event_id, CAST(value > 250 AS INTEGER) AS helper, CAST(event_type = 'error' AS INTEGER) AS mode,
        CAST(user_id % 4 = 0 AND k > 90 AS INTEGER) AS u0, CAST(user_id % 4 = 1 AND k > 90 AS INTEGER) AS u1,
        CAST(user_id % 4 = 2 AND k > 90 AS INTEGER) AS u2, CAST(user_id % 4 = 3 AND k > 90 AS INTEGER) AS u3 FROM ev)""", "ev"))
def rule_labels(spark, sf):
    rules = _rules()
    return clean.rule_labels(v.events(spark, sf), rules).select("event_id", *rules, "irregular")


@query("mask_around_events", v.sql("""
    SELECT idx, CAST(hit AS INTEGER) AS masked, CASE WHEN hit THEN NULL ELSE round(value, 6) END AS value, k FROM (
      SELECT *, coalesce(max(CASE WHEN value > 250 THEN 1 ELSE 0 END)
        OVER (ORDER BY us RANGE BETWEEN 599999999 PRECEDING AND 599999999 FOLLOWING), 0) = 1 AS hit FROM sl)""", "sl"))
def mask_around_events(spark, sf):
    rows = v.series(spark, sf, long=True, staged=True)
    out = clean.mask_around_events(rows, v.KEY, ["is_anomaly"], v.TEN_MINUTES, ["value"])
    return out.select("idx", "masked", r("value").alias("value"), "k")


@query("any_channel_over", v.sql("""
    SELECT series_id, idx, CAST(value > 180 OR k > 97 OR gap_s > 86400 AS INTEGER) AS flag FROM su""", "su"))
def any_channel_over(spark, sf):
    limits = {"value": 180.0, "k": 97.0, "gap_s": 86400.0}
    flag = clean.any_channel_over({c: F.col(c) for c in v.CH}, {c: F.lit(x) for c, x in limits.items()})
    return v.series(spark, sf).select("series_id", "idx", flag.alias("flag"))


@query("filter_windows_by_label", v.sql("""
    SELECT series_id, start_idx, string_agg(is_anomaly::VARCHAR, ',' ORDER BY pos) AS labels
    FROM wl GROUP BY series_id, start_idx HAVING max(is_anomaly) = 1""", "wl"))
def filter_windows_by_label(spark, sf):
    return clean.filter_windows_by_label(v.user_windows(spark, sf)).select(*v.WIN, joined("labels", 1).alias("labels"))


@query("guard_non_finite", v.sql("""
    SELECT event_type, 'ratio' AS feature, count(*) FILTER (k = 50) AS nulls, count(*) FILTER (k = 0) AS nans,
           count(*) FILTER (k = 1) AS infs FROM ev GROUP BY event_type
    UNION ALL SELECT event_type, 'value', 0, 0, 0 FROM ev GROUP BY event_type""", "ev"))
def guard_non_finite(spark, sf):
    ratio = F.when(F.col("k") == 50, None).when(F.col("k") == 0, float("nan")).when(F.col("k") == 1, float("inf")).otherwise(F.col("k"))
    rows = v.events(spark, sf).withColumn("ratio", ratio)
    return clean.guard_non_finite(rows, ["ratio", "value"], ["event_type"])


@query("assert_finite", v.sql("SELECT event_id, round((value - m) / s, 6) AS value FROM ev, (SELECT avg(value) m, stddev_pop(value) s FROM ev) f", "ev"))
def assert_finite(spark, sf):
    rows = v.events(spark, sf)
    out = clean.assert_finite(scale.scale_apply(rows, scale.standard_fit(rows, ["value"]), ["value"]), ["value"])
    return out.select("event_id", r("value").alias("value"))
