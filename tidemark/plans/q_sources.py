"""Queries: scans, sinks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, joins, scale, split, windows
from tidemark.plans import views as v
from tidemark.plans.registry import joined, query, r
from tidemark.sources import keyvalue, store, tables
from tidemark.sources.stage import fresh_path


@query("scan_table", v.sql("""
    SELECT user_id, count(*) AS rows, round(sum(value), 4) AS total, min(us) AS first_us, max(us) AS last_us
    FROM ev GROUP BY user_id""", "ev"))
def scan_table(spark, sf):
    return v.events(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rows"), r(F.sum("value"), 4).alias("total"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )


@query("scan_table_csv", v.sql("SELECT event_id, us, round(value, 6) AS value FROM ev", "ev"))
def scan_table_csv(spark, sf):
    path = fresh_path(spark, "telemetry", ".csv")
    v.events(spark, sf).select("event_id", "us", "value").write.option("header", True).csv(path)
    return tables.scan_table(spark, path, "event_id long, us long, value double").select("event_id", "us", r("value").alias("value"))


@query("scan_multi_join", v.sql("""
    SELECT series_id, us, event_id, round(value, 6) AS value, k, is_anomaly FROM su""", "su"))
def scan_multi_join(spark, sf):
    rows, on = v.keyed(spark, sf), ["series_id", "us", "event_id"]
    parts = [rows.select(*on, c) for c in ("value", "k", "is_anomaly")]
    return tables.scan_multi_join(parts, on).withColumn("value", r("value"))


@query("sink_splits", v.sql("SELECT split, count(*) AS rows, min(idx) AS first_idx, max(idx) AS last_idx, CAST(sum(idx) AS BIGINT) AS idx_sum, '42' AS seed FROM sp GROUP BY split", "sp"))
def sink_splits(spark, sf):
    path = store.artefact_path(fresh_path(spark, "artefacts"), "splits", v.L, "seed42")
    store.sink_splits(v.split_long(spark, sf).select("series_id", "idx", "split"), path, {"seed": "42"})
    return store.read_splits(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.sum("idx").alias("idx_sum"), F.first("seed").cast("string").alias("seed"),
    )


@query("read_splits", v.sql("SELECT series_id, idx FROM sp WHERE split = 'val'", "sp"))
def read_splits(spark, sf):
    path = fresh_path(spark, "splits")
    store.sink_splits(v.split_long(spark, sf).select("series_id", "idx", "split"), path)
    return store.read_splits(spark, path, "val").select("series_id", "idx")


_SCALER_SQL = v.sql("""
    SELECT 'value' AS feature, round(avg(value), 6) AS center, round(stddev_pop(value), 6) AS scale, count(*) AS n FROM nr WHERE split = 'train'
    UNION ALL SELECT 'k', round(avg(k), 6), round(stddev_pop(k), 6), count(*) FROM nr WHERE split = 'train'
    UNION ALL SELECT 'gap_s', round(avg(gap_s), 6), round(stddev_pop(gap_s), 6), count(*) FROM nr WHERE split = 'train'""", "nr")


@query("sink_scaler", _SCALER_SQL)
def sink_scaler(spark, sf):
    path = fresh_path(spark, "scaler")
    normal = split.normal_rows(v.split_long(spark, sf), v.KEY, v.L)
    store.sink_scaler(scale.standard_fit(split.scaler_fit_rows(normal, v.CH), v.CH), path)
    return store.read_scaler(spark, path).select("feature", r("center").alias("center"), r("scale").alias("scale"), "n")


@query("read_robust_scaler", v.sql("""
    SELECT 'value' AS feature, round(quantile_cont(value, 0.5), 6) AS center, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS scale,
           0.1::DOUBLE AS q_low, 0.9::DOUBLE AS q_high FROM ev""", "ev"))
def read_robust_scaler(spark, sf):
    """A robust scaler and its quantile range, written and read again."""
    path = fresh_path(spark, "scaler")
    store.sink_scaler(scale.robust_fit(v.events(spark, sf), ["value"], 0.1, 0.9), path)
    return store.read_scaler(spark, path).select("feature", r("center").alias("center"), r("scale").alias("scale"), "q_low", "q_high")


@query("read_scaler", v.sql("""
    SELECT series_id, idx, round((value - m) / s, 6) AS value
    FROM su, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) f""", "su"))
def read_scaler(spark, sf):
    path = fresh_path(spark, "scaler")
    rows = v.series(spark, sf)
    store.sink_scaler(scale.standard_fit(v.events(spark, sf), ["value"]), path)
    return scale.scale_apply(rows, store.read_scaler(spark, path), ["value"]).select("series_id", "idx", r("value").alias("value"))


@query("sink_eval", v.sql("""
    SELECT series_id, start_idx, string_agg(CAST(round(value * 100) AS BIGINT)::VARCHAR, ',' ORDER BY pos) AS value,
           string_agg(is_anomaly::VARCHAR, ',' ORDER BY pos) AS labels
    FROM wl GROUP BY series_id, start_idx""", "wl"))
def sink_eval(spark, sf):
    path = fresh_path(spark, "eval")
    store.sink_eval(v.user_windows(spark, sf), path, {"is_standardized": True, "strategy": "use_original", "seq_len": v.L, "seed": v.INJECT_SEED})
    found, _ = store.read_eval(spark, path)
    return found.select(*v.WIN, joined("value").alias("value"), joined("labels", 1).alias("labels"))


@query("read_eval", v.sql("""
    SELECT count(*) AS windows, true AS is_standardized, 'none' AS strategy FROM (SELECT DISTINCT series_id, start_idx FROM wl)""", "wl"))
def read_eval(spark, sf):
    path = fresh_path(spark, "eval")
    store.sink_eval(v.user_windows(spark, sf), path, {"strategy": "none", "seq_len": v.L})
    found, metadata = store.read_eval(spark, path)
    one = metadata.select(F.struct("is_standardized", "strategy").alias("m")).scalar()
    return found.agg(F.count(F.lit(1)).alias("windows"), F.first(one).alias("_m")).select("windows", "_m.is_standardized", "_m.strategy")


@query("scan_kv_files", v.sql("""
    SELECT event_type AS file_key, 'run ' || event_type AS exp_name, 'cae' AS model_name, count(*) % 1000 AS seed,
           event_type < 'n' AS filter_anomalies, count(*) * 1000 AS train_size, round(max(value), 2) AS top,
           2 AS n_features, 'k' AS last_feature
    FROM ev GROUP BY event_type""", "ev"))
def scan_kv_files(spark, sf):
    """One metadata file per event type, written and then read back."""
    per = v.events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    lines = F.array(
        F.concat(F.lit("Experiment: run "), F.col("event_type")),
        F.lit("Model: cae"),
        F.concat(F.lit("Seed: "), (F.col("n") % 1000).cast("string")),
        F.concat(F.lit("Filter anomalies: "), F.when(F.col("event_type") < "n", "True").otherwise("False")),
        F.concat(F.lit("Train indices: "), F.format_number(F.col("n") * 1000, 0)),
        F.concat(F.lit('Scaler params: {"top": "'), F.col("top").cast("string"), F.lit('", "unit": "a:b"}')),
        F.lit("Feature columns: value, k"),
        F.lit("a line without the separator"),
    )
    path = fresh_path(spark, "metadata")
    per.select("event_type", F.array_join(lines, "\n").alias("value")).write.partitionBy("event_type").text(path)
    return keyvalue.scan_kv_files(spark, path).select(
        F.regexp_extract("file", "event_type=([a-z]+)", 1).alias("file_key"),
        "exp_name", "model_name", "seed", "filter_anomalies", "train_size",
        r(F.col("scaler_params")["top"].cast("double"), 2).alias("top"),
        F.size("feature_columns").alias("n_features"), F.element_at("feature_columns", -1).alias("last_feature"),
    )


@query("sink_results", v.sql("""
    SELECT series_id AS run_id, idx + 1 AS epoch, round(value, 6) AS val_loss,
           round(min(value) OVER (PARTITION BY series_id ORDER BY idx), 6) AS best_val_loss FROM su""", "su"))
def sink_results(spark, sf):
    from tidemark.operators import runs

    path = fresh_path(spark, "results")
    table = runs.running_best(v.runs(spark, sf), {"val_loss": "min"})
    store.sink_results(table.where("run_id % 2 = 0"), path)
    store.sink_results(table.where("run_id % 2 = 1"), path)
    return store.read_results(spark, path).select("run_id", "epoch", r("val_loss").alias("val_loss"), r("best_val_loss").alias("best_val_loss"))


# ---------------------------------------------------------------- joins

@query("join_labels", v.sql("""
    SELECT series_id, us, event_id, round(value, 6) AS value, CAST(event_type = 'error' AS INTEGER) AS mode FROM su""", "su"))
def join_labels(spark, sf):
    on = ["series_id", "us", "event_id"]
    rows = v.keyed(spark, sf)
    labels = clean.rule_labels(rows, {"mode": F.col("event_type") == "error"}).select(*on, "mode")
    return joins.join_labels(rows.select(*on, r("value").alias("value")), labels, on)


@query("join_params", v.sql("""
    SELECT event_id, 'value' AS channel, round((value - mv) / sv, 6) AS z FROM ev, (SELECT avg(value) mv, stddev_pop(value) sv FROM ev) f
    UNION ALL SELECT event_id, 'k', round((k - mk) / sk, 6) FROM ev, (SELECT avg(k) mk, stddev_pop(k) sk FROM ev) f""", "ev"))
def join_params(spark, sf):
    rows = v.events(spark, sf)
    scaler = scale.standard_fit(rows, ["value", "k"])
    z = scale.scale_apply(rows, scaler, ["value", "k"])
    return windows.melt_channels(z, ["event_id"], ["value", "k"], "z").withColumn("z", r("z"))


@query("join_interval", v.sql("""
    SELECT s.series_id, s.idx, max(e.us) FILTER (e.us <= s.us) AS before_us, min(e.us) FILTER (e.us >= s.us) AS after_us
    FROM su s JOIN (SELECT series_id, us FROM su WHERE k > 90) e USING (series_id)
    GROUP BY s.series_id, s.idx, s.us HAVING min(abs(e.us - s.us)) < 21600000000""", "su"))
def join_interval(spark, sf):
    rows = v.series(spark, sf, staged=True).select("series_id", "us", "idx", "k")
    flagged = rows.where("k > 90").select("series_id", "us")
    return joins.join_interval(rows.select("series_id", "us", "idx"), flagged, v.KEY, "us", 6 * v.HOUR).select(
        "series_id", "idx", "before_us", "after_us"
    )


@query("join_asof", v.sql("""
    SELECT e.event_id, p.us AS at_us, round(p.value, 6) AS at_value
    FROM (SELECT * FROM ev WHERE event_type <> 'purchase') e
    ASOF LEFT JOIN (SELECT user_id, us, max(value) AS value FROM ev WHERE event_type = 'purchase' GROUP BY user_id, us) p
      ON e.user_id = p.user_id AND e.us >= p.us""", "ev"))
def join_asof(spark, sf):
    rows = v.keyed(spark, sf)
    left = rows.where("event_type <> 'purchase'").select("series_id", "us", "event_id")
    right = rows.where("event_type = 'purchase'").select("series_id", "us", "value")
    return joins.join_asof(left, right, v.KEY, "us", ["value"]).select("event_id", "at_us", r("at_value").alias("at_value"))


@query("join_anti", v.sql("SELECT series_id, idx FROM sp WHERE split <> 'val'", "sp"))
def join_anti(spark, sf):
    rows = v.series(spark, sf, long=True, staged=True)
    val = v.split_long(spark, sf, rows).where("split = 'val'")
    return joins.join_anti(rows.select("series_id", "idx"), val, ["series_id", "idx"])


@query("join_semi", v.sql("SELECT series_id, idx FROM sp WHERE split = 'val' AND is_anomaly = 1", "sp"))
def join_semi(spark, sf):
    rows = v.series(spark, sf, long=True, staged=True)
    val = v.split_long(spark, sf, rows).where("split = 'val'")
    return joins.join_semi(rows.where("is_anomaly = 1").select("series_id", "idx"), val, ["series_id", "idx"])
