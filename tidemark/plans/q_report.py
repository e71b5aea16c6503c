"""Queries: error reports and run comparison."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.operators import detect, joins, report, runs, score, windows
from tidemark.plans import views as v
from tidemark.plans.registry import joined, query, r
from tidemark.sources import store
from tidemark.sources.stage import fresh_path, stage


def _pair_errors(spark, sf):
    """Errors of corrupted windows beside those of their clean originals, under the mean reconstruction."""
    good = v.scaled_windows(spark, sf)
    fitted = detect.recon_mean_fit(good, v.CH)
    bad = stage(v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good), "corrupted")
    ids = [*v.WIN, "anomaly_type", "channel"]
    bad_err = score.window_errors(detect.recon_mean(bad, fitted, v.CH), ids, v.CH)
    good_err = score.window_errors(detect.recon_mean(good, fitted, v.CH), v.WIN, v.CH)
    return report.paired_errors(bad_err, good_err, v.WIN, v.CH)


@query("paired_errors", v.sql("""
    SELECT series_id, start_idx, pos, round(value, 5) AS value, round(k, 5) AS k, round(gap_s, 5) AS gap_s,
           round(clean_value, 5) AS clean_value, round(clean_k, 5) AS clean_k, round(clean_gap_s, 5) AS clean_gap_s FROM pe""", "pe"))
def paired_errors(spark, sf):
    cols = [*v.CH, *["clean_" + c for c in v.CH]]
    return _pair_errors(spark, sf).select(*v.WIN, F.col("pos").cast("long").alias("pos"), *[r(c, 5).alias(c) for c in cols])


@query("mean_gap", v.sql("""
    SELECT round(a, 6) AS normal_mean, round(b, 6) AS anomaly_mean, round(b - a, 6) AS difference, round(100 * (b - a) / a, 4) AS percent
    FROM (SELECT avg((value + k + gap_s) / 3) FILTER (anomalous = 0) a, avg((value + k + gap_s) / 3) FILTER (anomalous = 1) b FROM er)""", "er"))
def mean_gap(spark, sf):
    out = report.mean_gap(v.step_errors(spark, sf), v.CH)
    return out.select(*[r(c).alias(c) for c in ("normal_mean", "anomaly_mean", "difference")], r("percent", 4).alias("percent"))


_TOTALS = """SELECT {name} anomalous, count(*) AS windows, round(avg(t), 4) AS mean, round(stddev_samp(t), 4) AS std, round(min(t), 4) AS min, round(max(t), 4) AS max
    FROM (SELECT series_id, start_idx, anomalous, sum(value + k + gap_s) AS t FROM {src} GROUP BY ALL) GROUP BY anomalous"""


@query("window_error_totals", v.sql(_TOTALS.format(name="'raw' AS form,", src="er") + " UNION ALL " + _TOTALS.format(name="'normalised' AS form,", src="en"), "er", "en"))
def window_error_totals(spark, sf):
    raw = v.step_errors(spark, sf)
    factors = score.median_normaliser(windows.melt_channels(raw.where("anomalous = 0"), [], v.CH))
    both = raw.withColumn("form", F.lit("raw")).unionByName(score.normalise(raw, factors, v.CH).withColumn("form", F.lit("normalised")))
    out = report.window_error_totals(both, v.WIN, v.CH, ["form", "anomalous"])
    return out.withColumns({c: r(c, 4) for c in ("mean", "std", "min", "max")})


@query("class_error_stats", v.sql("""
    SELECT anomalous AS label, count(*) AS count, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std,
           round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.95), 6) AS q95
    FROM (SELECT anomalous, (value + k + gap_s) / 3 AS s FROM er) GROUP BY anomalous""", "er"))
def class_error_stats(spark, sf):
    steps = score.step_score_window_label(v.scored_windows(spark, sf), v.WIN, v.CH)
    return report.class_error_stats(steps, ["label"]).withColumns({c: r(c) for c in ("mean", "std", "median", "q95")})


def _timelines(spark, sf):
    """Normal and anomalous windows, each laid end to end and cut in blocks of 20 windows."""
    scored = v.scored_windows(spark, sf)
    parts = []
    for flag in (0, 1):
        ranked = windows.window_rank(scored.where(F.col("anomalous") == flag))
        arrays = [*v.CH, *[f"out_{c}" for c in v.CH]]
        line = windows.windows_to_timeline(ranked, v.L, arrays).withColumn("anomalous", F.lit(flag))
        parts.append(windows.timeline_blocks(line, v.L, 20))
    long = parts[0].unionByName(parts[1])
    return long.withColumns({f"err_{c}": score.elementwise_error(F.col(f"out_{c}"), F.col(c)) for c in v.CH})


_BLOCKS = """SELECT *, (dense_rank() OVER (PARTITION BY anomalous ORDER BY series_id, start_idx) - 1) // 20 AS block FROM er"""


@query("global_error_timeline", v.sql(f"""
    WITH bl AS (SELECT block, anomalous, (value + k + gap_s) / 3 AS e FROM ({_BLOCKS})),
         th AS (SELECT block, quantile_cont(e, 0.95) AS t FROM bl WHERE anomalous = 0 GROUP BY block)
    SELECT block, anomalous, round(max(t), 6) AS threshold, count(*) AS steps, round(avg(e), 6) AS mean_err,
           count(*) FILTER (e > t) AS above, round(count(*) FILTER (e > t) / count(*)::DOUBLE, 6) AS share_above
    FROM bl LEFT JOIN th USING (block) GROUP BY block, anomalous""".replace("WITH bl AS", "SELECT * FROM (WITH bl AS") + ")", "er"))
def global_error_timeline(spark, sf):
    line = stage(_timelines(spark, sf).select("block", "anomalous", *[F.col(f"err_{c}").alias(c) for c in v.CH]), "timeline")
    out = report.global_error_timeline(line, v.CH)
    return out.withColumns({c: r(c) for c in ("threshold", "mean_err", "share_above")})


def _range_sql(c: str) -> str:
    return f"""SELECT block, '{c}' AS channel, round(least(min(x_{c}), min(o_{c})) - 0.05::DOUBLE * (greatest(max(x_{c}), max(o_{c})) - least(min(x_{c}), min(o_{c}))), 5) AS value_low,
      round(greatest(max(x_{c}), max(o_{c})) + 0.05::DOUBLE * (greatest(max(x_{c}), max(o_{c})) - least(min(x_{c}), min(o_{c}))), 5) AS value_high,
      round(min(e_{c}) - 0.05::DOUBLE * (max(e_{c}) - min(e_{c})), 5) AS error_low, round(max(e_{c}) + 0.05::DOUBLE * (max(e_{c}) - min(e_{c})), 5) AS error_high
      FROM rg GROUP BY block"""


@query("channel_ranges", v.sql("SELECT * FROM (WITH rg AS (SELECT block, " + ", ".join(f"a.{c} AS x_{c}, m.{c} AS o_{c}, abs(m.{c} - a.{c}) AS e_{c}" for c in v.CH)
    + f" FROM (SELECT *, (dense_rank() OVER (PARTITION BY anomalous ORDER BY series_id, start_idx) - 1) // 20 AS block FROM az) a JOIN rm m USING (pos)) "
    + " UNION ALL ".join(_range_sql(c) for c in v.CH) + ")", "az", "rm"))
def channel_ranges(spark, sf):
    out = report.channel_ranges(_timelines(spark, sf), v.CH, ["block"])
    return out.withColumns({c: r(c, 5) for c in ("value_low", "value_high", "error_low", "error_high")})


@query("error_histogram", v.sql("""
    SELECT label, bin, count(*) AS count, round(count(*) / (max(n) * max(w)), 6) AS density FROM (
      SELECT label, n, w, least(49, floor((s - a) / w))::INTEGER AS bin FROM (
        SELECT anomalous AS label, s, min(s) OVER c AS a, (max(s) OVER c - min(s) OVER c) / 50 AS w, count(*) OVER c AS n
        FROM (SELECT anomalous, round((value + k + gap_s) / 3, 6) AS s FROM er) WINDOW c AS (PARTITION BY anomalous)))
    GROUP BY label, bin""", "er"))
def error_histogram(spark, sf):
    steps = score.step_score_window_label(v.scored_windows(spark, sf), v.WIN, v.CH).withColumn("score", r("score", 6))
    return report.error_histogram(steps, "label").withColumn("density", r("density"))


_CHANNEL = lambda p: f"CASE channel WHEN 'value' THEN {p}value WHEN 'k' THEN {p}k ELSE {p}gap_s END"
_TEXT = lambda e: f"string_agg(CAST(round({e} * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY pos)"


@query("sample_pairs", v.sql(f"""
    SELECT series_id, start_idx, rank, channel, original, corrupted, previous, next FROM (
      SELECT series_id, start_idx, channel, row_number() OVER (ORDER BY md5(concat_ws('|', '123', 'sample', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx) AS rank,
             original, corrupted, previous, next, (SELECT count(*) // 16 FROM wz) AS total FROM (
        SELECT series_id, start_idx, max(c.channel) AS channel, {_TEXT('c.z')} AS original, {_TEXT('c.x')} AS corrupted,
               {_TEXT("CASE c.channel WHEN 'k' THEN w.value WHEN 'gap_s' THEN w.k END")} AS previous,
               {_TEXT("CASE c.channel WHEN 'value' THEN w.k WHEN 'k' THEN w.gap_s END")} AS next
        FROM cz c JOIN wz w USING (series_id, start_idx, pos) GROUP BY series_id, start_idx HAVING max(c.label) = 1))
    WHERE rank <= least(trunc(total * 0.2::DOUBLE), 1000)""", "cz"))
def sample_pairs(spark, sf):
    good = v.scaled_windows(spark, sf).drop("labels")
    total = good.select(F.count(F.lit(1)).alias("n")).scalar()
    bad = v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good)
    pairs = joins.join_pairs(bad.drop("rank").withColumn("n_windows", total), good, v.WIN)
    out = report.sample_pairs(pairs, v.WIN, v.CH, 0.2, 1000, seed=v.INJECT_SEED)
    text = {c: F.when(F.col(c).isNotNull(), joined(c, 1e4)) for c in ("original", "corrupted", "previous", "next")}
    return out.select(*v.WIN, "rank", "channel", *[e.alias(c) for c, e in text.items()])


# ---------------------------------------------------------------- runs

SETTINGS = [
    {"error": "abs", "epsilon": 1e-3, "level": "step"},
    {"error": "abs", "epsilon": 1e-5, "level": "window"},
    {"error": "se", "epsilon": 1e-3, "level": "step"},
    {"error": "se", "epsilon": 1e-3, "level": "window"},
]


def _sweep_sql(i: int, s: dict) -> str:
    e = (lambda c: c) if s["error"] == "abs" else (lambda c: f"({c} * {c})")
    eps = f"{s['epsilon']:.10f}::DOUBLE"
    total = " + ".join(f"{e(c)} / (f_{c} + {eps})" for c in v.CH)
    medians = ", ".join(f"quantile_cont({e(c)}, 0.5) FILTER (anomalous = 0) AS f_{c}" for c in v.CH)
    steps = f"SELECT series_id, start_idx, ({total}) / 3 AS score, label FROM er, (SELECT {medians} FROM er) f"
    if s["level"] == "window":
        steps = f"SELECT avg(score) AS score, max(label) AS label FROM ({steps}) GROUP BY series_id, start_idx"
    return f"""
    SELECT {i} AS config_id, '{s['error']}' AS error, {s['epsilon']}::DOUBLE AS epsilon, '{s['level']}' AS level,
           round(sum(neg1 * (tp - pos1 + pos1 / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)), 6) AS roc_auc,
           round(max(tp / p - fp / n), 6) AS youden FROM (
      SELECT score, sum(pos1) OVER d AS tp, sum(neg1) OVER d AS fp, pos1, neg1, sum(pos1) OVER () AS p, sum(neg1) OVER () AS n FROM (
        SELECT score, count(*) FILTER (label = 1) AS pos1, count(*) FILTER (label = 0) AS neg1 FROM ({steps}) GROUP BY 1)
      WINDOW d AS (ORDER BY score DESC))"""


@query("sweep", v.sql(" UNION ALL ".join(_sweep_sql(i, s) for i, s in enumerate(SETTINGS)), "er"))
def sweep(spark, sf):
    errs = v.step_errors(spark, sf).withColumn("normal", 1 - F.col("anomalous"))
    out = runs.sweep(errs, v.WIN, v.CH, SETTINGS)
    return out.select("config_id", "error", "epsilon", "level", r("roc_auc").alias("roc_auc"), r(F.col("tpr") - F.col("fpr")).alias("youden"))


OPTIONS = {"error": ["abs", "se"], "normaliser": ["median", "none"], "epsilon": [1e-3, 1e-1], "level": ["step", "window"]}


def _grid_sql() -> str:
    """Every setting of the grid, those without a normaliser once, ranked as `best_run` ranks them."""
    parts, i = [], -1
    for error, normaliser, epsilon, level in itertools.product(*OPTIONS.values()):
        i += 1
        if normaliser == "none" and epsilon != OPTIONS["epsilon"][0]:
            continue
        e = (lambda c: c) if error == "abs" else (lambda c: f"({c} * {c})")
        by = (lambda c: "") if normaliser == "none" else (lambda c: f" / (f_{c} + {epsilon:.10f}::DOUBLE)")
        total = " + ".join(f"{e(c)}{by(c)}" for c in v.CH)
        medians = ", ".join(f"quantile_cont({e(c)}, 0.5) FILTER (anomalous = 0) AS f_{c}" for c in v.CH)
        steps = f"SELECT series_id, start_idx, ({total}) / 3 AS score, label FROM er, (SELECT {medians} FROM er) f"
        if level == "window":
            steps = f"SELECT avg(score) AS score, max(label) AS label FROM ({steps}) GROUP BY series_id, start_idx"
        parts.append(f"""
        SELECT {i} AS config_id, '{error}' AS error, '{normaliser}' AS normaliser, {epsilon}::DOUBLE AS epsilon, '{level}' AS level,
               sum(neg1 * (tp - pos1 + pos1 / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS val_roc_auc, max(tp / p - fp / n) AS youden FROM (
          SELECT score, sum(pos1) OVER d AS tp, sum(neg1) OVER d AS fp, pos1, neg1, sum(pos1) OVER () AS p, sum(neg1) OVER () AS n FROM (
            SELECT score, count(*) FILTER (label = 1) AS pos1, count(*) FILTER (label = 0) AS neg1 FROM ({steps}) GROUP BY 1)
          WINDOW d AS (ORDER BY score DESC))""")
    listed = " UNION ALL ".join(parts)
    return f"""
    SELECT config_id, error, normaliser, epsilon, level, round(val_roc_auc, 6) AS val_roc_auc, round(youden, 6) AS youden,
           row_number() OVER (ORDER BY round(val_roc_auc, 9) DESC, config_id) = 1 AS best FROM ({listed})"""


@query("sweep_grid", v.sql(_grid_sql(), "er"))
def sweep_grid(spark, sf):
    """A grid of scoring options: equal settings dropped, every run stored, the best one chosen from the store."""
    errs = store.reuse_or_rebuild(spark, fresh_path(spark, "errors"), lambda: v.step_errors(spark, sf).withColumn("normal", 1 - F.col("anomalous")))
    found = runs.sweep_grid(errs, v.WIN, v.CH, runs.scoring_grid(spark, OPTIONS))
    records = found.select(F.col("config_id").alias("run_id"), F.lit(1).alias("epoch"), r("roc_auc", 9).alias("val_roc_auc"), "roc_auc", (F.col("tpr") - F.col("fpr")).alias("youden"), "error", "normaliser", "epsilon", "level")
    path = fresh_path(spark, "runs")
    store.sink_results(records, path)
    store.sink_results(store.read_results(spark, path), path)  # publishing again changes nothing
    stored = store.read_results(spark, path)
    best = runs.best_run(stored, *runs.choose_metric("val_roc_auc", stored.columns, True)).select(F.col("run_id").alias("best_id"))
    marked = stored.join(best, F.col("run_id") == F.col("best_id"), "left")
    return marked.select(F.col("run_id").alias("config_id"), "error", "normaliser", "epsilon", "level", r("roc_auc").alias("val_roc_auc"), r("youden").alias("youden"), F.col("best_id").isNotNull().alias("best"))


@query("best_run", v.sql("""
    SELECT series_id AS run_id, round(arg_max(k, idx) / 100, 6) AS val_roc_auc, count(*) AS epochs FROM su GROUP BY series_id
    ORDER BY arg_max(k, idx) DESC, series_id LIMIT 1""", "su"))
def best_run(spark, sf):
    metric, mode = runs.choose_metric("val_roc_auc", ["val_loss", "val_roc_auc"], True)
    return runs.best_run(v.runs(spark, sf), metric, mode).withColumn("val_roc_auc", r("val_roc_auc"))


@query("best_run_lowest", v.sql("""
    SELECT series_id AS run_id, round(min(value), 6) AS val_loss, count(*) AS epochs FROM su GROUP BY series_id
    ORDER BY min(value), series_id LIMIT 1""", "su"))
def best_run_lowest(spark, sf):
    metric, mode = runs.choose_metric(None, ["val_loss"], False)
    return runs.best_run(v.runs(spark, sf), metric, mode, scope="all").withColumn("val_loss", r("val_loss"))


@query("best_run_nan", v.sql("""
    SELECT series_id AS run_id, round(min(value) FILTER (k % 7 <> 0), 6) AS val_loss, count(*) AS epochs FROM su GROUP BY series_id
    HAVING min(value) FILTER (k % 7 <> 0) IS NOT NULL ORDER BY min(value) FILTER (k % 7 <> 0), series_id LIMIT 1""", "su"))
def best_run_nan(spark, sf):
    """A seventh of the losses are not numbers; they are never the lowest."""
    diverged = v.runs(spark, sf).withColumn("val_loss", F.when(F.round(F.col("val_roc_auc") * 100).cast("int") % 7 == 0, float("nan")).otherwise(F.col("val_loss")))
    return runs.best_run(diverged, "val_loss", "min", scope="all").withColumn("val_loss", r("val_loss"))


@query("early_stop_nan", v.sql("""
    SELECT r.series_id AS run_id, min(s.idx) AS stop_idx FROM (SELECT DISTINCT series_id FROM su) r LEFT JOIN (
      WITH RECURSIVE x AS (SELECT series_id, idx, CASE WHEN idx >= 10 THEN NULL ELSE value END AS value FROM su), fold AS (
        SELECT series_id, idx, value AS best, 0 AS waited FROM x WHERE idx = 0
        UNION ALL
        SELECT s.series_id, s.idx, CASE WHEN f.best - s.value > 0.5::DOUBLE THEN s.value ELSE f.best END,
               CASE WHEN f.best - s.value > 0.5::DOUBLE THEN 0 ELSE f.waited + 1 END
        FROM fold f JOIN x s ON s.series_id = f.series_id AND s.idx = f.idx + 1)
      SELECT * FROM fold WHERE waited >= 12) s USING (series_id) GROUP BY r.series_id""", "su"))
def early_stop_nan(spark, sf):
    """Every run diverges at its eleventh epoch: what is not a number improves nothing."""
    diverged = v.runs(spark, sf).withColumn("val_loss", F.when(F.col("idx") >= 10, float("nan")).otherwise(F.col("val_loss")))
    return runs.early_stop_epoch(diverged, "val_loss", 12, 0.5)


@query("running_best", v.sql("""
    SELECT series_id AS run_id, idx + 1 AS epoch, round(min(value) OVER a, 6) AS best_val_loss, round(max(k) OVER a / 100, 6) AS best_val_roc_auc,
           CAST(coalesce(value < min(value) OVER b, true) AS INTEGER) AS improved_val_loss,
           CAST(coalesce(k > max(k) OVER b, true) AS INTEGER) AS improved_val_roc_auc
    FROM su WINDOW a AS (PARTITION BY series_id ORDER BY idx), b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "su"))
def running_best(spark, sf):
    out = runs.running_best(v.runs(spark, sf), {"val_loss": "min", "val_roc_auc": "max"})
    return out.select(
        "run_id", "epoch", r("best_val_loss").alias("best_val_loss"), r("best_val_roc_auc").alias("best_val_roc_auc"),
        "improved_val_loss", "improved_val_roc_auc",
    )


@query("early_stop_epoch", v.sql("""
    SELECT r.series_id AS run_id, min(s.idx) AS stop_idx FROM (SELECT DISTINCT series_id FROM su) r LEFT JOIN (
      WITH RECURSIVE fold AS (
        SELECT series_id, idx, value AS best, 0 AS waited FROM su WHERE idx = 0
        UNION ALL
        SELECT s.series_id, s.idx, CASE WHEN f.best - s.value > 0.5::DOUBLE THEN s.value ELSE f.best END,
               CASE WHEN f.best - s.value > 0.5::DOUBLE THEN 0 ELSE f.waited + 1 END
        FROM fold f JOIN su s ON s.series_id = f.series_id AND s.idx = f.idx + 1)
      SELECT * FROM fold WHERE waited >= 12) s USING (series_id) GROUP BY r.series_id""", "su"))
def early_stop_epoch(spark, sf):
    return runs.early_stop_epoch(v.runs(spark, sf), "val_loss", 12, 0.5)
