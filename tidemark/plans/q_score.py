"""Queries: detectors, errors, scores and threshold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, detect, evaluate, inject, scale, score, split, windows
from tidemark.plans import views as v
from tidemark.plans.registry import query, r
from tidemark.sources.stage import stage


def _sum(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


@query("recon_mean", v.sql("SELECT a.series_id, a.start_idx, a.pos, round(a.value, 6) AS value, round(m.value, 6) AS out_value, round(m.gap_s, 6) AS out_gap_s FROM az a JOIN rm m USING (pos)", "az", "rm"))
def recon_mean(spark, sf):
    long = windows.explode_positions(v.scored_windows(spark, sf), v.WIN, ["value", "out_value", "out_gap_s"])
    return long.select(*v.WIN, F.col("pos").cast("long").alias("pos"), *[r(c).alias(c) for c in ("value", "out_value", "out_gap_s")])


@query("recon_linear")
def recon_linear(spark, sf):
    """Linear code on embedding windows, fitted on the normal class; mean squared error per window."""
    channels = [f"c{i}" for i in range(8)]
    win = v.vectors(spark, sf)
    fitted = detect.recon_linear_fit(win.where("label = 0"), channels, 4)
    out = detect.recon_linear(win, fitted, channels)
    errs = score.window_errors(out, ["vec_id", "label"], channels, "se", None)
    return errs.groupBy("vec_id", "label").agg(r(F.avg(score.mean_of(channels)), 6).alias("mse"))


@query("forecast_last", v.sql("""
    SELECT series_id, idx AS start_idx, last_v AS out_value, n1 AS first_target FROM (
      SELECT series_id, idx, n, round(lead(value, 15) OVER w, 6) AS last_v, round(lead(value, 16) OVER w, 6) AS n1, lead(idx, 19) OVER w AS e
      FROM su WINDOW w AS (PARTITION BY series_id ORDER BY idx)) WHERE e IS NOT NULL AND idx % 4 = 0""", "su"))
def forecast_last(spark, sf):
    win = windows.slide_windows(v.series(spark, sf), v.KEY, ["value"], v.L, ahead=4, stride=4)
    out = detect.forecast_last(win, ["value"], 4)
    return out.select(*v.WIN, r(F.element_at("out_value", -1)).alias("out_value"), r(F.get("y_value", F.lit(0))).alias("first_target"))


@query("forecast_linear")
def forecast_linear(spark, sf):
    """Linear autoregression per channel, four steps ahead; absolute error per step."""
    rows = v.series(spark, sf, long=True, staged=True)
    win = windows.slide_windows(rows, v.KEY, ["value", "gap_s"], v.L, F.col("idx") % 4 == 0, "is_anomaly", ahead=4)
    fitted = detect.forecast_linear_fit(clean.filter_windows_by_label(win, anomalous=False), ["value", "gap_s"])
    out = detect.forecast_linear(win, fitted, ["value", "gap_s"], 4)
    errs = score.window_errors(out, v.WIN, ["value", "gap_s"], "abs", None, "y_")
    return errs.select(*v.WIN, "pos", r("value", 5).alias("value"), r("gap_s", 3).alias("gap_s"))


# Windows of two values: normal equations and the principal axis have a closed form there.
_PAIRS = """p AS (SELECT * FROM (
      SELECT series_id, idx AS start_idx, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS y FROM su WINDOW w AS (PARTITION BY series_id ORDER BY idx))
      WHERE y IS NOT NULL AND start_idx % 2 = 0),
    m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM p)"""


def _pairs(spark, sf):
    return windows.slide_windows(v.series(spark, sf, staged=True), v.KEY, ["value"], 2, ahead=1, stride=2)


@query("forecast_linear_pair", v.sql(f"""
    SELECT series_id, start_idx, round(my + ba * (a - ma) + bb_ * (b - mb), 4) AS out_value FROM (WITH {_PAIRS}
      SELECT p.*, ma, mb, my, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM p, m)""", "su"))
def forecast_linear_pair(spark, sf):
    """Linear autoregression on two values, one step ahead."""
    win = _pairs(spark, sf)
    out = detect.forecast_linear(win, detect.forecast_linear_fit(win, ["value"]), ["value"], 1)
    return out.select(*v.WIN, r(F.get("out_value", F.lit(0)), 4).alias("out_value"))


@query("recon_linear_pair", v.sql(f"""
    SELECT series_id, start_idx, round(ma + c * (c * (a - ma) + s * (b - mb)), 4) AS first, round(mb + s * (c * (a - ma) + s * (b - mb)), 4) AS second
    FROM (WITH {_PAIRS} SELECT p.*, ma, mb, cos(0.5 * atan2(2 * ab, aa - bb)) AS c, sin(0.5 * atan2(2 * ab, aa - bb)) AS s FROM p, m)""", "su"))
def recon_linear_pair(spark, sf):
    """The linear code of windows of two values keeps their principal axis."""
    win = _pairs(spark, sf)
    out = detect.recon_linear(win.select(*v.WIN, "value"), detect.recon_linear_fit(win, ["value"], 2), ["value"])
    return out.select(*v.WIN, *[r(F.get("out_value", F.lit(i)), 4).alias(n) for i, n in enumerate(("first", "second"))])


@query("inject_subspace_pair", v.sql(f"""
    SELECT series_id, start_idx, round(a - g * c, 4) AS first, round(b - g * s, 4) AS second FROM (
      SELECT *, CASE WHEN (a - ma) * c + (b - mb) * s < 0 THEN -1 ELSE 1 END * sqrt(0.5 * 2) * spread AS g FROM (
        SELECT *, c0 * turn AS c, s0 * turn AS s FROM (
          SELECT *, CASE WHEN abs(c0) >= abs(s0) THEN sign(c0) ELSE sign(s0) END AS turn FROM (WITH {_PAIRS}
            SELECT p.*, ma, mb, cos(0.5 * atan2(2 * ab, aa - bb)) AS c0, sin(0.5 * atan2(2 * ab, aa - bb)) AS s0,
                   (SELECT stddev_pop(x) FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p)) AS spread FROM p, m))))""", "su"))
def inject_subspace_pair(spark, sf):
    """Every window of two values moved against its principal axis."""
    win = _pairs(spark, sf).select(*v.WIN, "value")
    picked = inject.pick_type_channel(win, v.WIN, ["subspace"], ["value"])
    out = inject.corrupt(picked, inject.injector_fit(win, ["value"]), v.WIN, ["value"], 2, 0.5, types=["subspace"], directions=inject.principal_directions(win, ["value"]))
    return out.select(*v.WIN, *[r(F.get("value", F.lit(i)), 4).alias(n) for i, n in enumerate(("first", "second"))])


def _window_mean(batch):
    """A user model: every channel of a window as its own mean."""
    return batch.mean(axis=1, keepdims=True).repeat(batch.shape[1], axis=1)


@query("score_with_model", v.sql("""
    SELECT series_id, start_idx, pos, round(abs(avg(value) OVER w - value), 5) AS value, round(abs(avg(gap_s) OVER w - gap_s), 5) AS gap_s
    FROM az WINDOW w AS (PARTITION BY series_id, start_idx)""", "az"))
def score_with_model(spark, sf):
    out = detect.score_with_model(v.scaled_windows(spark, sf, clean_only=False), _window_mean, v.CH)
    errs = score.window_errors(out, v.WIN, v.CH, "abs")
    return errs.select(*v.WIN, F.col("pos").cast("long").alias("pos"), r("value", 5).alias("value"), r("gap_s", 5).alias("gap_s"))


@query("elementwise_error", v.sql("""
    SELECT series_id, start_idx, pos, label, round(value, 6) AS value, round(k, 6) AS k, round(gap_s, 6) AS gap_s FROM er""", "er"))
def elementwise_error(spark, sf):
    return v.step_errors(spark, sf).select(*v.WIN, F.col("pos").cast("long").alias("pos"), "label", *[r(c).alias(c) for c in v.CH])


@query("mse_loss", v.sql("SELECT round((sum(value * value) + sum(k * k) + sum(gap_s * gap_s)) / (3 * count(*)), 6) AS mse, 3 * count(*) AS elements FROM er", "er"))
def mse_loss(spark, sf):
    return score.mse_loss(v.scored_windows(spark, sf), v.CH).withColumn("mse", r("mse"))


@query("channel_error_stats", v.sql("SELECT channel, round(avg(err), 6) AS mean, round(stddev_samp(err), 6) AS std FROM el WHERE anomalous = 0 GROUP BY channel", "el"))
def channel_error_stats(spark, sf):
    stats = score.channel_error_stats(v.step_errors(spark, sf).where("anomalous = 0"), v.CH)
    return stats.select("channel", r("mean").alias("mean"), r("std").alias("std"))


@query("threshold_flags", v.sql("""
    SELECT series_id, start_idx, pos, CAST(value > tv OR k > tk OR gap_s > tg AS INTEGER) AS flag
    FROM er, (SELECT avg(value) + 2 * stddev_samp(value) tv, avg(k) + 2 * stddev_samp(k) tk, avg(gap_s) + 2 * stddev_samp(gap_s) tg
              FROM er WHERE anomalous = 0) t""", "er"))
def threshold_flags(spark, sf):
    errs = v.step_errors(spark, sf)
    stats = score.channel_error_stats(errs.where("anomalous = 0"), v.CH)
    return score.threshold_flags(errs, stats, v.CH, 2.0).select(*v.WIN, F.col("pos").cast("long").alias("pos"), "flag")


_DIST = ", ".join(f"round(quantile_cont(err, {p}), 6) AS {n}" for n, p in score.DISTRIBUTION_PROBS.items())


@query("error_distribution", v.sql(f"SELECT anomalous, count(*) AS count, round(avg(err), 6) AS mean, round(stddev_pop(err), 6) AS std, round(min(err), 6) AS min, round(max(err), 6) AS max, {_DIST} FROM el GROUP BY anomalous", "el"))
def error_distribution(spark, sf):
    long = windows.melt_channels(v.step_errors(spark, sf), ["anomalous"], v.CH)
    out = score.error_distribution(long, ["anomalous"])
    return out.select("anomalous", "count", *[r(c).alias(c) for c in out.columns if c not in ("anomalous", "count")])


@query("median_normaliser", v.sql("SELECT channel, round(factor, 6) AS factor FROM md", "md"))
def median_normaliser(spark, sf):
    normal = windows.melt_channels(v.step_errors(spark, sf).where("anomalous = 0"), [], v.CH)
    return score.median_normaliser(normal).withColumn("factor", r("factor"))


def _normalised(spark, sf):
    errs = v.step_errors(spark, sf)
    normal = windows.melt_channels(errs.where("anomalous = 0"), [], v.CH)
    return score.normalise(errs, score.median_normaliser(normal), v.CH)


@query("normalise", v.sql("SELECT series_id, start_idx, pos, round(value, 5) AS value, round(k, 5) AS k, round(gap_s, 5) AS gap_s FROM en", "en"))
def normalise(spark, sf):
    return _normalised(spark, sf).select(*v.WIN, F.col("pos").cast("long").alias("pos"), *[r(c, 5).alias(c) for c in v.CH])


def _steps(spark, sf):
    return score.step_score(_normalised(spark, sf), v.WIN, v.CH)


@query("step_score", v.sql("SELECT series_id, start_idx, pos, round(score, 6) AS score, label FROM ss", "ss"))
def step_score(spark, sf):
    return _steps(spark, sf).select(*v.WIN, F.col("pos").cast("long").alias("pos"), r("score").alias("score"), "label")


@query("sequence_score", v.sql("SELECT series_id, start_idx, round(avg((value + k + gap_s) / 3), 5) AS score, max(label) AS label FROM en GROUP BY series_id, start_idx", "en"))
def sequence_score(spark, sf):
    return score.sequence_score(_normalised(spark, sf), v.WIN, v.CH).withColumn("score", r("score", 5))


@query("step_labels", v.sql("SELECT series_id, start_idx, pos, label, anomalous AS window_label FROM az", "az"))
def step_labels(spark, sf):
    scored = v.scored_windows(spark, sf)
    own = score.step_score(score.window_errors(scored, v.WIN, v.CH), v.WIN, v.CH).select(*v.WIN, "pos", "label")
    spread = score.step_score_window_label(scored, v.WIN, v.CH).select(*v.WIN, "pos", F.col("label").alias("window_label"))
    return own.join(spread, [*v.WIN, "pos"]).withColumn("pos", F.col("pos").cast("long"))


@query("sequence_labels", v.sql("SELECT series_id, start_idx, max(label) AS label FROM az GROUP BY series_id, start_idx", "az"))
def sequence_labels(spark, sf):
    return score.sequence_score(v.step_errors(spark, sf), v.WIN, v.CH).select(*v.WIN, "label")


@query("roc_curve", v.sql("""
    SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM rc
    UNION ALL SELECT 'infinity'::DOUBLE, 0, 0""", "rc"))
def roc_curve(spark, sf):
    out = score.roc_curve(score.roc_counts(_steps(spark, sf)))
    return out.select(r("threshold").alias("threshold"), r("fpr").alias("fpr"), r("tpr").alias("tpr"))


@query("roc_auc", v.sql("SELECT round(roc_auc, 6) AS roc_auc FROM mr", "mr"))
def roc_auc(spark, sf):
    return score.roc_auc(score.roc_counts(_steps(spark, sf))).withColumn("roc_auc", r("roc_auc"))


@query("roc_auc_window_label", v.sql("""
    SELECT round(sum(neg1 * (tp - pos1 + pos1 / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)), 6) AS roc_auc FROM (
      SELECT score, sum(pos1) OVER d AS tp, pos1, neg1, sum(pos1) OVER () AS p, sum(neg1) OVER () AS n FROM (
        SELECT (value + k + gap_s) / 3 AS score, count(*) FILTER (anomalous = 1) AS pos1, count(*) FILTER (anomalous = 0) AS neg1 FROM er GROUP BY 1)
      WINDOW d AS (ORDER BY score DESC))""", "er"))
def roc_auc_window_label(spark, sf):
    """Window label repeated on every step of the window."""
    steps = score.step_score_window_label(v.scored_windows(spark, sf), v.WIN, v.CH)
    return score.roc_auc(score.roc_counts(steps)).withColumn("roc_auc", r("roc_auc"))


@query("youden_threshold", v.sql("SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n FROM mr", "mr"))
def youden_threshold(spark, sf):
    out = score.youden_threshold(score.roc_counts(_steps(spark, sf)))
    return out.withColumns({c: r(c) for c in ("threshold", "tpr", "fpr")})


@query("f1_from_rates", v.sql("SELECT round(prec, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM mf", "mf"))
def f1_from_rates(spark, sf):
    out = score.f1_from_rates(score.youden_threshold(score.roc_counts(_steps(spark, sf))))
    return out.select(r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"))


_WINDOW_SCORES = "(SELECT round(avg((value + k + gap_s) / 3), 6) AS score, max(label) AS label FROM en GROUP BY series_id, start_idx)"
_GRID = "[" + ", ".join(f"{i}/19.0::DOUBLE" for i in range(20)) + "]"


@query("best_f1_threshold", v.sql(f"""
    SELECT round(threshold, 5) AS threshold, round(f1, 6) AS f1 FROM (
      SELECT i, threshold, coalesce(2.0::DOUBLE * count(*) FILTER (score >= threshold AND label = 1)
        / (count(*) FILTER (score >= threshold) + count(*) FILTER (label = 1)), 0) AS f1
      FROM {_WINDOW_SCORES} s,
        (SELECT unnest(qs) AS threshold, unnest(range(0, 20)) AS i FROM (SELECT quantile_cont(score, {_GRID}) AS qs FROM {_WINDOW_SCORES} s2)) t
      GROUP BY i, threshold) ORDER BY f1 DESC, i LIMIT 1""", "en"))
def best_f1_threshold(spark, sf):
    seq = score.sequence_score(_normalised(spark, sf), v.WIN, v.CH).withColumn("score", r("score", 6))
    return score.best_f1_threshold(seq, 20).select(r("threshold", 5).alias("threshold"), r("f1").alias("f1"))


@query("metrics_record", v.sql("""
    SELECT round(roc_auc, 6) AS roc_auc, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
           round(prec, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n,
           'evaluation_set' AS normals_from FROM mf""", "mf"))
def metrics_record(spark, sf):
    out = score.metrics_record(_steps(spark, sf))
    return out.withColumns({c: r(c) for c in ("roc_auc", "threshold", "tpr", "fpr", "precision", "recall", "f1")})


_STATS = ("count", "mean", "std", "min", "max", *score.DISTRIBUTION_PROBS)


def _evaluation_sql(normals: str, level: str, source: str) -> str:
    """The whole record: corrupted windows against a sample of the clean windows that `normals` admits."""
    errs = ", ".join(f"abs(m.{c} - w.{c}) AS {c}" for c in _CHS)
    agg = ", ".join(["count(err) AS count", "avg(err) AS mean", "stddev_pop(err) AS std", "min(err) AS min", "max(err) AS max", *[f"quantile_cont(err, {p}) AS {n}" for n, p in score.DISTRIBUTION_PROBS.items()]])
    melted = " UNION ALL ".join(f"SELECT anomalous, {c} AS err FROM b" for c in _CHS)
    total = " + ".join(f"{c} / (f_{c} + 0.00001::DOUBLE)" for c in _CHS)
    steps = f"SELECT series_id, start_idx, anomalous, ({total}) / 3 AS score, label FROM b, f"
    if level == "window":
        steps = f"SELECT avg(score) AS score, max(label) AS label FROM ({steps}) GROUP BY series_id, start_idx, anomalous"
    shown = ", ".join(f"round(max({s}) FILTER (anomalous = {a}), 5) AS {p}_{s}" if s != "count" else f"max({s}) FILTER (anomalous = {a}) AS {p}_{s}" for a, p in ((0, "normal"), (1, "anomaly")) for s in _STATS)
    return f"""
    SELECT * FROM (WITH
      a AS (SELECT *, 1 AS anomalous FROM (SELECT series_id, start_idx, pos, {", ".join(_CHS)}, label, max(label) OVER (PARTITION BY series_id, start_idx) AS hit FROM pe) WHERE hit = 1),
      k AS (
        SELECT series_id, start_idx FROM (
          SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '123', 'normals', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx) AS rk
          FROM (SELECT DISTINCT series_id, start_idx FROM wz WHERE {normals}))
        WHERE rk <= (SELECT trunc(count(*) * 0.7::DOUBLE) FROM (SELECT DISTINCT series_id, start_idx FROM a))),
      b AS (
        SELECT series_id, start_idx, pos, {", ".join(_CHS)}, label, anomalous FROM a UNION ALL
        SELECT w.series_id, w.start_idx, w.pos, {errs}, 0, 0 FROM wz w JOIN rm m USING (pos) JOIN k USING (series_id, start_idx)),
      f AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS f_{c}" for c in _CHS)} FROM b WHERE anomalous = 0),
      t AS (SELECT anomalous, {agg} FROM ({melted}) GROUP BY anomalous),
      c AS (
        SELECT score, sum(pos1) OVER d AS tp, sum(neg1) OVER d AS fp, pos1, neg1, sum(pos1) OVER () AS p, sum(neg1) OVER () AS n FROM (
          SELECT score, count(*) FILTER (label = 1) AS pos1, count(*) FILTER (label = 0) AS neg1 FROM ({steps}) GROUP BY score) WINDOW d AS (ORDER BY score DESC)),
      r AS (
        SELECT sum(neg1 * (tp - pos1 + pos1 / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS roc_auc, arg_max(score, (tp / p - fp / n, score)) AS threshold,
               arg_max(tp / p, (tp / p - fp / n, score)) AS tpr, arg_max(fp / n, (tp / p - fp / n, score)) AS fpr, max(p) AS p, max(n) AS n FROM c)
    SELECT round(roc_auc, 6) AS roc_auc, round(threshold, 5) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
           round(tpr * p / (tpr * p + fpr * n + 1e-12::DOUBLE), 6) AS precision, round(tpr, 6) AS recall,
           round(2 * tpr * (tpr * p / (tpr * p + fpr * n + 1e-12::DOUBLE)) / (tpr * p / (tpr * p + fpr * n + 1e-12::DOUBLE) + tpr + 1e-12::DOUBLE), 6) AS f1,
           CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n, '{source}' AS normals_from, {", ".join(f"round(f_{c}, 6) AS factor_{c}" for c in _CHS)},
           (SELECT count(*) FROM k) AS normal_windows, (SELECT count(*) FROM (SELECT DISTINCT series_id, start_idx FROM a)) AS anomalous_windows, s.*
    FROM r, f, (SELECT {shown} FROM t) s)"""


def _evaluated(spark, sf, keep, level, source):
    """Clean windows, injection, a detector fitted on the clean ones, and the record over both."""
    good = v.scaled_windows(spark, sf).drop("labels")
    fitted = detect.recon_mean_fit(good, v.CH)
    bad = inject.really_changed(v.corrupted_windows(spark, sf, list(v.MIXED), clean_windows=good))
    errors = score.window_errors(detect.recon_mean(bad, fitted, v.CH), v.WIN, v.CH)
    clean_errors = score.window_errors(detect.recon_mean(good.where(keep), fitted, v.CH), v.WIN, v.CH, labels=None)
    record, _ = evaluate.evaluate(errors, clean_errors, v.WIN, v.CH, source, ratio=0.7, level=level)
    numbers = [r(c, 5 if c == "threshold" else 6).alias(c) for c in ("roc_auc", "threshold", "tpr", "fpr", "precision", "recall", "f1")]
    stats = [(F.col(f"{p}_stats")[s] if s == "count" else r(F.col(f"{p}_stats")[s], 5)).alias(f"{p}_{s}") for p in ("normal", "anomaly") for s in _STATS]
    factors = [r(F.col("normalisation")[c]).alias(f"factor_{c}") for c in v.CH]
    return record.select(*numbers, "p", "n", "normals_from", *factors, "normal_windows", "anomalous_windows", *stats)


_CHS = ("value", "k", "gap_s")


@query("evaluate_corrupted", v.sql(_evaluation_sql("true", "step", "evaluation_set"), "pe", "rm", "wz"))
def evaluate_corrupted(spark, sf):
    return _evaluated(spark, sf, F.lit(True), "step", "evaluation_set")


@query("metrics_record_external", v.sql(_evaluation_sql("start_idx % 32 = 0", "window", "validation"), "pe", "rm", "wz"))
def metrics_record_external(spark, sf):
    """Normal errors from outside the evaluation set, here every other clean window; scores by window."""
    return _evaluated(spark, sf, F.col("start_idx") % 32 == 0, "window", "validation")


def flagship(spark, sf):
    """One long series: split, fit on clean training rows, score every validation step, judge the flag."""
    rows = stage(split.mark_normal(v.split_long(spark, sf), v.KEY, v.L), "split")
    normal = rows.where("normal = 1")
    fitted = scale.standard_fit(split.scaler_fit_rows(normal, v.CH), v.CH)
    profile = scale.standard_fit(scale.scale_apply(normal.where("split = 'train'"), fitted, v.CH), v.CH)
    means = scale.scaler_params(profile, v.CH)

    def errors(part):
        z = scale.scale_apply(part, fitted, v.CH)
        return z.withColumns({c: score.elementwise_error(means[f"c{i}"], F.col(c)) for i, c in enumerate(v.CH)})

    clean_val = errors(normal.where("split = 'val'"))
    factors = score.median_normaliser(windows.melt_channels(clean_val, [], v.CH))
    val = score.normalise(errors(rows.where("split = 'val'")), factors, v.CH)
    steps = val.select(score.mean_of(v.CH).alias("score"), F.col("is_anomaly").alias("label"))
    out = score.metrics_record(steps)
    return out.withColumns({c: r(c) for c in ("roc_auc", "threshold", "tpr", "fpr", "precision", "recall", "f1")})


query("flagship", v.sql(f"""
    SELECT round(auc, 6) AS roc_auc, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(prec, 6) AS precision,
           round(tpr, 6) AS recall, round(2 * (prec * tpr) / (prec + tpr + 1e-12::DOUBLE), 6) AS f1, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n,
           'evaluation_set' AS normals_from FROM (
      SELECT *, tpr * p / (tpr * p + fpr * n + 1e-12::DOUBLE) AS prec FROM (
        SELECT sum(neg1 * (tp - pos1 + pos1 / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS auc, arg_max(score, (tp / p - fp / n, score)) AS threshold,
               arg_max(tp / p, (tp / p - fp / n, score)) AS tpr, arg_max(fp / n, (tp / p - fp / n, score)) AS fpr, max(p) AS p, max(n) AS n FROM (
          SELECT score, sum(pos1) OVER d AS tp, sum(neg1) OVER d AS fp, pos1, neg1, sum(pos1) OVER () AS p, sum(neg1) OVER () AS n FROM (
            SELECT ({" + ".join(f"abs({c} - m_{c}) / s_{c} / (f_{c} + 0.001::DOUBLE)" for c in _CHS)}) / 3 AS score,
                   count(*) FILTER (is_anomaly = 1) AS pos1, count(*) FILTER (is_anomaly = 0) AS neg1
            FROM sp, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _CHS)} FROM nr WHERE split = 'train') a,
              (SELECT {", ".join(f"quantile_cont(abs({c} - m_{c}) / s_{c}, 0.5) AS f_{c}" for c in _CHS)} FROM nr,
                 (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _CHS)} FROM nr WHERE split = 'train') WHERE split = 'val') b
            WHERE split = 'val' GROUP BY 1) WINDOW d AS (ORDER BY score DESC))))""", "nr"))(flagship)
