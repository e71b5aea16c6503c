"""Views over the test tables that give every operator realistic input, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clean, detect, inject, scale, score, split, windows
from tidemark.sources.stage import stage
from tidemark.sources.tables import scan_table

L = 16
SPLIT = 0.8
MIN_CHUNK = L * 10
SPLIT_SEED = 42
INJECT_SEED = 123
DELTA = 0.5
CH = ["value", "k", "gap_s"]
KEY = ["series_id"]
WIN = ["series_id", "start_idx"]
ANOMALY_LIMIT = 250.0
TEN_MINUTES = 600_000_000
HOUR = 3_600_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with time as microseconds since the epoch (read as UTC) and the number in `props`."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf, "events").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def keyed(spark: SparkSession, sf: str, long: bool = False) -> DataFrame:
    """Events as telemetry rows without positions: series per user, or one series of everything."""
    series = F.lit(0).cast("long") if long else F.col("user_id")
    return events(spark, sf).select(
        series.alias("series_id"), "us", "event_id", "user_id", "event_type", "value", "k",
        (F.col("value") > ANOMALY_LIMIT).cast("int").alias("is_anomaly"),
    )


def series(spark: SparkSession, sf: str, long: bool = False, staged: bool = False) -> DataFrame:
    """Telemetry rows with dense `idx`, series length `n`, and the seconds since the previous row as third channel."""
    out = split.row_index(keyed(spark, sf, long), KEY, carry_prev={"prev_us": "us"})
    gap = F.coalesce((F.col("us") - F.col("prev_us")) / F.lit(1e6), F.lit(0.0))
    out = out.withColumn("gap_s", gap).drop("prev_us")
    return stage(out, "series") if staged else out


def split_long(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The one long series with `chunk` and `split`."""
    rows = series(spark, sf, long=True, staged=True) if rows is None else rows
    plan = split.chunk_plan(keyed(spark, sf, True), KEY, SPLIT, min_chunk=MIN_CHUNK)
    chosen = split.choose_val_chunks(plan, KEY, SPLIT_SEED)
    return split.chunk_split(rows, plan, chosen, KEY)


def user_windows(spark: SparkSession, sf: str, step: int = L, rows: DataFrame | None = None, label: bool = True) -> DataFrame:
    """Windows of the user series at every `step`-th position."""
    rows = series(spark, sf) if rows is None else rows
    return windows.slide_windows(rows, KEY, CH, L, label="is_anomaly" if label else None, stride=step)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as windows of 8 steps x 8 channels; class 0 plays the anomaly."""
    def channel(c: int):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.get("embedding", p * 8 + c).cast("double"))

    return table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") == 0).cast("int").alias("label"), *[channel(c).alias(f"c{c}") for c in range(8)]
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run records read from the user series: one run per user, one epoch per row."""
    return series(spark, sf).select(
        F.col("series_id").alias("run_id"), "idx", (F.col("idx") + 1).alias("epoch"),
        F.col("value").alias("val_loss"), (F.col("k") / 100).alias("val_roc_auc"),
    )


def scaled_windows(spark: SparkSession, sf: str, clean_only: bool = True) -> DataFrame:
    """Non-overlapping windows of the user series, scaled by the values in windows without an anomaly.

    The raw windows are written once; scaling is a map over that table.
    """
    every = stage(user_windows(spark, sf), "windows")
    good = clean.filter_windows_by_label(every, anomalous=False)
    fitted = scale.standard_fit(windows.explode_positions(good, [], CH), CH)
    return scale.scale_windows(good if clean_only else every, fitted, CH)


def corrupted_windows(
    spark: SparkSession, sf: str, types: list[str], ratio: float = 0.5, clean_windows: DataFrame | None = None
) -> DataFrame:
    """A share of the clean scaled windows, each with one anomaly on one channel."""
    good = scaled_windows(spark, sf).drop("labels") if clean_windows is None else clean_windows.drop("labels")
    picked = inject.pick_type_channel(inject.pick_windows(good, WIN, ratio, INJECT_SEED), WIN, types, CH, seed=INJECT_SEED)
    directions = inject.principal_directions(good, CH) if "subspace" in types else None
    return inject.corrupt(picked, inject.injector_fit(good, CH), WIN, CH, L, DELTA, INJECT_SEED, types, directions)


def scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All scaled windows with labels, reconstructed as the mean of the clean ones."""
    every = scaled_windows(spark, sf, clean_only=False)
    fitted = detect.recon_mean_fit(clean.filter_windows_by_label(every, anomalous=False), CH)
    out = detect.recon_mean(every, fitted, CH)
    return out.withColumn("anomalous", clean.has_anomaly("labels").cast("int"))


def step_errors(spark: SparkSession, sf: str, kind: str = "abs", scored: DataFrame | None = None) -> DataFrame:
    """Errors per (window, pos) with `label` and the window's `anomalous` flag."""
    scored = scored_windows(spark, sf) if scored is None else scored
    return score.window_errors(scored, [*WIN, "anomalous"], CH, kind)


# ---------------------------------------------------------------- the same in SQL

_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
        SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
               CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS k
        FROM events"""),
    "su": (("ev",), """
        SELECT user_id AS series_id, row_number() OVER w - 1 AS idx, us, event_id, event_type, value, k,
               coalesce((us - lag(us) OVER w) / 1e6::DOUBLE, 0.0::DOUBLE) AS gap_s,
               CAST(value > 250 AS INTEGER) AS is_anomaly, count(*) OVER (PARTITION BY user_id) AS n
        FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)"""),
    "sl": (("ev",), """
        SELECT 0::BIGINT AS series_id, row_number() OVER w - 1 AS idx, us, event_id, user_id, event_type, value, k,
               coalesce((us - lag(us) OVER w) / 1e6::DOUBLE, 0.0::DOUBLE) AS gap_s,
               CAST(value > 250 AS INTEGER) AS is_anomaly, count(*) OVER () AS n
        FROM ev WINDOW w AS (ORDER BY us, event_id)"""),
    "plan": ((), """
        SELECT n, max(c) AS chunks, CAST(ceil(max(c) * (1 - 0.8::DOUBLE)) AS INTEGER) AS val_chunks,
               n // max(c) AS chunk_size
        FROM (SELECT count(*) AS n FROM events) t, range(1, 201) q(c)
        WHERE n // c >= 160 AND abs(ceil(c * (1 - 0.8::DOUBLE)) / c - (1 - 0.8::DOUBLE)) <= 0.01::DOUBLE GROUP BY n"""),
    "chosen": (("plan",), """
        SELECT chunk FROM (
          SELECT c AS chunk, val_chunks,
                 row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'chunk', '0', c::VARCHAR)), c) AS rk
          FROM plan, range(0, 200) q(c) WHERE c < chunks) WHERE rk <= val_chunks"""),
    "sp": (("sl", "chosen"), """
        SELECT s.*, CAST(least(s.idx // p.chunk_size, p.chunks - 1) AS INTEGER) AS chunk,
               CASE WHEN least(s.idx // p.chunk_size, p.chunks - 1) IN (SELECT chunk FROM chosen) THEN 'val' ELSE 'train' END AS split
        FROM sl s, plan p"""),
    "nr": (("sp",), """
        SELECT * FROM (
          SELECT *, CASE WHEN split = 'train' THEN max(CASE WHEN split = 'train' THEN is_anomaly END) OVER w
                    ELSE max(CASE WHEN split = 'val' THEN is_anomaly END) OVER w END AS near
          FROM sp WINDOW w AS (ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))
        WHERE coalesce(near, 0) = 0 OR n < 16"""),
    # one row per (window, position) of complete non-overlapping windows of 16
    "wl": (("su",), """
        SELECT series_id, (idx // 16) * 16 AS start_idx, idx % 16 AS pos, value, k, gap_s, is_anomaly
        FROM su WHERE (idx // 16) * 16 + 16 <= n"""),
    # the same, scaled by the mean and population std of the values in windows without an anomaly
    "wc": (("wl",), """
        SELECT w.* FROM wl w JOIN (
          SELECT series_id, start_idx FROM wl GROUP BY ALL HAVING max(is_anomaly) = 0) c USING (series_id, start_idx)"""),
    "wz": (("wc",), """
        SELECT series_id, start_idx, pos, (value - mv) / sv AS value, (k - mk) / sk AS k, (gap_s - mg) / sg AS gap_s
        FROM wc, (SELECT avg(value) mv, stddev_pop(value) sv, avg(k) mk, stddev_pop(k) sk, avg(gap_s) mg, stddev_pop(gap_s) sg
                  FROM wc) f"""),
    # all windows under the same scaling, with labels
    "az": (("wc",), """
        SELECT series_id, start_idx, pos, (value - mv) / sv AS value, (k - mk) / sk AS k, (gap_s - mg) / sg AS gap_s,
               is_anomaly AS label, max(is_anomaly) OVER (PARTITION BY series_id, start_idx) AS anomalous
        FROM wl, (SELECT avg(value) mv, stddev_pop(value) sv, avg(k) mk, stddev_pop(k) sk, avg(gap_s) mg, stddev_pop(gap_s) sg
                  FROM wc) f"""),
    "rm": (("wz",), "SELECT pos, avg(value) AS value, avg(k) AS k, avg(gap_s) AS gap_s FROM wz GROUP BY pos"),
    "er": (("az", "rm"), """
        SELECT a.series_id, a.start_idx, a.pos, abs(m.value - a.value) AS value, abs(m.k - a.k) AS k,
               abs(m.gap_s - a.gap_s) AS gap_s, a.label, a.anomalous
        FROM az a JOIN rm m USING (pos)"""),
    "el": (("er",), """
        SELECT anomalous, 'value' AS channel, value AS err FROM er UNION ALL SELECT anomalous, 'k', k FROM er
        UNION ALL SELECT anomalous, 'gap_s', gap_s FROM er"""),
    "md": (("el",), "SELECT channel, quantile_cont(err, 0.5) AS factor FROM el WHERE anomalous = 0 GROUP BY channel"),
    "en": (("er", "md"), """
        SELECT series_id, start_idx, pos, label, anomalous, value / (fv + 0.001::DOUBLE) AS value, k / (fk + 0.001::DOUBLE) AS k,
               gap_s / (fg + 0.001::DOUBLE) AS gap_s
        FROM er, (SELECT max(factor) FILTER (channel = 'value') AS fv, max(factor) FILTER (channel = 'k') AS fk,
                         max(factor) FILTER (channel = 'gap_s') AS fg FROM md) f"""),
    "ss": (("en",), """
        SELECT series_id, start_idx, pos, anomalous, label, (value + k + gap_s) / 3.0::DOUBLE AS score FROM en"""),
    "rc": (("ss",), """
        SELECT score, sum(pos1) OVER d AS tp, sum(neg1) OVER d AS fp, pos1, neg1, sum(pos1) OVER () AS p, sum(neg1) OVER () AS n FROM (
          SELECT score, count(*) FILTER (label = 1) AS pos1, count(*) FILTER (label = 0) AS neg1 FROM ss GROUP BY score)
        WINDOW d AS (ORDER BY score DESC)"""),
    "mr": (("rc",), """
        SELECT sum(neg1 * (tp - pos1 + pos1 / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS roc_auc,
               arg_max(score, (tp / p - fp / n, score)) AS threshold, arg_max(tp / p, (tp / p - fp / n, score)) AS tpr,
               arg_max(fp / n, (tp / p - fp / n, score)) AS fpr, max(p) AS p, max(n) AS n FROM rc"""),
    "mf": (("mr",), """
        SELECT *, tpr AS recall, 2 * (prec * tpr) / (prec + tpr + 1e-12::DOUBLE) AS f1
        FROM (SELECT *, tpr * p / (tpr * p + fpr * n + 1e-12::DOUBLE) AS prec FROM mr)"""),
}


def u_sql(purpose: str, *ids: str, seed: int = INJECT_SEED) -> str:
    """SQL form of `hashing.uniform`."""
    key = ", ".join([f"'{seed}'", f"'{purpose}'", *[f"({i})::VARCHAR" for i in ids]])
    return f"(('0x' || substr(md5(concat_ws('|', {key})), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _corrupt_cte(types: tuple[str, ...], ratio: float = 0.5) -> str:
    """One row per (corrupted window, pos): old value `z`, new value `x`, `label`."""
    w = ("series_id", "start_idx")
    sign = f"CASE WHEN {u_sql('sign', *w)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    place = f"floor({u_sql('place', *w)} * 16)"
    tone = lambda m: f"cos(2 * pi() * (0.1::DOUBLE + 0.1::DOUBLE * {u_sql(f'freq{m}', *w)}) * pos + 2 * pi() * {u_sql(f'phase{m}', *w)})"
    x = {
        "gwn": f"z + sqrt(0.5::DOUBLE) * sd * sqrt(-2 * ln(1 - {u_sql('gwn.r', *w, 'pos')})) * cos(2 * pi() * {u_sql('gwn.a', *w, 'pos')})",
        "constant": f"z + {sign} * sqrt(0.5::DOUBLE) * sd",
        "step": f"CASE WHEN pos >= {place} THEN z + {sign} * sqrt(8.0::DOUBLE / (16 - {place})) * sd ELSE z END",
        "impulse": f"CASE WHEN pos = {place} THEN z + {sign} * sqrt(8.0::DOUBLE) * sd ELSE z END",
        "narrowband": f"z + sqrt(1.0::DOUBLE / 3) * sd * ({tone(0)} + {tone(1)} + {tone(2)})",
    }
    options = "[" + ", ".join(f"'{t}'" for t in types) + "]"
    cases = " ".join(f"WHEN '{t}' THEN {x[t]}" for t in types)
    return f"""
        SELECT *, CAST(abs(z - x) > 1e-10::DOUBLE AS INTEGER) AS label FROM (
          SELECT *, CASE anomaly_type {cases} END AS x FROM (
            SELECT series_id, start_idx, pos, rank, anomaly_type, channel,
                   CASE channel WHEN 'value' THEN value WHEN 'k' THEN k ELSE gap_s END AS z,
                   CASE channel WHEN 'value' THEN sv WHEN 'k' THEN sk ELSE sg END AS sd
            FROM wz JOIN (
              SELECT series_id, start_idx, rank,
                     {options}[1 + floor({u_sql('type', *w)} * {len(types)})::INTEGER] AS anomaly_type,
                     ['value', 'k', 'gap_s'][1 + floor({u_sql('channel', *w)} * 3)::INTEGER] AS channel
              FROM (SELECT series_id, start_idx, count(*) OVER () AS total,
                           row_number() OVER (ORDER BY md5(concat_ws('|', '123', 'pick', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx) AS rank
                    FROM (SELECT DISTINCT series_id, start_idx FROM wz))
              WHERE rank <= trunc(total * {ratio}::DOUBLE)) p USING (series_id, start_idx),
            (SELECT stddev_pop(value) sv, stddev_pop(k) sk, stddev_pop(gap_s) sg FROM wz) f))"""


MIXED = ("gwn", "constant", "step", "impulse")
for _t in ("gwn", "constant", "step", "impulse", "narrowband"):
    _CTE["cz_" + _t] = (("wz",), _corrupt_cte((_t,)))
_CTE["cz"] = (("wz",), _corrupt_cte(MIXED))
# errors of corrupted windows (1) beside their clean originals (0) under the mean reconstruction
_CTE["pe"] = (("cz", "rm"), """
    SELECT c.series_id, c.start_idx, c.pos, c.channel, c.label, c.anomaly_type,
           abs(m.value - CASE WHEN c.channel = 'value' THEN c.x ELSE w.value END) AS value,
           abs(m.k - CASE WHEN c.channel = 'k' THEN c.x ELSE w.k END) AS k,
           abs(m.gap_s - CASE WHEN c.channel = 'gap_s' THEN c.x ELSE w.gap_s END) AS gap_s,
           abs(m.value - w.value) AS clean_value, abs(m.k - w.k) AS clean_k, abs(m.gap_s - w.gap_s) AS clean_gap_s
    FROM cz c JOIN wz w USING (series_id, start_idx, pos) JOIN rm m USING (pos)""")


def sql(body: str, *ctes: str) -> str:
    """`body` with the named common tables (and what they need) in front."""
    needed: list[str] = []

    def add(name: str) -> None:
        for d in _CTE[name][0]:
            add(d)
        if name not in needed:
            needed.append(name)

    for c in ctes:
        add(c)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in needed) + "\n" + body
