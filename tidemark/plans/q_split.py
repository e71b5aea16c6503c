"""Queries: positions, splits, anomaly surroundings, strides, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import clean, split, windows
from tidemark.plans import views as v
from tidemark.plans.registry import joined, query, r
from tidemark.sources.stage import stage


@query("row_index", v.sql("SELECT series_id, event_id, idx, n, round(gap_s, 6) AS gap_s FROM su", "su"))
def row_index(spark, sf):
    return v.series(spark, sf).select("series_id", "event_id", "idx", "n", r("gap_s").alias("gap_s"))


@query("row_index_null_key", """
    WITH e AS (SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS series_id, event_id, ts FROM events)
    SELECT series_id, event_id, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n
    FROM e WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)""")
def row_index_null_key(spark, sf):
    """A third of the rows have no key: they are one series."""
    rows = v.events(spark, sf).withColumn("series_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5))
    return split.row_index(rows.select("series_id", "event_id", "us"), ["series_id"]).select("series_id", "event_id", "idx", "n")


@query("chunk_split_short", """
    WITH e AS (SELECT event_id % 700 AS series_id, event_id, row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts, event_id) - 1 AS idx,
                      count(*) OVER (PARTITION BY event_id % 700) AS n FROM events)
    SELECT series_id, idx, CAST(CASE WHEN n < 3 THEN 2 ELSE least(idx // greatest(n // 3, 1), 2) END AS INTEGER) AS chunk FROM e""")
def chunk_split_short(spark, sf):
    """Series with fewer rows than chunks are all in their last chunk."""
    rows = v.events(spark, sf).select((F.col("event_id") % 700).alias("series_id"), "event_id", "us")
    rows = split.row_index(rows, ["series_id"])
    plan = split.fixed_chunk_plan(rows, ["series_id"], 3, 0.34)
    return split.chunk_split(rows, plan, split.choose_val_chunks(plan, ["series_id"]), ["series_id"]).select("series_id", "idx", "chunk")


@query("row_index_long", v.sql("SELECT event_id, idx, n, round(gap_s, 6) AS gap_s FROM sl", "sl"))
def row_index_long(spark, sf):
    return v.series(spark, sf, long=True).select("event_id", "idx", "n", r("gap_s").alias("gap_s"))


@query("chunk_plan", """
    WITH sizes AS (SELECT 'all' AS series, count(*) AS n FROM events
                   UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type)
    SELECT series, s.n, max(c) AS chunks, CAST(ceil(max(c) * (1 - 0.8::DOUBLE)) AS INTEGER) AS val_chunks, s.n // max(c) AS chunk_size
    FROM sizes s LEFT JOIN range(1, 201) q(c)
      ON s.n // c >= 160 AND abs(ceil(c * (1 - 0.8::DOUBLE)) / c - (1 - 0.8::DOUBLE)) <= 0.01::DOUBLE
    GROUP BY series, s.n""")
def chunk_plan(spark, sf):
    rows = v.events(spark, sf)
    both = rows.select(F.explode(F.array(F.lit("all"), F.col("event_type"))).alias("series"))
    return split.chunk_plan(both, ["series"], v.SPLIT, min_chunk=v.MIN_CHUNK, on_missing="null").withColumn("chunks", F.col("chunks").cast("long"))


@query("choose_val_chunks", v.sql("SELECT 0::BIGINT AS series_id, chunk FROM chosen", "chosen"))
def choose_val_chunks(spark, sf):
    plan = split.chunk_plan(v.keyed(spark, sf, True), v.KEY, v.SPLIT, min_chunk=v.MIN_CHUNK)
    return split.choose_val_chunks(plan, v.KEY, v.SPLIT_SEED).withColumn("chunk", F.col("chunk").cast("long"))


@query("chunk_split", v.sql("SELECT idx, event_id, chunk, split FROM sp", "sp"))
def chunk_split(spark, sf):
    return v.split_long(spark, sf).select("idx", "event_id", "chunk", "split")


@query("fixed_chunk_split", v.sql("""
    SELECT series_id, idx, CAST(least(idx // (n // 5), 4) AS INTEGER) AS chunk,
           CASE WHEN least(idx // (n // 5), 4) = pick THEN 'val' ELSE 'train' END AS split
    FROM su JOIN (
      SELECT series_id, c AS pick FROM (
        SELECT series_id, c, row_number() OVER (PARTITION BY series_id
          ORDER BY md5(concat_ws('|', '42', 'chunk', series_id::VARCHAR, c::VARCHAR)), c) AS rk
        FROM (SELECT DISTINCT series_id FROM su), range(0, 5) q(c)) WHERE rk = 1) USING (series_id)""", "su"))
def fixed_chunk_split(spark, sf):
    rows = v.series(spark, sf, staged=True)
    plan = split.fixed_chunk_plan(rows, v.KEY, 5, 0.2)
    chosen = split.choose_val_chunks(plan, v.KEY, v.SPLIT_SEED)
    return split.chunk_split(rows, plan, chosen, v.KEY).select("series_id", "idx", "chunk", "split")


@query("ordered_split", v.sql("""
    SELECT series_id, idx, rn, CASE WHEN rn < floor(0.8::DOUBLE * picked) THEN 'train' ELSE 'val' END AS split FROM (
      SELECT series_id, idx, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS rn,
             count(*) OVER (PARTITION BY series_id) AS picked FROM su WHERE idx % 4 = 0)""", "su"))
def ordered_split(spark, sf):
    return split.ordered_split(v.series(spark, sf, staged=True), v.KEY, 0.8, 4).select("series_id", "idx", "rn", "split")


_FRAMED = """SELECT *, count(*) OVER f AS c, max(is_anomaly) OVER f AS a FROM su
    WINDOW f AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)"""


@query("anomaly_window_starts", v.sql(f"SELECT series_id, idx AS start_idx FROM ({_FRAMED}) WHERE c = 16 AND a = 1", "su"))
def anomaly_window_starts(spark, sf):
    return split.anomaly_starts(v.series(spark, sf), v.KEY, v.L).select("series_id", "start_idx")


@query("anomaly_window_labels", v.sql("""
    SELECT series_id, idx AS start_idx, array_to_string(ls, ',') AS labels FROM (
      SELECT series_id, idx, list(is_anomaly) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS ls FROM sl)
    WHERE len(ls) = 16 AND list_contains(ls, 1)""", "sl"))
def anomaly_window_labels(spark, sf):
    out = split.anomaly_windows(v.series(spark, sf, long=True), v.KEY, v.L)
    return out.select("series_id", "start_idx", joined("labels", 1).alias("labels"))


_COVERED = """SELECT series_id, idx, CASE WHEN n >= 16 THEN coalesce(max(is_anomaly) OVER
    (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 0) ELSE 0 END AS covered FROM su"""


@query("anomaly_covered_rows", v.sql(_COVERED, "su"))
def anomaly_covered_rows(spark, sf):
    return split.anomaly_covered_rows(v.series(spark, sf), v.KEY, v.L).select("series_id", "idx", "covered")


@query("extract_anomalous_rows", v.sql(f"SELECT series_id, count(*) FILTER (covered = 1) AS near, count(*) FILTER (covered = 0) AS rest FROM ({_COVERED}) GROUP BY series_id", "su"))
def extract_anomalous_rows(spark, sf):
    near, rest = split.extract_anomalous_rows(v.series(spark, sf, staged=True), v.KEY, v.L)
    both = near.select("series_id", F.lit(1).alias("near")).unionByName(rest.select("series_id", F.lit(0).alias("near")))
    return both.groupBy("series_id").agg(F.count_if(F.col("near") == 1).alias("near"), F.count_if(F.col("near") == 0).alias("rest"))


@query("normal_rows", v.sql("SELECT idx, split FROM nr", "nr"))
def normal_rows(spark, sf):
    return split.normal_rows(v.split_long(spark, sf), v.KEY, v.L).select("idx", "split")


@query("normal_rows_label_list", v.sql("""
    SELECT idx, split FROM (
      SELECT *, CASE WHEN split = 'train' THEN max(CASE WHEN split = 'train' THEN hit END) OVER w ELSE max(CASE WHEN split = 'val' THEN hit END) OVER w END AS near
      FROM (SELECT *, CAST(value > 250 OR (event_type = 'error' AND k > 90) AS INTEGER) AS hit FROM sp)
      WINDOW w AS (ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))
    WHERE coalesce(near, 0) = 0 OR n < 16""", "sp"))
def normal_rows_label_list(spark, sf):
    """Two label columns, either of which marks an anomaly; a list with a column that is not there marks none."""
    rows = v.split_long(spark, sf).withColumn("fault", ((F.col("event_type") == "error") & (F.col("k") > 90)).cast("int"))
    normal = split.normal_rows(rows, v.KEY, v.L, label=["is_anomaly", "fault"])
    kept = split.mark_normal(normal.select("series_id", "idx", "split", "n", "is_anomaly"), v.KEY, v.L, label=["is_anomaly", "absent"])
    return kept.where("normal = 1").select("idx", "split")


@query("scaler_fit_rows", v.sql("SELECT round(value, 6) AS value, k, round(gap_s, 6) AS gap_s FROM nr WHERE split = 'train'", "nr"))
def scaler_fit_rows(spark, sf):
    out = split.scaler_fit_rows(split.normal_rows(v.split_long(spark, sf), v.KEY, v.L), v.CH)
    return out.select(r("value").alias("value"), "k", r("gap_s").alias("gap_s"))


def _stride_sql(overlap: float, boundary: str) -> str:
    step = split.stride_step(v.L, overlap)
    end = "run_end" if boundary == "strict" else "n - 1"
    return v.sql(f"""
    SELECT split, idx, run_start FROM (
      SELECT *, min(idx) OVER (PARTITION BY split, run) AS run_start, max(idx) OVER (PARTITION BY split, run) AS run_end FROM (
        SELECT split, idx, n, idx - row_number() OVER (PARTITION BY split ORDER BY idx) AS run FROM nr))
    WHERE (idx - run_start) % {step} = 0 AND idx + 15 <= {end}""", "nr")


@query("run_stride", _stride_sql(0.7, "strict"))
def run_stride(spark, sf):
    normal = split.normal_rows(v.split_long(spark, sf), v.KEY, v.L)
    return split.run_stride(normal, ["series_id", "split"], v.L, 0.7).select("split", "idx", "run_start")


@query("run_stride_open", _stride_sql(0.5, "open"))
def run_stride_open(spark, sf):
    normal = split.normal_rows(v.split_long(spark, sf), v.KEY, v.L)
    return split.run_stride(normal, ["series_id", "split"], v.L, 0.5, "open").select("split", "idx", "run_start")


@query("global_stride", v.sql("""
    SELECT split, idx FROM (SELECT split, idx, row_number() OVER (PARTITION BY split ORDER BY idx) - 1 AS rk FROM nr)
    WHERE rk % 5 = 0""", "nr"))
def global_stride(spark, sf):
    normal = split.normal_rows(v.split_long(spark, sf), v.KEY, v.L)
    return split.global_stride(normal, ["series_id", "split"], v.L, 0.7).select("split", "idx")


@query("shuffle_order", v.sql("""
    SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type
      ORDER BY md5(concat_ws('|', '42', 'shuffle', event_type, event_id::VARCHAR)), event_id) AS ord FROM ev""", "ev"))
def shuffle_order(spark, sf):
    return split.shuffle_order(v.events(spark, sf).select("event_type", "event_id"), ["event_type"], ["event_id"], v.SPLIT_SEED)


@query("set_difference", "SELECT user_id, event_type FROM events EXCEPT SELECT user_id, event_type FROM events WHERE value > 60")
def set_difference(spark, sf):
    rows = v.events(spark, sf)
    return split.set_difference(rows, rows.where("value > 60"), ["user_id", "event_type"])


@query("set_intersect", "SELECT user_id, event_type FROM events WHERE value > 150 INTERSECT SELECT user_id, event_type FROM events WHERE value < 2")
def set_intersect(spark, sf):
    rows = v.events(spark, sf)
    return split.set_intersect(rows.where("value > 150"), rows.where("value < 2"), ["user_id", "event_type"])


@query("set_union", "SELECT user_id, event_type FROM events WHERE value > 150 UNION SELECT user_id, event_type FROM events WHERE value < 2")
def set_union(spark, sf):
    rows = v.events(spark, sf)
    return split.set_union(rows.where("value > 150"), rows.where("value < 2"), ["user_id", "event_type"])


def _labelled_windows(spark, sf):
    """Ids and labels of the windows at every position; no channel is packed for them."""
    flag = clean.has_anomaly("labels").cast("int").alias("label")
    return windows.slide_windows(v.series(spark, sf), v.KEY, [], v.L, label="is_anomaly", stride=1).select(*v.WIN, flag)


_LABELLED = f"SELECT series_id, idx AS start_idx, a AS label FROM ({_FRAMED}) WHERE c = 16"


@query("balance_ratio", v.sql(f"""
    SELECT series_id, start_idx, label FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', 'balance', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx) AS rk,
             count(*) FILTER (label = 0) OVER () AS nn, count(*) FILTER (label = 1) OVER () AS na
      FROM ({_LABELLED}))
    WHERE CASE WHEN na >= CAST(trunc(nn / 2.0::DOUBLE) AS BIGINT) THEN label = 0 OR rk <= CAST(trunc(nn / 2.0::DOUBLE) AS BIGINT)
               ELSE label = 1 OR rk <= na * 2 END""", "su"))
def balance_ratio(spark, sf):
    return split.balance_ratio(_labelled_windows(spark, sf), v.WIN, "label", 2.0, v.SPLIT_SEED)


@query("balance_equal", v.sql(f"""
    SELECT series_id, start_idx, label FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', 'balance', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx) AS rk,
             count(*) FILTER (label = 0) OVER () AS nn, count(*) FILTER (label = 1) OVER () AS na
      FROM ({_LABELLED})) WHERE rk <= least(nn, na)""", "su"))
def balance_equal(spark, sf):
    return split.balance_ratio(_labelled_windows(spark, sf), v.WIN, "label", 1, v.SPLIT_SEED)


@query("sample_normals", v.sql(f"""
    WITH labelled AS ({_LABELLED}), ranked AS (
      SELECT series_id, start_idx, row_number() OVER (
        ORDER BY md5(concat_ws('|', '42', 'normals', series_id::VARCHAR, start_idx::VARCHAR)), series_id, start_idx) AS rk
      FROM labelled WHERE label = 0)
    SELECT series_id, start_idx FROM ranked WHERE rk <= (SELECT CAST(trunc(count(*) * 1.5::DOUBLE) AS BIGINT) FROM labelled WHERE label = 1)
    """.replace("WITH labelled", "SELECT * FROM (WITH labelled") + ")", "su"))
def sample_normals(spark, sf):
    labelled = stage(_labelled_windows(spark, sf), "labelled")
    out = split.sample_normals(labelled.where("label = 0"), labelled.where("label = 1"), v.WIN, 1.5, v.SPLIT_SEED)
    return out.select(*v.WIN)
