"""Operators against brute force and by their properties, on small edge cases."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import clean, detect, evaluate, inject, joins, resample, runs, scale, score, split, windows
from tidemark.sources import keyvalue, store


def rows_of(spark, values, labels=None, s=0):
    labels = labels or [0] * len(values)
    data = [(s, i, 1_000_000 * i, i, float(x), int(y), len(values)) for i, (x, y) in enumerate(zip(values, labels))]
    return spark.createDataFrame(data, "s int, idx long, us long, event_id long, x double, is_anomaly int, n long")


# ---------------------------------------------------------------- splits

def admissible(n, chunks, share, least):
    """The two conditions on a chunk count: chunks are long enough, and whole validation chunks come close to the share."""
    return n // chunks >= least and abs(math.ceil(chunks * share) / chunks - share) <= 0.01


def test_chunk_plan(spark):
    sizes = [1, 50, 800, 1000, 4321, 9999]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "s int, n long")
    rows = df.select("s", F.explode(F.sequence(F.lit(1), "n")))
    for split_share, min_chunk in ((0.8, 10), (0.7, 40), (0.9, 160)):
        plan = {r.s: r for r in split.chunk_plan(rows, ["s"], split_share, 200, min_chunk, on_missing="null").collect()}
        for i, n in enumerate(sizes):
            got, fits = plan[i], {c for c in range(1, 201) if admissible(n, c, 1 - split_share, min_chunk)}
            assert (got.chunks is None) == (not fits)
            if fits:  # the count is admissible and no larger one is
                assert got.chunks in fits and not any(c > got.chunks for c in fits)
                assert got.val_chunks == math.ceil(got.chunks * (1 - split_share)) and got.chunk_size == n // got.chunks


def test_chunk_plan_error(spark):
    with pytest.raises(Exception, match="no valid chunk count"):
        split.chunk_plan(rows_of(spark, range(5)), ["s"]).collect()


def test_rows_without_a_plan_stay(spark):
    rows = rows_of(spark, range(40)).unionByName(rows_of(spark, range(5), s=1)).withColumn("s", F.when(F.col("s") == 0, 0))
    plan = split.chunk_plan(rows, ["s"], 0.8, min_chunk=4, on_missing="null")
    out = split.chunk_split(rows, plan, split.choose_val_chunks(plan, ["s"]), ["s"]).collect()
    assert len(out) == 45 and {r.split for r in out if r.s is None} == {"unsplit"} and {r.split for r in out if r.s == 0} == {"train", "val"}


def test_chunk_split_is_complete_and_disjoint(spark):
    rows = rows_of(spark, range(1003))
    plan = split.chunk_plan(rows, ["s"], 0.8, min_chunk=10)
    out = split.chunk_split(rows, plan, split.choose_val_chunks(plan, ["s"]), ["s"], span=64).collect()
    assert sorted(r.idx for r in out) == list(range(1003))
    p = plan.first()
    assert len({r.chunk for r in out}) == p.chunks
    assert len({r.chunk for r in out if r.split == "val"}) == p.val_chunks
    for r in out:
        assert r.chunk == min(r.idx // p.chunk_size, p.chunks - 1)


@pytest.mark.parametrize("labels", ["none", "first", "last", "all", "random"])
@pytest.mark.parametrize("n", [1, 7, 8, 40])
def test_anomaly_surroundings(spark, labels, n):
    length = 8
    rng = random.Random(n)
    y = {"none": [0] * n, "first": [1] + [0] * (n - 1), "last": [0] * (n - 1) + [1], "all": [1] * n,
         "random": [int(rng.random() < 0.1) for _ in range(n)]}[labels]
    rows = rows_of(spark, range(n), y)
    starts = sorted(r.start_idx for r in split.anomaly_windows(rows, ["s"], length, span=5).collect())
    want = [s for s in range(0, n - length + 1) if any(y[s:s + length])]
    assert starts == want
    covered = {r.idx for r in split.anomaly_covered_rows(rows, ["s"], length, span=5).where("covered = 1").collect()}
    assert covered == {i for s in want for i in range(s, s + length)}
    near, rest = split.extract_anomalous_rows(rows, ["s"], length)
    assert near.count() + rest.count() == n


def test_normal_rows_only_look_at_their_own_split(spark):
    y = [0] * 60
    y[29] = 1
    rows = rows_of(spark, range(60), y).withColumn("split", F.when(F.col("idx") < 30, "train").otherwise("val"))
    kept = {r.idx for r in split.normal_rows(rows, ["s"], 5, span=7).collect()}
    assert kept == set(range(25)) | set(range(30, 60))
    assert split.normal_rows(rows.drop("is_anomaly"), ["s"], 5).count() == 60


@pytest.mark.parametrize("overlap", [0, 0.2, 0.5, 0.7, 0.8, 0.9])
@pytest.mark.parametrize("boundary", ["strict", "open"])
def test_run_stride(spark, overlap, boundary):
    length, n = 10, 90
    keep = [i for i in range(n) if not (20 <= i < 27 or i in (50, 51))]
    rows = rows_of(spark, range(n)).where(F.col("idx").isin(keep))
    got = sorted(r.idx for r in split.run_stride(rows, ["s"], length, overlap, boundary, span=16).collect())
    step, groups = max(1, int(length * (1 - overlap))), []
    for i in keep:
        if groups and groups[-1][-1] == i - 1:
            groups[-1].append(i)
        else:
            groups.append([i])
    want = [i for g in groups for i in g[::step] if i + length - 1 <= (g[-1] if boundary == "strict" else n - 1)]
    assert got == want


def test_step_tables():
    overlaps = [0, 0.2, 0.5, 0.7, 0.8, 0.9]
    assert [split.stride_step(16, o) for o in overlaps] == [16, 12, 8, 4, 3, 1]
    assert [split.global_step(16, o) for o in overlaps] == [16, 13, 8, 5, 4, 2]
    assert [split.stride_step(10, o) for o in overlaps] == [10, 8, 5, 3, 1, 1]
    assert [split.global_step(10, o) for o in overlaps] == [10, 8, 5, 3, 2, 1]


@pytest.mark.parametrize("normals, anomalies, ratio, want", [
    (10, 4, 1, (4, 4)), (10, 4, 2, (8, 4)), (10, 6, 2, (10, 5)), (10, 30, 0.5, (10, 20)), (10, 1, 0.5, (1, 1)),
])
def test_balance_ratio(spark, normals, anomalies, ratio, want):
    df = spark.createDataFrame([(i, int(i >= normals)) for i in range(normals + anomalies)], "id long, label int")
    out = split.balance_ratio(df, ["id"], "label", ratio).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == dict(enumerate(want))


# ---------------------------------------------------------------- windows, resampling, scaling

@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 23])
def test_slide_windows(spark, n):
    rows = rows_of(spark, range(n)) if n else rows_of(spark, [0.0]).where("false")
    got = {r.start_idx: list(r.x) for r in windows.slide_windows(rows, ["s"], ["x"], 4, span=5).collect()}
    assert got == {s: [float(v) for v in range(s, s + 4)] for s in range(n - 3)}


def test_unknown_labels_are_null(spark):
    out = windows.slide_windows(rows_of(spark, range(8)).drop("is_anomaly"), ["s"], ["x"], 4, label="is_anomaly").first()
    assert list(out.labels) == [None] * 4


def test_tumble_drops_incomplete_and_overfull(spark):
    data = [(0, t, i, float(i)) for i, t in enumerate([0, 1, 2, 3, 4, 5, 8, 8, 9, 10, 11, 13])]
    rows = spark.createDataFrame(data, "s int, us long, event_id long, x double")
    got = {r.tile: list(r.x) for r in windows.tumble_windows_wide(rows, ["s"], ["x"], 4, 1).collect()}
    assert got == {0: [0.0, 1.0, 2.0, 3.0]}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_upsample(spark, n):
    rng = random.Random(n)
    t = np.cumsum([rng.randint(1, 9) for _ in range(n)])
    y = np.array([rng.random() for _ in range(n)])
    rows = spark.createDataFrame(
        [(0, i, int(t[i]), i, float(y[i]), n) for i in range(n)], "s int, idx long, us long, event_id long, x double, n long"
    )
    points = np.linspace(t[0], t[-1], (n - 1) * 3 + 1)
    out = sorted((r.g, r["x"]) for r in resample.upsample_grid(rows, ["s"], 3).collect())
    assert [g for g, _ in out] == list(range(len(points)))
    np.testing.assert_allclose([x for _, x in out], points)
    line = rows.withColumnRenamed("x", "v")
    got = [r.v for r in resample.upsample(line, ["s"], ["v"], 3, span=2).orderBy("g").collect()]
    np.testing.assert_allclose(got, np.interp(points, t, y))
    cubic = [r.v for r in resample.upsample(line, ["s"], ["v"], 3, "cubic_local").orderBy("g").collect()]
    assert len(cubic) == len(points) and all(c is not None for c in cubic)
    whole = [r.v for r in resample.upsample(line, ["s"], ["v"], 3, "cubic").orderBy("g").collect()]
    np.testing.assert_allclose(whole, not_a_knot(t, y, points), atol=1e-9)


def not_a_knot(t, y, at):
    """The cubic spline with not-a-knot ends by one dense system for the polynomials' coefficients; linear under four points."""
    n = len(t)
    if n < 4:
        return np.interp(at, t, y)
    rows, right = [], []

    def put(values, result):
        row = np.zeros(4 * (n - 1))
        for piece, terms in values.items():
            row[4 * piece : 4 * piece + 4] = terms
        rows.append(row / np.abs(row).max())
        result /= np.abs(row).max()
        right.append(result)

    for k in range(n - 1):  # each polynomial in its own interval's length, to keep the system well conditioned
        put({k: [1, 0, 0, 0]}, y[k])
        put({k: [1, 1, 1, 1]}, y[k + 1])
        if k < n - 2:
            q = float(t[k + 1] - t[k]) / float(t[k + 2] - t[k + 1])
            put({k: [0, 1, 2, 3], k + 1: [0, -q, 0, 0]}, 0)
            put({k: [0, 0, 2, 6], k + 1: [0, 0, -2 * q * q, 0]}, 0)
            if k in (0, n - 3):
                put({k: [0, 0, 0, 1], k + 1: [0, 0, 0, -(q**3)]}, 0)
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(-1, 4)
    piece = np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2)
    d = (at - np.asarray(t)[piece]) / np.diff(t)[piece]
    return (c[piece] * np.stack([np.ones_like(d), d, d * d, d**3], axis=1)).sum(axis=1)


def test_spline_over_many_buckets(spark):
    """One series cut in buckets of the least size, uneven steps, repeated times, two channels, a null and another key."""
    draw = np.random.default_rng(3)
    t = np.cumsum(np.exp(draw.normal(0, 2, 700)).astype(int) + 1) + 10**15
    y, z = draw.normal(size=700), np.cumsum(draw.normal(size=700))
    data = [(None, i, int(t[i]), float(y[i]), float(z[i])) for i in range(700)] + [(7, i, 5 * i, float(i * i), 1.0) for i in range(5)]
    df = spark.createDataFrame(data, "s long, idx long, us long, v double, w double")
    got = resample.upsample(df, ["s"], ["v", "w"], 3, "cubic", span=8)
    mine = sorted((r.g, r["x"], r.v, r.w) for r in got.where("s IS NULL").collect())
    assert [g for g, *_ in mine] == list(range(699 * 3 + 1))
    x = np.array([p[1] for p in mine]) - 1e15
    np.testing.assert_allclose([p[2] for p in mine], not_a_knot(t - 10**15, y, x), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose([p[3] for p in mine], not_a_knot(t - 10**15, z, x), rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose([r.v for r in got.where("s = 7").orderBy("g").collect()], [(r / 3) ** 2 for r in range(13)], atol=1e-9)
    again = [(1, 0, 0, 9.0), (1, 1, 0, 0.0), (1, 2, 1, 1.0), (1, 3, 2, 5.0), (1, 4, 2, 8.0), (1, 5, 3, 27.0), (1, 6, 4, 64.0)]
    out = resample.upsample(spark.createDataFrame(again, "s long, idx long, us long, v double"), ["s"], ["v"], 2, "cubic").orderBy("g").collect()
    np.testing.assert_allclose([r.v for r in out], [r["x"] ** 3 for r in out], atol=1e-9)
    assert len(out) == 13


def test_upsample_a_wide_gap(spark):
    """An interval that holds nearly all grid points is dealt out in pieces."""
    df = spark.createDataFrame([(1, i, i if i < 2999 else 10**9, float(i)) for i in range(3000)], "s long, idx long, us long, v double")
    got = resample.upsample(df, ["s"], ["v"], 20)
    assert got.count() == 2999 * 20 + 1 and got.select("g").distinct().count() == 2999 * 20 + 1
    assert got.agg({"v": "max"}).first()[0] == 2999.0


def test_cubic_is_exact_on_a_cubic(spark):
    rows = rows_of(spark, [i ** 3 for i in range(10)]).withColumnRenamed("x", "v").withColumn("us", F.col("idx"))
    out = resample.upsample(rows, ["s"], ["v"], 4, "cubic_local").where("x between 1 and 8").collect()
    np.testing.assert_allclose([r.v for r in out], [r.x ** 3 for r in out], rtol=1e-9)
    out = resample.upsample(rows, ["s"], ["v"], 4, "cubic").collect()
    np.testing.assert_allclose([r.v for r in out], [r.x ** 3 for r in out], rtol=1e-9, atol=1e-9)


def test_factor_one_and_bad_names(spark):
    rows = rows_of(spark, range(4))
    assert resample.upsample(rows, ["s"], ["x"], 1) is rows
    with pytest.raises(ValueError):
        resample.upsample(rows, ["s"], ["x"], 2, "quintic")
    with pytest.raises(ValueError):
        scale.fit_named(rows, ["x"], "OtherScaler")


def test_scaler_round_trip_and_checks(spark):
    rows = rows_of(spark, [1, 2, 3, 10]).withColumn("c", F.lit(5.0))
    for name in ("StandardScaler", "MinMaxScaler", "RobustScaler-10-90"):
        fitted = scale.fit_named(rows, ["x", "c"], name)
        there = scale.scale_apply(rows, fitted, ["x", "c"])
        assert {r.c for r in there.collect()} == {0.0}  # constant channel: scale 1
        back = scale.scale_inverse(there, fitted, ["x", "c"])
        np.testing.assert_allclose(sorted(r.x for r in back.collect()), [1, 2, 3, 10])
        with pytest.raises(ValueError, match="differ"):
            scale.scale_apply(rows, fitted, ["c", "x"])
    assert scale.scale_apply(rows, None, ["x"]) is rows


def test_fit_on_windows_weights_overlaps(spark):
    rows = rows_of(spark, [1, 5, 2, 8, 3, 9, 4])
    fitted = scale.fit_on_windows(rows, ["s"], ["x"], 3, F.col("idx") % 2 == 0).first()
    values = [v for s in (0, 2, 4) for v in [1, 5, 2, 8, 3, 9, 4][s:s + 3]]
    assert fitted.center == pytest.approx(np.mean(values)) and fitted.scale == pytest.approx(np.std(values))


# ---------------------------------------------------------------- cleaning and joins

def test_mask_is_strict(spark):
    rows = rows_of(spark, range(10), [0, 0, 0, 0, 1, 0, 0, 0, 0, 0])
    out = clean.mask_around_events(rows, ["s"], ["is_anomaly"], 2_000_000, ["x"], span=3).collect()
    assert {r.idx for r in out if r.x is None} == {3, 4, 5}


def test_drop_missing_takes_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert clean.drop_missing(df).count() == 1
    counts = clean.guard_non_finite(df, ["x"]).first()
    assert (counts.nulls, counts.nans, counts.infs) == (1, 1, 0)
    with pytest.raises(Exception, match="non-finite"):
        clean.assert_finite(df, ["x"]).collect()


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof(spark, direction):
    rng = random.Random(3)
    left = [(rng.randint(0, 2), rng.randint(0, 60), i) for i in range(80)]
    right = [(s, t, float(t)) for s in range(3) for t in rng.sample(range(60), 9)]
    out = joins.join_asof(
        spark.createDataFrame(left, "s int, us long, id int"), spark.createDataFrame(right, "s int, us long, v double"),
        ["s"], "us", ["v"], direction,
    ).collect()
    assert len(out) == len(left)
    for r in out:
        if direction == "backward":
            want = max((t for s, t, _ in right if s == r.s and t <= r.us), default=None)
        else:
            want = min((t for s, t, _ in right if s == r.s and t >= r.us), default=None)
        assert r.at_us == want


# ---------------------------------------------------------------- injection

def clean_windows(spark, n=60, length=8):
    rng = np.random.default_rng(1)
    data = [(i, [float(v) for v in rng.normal(size=length)], [float(v) for v in rng.normal(size=length)]) for i in range(n)]
    return spark.createDataFrame(data, "w long, a array<double>, b array<double>")


@pytest.mark.parametrize("kind", list(inject.INJECTORS))
def test_injection_properties(spark, kind):
    length, delta = 8, 0.5
    good = clean_windows(spark, 200)
    picked = inject.pick_type_channel(inject.pick_windows(good, ["w"], 0.5), ["w"], [kind], ["a", "b"])
    directions = inject.principal_directions(good, ["a", "b"]) if kind == "subspace" else None
    bad = inject.corrupt(picked, inject.injector_fit(good, ["a", "b"]), ["w"], ["a", "b"], length, delta, directions=directions)
    assert bad.count() == 100
    original = {r.w: r for r in good.collect()}
    power = []
    for r in bad.collect():
        o = original[r.w]
        other = "b" if r.channel == "a" else "a"
        assert list(r[other]) == list(o[other])
        moved = [int(abs(x - y) > 1e-10) for x, y in zip(r[r.channel], o[r.channel])]
        assert list(r.labels) == moved and any(moved)
        power.append(np.mean((np.array(r[r.channel]) - np.array(o[r.channel])) ** 2))
    assert np.mean(power) == pytest.approx(delta, rel=0.35)
    stats = inject.check_untouched(joins.join_pairs(bad, good, ["w"]), ["a", "b"]).collect()
    assert sum(r.one_channel_pairs for r in stats) == 100 and max(r.max_other_change for r in stats) == 0


def test_strategies(spark):
    good = clean_windows(spark, 20)
    picked = inject.pick_type_channel(inject.pick_windows(good, ["w"], 0.5), ["w"], ["constant"], ["a", "b"])
    bad = inject.corrupt(picked, inject.injector_fit(good, ["a", "b"]), ["w"], ["a", "b"], 8)
    real = good.limit(3).withColumn("labels", F.array_repeat(F.lit(1), 8))
    size = lambda s, r: inject.evaluation_set(s, good, bad, r, 8).count()
    assert inject.evaluation_set("none", good, bad, real, 8) is None
    assert (size("corrupt_validation", real), size("use_original", real), size("both", real)) == (30, 23, 33)
    assert size("use_original", None) == 30
    with pytest.raises(ValueError):
        inject.evaluation_set("both", good, bad, real, 8, (True, False))


def run_lengths(labels):
    return [len(list(g)) for x, g in itertools.groupby(labels) if x]


@pytest.mark.parametrize("n, share, lo, hi", [(2000, 0.0, 5, 40), (2000, 0.1, 5, 40), (127, 0.6, 4, 16), (40, 0.1, 4, 64), (3, 0.4, 1, 9), (60, 0.5, 1, 1), (60, 0.75, 3, 3), (500, 1.0, 7, 1500), (90, 0.9, 8, 11)])
def test_random_label_runs(spark, n, share, lo, hi):
    """The share is exact, each run has an admissible length, and no two touch, for every series and several seeds."""
    two = rows_of(spark, range(n)).unionByName(rows_of(spark, range(3 * n), s=1)).withColumn("s", F.when(F.col("s") == 1, 1))
    seen = set()
    for seed in (1, 2):
        rows = inject.random_label_runs(two, ["s"], share, lo, hi, seed).orderBy("idx").collect()
        assert len(rows) == 4 * n
        for s, size in ((None, n), (1, 3 * n)):
            labels = [r.label for r in rows if r.s == s]
            runs_found = run_lengths(labels)
            assert sum(labels) == int(size * share) and all(lo <= x <= hi for x in runs_found)
            seen.add((seed, s, tuple(labels)))
    assert len(seen) == 4 or share in (0.0, 1.0) or n < 100


def test_label_runs_that_do_not_fit(spark):
    rows = rows_of(spark, range(5))
    for share, lo, hi in ((1.0, 1, 2), (0.6, 4, 9), (0.8, 1, 1)):
        with pytest.raises(Exception, match="no runs of this length cover"):
            inject.random_label_runs(rows, ["s"], share, lo, hi).collect()
        assert {r.label for r in inject.random_label_runs(rows, ["s"], share, lo, hi, on_impossible="none").collect()} == {0}
    with pytest.raises(ValueError):
        inject.random_label_runs(rows, ["s"], 0.5, 3, 2)


def test_label_runs_are_spread(spark):
    """Over a long series, lengths and places take their whole range."""
    sizes = spark.createDataFrame([(1, 400_000)], "s int, n long")
    out = inject.label_runs(sizes, ["s"], 0.3, 4, 20).orderBy("start").collect()
    ends = [0] + [r.start + r.length for r in out]
    assert sum(r.length for r in out) == 120_000 and {r.length for r in out} == set(range(4, 21)) and ends[-1] <= 400_000
    assert all(r.start > e or (r.start == 0 and not i) for i, (r, e) in enumerate(zip(out, ends)))
    assert 0.28 < sum(r.length for r in out if r.start < 200_000) / 200_000 < 0.32


def test_unknown_injectors_are_named(spark):
    with pytest.raises(ValueError, match="clipping"):
        inject.known_types(["gwn", "clipping"])
    with pytest.warns(UserWarning, match="clipping"):
        assert inject.known_types(["gwn", "clipping"], "warn") == ["gwn"]


def test_values_that_are_no_number(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([5.0, 4.0, nan, nan, nan, nan])] + [("b", 0, 6.0), ("c", 0, nan)], "run_id string, epoch int, loss double")
    assert runs.best_run(df, "loss", "min", scope="all").first().run_id == "a" and runs.best_run(df, "loss", "min").first().run_id == "b"
    stops = {r.run_id: r.stop_idx for r in runs.early_stop_epoch(df, "loss", 3, 0.5, idx="epoch").collect()}
    assert stops == {"a": 4, "b": None, "c": None}
    best = {(r.run_id, r.epoch): (r.best_loss, r.improved_loss) for r in runs.running_best(df, {"loss": "max"}).collect()}
    assert best["a", 5] == (5.0, 0) and best["c", 0] == (None, 0)
    assert df.select(clean.any_channel_over({"x": F.col("loss")}, {"x": F.lit(4.5)}).alias("f")).where("f = 1").count() == 2
    with pytest.raises(Exception, match="not a number"):
        score.roc_counts(df.select(F.col("loss").alias("score"), F.lit(1).alias("label"))).collect()


def test_text_keys_and_ties(spark):
    df = spark.createDataFrame([(k, t, f"e{t:03d}") for k in ("x", None, "y") for t in range(200)], "s string, us long, event_id string")
    out = split.row_index(df, ["s"]).collect()
    assert all(r.idx == r.us and r.n == 200 for r in out) and len(out) == 600


# ---------------------------------------------------------------- scoring

def roc_brute(scores):
    pos = [s for s, y in scores if y]
    neg = [s for s, y in scores if not y]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [3, 1000])
@pytest.mark.parametrize("n", [1, 2, 200])
def test_auc_and_youden(spark, levels, n):
    rng = random.Random(n * levels)
    data = [(rng.randint(0, levels) / 7, int(rng.random() < 0.3)) for _ in range(n)]
    df = spark.createDataFrame(data, "score double, label int")
    auc = score.roc_auc(score.roc_counts(df)).first().roc_auc
    want = roc_brute(data)
    assert (auc is None) == (want is None)
    if want is None:
        return
    assert auc == pytest.approx(want)
    flipped = score.roc_auc(score.roc_counts(df.withColumn("score", -F.col("score")))).first().roc_auc
    assert flipped == pytest.approx(1 - want)
    p, q = sum(y for _, y in data), sum(1 - y for _, y in data)
    rate = lambda t, c: sum(s >= t and y == c for s, y in data) / (p if c else q)
    gains = {t: rate(t, 1) - rate(t, 0) for t in {s for s, _ in data}}
    best = score.youden_threshold(score.roc_counts(df)).first()
    if max(gains.values()) > 0:
        assert gains[best.threshold] == pytest.approx(max(gains.values()))
    else:
        assert best.threshold == float("inf")
    record = score.metrics_record(df).first()
    assert record.roc_auc == pytest.approx(want) and record.threshold == best.threshold


def test_best_f1(spark):
    rng = random.Random(5)
    data = [(rng.random() + 0.4 * y, y) for y in [int(rng.random() < 0.4) for _ in range(150)]]
    best = score.best_f1_threshold(spark.createDataFrame(data, "score double, label int"), 30).first()

    def f1(t):
        tp = sum(s >= t and y for s, y in data)
        return 2 * tp / (sum(s >= t for s, _ in data) + sum(y for _, y in data))

    grid = np.quantile([s for s, _ in data], np.linspace(0, 1, 30))
    assert best.f1 == pytest.approx(max(f1(t) for t in grid))
    assert f1(best.threshold) == pytest.approx(best.f1)


def test_linear_code_matches_numpy(spark):
    rng = np.random.default_rng(0)
    basis = rng.normal(size=(2, 8))
    x = rng.normal(size=(80, 2)) @ basis + 0.01 * rng.normal(size=(80, 8)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r[:4]], [float(v) for v in r[4:]]) for i, r in enumerate(x)], "w int, a array<double>, b array<double>")
    fitted = detect.recon_linear_fit(df, ["a", "b"], 4)
    out = detect.recon_linear(df, fitted, ["a", "b"]).orderBy("w").collect()
    got = np.array([list(r.out_a) + list(r.out_b) for r in out])
    mean = x.mean(axis=0)
    vt = np.linalg.svd(x - mean)[2][:2]
    np.testing.assert_allclose(got, mean + (x - mean) @ vt.T @ vt, atol=1e-6)


def test_linear_forecast_follows_a_recurrence(spark):
    y = [1.0, 2.0]
    for _ in range(40):
        y.append(1.5 * y[-1] - 0.9 * y[-2] + 0.3)
    win = windows.slide_windows(rows_of(spark, y), ["s"], ["x"], 3, ahead=4)
    fitted = detect.forecast_linear_fit(win, ["x"])
    for r in detect.forecast_linear(win, fitted, ["x"], 4).collect():
        np.testing.assert_allclose(r.out_x, r.y_x, atol=1e-4)


# ---------------------------------------------------------------- runs and files

def holds(values, stop, patience, delta):
    """The property of a stop: the rows that beat the best before them by more than `delta` are never `patience` apart before it,
    and the last of them is exactly `patience` before it."""
    beaten, best = [], math.inf
    for i, x in enumerate(values if stop is None else values[: stop + 1]):
        if best - x > delta:
            beaten.append(i)
            best = x
    ends = [*beaten, len(values) if stop is None else stop]
    gaps = [b - a for a, b in zip(ends, ends[1:])]
    return all(g <= patience for g in gaps[:-1]) and (gaps[-1] == patience if stop is not None else gaps[-1] <= patience)


@pytest.mark.parametrize("span", [4, 7, 4096])
@pytest.mark.parametrize("patience, delta", [(1, 0.0), (3, 0.1), (5, 0.4)])
def test_early_stop(spark, span, patience, delta):
    rng = random.Random(patience * span)
    runs_ = {k: [round(10 / (1 + i * rng.random()) + rng.random(), 3) for i in range(rng.choice([1, 5, 60]))] for k in range(12)}
    df = spark.createDataFrame([(k, i, x) for k, xs in runs_.items() for i, x in enumerate(xs)], "run_id int, idx long, m double")
    got = {r.run_id: r.stop_idx for r in runs.early_stop_epoch(df, "m", patience, delta, span=span).collect()}
    assert got.keys() == runs_.keys() and all(holds(xs, got[k], patience, delta) for k, xs in runs_.items())
    flipped = df.withColumn("m", -F.col("m"))
    assert got == {r.run_id: r.stop_idx for r in runs.early_stop_epoch(flipped, "m", patience, delta, "max", span=span).collect()}


def test_metric_choice():
    assert runs.metric_mode("val_roc_auc") == "max" and runs.metric_mode("val_loss") == "min" and runs.metric_mode("val_fpr") == "min"
    assert runs.choose_metric("val_f1_score", [], True) == ("val_f1_score", "max")
    assert runs.choose_metric("val_f1_score", [], False) == ("val_loss", "min")
    assert runs.choose_metric("speed", [], True) == ("val_loss", "min")
    assert runs.choose_metric(None, ["val_tpr", "val_roc_auc"], True) == ("val_roc_auc", "max")


def test_settings_grid(spark):
    grid = runs.settings_grid(spark, {"bottleneck": [0, 1], "decoder": ["plain", "progressive"], "length": [8, 16]})
    assert grid.count() == 8 and grid.select("config_id").distinct().count() == 8
    assert runs.drop_equal_settings(grid, F.col("bottleneck") == 1, "decoder", "progressive").count() == 6


def test_metadata_lines(spark):
    lines = [
        ("f1", "Experiment: a:b"), ("f1", "Train indices: 1,234,567"), ("f1", "Filter anomalies: TRUE"), ("f1", "noise"),
        ("f1", "Scaler params: {\"mean_\": [1, 2]}"), ("f1", "Feature columns: x , y,z"), ("f1", "Unknown: 3"),
        ("f2", "Feature columns: x"), ("f2", "Scaler params: not json"),
    ]
    lines += [("f2", "Seed: 9"), ("f2", "Seed: 10"), ("f2", "Model: b"), ("f2", "Model: a")]
    numbered = [(f, x, i) for i, (f, x) in enumerate(lines)]
    out = {r.file: r for r in keyvalue.parse_kv_lines(spark.createDataFrame(numbered, "file string, line string, pos int")).collect()}
    assert out["f1"].exp_name == "a:b" and out["f1"].train_size == 1234567 and out["f1"].filter_anomalies is True
    assert out["f1"].feature_columns == ["x", "y", "z"] and out["f1"].scaler_params["mean_"] == "[1,2]"
    assert out["f1"].seed is None and out["f2"].seed == 10 and out["f2"].model_name == "a"  # the last line counts
    with pytest.raises(Exception, match="no feature columns"):
        keyvalue.parse_kv_lines(spark.createDataFrame([("f3", "Seed: 1", 0)], "file string, line string, pos int")).collect()
    with pytest.raises(Exception, match="no feature columns"):
        keyvalue.parse_kv_lines(spark.createDataFrame([("f4", "nothing known", 0)], "file string, line string, pos int")).collect()


def test_store(spark, tmp_path):
    path = store.artefact_path(str(tmp_path), "cae", "exp/1", 16)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert store.reuse_or_rebuild(spark, path, build).count() == 3
    assert store.reuse_or_rebuild(spark, path, build).count() == 3
    assert len(calls) == 1
    store.reuse_or_rebuild(spark, path, build, force=True)
    assert len(calls) == 2
    store.sink_eval(spark.range(2), str(tmp_path / "raw"), {"is_standardized": False})
    with pytest.raises(ValueError, match="unscaled"):
        store.read_eval(spark, str(tmp_path / "raw"))


@pytest.mark.parametrize("length, stride, ahead", [(3, 3, 0), (4, 2, 1), (2, 5, 0), (5, 1, 2)])
def test_windows_by_stride_equal_framed_ones(spark, length, stride, ahead):
    rows = rows_of(spark, range(23), [int(i % 5 == 0) for i in range(23)]).unionByName(rows_of(spark, range(2), s=1)).where("idx <> 11").withColumn("s", F.when(F.col("s") == 1, 1))
    framed = windows.slide_windows(rows, ["s"], ["x"], length, F.col("idx") % stride == 0, "is_anomaly", ahead=ahead, carry=["us"])
    grouped = windows.slide_windows(rows, ["s"], ["x"], length, label="is_anomaly", ahead=ahead, carry=["us"], stride=stride)
    assert sorted(map(str, framed.collect())) == sorted(map(str, grouped.collect())) and framed.columns == grouped.columns


def test_scoring_grid_drops_equal_settings(spark):
    grid = runs.scoring_grid(spark, {"error": ["se", "abs"], "normaliser": ["none", "median"], "epsilon": [1e-3, 1e-1, 1.0]})
    assert len(grid) == 8 and sum(s["normaliser"] == "none" for s in grid) == 2
    assert [s["config_id"] for s in grid] == sorted(s["config_id"] for s in grid) and {s["level"] for s in grid} == {"step"}
    with pytest.raises(ValueError, match="scaler"):
        runs.scoring_grid(spark, {"scaler": ["x"]})
    with pytest.raises(ValueError, match="cube"):
        runs.scoring_grid(spark, {"error": ["cube"]})


def test_results_published_twice(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.9)], "run_id long, epoch int, loss double")
    for _ in range(3):
        store.sink_results(first, path)
    rows = lambda: sorted(tuple(r) for r in store.read_results(spark, path).select("run_id", "epoch", "loss").collect())
    assert rows() == [(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.9)]
    store.sink_results(spark.createDataFrame([(1, 2, 0.3, 7), (1, 3, 0.2, 8)], "run_id long, epoch int, loss double, more int"), path)
    assert rows() == [(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2), (2, 1, 0.9)]
    assert {r.more for r in store.read_results(spark, path).collect()} == {None, 7, 8}
    with pytest.raises(Exception, match="broken"):
        store.sink_results(first.select("run_id", F.raise_error(F.lit("broken")).cast("int").alias("epoch")), path)
    assert len(rows()) == 4


@pytest.mark.parametrize("length", [1, 2, 7, 40])
def test_surroundings_in_small_buckets(spark, length):
    """Nearest marks against all rows, over buckets smaller than the surroundings, with gaps, two series and a null label."""
    draw = random.Random(length)
    data = [(s, i, draw.choice([0, 0, 0, 0, 0, 0, 1, None]) if i % 50 < 20 else 0, draw.choice(["train", "val"]), 120) for s in (None, 1) for i in range(120) if s is None or i % 11]
    df = spark.createDataFrame(data, "s int, idx long, is_anomaly int, split string, n long")
    near = lambda s, i, part=None: any(x[0] == s and x[2] == 1 and abs(x[1] - i) < length and part in (None, x[3]) for x in data)
    out = split.anomaly_covered_rows(df, ["s"], length, span=16).collect()
    assert len(out) == len(data) and all(r.covered == near(r.s, r.idx) for r in out)
    out = split.mark_normal(df, ["s"], length, span=16).collect()
    assert len(out) == len(data) and all(r.normal == (not near(r.s, r.idx, r.split)) for r in out)
    full = df.where("s IS NULL")
    starts = {r.start_idx for r in split.anomaly_starts(full, ["s"], length, span=16).collect()}
    assert starts == {i for i in range(120 - length + 1) if any(x[0] is None and x[2] == 1 and i <= x[1] < i + length for x in data)}


def test_windows_from_blocks(spark, monkeypatch):
    """Slices of blocks against plain slices: any starts, targets, carried columns, missing positions, null keys."""
    monkeypatch.setattr(windows, "BLOCK", 8)
    data = [(s, i, float(i), i % 3) for s in (None, 2) for i in range(60) if s is None or i not in (20, 41)]
    df = spark.createDataFrame(data, "s int, idx long, x double, tag int")
    out = windows.slide_windows(df, ["s"], ["x"], 5, F.col("idx") % 3 == 1, carry=["tag"], ahead=2, span=8).collect()
    have = {(s, i) for s, i, _, _ in data}
    want = {(s, i) for s, i in have if i % 3 == 1 and all((s, j) in have for j in range(i, i + 7))}
    assert {(r.s, r.start_idx) for r in out} == want
    assert all(r.x == [float(j) for j in range(r.start_idx, r.start_idx + 5)] and r.y_x == [r.start_idx + 5.0, r.start_idx + 6.0] and r.tag == r.start_idx % 3 for r in out)


def test_asof_and_interval_with_one_frequent_time(spark):
    """A time that a third of the rows share is spread over buckets, and ties between the sides keep their rule."""
    left = [(s, 500 if i % 3 == 0 else i, i) for s in (None, 1) for i in range(900)]
    right = [(s, t, v) for s in (None, 1) for t in (0, 250, 500, 700) for v in (1, 5, 3)] + [(7, 1, 1)]
    a = spark.createDataFrame(left, "s int, t long, id int")
    b = spark.createDataFrame(right, "s int, t long, v int")
    sizes = [r["count"] for r in joins._both_sides(a, b, ["s"], "t", ["v"], True).groupBy("_b").count().collect()]
    assert max(sizes) <= 3 * sum(sizes) / len(sizes) + 64
    back = {(r.s, r.id): (r.at_t, r.at_v) for r in joins.join_asof(a, b, ["s"], "t", ["v"]).collect()}
    fore = {(r.s, r.id): (r.at_t, r.at_v) for r in joins.join_asof(a, b, ["s"], "t", ["v"], "forward").collect()}
    near = {(r.s, r.id): (r.before_t, r.after_t) for r in joins.join_interval(a, b.select("s", "t"), ["s"], "t", 40).collect()}
    times = [0, 250, 500, 700]
    for s, t, i in left:
        before, after = max(x for x in times if x <= t), min((x for x in times if x >= t), default=None)
        assert back[s, i] == (before, 5) and fore[s, i] == (after, None if after is None else 1)
        close = t - before < 40 or (after is not None and after - t < 40)
        assert near.get((s, i)) == ((before, after) if close else None)


@pytest.mark.parametrize("k", [0, 1, 7, 300, 5000])
def test_sample_of_lowest_hashes(spark, k):
    """The same rows as by ranking everything, with null ids and other columns."""
    ids = [(None if i == 3 else i // 40, i) for i in range(900)]
    df = spark.createDataFrame([(*x, [float(x[1])] * 3) for x in ids], "a int, b int, x array<double>")
    digest = lambda x: hashlib.md5("|".join(["5", "pick", *[str(v) for v in x if v is not None]]).encode()).hexdigest()
    order = sorted(ids, key=digest)[:k]
    got = split.take_ranked(df, ["a", "b"], k, 5, "pick").collect()
    assert sorted((r["rank"], r.a, r.b) for r in got) == [(i + 1, *x) for i, x in enumerate(order)]
    assert all(r.x == [float(r.b)] * 3 for r in got)


def test_evaluate(spark):
    """Every field of the record against plain numbers, for both sources and levels; bad errors are named."""
    draw = np.random.default_rng(6)
    rows = lambda n, shift: [(i, p, float(draw.random() + shift), float(draw.random() * 3), int(p == 2)) for i in range(n) for p in range(4)]
    bad, good = rows(6, 0.4), rows(20, 0.0)
    schema = "id int, pos int, u double, w double, label int"
    errors = spark.createDataFrame(bad, schema), spark.createDataFrame(good, schema).drop("label")
    for level, source in (("step", "evaluation_set"), ("window", "validation")):
        record, sampled = evaluate.evaluate(*errors, ["id"], ["u", "w"], source, ratio=1.5, level=level)
        r, picked = record.first(), {x.id for x in sampled.collect()}
        assert len(picked) == 9 == r.normal_windows and r.anomalous_windows == 6 and r.normals_from == source
        normal = [x for x in good if x[0] in picked]
        factors = [np.median([x[c] for x in normal]) for c in (2, 3)]
        np.testing.assert_allclose([r.normalisation["u"], r.normalisation["w"]], factors)
        for stats, part in ((r.normal_stats, normal), (r.anomaly_stats, bad)):
            flat = np.array([x[c] for x in part for c in (2, 3)])
            np.testing.assert_allclose([stats["mean"], stats["std"], stats["min"], stats["max"], stats["q05"], stats["median"]], [flat.mean(), flat.std(), flat.min(), flat.max(), np.quantile(flat, 0.05), np.median(flat)])
            assert stats["count"] == len(flat)
        scored = [(np.mean([x[2] / (factors[0] + 1e-5), x[3] / (factors[1] + 1e-5)]), y, (k, x[0])) for k, part in enumerate((normal, bad)) for x in part for y in [x[4] * k]]
        if level == "window":
            scored = [(np.mean([s for s, _, i in scored if i == w]), max(y for _, y, i in scored if i == w), w) for w in {i for *_, i in scored}]
        pos, neg = [s for s, y, _ in scored if y], [s for s, y, _ in scored if not y]
        assert r.p == len(pos) and r.n == len(neg)
        assert r.roc_auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    with pytest.raises(ValueError):
        evaluate.evaluate(*errors, ["id"], ["u", "w"], "elsewhere")
    with pytest.raises(ValueError, match="no normal window"):
        evaluate.evaluate(errors[0], errors[1].limit(0), ["id"], ["u", "w"])
    with pytest.raises(Exception, match="error of w is missing"):
        evaluate.evaluate(errors[0].withColumn("w", F.when(F.col("pos") > 0, F.col("w"))), errors[1], ["id"], ["u", "w"])


@pytest.mark.parametrize("patience", [1, 3, 6])
def test_early_stop_over_many_levels(spark, monkeypatch, patience):
    """Maps of small buckets, composed two at a time, against the plain loop."""
    monkeypatch.setattr(runs, "FAN", 2)
    draw = random.Random(patience)
    values = {r: [10 - 0.2 * i + draw.random() * r for i in range(n)] for r, n in ((1, 70), (2, 55), (6, 90), (9, 3), (30, 40))}
    df = spark.createDataFrame([(r, i, v) for r, vs in values.items() for i, v in enumerate(vs)], "run_id int, idx long, loss double")
    got = {r.run_id: r.stop_idx for r in runs.early_stop_epoch(df, "loss", patience, 0.1, span=4).collect()}
    for r, vs in values.items():
        best, waited, stop = vs[0], 0, None
        for i, v in enumerate(vs[1:], 1):
            best, waited = (v, 0) if best - v > 0.1 else (best, waited + 1)
            if waited >= patience:
                stop = i
                break
        assert got[r] == stop


def test_running_totals_in_two_levels(spark, monkeypatch):
    """Running values over many groups of buckets, both ways, with negative bucket numbers and a null key."""
    from tidemark.functions import ordered

    monkeypatch.setattr(ordered, "GROUP", 3)
    draw = random.Random(2)
    data = [(k, i, draw.randrange(50)) for k in (None, 1) for i in range(200)]
    df = spark.createDataFrame(data, "k int, i long, x long").withColumn("_b", F.floor((F.col("i") - 100) / 4).cast("long"))
    out = ordered.running(df, ["k"], [F.col("i")], {
        "up": ordered.Running("sum", F.col("x"), exclusive=True), "low": ordered.Running("min", F.col("x")), "left": ordered.Running("max", F.col("x"), backward=True),
    }, {"all": ("sum", F.col("x")), "n": ("count", F.lit(1))}).collect()
    assert len(out) == 400
    for r in out:
        xs = [x for k, _, x in data if k == r.k]
        assert (r.up, r.low, r.left, r["all"], r.n) == (sum(xs[: r.i]), min(xs[: r.i + 1]), max(xs[r.i :]), sum(xs), 200)


def test_overlapping_windows_are_slices_of_blocks(spark, monkeypatch):
    """Where windows overlap, no row is copied to each of them."""
    monkeypatch.setattr(windows, "_grouped", lambda *args: pytest.fail("rows are gathered by window"))
    rows = rows_of(spark, range(2000)).withColumn("at", F.col("idx"))
    out = windows.slide_windows(rows, ["s"], ["x"], 16, label="is_anomaly", stride=3, carry=["at"])
    assert out.count() == 662 and out.where("start_idx <> at OR start_idx % 3 <> 0 OR size(x) <> 16 OR x[0] <> start_idx").isEmpty()


def test_samples_order_only_what_the_count_asks_for(spark, monkeypatch):
    """A class that stays whole is not ordered, and of a trimmed one little more than what stays."""
    seen, rank = [], split.digest_rank
    monkeypatch.setattr(split, "digest_rank", lambda df, *args, **named: (seen.append(df.count()), rank(df, *args, **named))[1])
    df = spark.range(20_000).withColumn("label", (F.col("id") % 100 == 0).cast("int"))
    for ratio, keep in ((1, 200), (2, 400)):
        assert split.balance_ratio(df, ["id"], "label", ratio).count() == 200 + keep
    assert split.sample_normals(df.where("label = 0"), df.where("label = 1"), ["id"], 1.5).count() == 300
    assert len(seen) == 3 and max(seen) < 700


@pytest.mark.parametrize("ratio", [1, 2, 0.5, 40])
def test_balance_ratio_keeps_the_first_by_digest(spark, ratio):
    """The same rows as ranking all of them, with labels that are neither, null ids and rows that share an id."""
    data = [(i % 900 if i % 50 else None, [0, 1, 0, None, 0, 2, 0][i % 7], float(i)) for i in range(1400)]
    df = spark.createDataFrame(data, "id long, label int, x double")
    order = hashing.digest(9, "balance", "id")
    n, a = df.where("label = 0").count(), df.where("label = 1").count()
    wanted, fallback = int(n / ratio), int(a * ratio)
    keep = (min(n, a),) * 2 if ratio == 1 else (wanted, n) if a >= wanted else (a, max(1, fallback) if ratio < 1 else fallback)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(order, "id")))
    want = ranked.where(F.when(F.col("label") == 1, F.col("rank") <= keep[0]).otherwise(F.col("rank") <= keep[1]))
    got = split.balance_ratio(df, ["id"], "label", ratio, 9)
    assert got.columns == df.columns
    ids = lambda d: sorted(map(str, d.select("id", "label").collect()))
    assert ids(got) == ids(want)


def _rows_ordered(monkeypatch, module):
    seen, real = [], module.exact_quantiles
    monkeypatch.setattr(module, "exact_quantiles", lambda df, *args, **named: (seen.append(df.count()), real(df, *args, **named))[1])
    return seen


def test_grid_orders_errors_of_a_channel_once(spark, monkeypatch):
    """Medians of absolute and squared errors come from one order."""
    data = [(i // 4, i % 4, (-1) ** i * (i * 7 % 23) / 3.0, (i * 5 % 17) / 7.0, int(i % 9 == 0), int(i % 4 != 3)) for i in range(200)]
    deltas = spark.createDataFrame(data, "id long, pos int, u double, w double, label int, normal int")
    seen = _rows_ordered(monkeypatch, runs)
    got = {r.config_id: r.threshold for r in runs.sweep_grid(deltas, ["id"], ["u", "w"], runs.scoring_grid(spark, {"error": ["abs", "se"]})).collect()}
    assert seen == [2 * deltas.where("normal = 1").count()]
    for i, error in enumerate((abs, lambda x: x * x)):
        factors = [float(np.median([error(d[c]) for d in data if d[5]])) + 1e-3 for c in (2, 3)]
        scores = {(error(d[2]) / factors[0] + error(d[3]) / factors[1]) / 2 for d in data}
        assert math.isinf(got[i]) or min(abs(got[i] - s) for s in scores) < 1e-12


def test_evaluation_orders_each_error_once(spark, monkeypatch):
    make = lambda n, more: spark.createDataFrame([(i, p, i + p / 3.0, i * p / 7.0 + more, 1) for i in range(n) for p in range(4)], "id long, pos int, u double, w double, label int")
    seen = _rows_ordered(monkeypatch, evaluate)
    record = evaluate.evaluate(make(5, 2.0), make(9, 0.0).drop("label"), ["id"], ["u", "w"])[0].first()
    assert record.normal_windows == 5 and seen == [2 * 4 * (5 + 5)]
