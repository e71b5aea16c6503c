"""Ordered building blocks against brute force, with buckets small enough that borders matter."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered
from tidemark.functions.ordered import (
    Running,
    bucket_by_index,
    bucket_by_value,
    exact_quantiles,
    framed,
    running,
    spread_join,
)
from tidemark.operators import split


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def series(seed, sizes):
    rng = random.Random(seed)
    return [(s, i, rng.randint(0, 50) / 2, int(rng.random() < 0.05)) for s, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("span", [3, 7, 1000])
def test_running_matches_loop(spark, span):
    rows = series(1, [40, 1, 13])
    df = bucket_by_index(make(spark, rows, "s int, idx long, x double, a int"), "idx", span)
    got = {
        (r.s, r.idx): (r.up, r.low, r.ahead, r.before, r.n)
        for r in running(
            df, ["s"], [F.col("idx")],
            {
                "up": Running("sum", F.col("x")),
                "low": Running("min", F.col("x")),
                "ahead": Running("min", F.when(F.col("a") == 1, F.col("idx")), backward=True),
                "before": Running("count", F.lit(1), exclusive=True),
            },
            {"n": ("count", F.lit(1))},
        ).collect()
    }
    for s, i, _, _ in rows:
        mine = [r for r in rows if r[0] == s]
        upto = [r[2] for r in mine if r[1] <= i]
        later = [r[1] for r in mine if r[1] >= i and r[3] == 1]
        assert got[(s, i)] == (sum(upto), min(upto), min(later, default=None), i, len(mine))


@pytest.mark.parametrize("span", [1, 4, 5, 1000])
def test_frames_do_not_depend_on_buckets(spark, span):
    rows = series(2, [30, 3])
    df = make(spark, rows, "s int, idx long, x double, a int")
    out = framed(df, ["s"], "idx", {"m": (F.max("x"), -3, 2), "l": (F.collect_list("x"), 0, 4)}, span).collect()
    assert len(out) == len(rows)
    by = {(s, i): x for s, i, x, _ in rows}
    for r in out:
        assert r.m == max(by[(r.s, j)] for j in range(r.idx - 3, r.idx + 3) if (r.s, j) in by)
        assert r.l == [by[(r.s, j)] for j in range(r.idx, r.idx + 5) if (r.s, j) in by]


@pytest.mark.parametrize("ties", [1, 5, 1000])
def test_row_index_with_heavy_ties(spark, ties):
    """Many rows of one series share a time; the order inside goes by the tie-break."""
    rng = random.Random(ties)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 4), rng.randint(0, 2000 // ties) if rng.random() < 0.5 else 3, e) for e in range(3000)]
    df = make(spark, rows, "s int, us long, event_id long")
    got = {r.event_id: (r.idx, r.n) for r in split.row_index(df, ["s"]).collect()}
    for s in range(5):
        mine = sorted((us, e) for k, us, e in rows if k == s)
        for i, (_, e) in enumerate(mine):
            assert got[e] == (i, len(mine))


def test_value_buckets_are_balanced(spark):
    rows = [(i, 5 if i % 3 == 0 else i) for i in range(20_000)]
    df = bucket_by_value(make(spark, rows, "id long, v long"), "v", "id", buckets=16)
    sizes = [r["count"] for r in df.groupBy("_b").count().collect()]
    assert sum(sizes) == 20_000
    assert max(sizes) < 20_000 / 16 * 3


@pytest.mark.parametrize("n", [1, 2, 5, 501])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    values = {k: sorted(rng.choice([0.0, rng.random()]) for _ in range(n)) for k in ("a", "b")}
    df = make(spark, [(k, x) for k, xs in values.items() for x in xs], "k string, x double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.k, r.p): r.q for r in exact_quantiles(df, ["k"], "x", probs).collect()}
    for k, xs in values.items():
        for p in probs:
            rank = p * (n - 1)
            lo = int(rank)
            hi = min(lo + 1, n - 1)
            assert got[(k, p)] == pytest.approx(xs[lo] + (xs[hi] - xs[lo]) * (rank - lo))


def test_quantiles_ignore_missing(spark):
    df = make(spark, [(1.0,), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, [], "x", [0.5]).first().q == 2.0


def test_spread_join_keeps_every_row(spark):
    rows = make(spark, [(s, i) for s in (1, 2, 3) for i in range(25)], "s int, idx long")
    small = make(spark, [(1, "a"), (2, "b")], "s int, t string")
    out = spread_join(rows, small, ["s"], "idx", span=4)
    assert out.count() == 50
    assert out.where("s = 2 and t = 'b'").count() == 25


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    rows = make(spark, [(i % 3, 1000 - i, i) for i in range(500)], "s int, us long, event_id long").repartition(partitions)
    out = split.shuffle_order(split.row_index(rows, ["s"]), ["s"], ["event_id"]).agg(
        F.sum(F.col("idx") * F.col("event_id")), F.sum(F.col("ord") * F.col("event_id"))
    ).first()
    fixed = split.shuffle_order(
        split.row_index(rows.coalesce(1), ["s"]), ["s"], ["event_id"]
    ).agg(F.sum(F.col("idx") * F.col("event_id")), F.sum(F.col("ord") * F.col("event_id"))).first()
    assert tuple(out) == tuple(fixed)


def test_running_by_value_cuts_only_long_keys(spark, monkeypatch):
    """Keys of few rows, a null one too, are ordered in one piece; the result is that of buckets."""
    cut = []
    monkeypatch.setattr(ordered, "bucket_by_value", lambda df, *args, **named: (cut.append(df.count()), bucket_by_value(df, *args, **named))[1])
    data = [(None if i % 97 == 0 else 0 if i % 3 else i % 40, (i * 7919) % 251, i, float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(data, "s int, us long, event_id long, x double")
    specs = {"i": ordered.Running("count", F.lit(1), exclusive=True), "most": ordered.Running("max", F.col("us"), exclusive=True), "sum": ordered.Running("sum", F.col("x")), "rest": ordered.Running("sum", F.col("x"), backward=True)}
    totals = {"n": ("count", F.lit(1))}
    want = ordered.running(bucket_by_value(df, "us", "event_id"), ["s"], [F.col("us"), F.col("event_id")], specs, totals)
    for span, rows in ((500, [df.where("s = 0").count()]), (5000, []), (0, [3000])):
        cut.clear()
        got = ordered.running_by_value(df, ["s"], "us", "event_id", specs, totals, span)
        assert cut == rows and got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quantiles_of_overlapping_parts_share_one_order(spark):
    """Parts give what separate calls give, and rows are not copied to them."""
    data = [(i % 2, i % 5, float((i * 37) % 101) if i % 11 else None) for i in range(700)]
    df = spark.createDataFrame(data, "s int, c int, x double")
    parts = {"all": (F.lit(True), [0.0, 0.3, 1.0]), "low": (F.col("c") < 2, [0.5]), "none": (F.col("c") > 9, [0.5])}
    got = {(r.s, r.part, r.p): (r.n, r.q) for r in exact_quantiles(df, ["s"], "x", [], parts=parts).collect()}
    want = {(r.s, "all", r.p): (r.n, r.q) for r in exact_quantiles(df, ["s"], "x", [0.0, 0.3, 1.0]).collect()}
    want |= {(r.s, "low", r.p): (r.n, r.q) for r in exact_quantiles(df.where("c < 2"), ["s"], "x", [0.5]).collect()}
    assert got == want and len(got) == 8
