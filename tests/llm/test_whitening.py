"""Whitening against an eigendecomposition of the whole covariance."""

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op13
from tidemark.sources.stage import clear_stages


@pytest.fixture(autouse=True)
def tidy(spark):
    yield
    clear_stages(spark)


def integers(v):
    return [int(np.floor(1024 * float(c))) + 100_000 for c in v]


def check(rows, got, components=8):
    """rows: (id, vector) of the vectors that remain, ids unique."""
    x = np.array([integers(v) for _, v in rows])
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, x.shape[1])
    own = centred @ vectors[:, :k]
    at = {i: j for j, (i, _) in enumerate(rows)}
    assert len(got) == n * k
    sign = {}
    for r in got:
        i, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total, strict=True))
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(own[i, c]) > 1e-6 * np.sqrt(values[c]):
            s = sign.setdefault(c, np.sign(own[i, c] * r["whitened"]))
            assert s * r["whitened"] * np.sqrt(values[c]) == pytest.approx(own[i, c], abs=1e-7 * np.sqrt(values[0]))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    check(rows, op13(spark, path).collect())


def test_close_and_steep_spectra(spark):
    draw = np.random.default_rng(5)
    for scale in ([2.0 ** -i for i in range(36)] + [0.0] * 4, [1.0] * 3 + [0.99] * 20 + [0.5] * 17):
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(draw.standard_normal((300, 40)) * scale * 50)]
        check(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), float(i % 3)]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, -inf, 1.0])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in good + bad], "vec_id long, embedding array<float>, n int, component string")
    check(good, whitening.whiten(df).collect())
    # repeated rows and null ids are rows of their own
    twice = df.where("vec_id < 30").unionByName(df.where("vec_id = 4")).unionByName(df.where("vec_id = 5").selectExpr("cast(null as long) as vec_id", "embedding", "n", "component"))
    out = whitening.whiten(twice).collect()
    assert len(out) == 32 * 3 and sum(r["vec_id"] is None for r in out) == 3 and {r["n"] for r in out} == {32}
    four = sorted((r["component"], r["whitened"], r["deviation"]) for r in out if r["vec_id"] == 4)
    assert four[0::2] == four[1::2]
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id >= 100")).collect() == []
    assert whitening.whiten(df.limit(1).selectExpr("vec_id", "array() as embedding")).collect() == []
    with pytest.raises(ValueError, match="same number"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_no_variance(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    out = whitening.whiten(flat).collect()
    assert len(out) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)], "vec_id long, embedding array<double>")
    out = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in out) and out[0]["identity_error"] < 1e-9
    assert sum(r["whitened"] ** 2 for r in out if r["component"] == 1) == pytest.approx(6)


def test_deviation_beyond_long(spark):
    wide = spark.createDataFrame([(i, [1e12 * i]) for i in range(4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="deviation does not fit"):
        whitening.whiten(wide).collect()
