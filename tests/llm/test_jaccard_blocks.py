"""Long lists of the Jaccard join are compared in blocks of bounded size, and no pair is lost."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join
from tidemark.sources.stage import clear_stages


def test_cross_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    draw = random.Random(3)
    rows = []
    for token, members, largest in ((1, 900, 0), (2, 700, 650), (3, 30, 10), (4, 200, 200), (5, 2, 1), (6, 300, 150)):
        for m in range(members):
            cid = token * 10_000 + m
            comp = token * 10_000 if m < largest else token * 10_000 + draw.randrange(largest, members)
            rows.append((token, cid, draw.choice([20, 22, 30]) << 32 | draw.randrange(5), comp))
    entries = spark.createDataFrame(rows, "token long, cid long, at long, comp long")
    most = jaccard_join.block_rows(entries).groupBy("token", "i", "j").count().agg(F.max("count")).first()[0]
    assert most <= 4 * 40  # two blocks, dealt by a hash
    full = bytes([255])  # a sketch that rules nothing out
    sketches = entries.select("cid").distinct().withColumn("sketch", F.lit(full))
    got = sorted((r["a"], r["b"]) for r in jaccard_join.cross_pairs(entries, sketches, 75).collect())
    clear_stages(spark)

    def may_link(x, y):
        (na, pa), (nb, pb) = (divmod(v, 1 << 32) for v in (x, y))
        return 100 * min(na, nb) >= 75 * max(na, nb) and min(na - pa, nb - pb) >= jaccard_join.need(na, nb, 75) - 1

    want = sorted((a[1], b[1]) for n, a in enumerate(rows) for b in rows[n + 1 :] if a[0] == b[0] and a[3] != b[3] and may_link(a[2], b[2]))
    assert got == want


def test_folded_sketches_bound_what_sets_share():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 90, 4000, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 2 // 3], r.integers(0, 2**63, len(s) // 3, dtype=np.uint64)])) for s in sets]
    bounds = jaccard_join.Bounds([jaccard_join.sketch(s) for s in sets], 64)
    assert max(bounds.widths) == 64
    for x, s in enumerate(sets):
        for t, bound in zip(sets, bounds.room(x, np.arange(len(sets))), strict=True):
            assert len(np.intersect1d(s, t)) <= bound
