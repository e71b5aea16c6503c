"""Members of long lists meet in clusters: what is written grows with the members, and no link is lost."""

import random

import numpy as np
import pytest

from tidemark.llm import jaccard_join
from tidemark.sources.stage import clear_stages


def groups(pairs):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    return {frozenset(y for y in root if top(y) == top(x)) for x in list(root)}


@pytest.mark.parametrize("block", [1024, 30])
def test_forest_connects_what_pairs_connect(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = np.random.default_rng(6)
    rows, sets = [], {}
    for token in (1, 2, 3):  # every list holds a family of near copies, none of them linked yet, and texts of their own
        family = r.integers(0, 2**63, 60, dtype=np.uint64)
        for m in range(150):
            cid = token * 1000 + m
            own = r.integers(0, 2**63, 60, dtype=np.uint64)
            sets[cid] = np.unique(np.concatenate([family[:54], own[:6]]) if m < 100 else own)
            rows.append((token, cid, len(sets[cid]) << 32, cid))
    entries = spark.createDataFrame(rows, "token long, cid long, at long, comp long")
    sketches = spark.createDataFrame([(c, jaccard_join.sketch(s)) for c, s in sets.items()], "cid long, sketch binary")
    pairs = [tuple(x) for x in jaccard_join.cross_pairs(entries, sketches, 75).collect()]
    edges = [tuple(x) for x in jaccard_join.cross_pairs(entries, sketches, 75, forest=True).collect()]
    clear_stages(spark)
    assert groups(edges) == groups(pairs) and len(pairs) > 3 * 100 * 99 / 2 - 1
    pieces = {1024: 1, 30: 15}[block]  # pairs of five blocks
    assert len(edges) <= pieces * len(rows)
    if block == 1024:
        assert len(edges) < len(rows)


@pytest.mark.parametrize("block", [1024, 25])
def test_links_of_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    draw, r = random.Random(9), np.random.default_rng(9)
    sets, rows = {}, []
    for token in (7, 8):
        family = r.integers(0, 2**63, 80, dtype=np.uint64)
        for m in range(120):
            cid = token * 1000 + m
            kept = draw.choice([80, 72, 66, 62])
            sets[cid] = np.unique(np.concatenate([family[r.permutation(80)[:kept]], r.integers(0, 2**63, 80 - kept, dtype=np.uint64)]))
            rows.append((token, cid, token * 1000 if m < 20 else cid))
    clusters = spark.createDataFrame(rows, "token long, cid long, comp long")
    whole = spark.createDataFrame([(c, s.tobytes()) for c, s in sets.items()], "cid long, shingles binary")
    got = [tuple(x) for x in jaccard_join.block_links(clusters, whole, 75).collect()]
    clear_stages(spark)

    def links(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        return 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common)

    known = [(c, comp) for _, c, comp in rows if c != comp]
    want = [(a[1], b[1]) for n, a in enumerate(rows) for b in rows[n + 1 :] if a[0] == b[0] and a[2] != b[2] and links(a[1], b[1])]
    assert all(links(a, b) for a, b in got) and len(want) > 5 * len(rows)
    assert groups(got + known) == groups(want + known)
    if block == 1024:
        assert len(got) < len(rows)
