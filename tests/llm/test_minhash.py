"""MinHash near-dedup against a brute-force join over all pairs."""

import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import minhash
from tidemark.llm.queries import op11
from tidemark.sources.stage import clear_stages


@pytest.fixture(autouse=True)
def tidy(spark):
    yield
    clear_stages(spark)


def shingle_set(text, words=4):
    x = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(x[i : i + words]) for i in range(max(1, len(x) - words + 1))) if x else frozenset()


def brute(rows, words=4, percent=80):
    """(id, size, component, kept) of every row, by counting what any two different sets share."""
    sets = sorted({s for _, t in rows if (s := shingle_set(t, words))}, key=sorted)
    holders, root = defaultdict(list), list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[top(i)] = top(j)
    number = {s: i for i, s in enumerate(sets)}
    lows = defaultdict(list)
    for i, t in rows:
        if i is not None and (s := shingle_set(t, words)):
            lows[top(number[s])].append(i)
    out = []
    for i, t in rows:
        s = shingle_set(t, words)
        low = i if not s else min(lows[top(number[s])], default=None)
        out.append((i, len(s), low, i == low))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def result(df, **more):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **more).collect()), key=key)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = op11(spark, f"/root/testdata/{sf}").collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key) and sum(not r[3] for r in want) > 10


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (6, "one two three"), (7, "one two three four"), (None, "one two three four"), (None, "nobody has an id here"),
        (None, "Nobody has an id here"), (8, long), (9, long + " end"), (9, long + " end"), (10, "a b c d e f g h i j k l m n"), (10, "a b c d e f g h i j k l m o"), (11, "x " * 50), (12, "x " * 9),
    ]
    df = spark.createDataFrame([(*r, 3, True) for r in rows], "doc_id long, text string, n int, cid boolean")
    assert result(df) == sorted(brute(rows), key=key)
    assert result(df, words=2, percent=60) == sorted(brute(rows, 2, 60), key=key)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_large_groups(spark, monkeypatch):
    """Chains, hubs and loose copies in buckets of several components, with small blocks so that all ways are taken."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SHARE", 8)
    draw = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        x = list(base)
        for _ in range(draw.choice([1, 1, 2, 3, 4])):
            x[draw.randrange(60)] = f"c{i}{draw.random()}"
        rows.append((i, " ".join(x)))
    chain = [f"k{i}" for i in range(80)]
    for i in range(40):
        chain[2 * i % 80] = f"new{i}"
        rows.append((1000 + i, " ".join(chain)))
    draw.shuffle(rows)
    for i in range(60):  # copies too far from the first text, some near each other
        x = list(base)
        for k in range(8):
            x[(7 * k + i // 6) % 60] = f"d{i // 3}.{k}" if i % 3 else f"e{i}.{k}"
        rows.append((2000 + i, " ".join(x)))
    want = brute(rows)
    assert len({r[2] for r in want}) > 3
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == sorted(want, key=key)


def test_stars(spark):
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(50)] + [(100, draw.randrange(101, 140)) for _ in range(60)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(90)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["u"]: r["v"] for r in minhash.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert minhash.stars(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signature_floor():
    assert 0 < minhash.signature_floor(60) < minhash.signature_floor(80) < minhash.HASHES
    assert minhash.signature_floor(0) == 0 and minhash.signature_floor(100) == minhash.HASHES
