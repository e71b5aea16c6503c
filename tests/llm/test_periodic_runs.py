"""Periodic runs against a brute-force reading of their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import periodic_runs
from tidemark.llm.queries import op12
from tidemark.sources.stage import clear_stages


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def runs_of(x, least):
    """(start, length, period) of every run: stretches equal to themselves q further on, for each q that no smaller period explains."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        same = [x[i] == x[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            j = i
            while same[j]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and not any(x[i : j + q - d] == x[i + d : j + q] for d in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(x, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def longest_lyndon(x, i):
    return max(n for n in range(1, len(x) - i + 1) if all(x[i : i + n] < x[i + k : i + n] for k in range(1, n)))


def sequences():
    draw = random.Random(11)
    for _ in range(500):
        yield [draw.randrange(draw.randrange(1, 5)) for _ in range(draw.randrange(1, 45))]


def test_lyndon_arrays():
    for x in sequences():
        for one in (x, [-v for v in x]):
            ranks = np.unique(one, return_inverse=True)[1].tolist()
            assert periodic_runs.lyndon_array(ranks) == [longest_lyndon(one, i) for i in range(len(one))]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_sequences(least):
    found = 0
    for x in sequences():
        got = [(a, b - a, q) for a, b, q in periodic_runs.runs_of(np.array(x), least).tolist()]
        assert got == runs_of(x, least)
        found += len(got)
    assert found > 10


def test_long_sequences():
    one = periodic_runs.runs_of(np.zeros(50_000, int), 12)
    assert one.tolist() == [[0, 50_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert [(s, e - s, q) for s, e, q in periodic_runs.runs_of(np.array(b), 12).tolist()] == runs_of(b, 12)


def edited(doc_id, text):
    """The text of the contract: a tenth of the documents turns periodic."""
    x = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(x)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
    return x


def fast_runs(x, least):
    """As `runs_of`, but only distances at which a piece of the text repeats are looked at."""
    seen, gaps = {}, set()
    for i in range(len(x) - 5):
        for j in seen.setdefault(tuple(x[i : i + 6]), []):
            gaps.add(i - j)
        seen[tuple(x[i : i + 6])].append(i)
    out, n = [], len(x)
    for q in sorted(gaps):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and not any(s <= i and j + q <= s + m and q % d == 0 for s, m, d in out):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op12(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    clear_stages(spark)
    assert len(got) == len(rows) and sum(r["n_runs"] for r in got.values()) > 100
    for r in rows:
        x, g = edited(r["doc_id"], r["text"]), got[r["doc_id"]]
        want = fast_runs(x, 12)
        assert g["n_runs"] == len(want)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in want)
        assert g["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert g["collapsed_sha256"] == hashlib.sha256(collapsed(x, want).encode()).hexdigest()
        best = max(want, key=lambda t: (t[1], -t[0], -t[2]), default=(None, None, None))
        assert (g["start"], g["length"], g["period"]) == best
        assert g["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "a b " * 6), (5, "a b " * 6), (None, "x y " * 12), (6, "A a " * 7 + "end"), (7, "w " * 11),
        (8, " ".join(["p q r s t u"] * 2)), (9, " ".join(str(i % 977) for i in range(30_000))), (10, " ".join(["aab " * 5 + "b"] * 4)), (11, "퟿ é " * 13),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, runs string, start int")
    out = periodic_runs.periodic_runs(df)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    want = sorted(((i is None, i or 0), fast_runs(words_of(t), 12), collapsed(words_of(t), fast_runs(words_of(t), 12))) for i, t in rows)
    assert got == want
    assert dict((k[1], runs) for k, runs, _ in got)[9] == [(0, 30_000, 977)]
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []
    clear_stages(spark)


def test_with_repeats(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(200)] + [(None, "a b c"), (10**12, None), (7, "")]
    got = periodic_runs.with_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    changed = 0
    for (i, text), r in zip(rows, got, strict=True):
        if i is None or not text:
            assert r["text"] == text
        else:
            assert words_of(r["text"]) == edited(i, text)
            changed += words_of(r["text"]) != words_of(text)
    assert changed > 5
