"""The sample of the join decides how its work is ordered, not what it finds."""

import random

import numpy as np
import pytest

from tests.llm.test_jaccard_join import brute, got
from tidemark.llm import jaccard_join


def texts():
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base, passage = [r.choice(words) for _ in range(60)], [r.choice(words) for _ in range(40)]
    rows = [(0, None), (1, "one two"), (2, "One TWO")]
    for i in range(30):  # near copies, some beyond the threshold
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(60)] = r.choice(words)
        rows.append((100 + i, " ".join(text)))
    rows += [(200 + i, " ".join(passage + [r.choice(words) for _ in range(r.randint(3, 40))])) for i in range(25)]
    rows += [(300 + i, " ".join(base[: r.randint(1, 16)] + [r.choice(words) for _ in range(r.randint(0, 2))])) for i in range(40)]
    return rows


@pytest.mark.parametrize("sample", ["nothing", "all is wide", "wrong counts", "wrong sizes"])
def test_any_sample_gives_the_same_result(spark, monkeypatch, sample):
    real, none = jaccard_join.wide_shingles, (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def drawn(docs, rows):
        tokens, uses, sizes, narrow = real(docs, rows)
        if sample == "nothing":
            return *none, {}, 1.0
        if sample == "wrong counts":
            return tokens, np.random.default_rng(1).permutation(uses.max() + 1 - uses), sizes, narrow
        if sample == "wrong sizes":
            return tokens, uses, {k: 10**6 for k in range(1, 8)}, 1e-3
        return tokens, uses, sizes, narrow

    monkeypatch.setattr(jaccard_join, "OFTEN", 1 if sample == "all is wide" else 2)
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "wide_shingles", drawn)
    rows = texts()
    assert got(spark, rows) == brute(rows)
