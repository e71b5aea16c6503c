"""The size-aware join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import jaccard_join
from tidemark.llm.queries import op7
from tidemark.sources.stage import clear_stages

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posts[x].append(i)
    common = Counter()
    for members in posts.values():
        for i in range(len(members)):
            for j in range(i):
                common[members[j], members[i]] += 1
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)].append(doc_id)
    return sorted((str(d), len(sets[i]), str(min((x for x in low[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def got(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, cid string, n int")
    out = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.link_groups(df).collect())
    clear_stages(spark)
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in op7(spark, sf).collect())
    clear_stages(spark)
    assert out == brute(rows)


@pytest.mark.parametrize("wide", [False, True])
def test_groups_and_edges(spark, monkeypatch, wide):
    if wide:  # a sample in which almost every shared shingle is of wide use
        monkeypatch.setattr(jaccard_join, "OFTEN", 2)
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    passage = [r.choice(words) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (None, "one  two"), (5, "a b c d e f"), (6, "a b c d e f g"), (7, "a b c d e f g h")]
    for i in range(40):  # near copies, some beyond the threshold
        text = list(base)
        for _ in range(r.randint(0, 3)):
            text[r.randrange(60)] = r.choice(words)
        rows.append((100 + i, " ".join(text)))
    for i in range(30):  # a common passage in texts of their own
        rows.append((200 + i, " ".join(passage + [r.choice(words) for _ in range(r.randint(5, 40))])))
    for i in range(60):  # short texts
        rows.append((300 + i, " ".join(base[: r.randint(1, 16)] + [r.choice(words) for _ in range(r.randint(0, 2))])))
    rows += [(300, rows[-1][1]), (17, rows[-1][1]), (18, "x" * 100 + " " + "y " * 3000), (19, " ".join(f"v{i}" for i in range(3000))), (20, " ".join(f"v{i}" for i in range(3400)))]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert jaccard_join.link_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_sets_meet_in_a_subset():
    for boundary in range(1, jaccard_join.SMALL + 1):
        for a in range(1, boundary + 1):
            for b in range(a, boundary + 1):
                if 100 * a >= 75 * b:
                    k = jaccard_join.need(a, b, 75)
                    assert k in jaccard_join.subset_sizes(a, boundary, 75) and k in jaccard_join.subset_sizes(b, boundary, 75)


def test_long_text_is_hashed_like_short_pieces():
    from tidemark.llm import words

    text = " ".join(f"Word{i % 7919}é" for i in range(400_000))
    whole = list(words.word_hashes([text, "a B", None]))
    assert len(whole[0]) == 400_000 and np.array_equal(whole[0][:100], list(words.word_hashes([text[:1500]]))[0][:100])
    assert len(whole[1]) == 2 and len(whole[2]) == 0


def test_sketches_bound_what_sets_share():
    r = np.random.default_rng(4)
    for n, m in ((1, 1), (7, 9), (60, 80), (500, 400), (3000, 3900)):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, m, dtype=np.uint64)]))
        assert len(np.intersect1d(a, b)) <= jaccard_join.most_common(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= min(len(a), len(b))
