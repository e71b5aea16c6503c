"""Line dedup against a brute-force list of all repeated passages of lines."""

import random

import pytest

from tidemark.llm import line_dedup
from tidemark.sources.stage import clear_stages


def passages(lines, min_lines, min_chars):
    """First line, end and text of every run of lines that counts."""
    for a in range(len(lines)):
        for b in range(a + min_lines, len(lines) + 1):
            body = "\n".join(lines[a:b])
            if len(body) >= min_chars:
                yield a, b, (b - a, body)


def brute(rows, min_lines, min_chars):
    """Texts without the lines of passages that an earlier place has; ids are unique and not null here."""
    first, out = {}, []
    for doc_id, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a, b, body in passages(lines, min_lines, min_chars):
            if body in first:
                gone |= set(range(a, b))
            else:
                first[body] = (doc_id, a)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def result(spark, rows, **more):
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    clear_stages(spark)
    return sorted((r["doc_id"], r["text"], r["removed_lines"]) for r in got)


def test_passages_of_any_length_and_place(spark):
    rows = []
    for n in range(2, 9):
        for t in range(6):
            body = [f"passage {n} {t}, line {i} of several" for i in range(n)]
            for copy in range(2):
                around = [f"own line {n} {t} {copy} {i}" for i in range(6)]
                cut = (t + copy) % 7
                rows.append((len(rows), "\n".join(around[:cut] + body + around[cut:])))
    got = result(spark, rows)
    assert got == brute(rows, 2, 20)
    assert sum(n for _, _, n in got) == 6 * sum(range(2, 9)) and all("passage" not in text for i, text, _ in got if i % 2)


@pytest.mark.parametrize("min_lines, min_chars", [(2, 20), (3, 12), (1, 9), (2, 0)])
def test_random_lines(spark, min_lines, min_chars):
    draw = random.Random(5)
    words = ["", "", "a", "bb ", "é", "ccccc", "dddddddd", "a line of some length", "another line of words"]
    rows = [(i, "\n".join(draw.choice(words) + draw.choice(["", "", str(draw.randrange(9))]) for _ in range(draw.randrange(1, 30)))) for i in range(60)]
    got = result(spark, rows, min_lines=min_lines, min_chars=min_chars)
    assert got == brute(rows, min_lines, min_chars)
    assert sum(n for _, _, n in got) > 0
