"""Line dedup against a brute-force reading of its definition: whole table, nulls, ties, repeated rows, clashing columns."""

import xxhash

from tidemark.llm import line_dedup
from tidemark.llm.queries import op6
from tidemark.sources.stage import clear_stages


def text_hash(s):
    h = xxhash.xxh64(s.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def shortest(lines, min_lines=2, min_chars=20):
    """The shortest counting passage from each line on and up to each line; every longer one is made up of these."""
    found = set()
    sizes = [len(x) + 1 for x in lines]
    for step in (1, -1):
        for i in range(len(lines)):
            j, n, chars = i, 0, -1
            while 0 <= j < len(lines) and (n < min_lines or chars < min_chars):
                n, chars, j = n + 1, chars + sizes[j], j + step
            if n >= min_lines and chars >= min_chars:
                a, b = (i, i + n) if step == 1 else (i + 1 - n, i + 1)
                found.add((a, b, "\n".join(lines[a:b])))
    return found


def brute(rows):
    first, out = {}, []
    place = lambda doc_id, text, a: (2**63 - 1 if doc_id is None else doc_id, text_hash(text), a)
    for doc_id, text in rows:
        if text is not None:
            for a, _, body in shortest(text.split("\n")):
                first[body] = min(first.get(body, (2**63, 0, 0)), place(doc_id, text, a))
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, None, 0))
            continue
        lines, gone = text.split("\n"), set()
        for a, b, body in shortest(lines):
            if first[body] != place(doc_id, text, a):
                gone |= set(range(a, b))
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r["doc_id"], r["text"], r["removed_lines"]) for r in op6(spark, sf).collect()]
    clear_stages(spark)
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(n for _, _, n in want) > 1000


def test_edges(spark):
    passage = "\n".join(f"a passage of many lines, number {i}" for i in range(12))
    rows = [
        (1, passage), (2, "own line\n" + passage + "\nend"), (2, "own line\n" + passage + "\nend"), (None, passage), (None, None), (3, ""), (4, None),
        (5, "one line only"), (6, "one line only"), (7, passage + "\n" + passage), (8, "\n".join(f"x{i % 50} long line of words" for i in range(5000))), (9, "\r\n\r\n \n"),
    ]
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, start string, removed_lines int")
    out = line_dedup.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "start", "removed_lines"]
    got = [(r["doc_id"], r["text"], r["removed_lines"]) for r in out.collect()]
    clear_stages(spark)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert sum(n for _, _, n in got) > 20


def test_empty(spark):
    assert line_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
