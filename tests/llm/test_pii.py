"""Base spans against a plain reading of their definition, and the learned part by property."""

import hashlib
import re

from tidemark.llm import pii
from tidemark.llm.queries import op1
from tidemark.sources.stage import clear_stages

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    odd, even = number[::-1][0::2], number[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(x)))) for x in even)) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": kind == "card" and 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: base_spans(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1(spark, sf).collect()
    clear_stages(spark)
    assert len(got) == len(want) and sum(len(x) for x in want.values()) > 50
    for r in got:
        spans = want[r["doc_id"]]
        assert r["base_sha256"] == digest(spans)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in spans) for x in ("email", "ip", "card", "phone")]
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r["spans"].split(","))


def test_edge_texts(spark):
    texts = [
        None, "", "a@b.c_d@e.f x@y", "é 1.2.3.4.5.6.7.8 😀 256.1.1.1 001.02.3.4 " + "9" * 400 + ".1.1.1", "4111 1111-1111 1111 and 4111  1111",
        "+1 (743) 555-3824 +12 +123456789", "12 34 5 678 9-0 1 " * 30000, "x" * 200000 + "@a" + ".b" * 50000, "1.1" * 40000,
        "write to jo [at] mail [dot] com or call (743) 555-3824", "4111111111111111", "4111111111111111",
    ]
    rows = spark.createDataFrame([(i if i != 1 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find_spans(rows).collect()}
    clear_stages(spark)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [(pii.KINDS[x["k"]], x["s"], x["e"]) for x in got[i if i != 1 else None]["base"]]
        assert base == base_spans(t), t[:60]


def test_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_labelers_are_weighed():
    counts = [(0, (1, 1, 1), 500), (0, (1, 1, 0), 300), (0, (-1, -1, 0), 400), (0, (-1, 1, 0), 20), (0, (1, -1, 0), 15)]
    sure, truth = pii.fit_labelers(counts)
    assert truth[0, (1, 1, 1)] > 0.95 and truth[0, (-1, -1, 0)] < 0.05
    weights = pii.fit_classifier([(k, v, 1, n) for k, v, n in counts], truth)
    z = lambda v: sum(w * x for w, x in zip(weights, pii.features(0, v, 1), strict=True))
    assert z((1, 1, 1)) > 0 > z((-1, -1, 0)) and sure[0, 0] > 0.9
