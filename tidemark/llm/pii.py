"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Every pattern hit of a text is a candidate span. Three labelers vote on each (+1, 0, -1): `regex` (does the strict form hold),
`gazetteer` (is its suffix, prefix, range or first word listed) and `context` (does a cue word of its kind stand before it).
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind and gives every
pattern a probability. A logistic span classifier is trained on these and on shape features; it decides which candidates are
added. The base spans, those of the strict forms, always stay.

All text work is Spark SQL expressions. Only counts of vote patterns reach the driver: kinds x 3^3 votes x 4 length classes,
so 648 rows at most whatever the corpus holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole
from tidemark.sources.stage import stage

# Fixed values. A pattern that may not start inside a run of its own first class starts where a run or the search starts (\G), so
# each run is read once. Repeated groups are possessive: nothing follows them, so the matches are the same, and a text of any
# length needs no deeper stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"\b(?:token|api_key|apikey|secret|password|passwd) ?[=:] ?\"[0-9A-Za-z_/+=-]{16,200}\"",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?",
}
KINDS = ["email", "ip", "card", "phone", "secret", "name"]
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|33|34|44|49)\b|\(?[2-9])",
    "secret": r"(?=.*[0-9])(?=.*[A-Za-z])",
    "name": r" (?:Anna|Maria|John|James|Mary|Peter|Paul|Marie|Hans|Jose|Carlos|David|Laura|Thomas|Sarah|Michael)\b",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|write to)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|telefono)\b",
    "secret": r"(?i)\b(?:auth|bearer|login|config|credentials)\b",
    "name": r"(?i)\b(?:dear|patient|client|signed|by|from)\b",
}
WIDTH = 40  # characters of context before a span
BLOCK = 64  # matches that one fold handles
LABELERS = ["regex", "gazetteer", "context"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of digits."""
    each = F.transform(
        F.filter(F.split(F.reverse(number), ""), lambda x: x != ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
            F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def strict(kind: str, match: Column) -> Column:
    """Whether a hit of the base pattern is a base span."""
    if kind == "ip":  # compared as text, so that no part is too long for a number
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = digits(match)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def hits(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Replaces each column of matches by their start, end and words before: gaps between matches and matches add up to positions.

    Gaps, pairs and blocks have columns of their own, as an expression inside a lambda is computed anew for every item.
    """
    rows = rows.withColumns({f"g_{c}": F.when(F.size(c) > 0, F.split("t", p, -1)) for c, p in patterns.items()})
    pair = lambda g, m: F.struct(g.alias("gap"), m.alias("m"))
    rows = rows.withColumns({f"g_{c}": F.zip_with(F.slice(f"g_{c}", F.lit(1), F.size(c)), c, pair) for c in patterns})
    return rows.withColumns({c: placed(F.col(f"g_{c}")) for c in patterns}).drop(*[f"g_{c}" for c in patterns])


def placed(pairs: Column) -> Column:
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")
    # Running sums within blocks and over blocks: a fold that appends copies what it has, so folds are kept short.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.substring(x["gap"], -WIDTH, WIDTH).alias("b"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def next_block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(b, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["blocks"], F.array(inner["out"])).alias("blocks"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string,b:string>>>").alias("blocks"))
    return F.when(F.size(pairs) > 0, F.aggregate(blocks, begin, next_block, lambda acc: F.flatten(acc["blocks"]))).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, spans`: every candidate of a text with its votes, sorted by start and kind; `base` marks those that stay anyway."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("t"))
    has_digit = F.col("t").rlike("[0-9]")
    rows = rows.withColumn("digit", has_digit)
    guard = {
        "b_email": F.contains("t", F.lit("@")), "b_ip": F.col("digit"), "b_card": F.col("digit"), "b_phone": F.contains("t", F.lit("+")),
        "m_email": F.contains("t", F.lit("at)")) | F.contains("t", F.lit("at]")), "m_phone": F.col("digit"), "m_secret": F.contains("t", F.lit('"')),
        "m_name": F.col("t").rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\b"),
    }
    patterns = {f"b_{k}": p for k, p in BASE.items()} | {f"m_{k}": p for k, p in MORE.items()}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.when(guard[c], F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none) for c, p in patterns.items()})
    rows = hits(rows, patterns)

    def voted(c: str) -> Column:
        kind, base = c[2:], c[0] == "b"

        def one(x: Column) -> Column:
            ok = strict(kind, x["m"]) if base else F.lit(False)
            listed = x["m"].rlike(GAZETTEER[kind])
            n = F.length(x["m"])
            return F.struct(
                x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), ok.alias("base"),
                (F.when(ok, 1).otherwise(-1) if base else F.lit(0)).alias("regex"),
                F.when(listed, 1).otherwise(-1).alias("gazetteer"),
                F.when(x["b"].rlike(CUES[kind]), 1).otherwise(0).alias("context"),
                F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3).alias("size"),
            )

        return F.transform(F.col(c), one)

    return rows.select("doc_id", F.array_sort(F.concat(*[voted(c) for c in patterns])).alias("spans"))


def fit_labelers(counts: list[tuple], rounds: int = 30) -> tuple[dict, dict]:
    """Expectation-maximisation over `(kind, votes, n)`: the accuracy of each labeler for each kind, and the probability of each pattern."""
    truth = {(k, v): 1 / (1 + math.exp(-2.0 * sum(v))) for k, v, _ in counts}
    sure: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        prior: dict[int, float] = {}
        for kind in {k for k, _, _ in counts}:
            own = [(v, n, truth[k, v]) for k, v, n in counts if k == kind]
            prior[kind] = (sum(n * p for _, n, p in own) + 1) / (sum(n for _, n, _ in own) + 2)
            for j in range(len(LABELERS)):
                right = sum(n * (p if v[j] > 0 else 1 - p) for v, n, p in own if v[j])
                sure[kind, j] = min(0.98, max(0.55, (right + 2) / (sum(n for v, n, _ in own if v[j]) + 3)))
        for k, v, _ in counts:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(x * math.log(sure[k, j] / (1 - sure[k, j])) for j, x in enumerate(v))
            truth[k, v] = 1 / (1 + math.exp(-odds))
    return sure, truth


def features(kind: int, votes: tuple, size: int) -> list[float]:
    """Inputs of the span classifier: kind, votes for and against, length class."""
    return [float(kind == k) for k in range(len(KINDS))] + [float(v > 0) for v in votes] + [float(v < 0) for v in votes] + [float(size == s) for s in range(4)]


def fit_classifier(counts: list[tuple], truth: dict, rounds: int = 400, rate: float = 2.0) -> list[float]:
    """Logistic regression on `(kind, votes, size, n)` with the labelers' joint probability as target."""
    rows = [(features(k, v, s), truth[k, v], n) for k, v, s, n in counts]
    weights = [0.0] * len(features(0, (0,) * len(LABELERS), 0))
    total = sum(n for _, _, n in rows) or 1
    for _ in range(rounds):
        slope = [0.0] * len(weights)
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x, strict=True))))
            for i, v in enumerate(x):
                if v:
                    slope[i] += n * (p - y)
        weights = [w - rate * (g / total + 1e-4 * w) for w, g in zip(weights, slope, strict=True)]
    return weights


def score(weights: list[float], x: Column) -> Column:
    """The classifier's log-odds of one candidate."""
    n, m = len(KINDS), len(LABELERS)
    kind, plus, minus, size = weights[:n], weights[n : n + m], weights[n + m : n + 2 * m], weights[n + 2 * m :]
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), i + 1)
    z = pick(kind, x["k"]) + pick(size, x["size"])
    for j, name in enumerate(LABELERS):
        z = z + F.when(x[name] > 0, float(plus[j])).when(x[name] < 0, float(minus[j])).otherwise(0.0)
    return z


def listed(spans: Column) -> Column:
    """`kind:start:end` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`: `doc_id` and `spans`, an array of (start, kind, end, base, votes) in code points, end exclusive.

    A null or empty text has no spans. A null id stays null; repeated rows are each returned. Other columns are not read. An
    empty table gives no rows. An added span that touches a base span of the same kind is left out, as it is known already.
    """
    rows = stage(candidates(docs, id_col, text_col), "pii")
    votes = rows.select(F.explode("spans").alias("x")).select("x.*")
    seen = votes.groupBy("k", "size", *LABELERS).count().collect()  # 648 rows at most
    by_votes: dict[tuple, int] = {}
    for r in seen:
        key = (r["k"], tuple(r[j] for j in LABELERS))
        by_votes[key] = by_votes.get(key, 0) + r["count"]
    _, truth = fit_labelers([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    weights = fit_classifier(sorted((r["k"], tuple(r[j] for j in LABELERS), r["size"], r["count"]) for r in seen), truth)
    cut = math.log(threshold / (1 - threshold))
    base = F.filter("spans", lambda x: x["base"])
    rows = rows.withColumn("base", base).withColumn(
        "more", F.filter("spans", lambda x: ~x["base"] & (x["regex"] >= 0) & (score(weights, x) >= cut))
    )
    new = F.filter("more", lambda x: ~F.exists("base", lambda y: (y["k"] == x["k"]) & (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return rows.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", new))).alias("spans"))
