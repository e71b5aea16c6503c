"""Mixing to target weights with soft domain membership.

A naive Bayes classifier, trained on labelled documents, gives every document a probability for each domain. Each document gets
a nonnegative rate, the expected number of its copies in the mix, such that the expected tokens of every domain meet a target:
rates minimise the squared misses by projected gradient steps. The gradient for a document is its posterior times one vector of
misses, so an iteration is one aggregation over the table, and the state is the list of these vectors, a few numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.llm.common import map_batches, whole
from tidemark.llm.words import word_hashes
from tidemark.sources.stage import stage

BUCKETS = 1 << 18
TRAIN_ROWS = 20_000
HEATS = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5]
SURE = 4.0  # standard errors from 0 that a word's log-odds must be to count
RIDGE = 0.02  # of the largest eigenvalue, in the metric of the steps


def training_rows(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """`domain, half, text` of at most about `rows` labelled documents, drawn by a hash of the id. The drawn ids are broadcast: they are `rows` at most."""
    drawn = labelled.where(F.col("domain").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("domain").alias("domain"))
    drawn = drawn.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).alias("__id"), "domain")
    met = docs.join(F.broadcast(drawn), docs[id_col] == F.col("__id"))
    return met.select("domain", (F.pmod(F.xxhash64("__id", F.lit("half")), F.lit(4)) == 0).alias("half"), whole(text_col).alias("text"))


def buckets_of(words: np.ndarray) -> np.ndarray:
    """Buckets of the distinct words of a text."""
    return np.unique((words % np.uint64(BUCKETS)).astype(np.int64))


class Classifier:
    """Log-odds of each word bucket for each domain, where they are sure; prior log-odds; and the heat by which a text's sum counts."""

    def __init__(self, domains: list[str], table: np.ndarray, prior: np.ndarray, heat: float):
        self.domains, self.table, self.prior, self.heat = domains, table, prior, heat

    def sums(self, words: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(words), len(self.domains)))
        for i, w in enumerate(words):
            out[i] = self.table[:, buckets_of(w)].sum(axis=1)
        return out

    def posteriors(self, sums: np.ndarray, heat: float | None = None) -> np.ndarray:
        odds = self.prior + (self.heat if heat is None else heat) * sums
        odds -= odds.max(axis=1, keepdims=True)
        p = np.exp(odds)
        return p / p.sum(axis=1, keepdims=True)


def train(rows: DataFrame, domains: list[str]) -> Classifier:
    """Word log-odds from three quarters of the rows, by number of documents; the heat that makes the other quarter most likely.

    What reaches the driver has domains x (`BUCKETS` + 1) numbers.
    """
    width = len(domains)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((width, BUCKETS + 1))
        for batch in batches:
            names, half, texts = (c.to_pylist() for c in batch.columns)
            keep = [i for i, h in enumerate(half) if not h and names[i] in domains]
            for i, words in zip(keep, word_hashes([texts[i] for i in keep]), strict=True):
                d = domains.index(names[i])
                found[d, buckets_of(words)] += 1
                found[d, BUCKETS] += 1
        d, b = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(b), pa.array(found[d, b])], names=["d", "b", "n"])

    parts = stage(map_batches(rows, count, "d long, b long, n double"), "counts")
    docs = np.zeros(width)
    for r in parts.where(F.col("b") == BUCKETS).groupBy("d").agg(F.sum("n").alias("n")).collect():
        docs[r["d"]] = r["n"]
    by_word = parts.where(F.col("b") < BUCKETS).groupBy("b").agg(*[F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0.0)).alias(f"n{d}") for d in range(width)])
    total = sum((F.col(f"n{d}") for d in range(width)), F.lit(0.0))
    for d in range(width):
        own, rest = F.col(f"n{d}"), total - F.col(f"n{d}")
        odds = F.log((own + 1) / float(docs[d] + 2)) - F.log((rest + 1) / float(docs.sum() - docs[d] + 2))
        sure = F.abs(odds) >= SURE * F.sqrt(1 / (own + 1) + 1 / (rest + 1))
        by_word = by_word.withColumn(f"o{d}", F.when(sure, odds).otherwise(0.0))
    table = np.zeros((width, BUCKETS))
    for r in by_word.where(" OR ".join(f"o{d} <> 0" for d in range(width))).select("b", *[f"o{d}" for d in range(width)]).collect():
        table[:, r["b"]] = [r[f"o{d}"] for d in range(width)]
    model = Classifier(domains, table, np.log((docs + 1) / (docs + 1).sum()), HEATS[0])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(HEATS))
        for batch in batches:
            names, half, texts = (c.to_pylist() for c in batch.columns)
            keep = [i for i, h in enumerate(half) if h and names[i] in domains]
            sums, own = model.sums(list(word_hashes([texts[i] for i in keep]))), [domains.index(names[i]) for i in keep]
            for j, heat in enumerate(HEATS):
                loss[j] -= np.log(model.posteriors(sums, heat)[np.arange(len(own)), own] + 1e-12).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(HEATS))), pa.array(np.round(loss, 3))], names=["j", "loss"])

    losses = map_batches(rows, judge, "j long, loss double").groupBy("j").agg(F.sum("loss").alias("loss")).collect()
    if losses:
        model.heat = float(HEATS[min(losses, key=lambda r: (round(r["loss"], 1), r["j"]))["j"]])
    return model


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """`docs` with `__tokens` (words of the text) and `__p` (a probability for each domain, to six places)."""
    kept = docs.columns
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sums, tokens = np.zeros((len(texts), len(model.domains))), np.zeros(len(texts), np.int64)
            for i, words in enumerate(word_hashes(texts)):
                tokens[i], sums[i] = len(words), model.sums([words])[0]
            p = np.round(model.posteriors(sums), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens), pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*kept, "__tokens", "__p"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return map_batches(docs, run, ", ".join([*fields, "`__tokens` long", "`__p` array<double>"]))


def rate_of(steps: list[list[float]]) -> Column:
    """A document's rate after these steps, from 1: each adds posterior . step and stops at 0."""
    r = F.lit(1.0)
    for step in steps:
        move = F.lit(0.0)
        for d, g in enumerate(step):
            move = move + F.get("__p", F.lit(d)) * F.lit(float(g))
        r = F.greatest(F.lit(0.0), r + move)
    return r


def exact(x: Column) -> Column:
    """For sums that do not depend on the order of rows: six decimal places, added exactly."""
    return F.sum(F.round(x, 6).cast("decimal(24,6)")).cast("double")


def fit_rates(docs: DataFrame, targets: list[float], share: bool = True, keep: tuple[int, ...] = (), rounds: int = 40, tolerance: float = 1e-4) -> tuple[list[list[float]], dict]:
    """Steps whose rates make the expected tokens of domain d meet `targets[d]`, and a report.

    With `share`, targets are weights of the mix: they are scaled to the tokens of the table or, with `keep`, to the least total
    with which no domain of `keep` has to shrink. Steps are projected gradients of the squared misses, weighed by the inverse of
    sum(tokens p p') with a ridge: with it a step of 1 never overshoots. It ends when all misses are below `tolerance` of the total,
    when ten steps have not lowered the largest one by a twentieth, or after `rounds` steps: targets that nonnegative rates cannot
    reach leave the nearest mix, and the report says how far it is.
    """
    width = len(targets)
    p = [F.get("__p", F.lit(d)) for d in range(width)]
    tokens = F.col("__tokens").cast("double")
    first = docs.agg(*[exact(tokens * p[a] * p[b]).alias(f"h{a}_{b}") for a in range(width) for b in range(a, width)], *[exact(tokens * p[a]).alias(f"m{a}") for a in range(width)]).first()
    have = np.array([first[f"m{a}"] or 0.0 for a in range(width)])
    total = have.sum()
    want = np.array(targets, float)
    if share:
        want = want / want.sum()
        want = want * max([have[d] / want[d] for d in keep if want[d] > 0], default=total) if keep else want * total
    h = np.zeros((width, width))
    for a in range(width):
        for b in range(a, width):
            h[a, b] = h[b, a] = first[f"h{a}_{b}"] or 0.0
    inverse = np.linalg.inv(h + np.eye(width) * max(1e-9, RIDGE * np.linalg.eigvalsh(h).max()))
    steps: list[list[float]] = []
    scale = max(1.0, want.sum())
    past = [np.abs(want - have).max()]
    while total and len(steps) < rounds and past[-1] > tolerance * scale and (len(past) <= 10 or past[-1] < 0.95 * past[-11]):
        steps.append([float(f"{x:.9g}") for x in inverse @ (want - have)])
        rate = rate_of(steps)
        found = docs.agg(*[exact(tokens * p[a] * rate).alias(f"m{a}") for a in range(width)]).first()
        have = np.array([found[f"m{a}"] or 0.0 for a in range(width)])
        past.append(np.abs(want - have).max())
    return steps, {"want": want.tolist(), "have": have.tolist(), "miss": float(np.abs(want - have).max() / scale), "steps": len(steps)}


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    seed: int = 17, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """`docs` with `n_tokens`, `posteriors` (domains in order of name), `rate` and `copies`, whole copies drawn by a hash of id and text.

    `wanted` and `reached` are the same in all rows: for each domain, in order of name, the tokens that the weights ask for and
    the expected tokens that the rates give. They differ where no nonnegative rates meet the weights.

    `labelled` has `id_col` and `domain`; ids with a null or unlisted domain teach nothing, of several domains of an id the
    largest name counts. `train_rows` bounds the labelled documents that are used for training. A null or empty text has no
    tokens and the prior as posterior, so it takes part in no target. Without any label all domains are equally likely. A null
    id is drawn like any other. Rows that repeat id and text get the same rate and copies. Other columns stay, columns of the
    result's names are replaced, and an empty table gives no rows.
    """
    domains = sorted(weights)
    new = ["n_tokens", "posteriors", "rate", "copies", "wanted", "reached"]
    base = docs.select(*[c for c in docs.columns if c not in new])
    model = train(training_rows(base, labelled, id_col, text_col, train_rows), domains)
    rows = stage(with_posteriors(base, model, text_col), "posteriors")
    steps, report = fit_rates(rows.select("__tokens", "__p"), [weights[d] for d in domains], keep=tuple(domains.index(d) for d in keep))
    rate = F.round(rate_of(steps), 6)
    out = rows.select(*base.columns, F.col("__tokens").alias("n_tokens"), F.col("__p").alias("posteriors"), rate.alias("rate"))
    luck = uniform(seed, "copies", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(whole(text_col)))
    extra = (luck < F.col("rate") - F.floor("rate")).cast("long")
    wanted, reached = (F.array(*[F.lit(float(x)) for x in report[k]]) for k in ("want", "have"))
    return out.withColumn("copies", F.floor("rate").cast("long") + extra).withColumns({"wanted": wanted, "reached": reached})


def domains_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Domains of the labels table: `toxic`, else `high` or `low` quality; null where neither is known."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(id_col, domain.alias("domain"))
