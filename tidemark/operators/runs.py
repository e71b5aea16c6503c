"""Comparison of runs: sweeps over scoring settings, best run, running best, early stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ordered import SPAN, Running, bucket_by_index, exact_quantiles, framed, running
from tidemark.operators.score import elementwise_error, metrics_record
from tidemark.sources.stage import stage

# fixed values: direction of each metric, looked up by the metric's name
METRIC_MODES = {
    "loss": "min",
    "f1_score": "max",
    "precision": "max",
    "recall": "max",
    "accuracy": "max",
    "roc_auc": "max",
    "fpr": "min",
    "tpr": "max",
    "error": "min",
    "mae": "min",
    "mse": "min",
}
FAN = 64  # maps of neighbouring buckets that are composed into one at a time
# fixed values: metrics in order of preference
PREFERRED_METRICS = ["val_loss", "val_roc_auc", "val_f1_score", "val_tpr", "val_fpr"]


def metric_mode(metric: str) -> str:
    """`min` or `max` for a metric name; names without a known part are maximised."""
    name = metric.lower()
    known = [mode for part, mode in METRIC_MODES.items() if part in name]
    return known[0] if known else "max"


def choose_metric(wanted: str | None, reported: Sequence[str], has_eval_set: bool) -> tuple[str, str]:
    """Metric and direction to compare runs by; `val_loss`, `min` when the wish cannot be met."""
    options = [wanted] if wanted else [m for m in PREFERRED_METRICS if m in reported]
    metric = options[0] if options else "val_loss"
    usable = metric in PREFERRED_METRICS and (has_eval_set or metric == "val_loss")
    return (metric, metric_mode(metric)) if usable else ("val_loss", "min")


# ---------------------------------------------------------------- sweep

def settings_grid(spark: SparkSession, options: dict[str, Sequence]) -> DataFrame:
    """One row per combination of the listed options with a `config_id` in listing order."""
    grid = spark.range(1).drop("id").select(F.lit(0).alias("config_id"))
    for name, values in options.items():
        grid = grid.select(
            *grid.columns, F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name)
        ).withColumn("config_id", F.col("config_id") * len(values) + F.col("_i")).drop("_i")
    return grid


def drop_equal_settings(grid: DataFrame, when: Column, column: str, keep: str) -> DataFrame:
    """Where `when` holds, all values of `column` mean the same: keep one of them."""
    merged = grid.withColumn(column, F.when(when, F.lit(keep)).otherwise(F.col(column)))
    return merged.groupBy(*[c for c in merged.columns if c != "config_id"]).agg(F.min("config_id").alias("config_id"))


def sweep(
    deltas: DataFrame, ids: Sequence[str], channels: Sequence[str], settings: Sequence[dict], normal: str = "normal"
) -> DataFrame:
    """Metrics for every scoring setting in one plan.

    `deltas` holds per (ids, pos) the output minus target of each channel, `label`, and `normal` = 1 for rows that set the
    normaliser. A setting has `error` (abs/se), `epsilon` and `level` (step/window); rows carry a `config_id`.
    """
    listed = F.array(*[
        F.struct(
            F.lit(i).alias("config_id"), F.lit(s["error"]).alias("error"), F.lit(float(s["epsilon"])).alias("epsilon"),
            F.lit(s["level"]).alias("level"),
        )
        for i, s in enumerate(settings)
    ])
    kinds = F.array(*[F.lit(k) for k in sorted({s["error"] for s in settings})])
    by_kind = deltas.withColumn("error", F.explode(kinds)).withColumns({
        c: F.when(F.col("error") == "abs", elementwise_error(F.col(c), F.lit(0.0), "abs")).otherwise(
            elementwise_error(F.col(c), F.lit(0.0), "se")
        )
        for c in channels
    })
    long = by_kind.where(F.col(normal) == 1).select(
        F.inline(F.array(*[
            F.struct(F.concat_ws("|", "error", F.lit(c)).alias("k"), F.col(c).alias("err")) for c in channels
        ]))
    )
    medians = {row["k"]: row["q"] for row in exact_quantiles(long, ["k"], "err", [0.5]).collect()}  # error kinds x channels
    fanned = by_kind.withColumn("s", F.explode(F.filter(listed, lambda s: s["error"] == F.col("error"))))

    def factor(c: str) -> Column:
        return F.coalesce(*[
            F.when(F.col("error") == k.partition("|")[0], F.lit(q)) for k, q in medians.items() if k.partition("|")[2] == c
        ])

    scaled = [F.col(c) / (factor(c) + F.col("s.epsilon")) for c in channels]
    score = sum(scaled) / F.lit(float(len(channels)))
    steps = fanned.select(*ids, F.col("s.config_id").alias("config_id"), F.col("s.level").alias("level"), score.alias("score"), "label")
    windows = steps.where("level = 'window'").groupBy(*ids, "config_id").agg(
        F.avg("score").alias("score"), F.max("label").alias("label")
    )
    both = steps.where("level = 'step'").select("config_id", "score", "label").unionByName(
        windows.select("config_id", "score", "label")
    )
    record = metrics_record(both, ["config_id"])
    return record.withColumn("setting", F.get(listed, F.col("config_id"))).select(
        "config_id", "setting.error", "setting.epsilon", "setting.level",
        "roc_auc", "threshold", "tpr", "fpr", "precision", "recall", "f1",
    )


def scoring_grid(spark: SparkSession, options: dict[str, Sequence]) -> list[dict]:
    """The settings of an option grid over `error`, `normaliser`, `epsilon` and `level`, each meaning once, in listing order.

    With `normaliser='none'` nothing is divided, so all values of `epsilon` mean the same and the first is kept.
    """
    known = {"error": ["abs"], "normaliser": ["median"], "epsilon": [1e-3], "level": ["step"]}
    unknown = set(options) - set(known)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    full = {k: list(options.get(k, v)) for k, v in known.items()}
    if bad := [v for k, allowed in (("error", ("abs", "se")), ("normaliser", ("median", "none")), ("level", ("step", "window"))) for v in full[k] if v not in allowed]:
        raise ValueError(f"unknown values {bad}")
    grid = settings_grid(spark, full).withColumn("epsilon", F.col("epsilon").cast("double"))
    merged = drop_equal_settings(grid, F.col("normaliser") == "none", "epsilon", full["epsilon"][0])
    return [r.asDict() for r in merged.orderBy("config_id").collect()]  # as many as the caller listed


def sweep_grid(
    deltas: DataFrame, ids: Sequence[str], channels: Sequence[str], settings: Sequence[dict], normal: str = "normal"
) -> DataFrame:
    """One metrics record per setting of `scoring_grid`, all in one plan.

    `deltas` holds per (ids, pos) the output minus target of each channel, `label`, and `normal` = 1 for rows that set the normaliser.
    Every step is read once and carries one score column for each way of scoring; windows average all columns in one grouping. Only
    then are scores listed by setting: equal ones collapse in the map tasks, and all curves run over one order of scores.
    """
    kinds = sorted({s["error"] for s in settings})
    errors = {(k, c): elementwise_error(F.col(c), F.lit(0.0), k) for k in kinds for c in channels}
    medians = {}
    if any(s["normaliser"] == "median" for s in settings):
        wanted = F.array(*[F.struct(F.lit(c).alias("c"), elementwise_error(F.col(c), F.lit(0.0), "abs").alias("err")) for c in channels])
        long = deltas.where(F.col(normal) == 1).select(F.inline(wanted))
        middle = exact_quantiles(long, ["c"], "err", [0.5]).collect()  # one row per channel
        # squares are in the order of the absolute errors, so one order gives the neighbours of both medians
        for kind, of in (("abs", lambda x: x), ("se", lambda x: x * x)):
            medians |= {f"{kind}|{m['c']}": of(m["low"]) + (of(m["high"]) - of(m["low"])) * m["fraction"] for m in middle}

    def scored(s: dict) -> Column:
        parts = [errors[s["error"], c] if s["normaliser"] == "none" else errors[s["error"], c] / F.lit(medians[f"{s['error']}|{c}"] + s["epsilon"]) for c in channels]
        return sum(parts) / F.lit(float(len(channels)))

    label = (F.coalesce("label", F.lit(0)) > 0).cast("int")
    parts = []
    for kind in ("step", "window"):
        own = [s for s in settings if s["level"] == kind]
        if not own:
            continue
        wide = deltas.select(*ids, label.alias("label"), *[scored(s).alias(f"s{s['config_id']}") for s in own])
        if kind == "window":
            wide = wide.groupBy(*ids).agg(F.max("label").alias("label"), *[F.avg(f"s{s['config_id']}").alias(f"s{s['config_id']}") for s in own])
        listed = F.array(*[F.struct(F.lit(s["config_id"]).alias("config_id"), F.col(f"s{s['config_id']}").alias("score")) for s in own])
        parts.append(wide.select(F.inline(listed), "label"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = F.array(*[F.struct(*[F.lit(s[k]).alias(k) for k in ("config_id", "error", "normaliser", "epsilon", "level")]) for s in settings])
    named = metrics_record(both, ["config_id"]).withColumn("s", F.get(F.filter(names, lambda s: s["config_id"] == F.col("config_id")), F.lit(0)))
    return named.select(
        "config_id", "s.error", "s.normaliser", "s.epsilon", "s.level", "roc_auc", "threshold", "tpr", "fpr", "precision", "recall", "f1", "p", "n"
    )


# ---------------------------------------------------------------- runs

def number_or_null(value: Column) -> Column:
    """The value as double, null where it is not a number."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def best_run(runs: DataFrame, metric: str, mode: str | None = None, run: str = "run_id", epoch: str = "epoch", scope: str = "last") -> DataFrame:
    """The best run by its last (`scope='last'`) or its best (`scope='all'`) value; ties go to the smaller run id.

    A value that is not a number counts as missing: a run that ends with one is not ranked by its last value.
    """
    mode = mode or metric_mode(metric)
    sign = 1.0 if mode == "max" else -1.0
    known = number_or_null(F.col(metric))
    if scope == "last":
        value = number_or_null(F.max_by(metric, epoch))
    else:
        value = (F.max if mode == "max" else F.min)(known)
    per_run = runs.groupBy(run).agg(value.alias(metric), F.count(F.lit(1)).alias("epochs")).where(F.col(metric).isNotNull())
    return per_run.orderBy((F.lit(sign) * F.col(metric)).desc(), F.col(run)).limit(1)


def running_best(
    runs: DataFrame, metrics: dict[str, str], run: str = "run_id", idx: str = "epoch", span: int = SPAN
) -> DataFrame:
    """Best value so far of every metric (`metric -> min/max`) and `improved_<metric>` where it moved.

    A value that is not a number is never a best one.
    """
    specs = {}
    for m, mode in metrics.items():
        specs[f"best_{m}"] = Running(mode, number_or_null(F.col(m)))
        specs[f"_before_{m}"] = Running(mode, number_or_null(F.col(m)), exclusive=True)
    out = running(bucket_by_index(runs, idx, span), [run], [F.col(idx)], specs)

    def better(m: str, mode: str) -> Column:
        now, old = number_or_null(F.col(m)), F.col(f"_before_{m}")
        moved = (now > old) if mode == "max" else (now < old)
        return (now.isNotNull() & F.coalesce(moved, F.lit(True))).cast("int")

    return out.withColumns({f"improved_{m}": better(m, mode) for m, mode in metrics.items()}).drop(
        *[f"_before_{m}" for m in metrics]
    )


def early_stop_epoch(
    runs: DataFrame,
    metric: str,
    patience: int,
    min_delta: float,
    mode: str = "min",
    run: str = "run_id",
    idx: str = "idx",
    span: int = 1 << 12,
) -> DataFrame:
    """Position at which `patience` evaluations in a row failed to beat the best by more than `min_delta`; NULL if never.

    A value that is not a number improves nothing; a run whose first value is none never improves. The best only moves on such an
    improvement, so each row points to the first row among the next `patience` ones that
    beats it, and the bests of a run are the chain of pointers from its first row. A chain enters a bucket on one of its
    first `patience` rows: each bucket is reduced to (entry -> exit). Such maps compose, so `FAN` of them in a row become one, level by
    level, until a run has one map; no row grows with the run.
    """
    cost = F.col(metric) if mode == "min" else -F.col(metric)
    base = runs.select(run, idx, cost.cast("double").alias("v"))
    ahead = framed(base, [run], idx, {"_next": (F.collect_list(F.struct(idx, "v")), 1, patience)}, span, keep_bucket=True)
    # nothing beats a best that is not a number, and such a value beats nothing
    beats = lambda r: ~F.isnan(F.col("v")) & ~F.isnan(r["v"]) & ((F.col("v") - r["v"]) > F.lit(float(min_delta)))
    nxt = F.get(F.array_sort(F.filter("_next", beats)), F.lit(0))
    # a full look-ahead without improvement stops the run; a short one means the run ended first
    full = F.size("_next") == patience
    linked = ahead.select(run, "_b", F.col(idx).alias("i"), nxt[idx].alias("to"), full.alias("full"))
    width = max(span, patience)
    packed = linked.groupBy(run, "_b").agg(F.array_sort(F.collect_list(F.struct("i", "to", "full"))).alias("rows"))
    state = "struct<at:bigint,stop:bigint>"
    stay = lambda at, stop: F.struct(at.cast("bigint").alias("at"), stop.cast("bigint").alias("stop"))
    none = F.lit(None).cast("bigint")

    def walk(entry: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            ended = F.when(r["full"], stay(none, r["i"] + patience)).otherwise(stay(none, none))
            return F.when(acc["at"] == r["i"], F.when(r["to"].isNotNull(), stay(r["to"], none)).otherwise(ended)).otherwise(acc)

        return F.aggregate(F.col("rows"), F.struct(entry.cast("bigint").alias("at"), none.alias("stop")), step)

    entries = F.sequence(F.lit(0), F.lit(patience - 1))
    first = F.col("_b") * F.lit(width)
    exits = F.map_from_entries(F.transform(entries, lambda e: F.struct((first + e).alias("entry"), walk(first + e).alias("exit"))))
    reduced = packed.select(run, "_b", exits.alias("exits"))

    def hop(acc: Column, bucket: Column) -> Column:
        found = F.get(F.filter(bucket["exits"], lambda e: e["key"] == acc["at"]), F.lit(0))
        return F.when(found.isNotNull(), found["value"]).otherwise(acc)

    level = stage(reduced, "exits")
    last = level.agg(F.max("_b")).first()[0] or 0
    while last > 0:
        last //= FAN
        hops = level.groupBy(run, F.floor(F.col("_b") / FAN).cast("long").alias("_b")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"), F.map_entries("exits").alias("exits")))).alias("hops")
        )
        through = lambda e: F.aggregate("hops", F.struct(e["key"].alias("at"), none.alias("stop")).cast(state), hop)
        level = hops.select(run, "_b", F.map_from_entries(F.transform(F.get("hops", F.lit(0))["exits"], lambda e: F.struct(e["key"].alias("entry"), through(e).alias("exit")))).alias("exits"))
    start = F.element_at("exits", F.lit(0).cast("bigint"))
    return level.select(run, start["stop"].alias("stop_idx"))
