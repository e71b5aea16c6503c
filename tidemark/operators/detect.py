"""Simple detectors and the slot for user models.

Each detector turns a window set into the same set with `out_<channel>` arrays beside the channel arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.moments import array_moments
from tidemark.functions.ordered import double_array
from tidemark.operators.windows import explode_positions


def recon_mean_fit(windows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean per window position and channel over training windows: L rows."""
    return explode_positions(windows, [], channels).groupBy("pos").agg(*[F.avg(c).alias(c) for c in channels])


def recon_mean(windows: DataFrame, fitted: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Reconstruct every window as the training mean; the fitted table has one row per window position."""
    rows = sorted(fitted.select("pos", *channels).collect())
    return windows.withColumns({f"out_{c}": double_array([row[c] for row in rows]) for c in channels})


def forecast_last(windows: DataFrame, channels: Sequence[str], ahead: int) -> DataFrame:
    """Forecast `ahead` steps as the last value of the window."""
    return windows.withColumns({f"out_{c}": F.array_repeat(F.element_at(c, -1), ahead) for c in channels})


def _flat(channels: Sequence[str]):
    return F.concat(*[F.col(c) for c in channels])


def recon_linear_fit(windows: DataFrame, channels: Sequence[str], compression: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions of flattened training windows; `max(1, size // compression)` directions are kept."""
    _, mean, spread = array_moments(windows, {"window": _flat(channels)})["window"]
    values, vectors = np.linalg.eigh(spread)
    k = max(1, len(mean) // compression)
    return mean, vectors[:, np.argsort(values)[::-1][:k]]


def recon_linear(windows: DataFrame, fitted: tuple[np.ndarray, np.ndarray], channels: Sequence[str]) -> DataFrame:
    """Reconstruct through the narrow code: `mean + PC PC' (x - mean)`."""
    mean, pc = fitted

    def model(batch: np.ndarray) -> np.ndarray:
        flat = batch.transpose(0, 2, 1).reshape(len(batch), -1)
        out = mean + (flat - mean) @ pc @ pc.T
        return out.reshape(len(batch), batch.shape[2], batch.shape[1]).transpose(0, 2, 1)

    return score_with_model(windows, model, channels)


def forecast_linear_fit(windows: DataFrame, channels: Sequence[str]) -> dict[str, tuple[float, list[float]]]:
    """Per channel: intercept and coefficients predicting the next value from the window; needs `y_<channel>`.

    Least squares from the moments of all channels, found in one pass.
    """
    both = {c: F.concat(F.col(c), F.slice(f"y_{c}", 1, 1)) for c in channels}
    out = {}
    for c, (_, mean, spread) in array_moments(windows, both).items():
        weights = np.linalg.lstsq(spread[:-1, :-1], spread[:-1, -1], rcond=1e-12)[0]
        out[c] = (float(mean[-1] - weights @ mean[:-1]), [float(x) for x in weights])
    return out


def forecast_linear(
    windows: DataFrame, fitted: dict[str, tuple[float, list[float]]], channels: Sequence[str], ahead: int
) -> DataFrame:
    """Predict `ahead` steps, feeding each prediction back in as the newest value."""
    def roll(c: str):
        intercept, coefs = fitted[c]
        weights = double_array(coefs)
        length = len(coefs)

        def step(state, _):
            recent = F.slice(state, F.size(state) - (length - 1), length)
            dot = F.aggregate(F.zip_with(recent, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
            return F.concat(state, F.array(dot + F.lit(intercept)))

        rolled = F.aggregate(F.sequence(F.lit(1), F.lit(ahead)), F.col(c), step)
        return F.slice(rolled, length + 1, ahead)

    return windows.withColumns({f"out_{c}": roll(c) for c in channels})


def score_with_model(
    windows: DataFrame, model: Callable[[np.ndarray], np.ndarray], channels: Sequence[str]
) -> DataFrame:
    """Apply a user model `[N, L, F] -> [N, L', F]` batch by batch in the tasks; every input column is kept."""
    fields = [*windows.schema.fields, *[T.StructField(f"out_{c}", T.ArrayType(T.DoubleType())) for c in channels]]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.stack(pdf[c].to_numpy()) for c in channels], axis=2).astype(float)
                y = model(x)
                for i, c in enumerate(channels):
                    pdf[f"out_{c}"] = pd.Series(list(y[:, :, i]), index=pdf.index)
                yield pdf

    return windows.mapInPandas(run, T.StructType(fields))


# Detectors by name: (fit, apply). `fit` sees training windows, `apply` any window set.
DETECTORS: dict[str, tuple[Callable, Callable]] = {
    "recon_mean": (recon_mean_fit, recon_mean),
    "recon_linear": (recon_linear_fit, recon_linear),
    "forecast_last": (lambda windows, channels: None, lambda windows, fitted, channels, ahead=1: forecast_last(windows, channels, ahead)),
    "forecast_linear": (forecast_linear_fit, forecast_linear),
}
