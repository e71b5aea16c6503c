"""First and second moments of array columns, all columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_moments(df: DataFrame, arrays: dict[str, Column]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per name: number of rows, mean and population covariance of the array's places; rows with a null array or place are left out.

    Two passes over all arrays together: means, then products of deviations. A task returns one sum per pair of places, so what
    reaches the driver has (arrays x places^2) numbers.
    """
    names = list(arrays)
    rows = df.select(*[F.when(~F.exists(c, lambda x: x.isNull()), c.cast("array<double>")).alias(f"a{i}") for i, c in enumerate(arrays.values())])

    def sums(centres: list[np.ndarray] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for i in range(len(names)):
                    column = batch.column(i).drop_null()
                    if not len(column):
                        continue
                    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                    part = x.sum(axis=0)[None, :] if centres is None else (x - centres[i]).T @ (x - centres[i])
                    if i in total:
                        total[i] = [total[i][0] + len(x), total[i][1] + part]
                    else:
                        total[i] = [len(x), part]
            for i, (n, part) in total.items():
                a, b = np.indices(part.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.size, i)), pa.array(a.ravel()), pa.array(b.ravel()), pa.array(part.ravel()), pa.array(np.full(part.size, n))],
                    names=["i", "a", "b", "s", "n"],
                )

        found = rows.mapInArrow(run, "i long, a long, b long, s double, n long").groupBy("i", "a", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        out: list[tuple[int, np.ndarray]] = []
        for i in range(len(names)):
            own = [r for r in found if r["i"] == i]
            if not own:
                raise ValueError(f"no complete row of {names[i]}")
            grid = np.zeros((max(r["a"] for r in own) + 1, max(r["b"] for r in own) + 1))
            for r in own:
                grid[r["a"], r["b"]] = r["s"]
            out.append((own[0]["n"], grid))
        return out

    means = [s[0] / n for n, s in sums(None)]
    return {name: (n, means[i], s / n) for i, (name, (n, s)) in enumerate(zip(names, sums(means), strict=True))}
