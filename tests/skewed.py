"""A skewed copy of the test tables: one user holds a third of the events, and many of those share one time."""

from __future__ import annotations

import os
import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq


def write_skewed(source: str, target: str, copies: int = 2, seed: int = 7) -> str:
    os.makedirs(target, exist_ok=True)
    for name in os.listdir(source):
        if name != "events.parquet":
            shutil.copyfile(f"{source}/{name}", f"{target}/{name}")
    events = pq.read_table(f"{source}/events.parquet").to_pandas()
    rng = np.random.default_rng(seed)
    parts = [events]
    for _ in range(copies - 1):
        more = events.copy()
        more["ts"] = more["ts"] + np.array(rng.integers(1, 3_600_000_000, len(more)), dtype="timedelta64[us]")
        more["value"] = np.round(more["value"] * rng.uniform(0.5, 1.5, len(more)), 2)
        parts.append(more)
    out = parts[0] if len(parts) == 1 else __import__("pandas").concat(parts, ignore_index=True)
    hot = rng.random(len(out)) < 1 / 3
    out.loc[hot, "user_id"] = 7
    same = hot & (rng.random(len(out)) < 0.5)
    out.loc[same, "ts"] = out["ts"].sort_values().iloc[len(out) // 2]
    out["event_id"] = rng.permutation(len(out)).astype("int64")
    out["ts"] = out["ts"].astype("datetime64[us]")
    table = pa.Table.from_pandas(out, schema=pq.read_schema(f"{source}/events.parquet"), preserve_index=False)
    pq.write_table(table, f"{target}/events.parquet")
    return target
