"""Seeded randomness as a pure function of (seed, purpose, ids).

Nothing here depends on partitioning, task order or retries, so a lost executor cannot change a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, purpose: str, *ids: Column | str) -> Column:
    """md5 of `seed|purpose|id|id...`; its text order is a random order of the ids."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[c.cast("string") for c in cols]))


def head32(hexdigest: Column) -> Column:
    """First 32 bits of a hex digest as a long."""
    return F.conv(F.substring(hexdigest, 1, 8), 16, 10).cast("long")


def uniform(seed: int, purpose: str, *ids: Column | str) -> Column:
    """Uniform number in [0, 1)."""
    return head32(digest(seed, purpose, *ids)).cast("double") / F.lit(4294967296.0)


def normal(seed: int, purpose: str, *ids: Column | str) -> Column:
    """Standard normal deviate (Box-Muller on two uniforms)."""
    u1 = F.lit(1.0) - uniform(seed, purpose + ".r", *ids)
    u2 = uniform(seed, purpose + ".a", *ids)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
