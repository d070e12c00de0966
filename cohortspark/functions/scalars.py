"""Column expressions: guarded arithmetic, transforms, binning, shared hashing.

Spark runs in ANSI mode, so every division whose divisor can be zero goes through :func:`ratio`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SCALE = 1e4  # counts per ten thousand


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """``num / den``, NULL where the divisor is 0."""
    den = c(den).cast("double")
    return c(num).cast("double") / F.when(den != 0, den)


def log_cp10k(count, library) -> Column:
    """log1p of counts per ten thousand; an empty library divides by 1."""
    lib = c(library).cast("double")
    return F.log1p(c(count).cast("double") / F.when(lib != 0, lib).otherwise(1.0) * SCALE)


def zscore(x, part: Sequence[str] = (), ddof: int = 0, eps: float | None = None) -> Column:
    """Standard score over a window. Zero spread gives 0, or is damped by ``eps`` added to the divisor."""
    w = Window.partitionBy(*part)
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(c(x)).over(w)
    centred = c(x) - F.avg(c(x)).over(w)
    if eps is not None:
        return centred / (sd + F.lit(eps))
    return F.coalesce(centred / F.when(sd != 0, sd), F.lit(0.0))


def centre(x, part: Sequence[str]) -> Column:
    return c(x) - F.avg(c(x)).over(Window.partitionBy(*part))


def clr(fraction, part: Sequence[str], offset: float = 1e-4) -> Column:
    """Centred log-ratio of a composition inside each ``part``."""
    return centre(F.log(c(fraction) + F.lit(offset)), part)


def fisher_z(rho, clip: float = 0.9999) -> Column:
    return F.atanh(F.greatest(F.least(c(rho), F.lit(clip)), F.lit(-clip)))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def bin_by_edges(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; outside values are NULL."""
    x = c(x)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        out = out.when((x > F.lit(float(lo))) & (x <= F.lit(float(hi))), F.lit(lab))
    return out


def equal_width_bin(x, lo, hi, k: int) -> Column:
    """Index 0..k-1 of ``k`` right-closed equal-width bins on ``[lo, hi]``; ``lo`` itself falls in bin 0."""
    x, lo, hi = c(x), c(lo), c(hi)
    pos = F.ceil((x - lo) / F.when(hi != lo, hi - lo) * F.lit(float(k))) - 1
    return F.coalesce(F.greatest(F.least(pos, F.lit(k - 1)), F.lit(0)), F.lit(0)).cast("int")


def ordinal_decode(logits) -> Column:
    """Rank predicted by cumulative-threshold logits: number of thresholds passed with probability > 0.5."""
    return F.aggregate(c(logits), F.lit(0), lambda acc, x: acc + F.when(x > 0, 1).otherwise(0))


def cumulative_targets(rank, n_levels: int) -> Column:
    """Array of 0/1 flags ``rank > j`` for the ``n_levels - 1`` thresholds."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_levels - 2)),
                       lambda j: F.when(c(rank) > j, 1).otherwise(0))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def softmax(x, part: Sequence[str]) -> Column:
    w = Window.partitionBy(*part)
    e = F.exp(c(x) - F.max(c(x)).over(w))
    return e / F.sum(e).over(w)


def sign_label(x, up: str = "ascending", down: str = "descending", flat: str = "plateau") -> Column:
    x = c(x)
    return F.when(x > 0, up).when(x < 0, down).when(x == 0, flat)


# ---- shared hash: md5 gives the same bits in every SQL engine, so random designs are reproducible elsewhere ----

def hash_text(*parts) -> Column:
    return F.concat_ws("|", *[c(p).cast("string") for p in parts])


def hash_key(*parts) -> Column:
    """Sort key of a pseudo-random order."""
    return F.md5(hash_text(*parts))


def hash_u32(*parts) -> Column:
    """Pseudo-random integer in [0, 2^32)."""
    return F.conv(F.substring(F.md5(hash_text(*parts)), 1, 8), 16, 10).cast("bigint")


def hash_sign(*parts) -> Column:
    return F.when(hash_u32(*parts) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
