"""Tail probabilities. Spark has no such built-ins, so these are Arrow-batched pandas UDFs over NumPy."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohortspark.functions.scalars import c

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
TINY = 1e-300
LARGE_SHAPE = 1e4          # shapes from here on use the uniform expansion
ROUNDS = 1_000_000         # no shape below LARGE_SHAPE, and no beta of 1e9 degrees of freedom, comes near


def _gamma_ratio(b, a):
    """ln Gamma(a + b) - ln Gamma(b), by the difference of Stirling series where b is large (the logs themselves cancel)."""
    b, a = np.asarray(b, float), np.asarray(a, float)
    out = np.empty(b.shape)
    big = b > 1e3
    bb, aa = b[big], a[big]
    rest = lambda z: 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    out[big] = aa * np.log(bb) + (bb + aa - 0.5) * np.log1p(aa / bb) - aa + rest(bb + aa) - rest(bb)
    out[~big] = _lgamma(a[~big] + b[~big]) - _lgamma(b[~big]) if (~big).any() else 0.0
    return out


def _beta_fraction(x, a, b):
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    cc = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < TINY, TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, ROUNDS):
        for num in (m * (b - m) * x / ((qam + 2 * m) * (a + 2 * m)),
                    -(a + m) * (qab + m) * x / ((a + 2 * m) * (qap + 2 * m))):
            d = 1.0 + num * d
            d = np.where(np.abs(d) < TINY, TINY, d)
            cc = 1.0 + num / cc
            cc = np.where(np.abs(cc) < TINY, TINY, cc)
            d = 1.0 / d
            step = d * cc
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            return h
    raise ArithmeticError("the continued fraction of the incomplete beta function did not settle")


def beta_inc(x, a, b, rest=None):
    """Regularised incomplete beta function; ``rest`` is 1 - x where the caller knows it more exactly."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    y = 1 - x if rest is None else np.broadcast_to(np.asarray(rest, float), x.shape)
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    ok = (x > 0) & (x < 1) & np.isfinite(a) & np.isfinite(b)
    if ok.any():
        xv, av, bv = x[ok], a[ok], b[ok]
        swap = xv > (av + 1) / (av + bv + 2)
        yv = y[ok]
        xs, ys = np.where(swap, yv, xv), np.where(swap, xv, yv)
        as_, bs = np.where(swap, bv, av), np.where(swap, av, bv)
        log = lambda u, v: np.where(u > 0.5, np.log1p(-np.minimum(v, 0.75)), np.log(u))
        low, high = np.minimum(as_, bs), np.maximum(as_, bs)
        front = np.exp(_gamma_ratio(high, low) - _lgamma(low) + as_ * log(xs, ys) + bs * log(ys, xs))
        val = front * _beta_fraction(xs, as_, bs) / as_
        out[ok] = np.where(swap, 1 - val, val)
    return out


def _gamma_upper_large(s, x):
    """Upper incomplete gamma function for large shapes, uniform in x (DLMF 8.12): a normal tail and two corrections."""
    mu = x / s - 1
    small = np.abs(mu) < 0.02
    m = np.where(small, mu, 0.0)
    # mu - log1p(mu), by its series near 0
    gap = np.where(small, sum((-1)**k * m**k / k for k in range(2, 14)), mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2 * gap)
    e, u = np.where(small, 1.0, eta), np.where(small, 1.0, mu)
    c0 = np.where(small, -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864 + eta**4 / 2835 - 139 * eta**5 / 777600, 1 / u - 1 / e)
    c1 = np.where(small, -1 / 540 - eta / 288 + eta**2 / 378 - 77 * eta**3 / 77760, 1 / e**3 - 1 / u**3 - 1 / u**2 - 1 / (12 * u))
    return 0.5 * _erfc(eta * np.sqrt(s / 2)) + np.exp(-s * gap) / np.sqrt(2 * np.pi * s) * (c0 + c1 / s)


def gamma_upper(s, x):
    """Regularised upper incomplete gamma function."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    large = (s >= LARGE_SHAPE) & (x > 0) & np.isfinite(x)
    if large.any():
        out[large] = _gamma_upper_large(s[large], x[large])
    out[x <= 0] = 1.0
    low = (x > 0) & (x < s + 1) & ~large
    if low.any():
        sv, xv = s[low], x[low]
        term = 1.0 / sv
        total = term.copy()
        for k in range(1, ROUNDS):
            term = term * xv / (sv + k)
            total += term
            if np.all(term < total * 1e-17):
                break
        else:
            raise ArithmeticError("the series of the incomplete gamma function did not settle")
        out[low] = 1 - total * np.exp(-xv + sv * np.log(xv) - _lgamma(sv))
    high = (x >= s + 1) & np.isfinite(x) & ~large
    if high.any():
        sv, xv = s[high], x[high]
        b = xv + 1 - sv
        cc = np.full_like(xv, 1 / TINY)
        d = 1 / b
        h = d.copy()
        for k in range(1, ROUNDS):
            an = -k * (k - sv)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            cc = b + an / cc
            cc = np.where(np.abs(cc) < TINY, TINY, cc)
            step = d * cc
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        else:
            raise ArithmeticError("the continued fraction of the incomplete gamma function did not settle")
        out[high] = h * np.exp(-xv + sv * np.log(xv) - _lgamma(sv))
    out[np.isposinf(x)] = 0.0
    return out


def t_tail(t, df):
    """Two-sided Student t probability."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def normal_tail(z):
    z = np.asarray(z, float)
    return gamma_upper(0.5, z * z / 2.0)


def chi2_tail(x, df):
    return gamma_upper(np.asarray(df, float) / 2.0, np.asarray(x, float) / 2.0)


def binomial_sign(k, n):
    """Two-sided sign test at one half."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    low = np.minimum(k, n - k)
    return np.minimum(1.0, np.where(2 * low == n, 1.0, 2 * beta_inc(np.full(k.shape, 0.5), n - low, low + 1)))


EXACT_UNITS = 120          # with more units in both groups together the normal form with continuity correction is used


@lru_cache(maxsize=256)
def _u_upper(n1: int, n2: int) -> np.ndarray:
    """P(U >= u) for every u. The largest unit is of the first group with probability n1 / (n1 + n2), and then adds n2; all
    terms are positive, so nothing cancels. Kept for each pair of sizes: a batch of rows builds it once."""
    row = [np.ones(1) for _ in range(n2 + 1)]
    for i in range(1, n1 + 1):
        new = [np.ones(1)]
        for j in range(1, n2 + 1):
            p = np.zeros(i * j + 1)
            p[j:] += row[j] * (i / (i + j))
            p[:i * (j - 1) + 1] += new[j - 1] * (j / (i + j))
            new.append(p)
        row = new
    return np.minimum(np.cumsum(row[n2][::-1])[::-1], 1.0)


def mann_whitney_exact(u, n1, n2):
    """Two-sided p of one U without ties: exact, and beyond EXACT_UNITS units by the normal form."""
    n1, n2 = int(n1), int(n2)
    big = max(u, n1 * n2 - u)
    if n1 + n2 > EXACT_UNITS:
        z = (big - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
        return float(min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2))))
    return float(min(1.0, 2 * _u_upper(min(n1, n2), max(n1, n2))[math.ceil(big)]))


def _udf(fn, n_args):
    if n_args == 1:
        @pandas_udf("double")
        def run(a: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float)))
    elif n_args == 2:
        @pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float), b.to_numpy(float)))
    else:
        @pandas_udf("double")
        def run(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series([np.nan if not np.isfinite(x + y + z) else fn(x, y, z) for x, y, z in zip(a, b, d)])
    return run


def _apply(fn, *cols) -> Column:
    """NaN results (from NULL inputs) go back to NULL, so they never reach sums or orders."""
    v = _udf(fn, len(cols))(*[c(x).cast("double") for x in cols])
    return F.nanvl(v, F.lit(None).cast("double"))


def p_student(t, df) -> Column:
    return _apply(t_tail, t, df)


def p_normal(z) -> Column:
    return _apply(normal_tail, z)


def p_chi2(x, df) -> Column:
    return _apply(chi2_tail, x, df)


def p_sign(k, n) -> Column:
    return _apply(binomial_sign, k, n)


def p_mann_whitney_exact(u, n1, n2) -> Column:
    return _apply(mann_whitney_exact, u, n1, n2)
