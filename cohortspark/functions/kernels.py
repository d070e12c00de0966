"""Small NumPy kernels run inside Spark tasks: elastic net on cross-products, logistic regression, projections.

They see sufficient statistics or short unit tables, never a whole data matrix. Sizes are bounded by the number of
selected features and covariates, which are parameters.
"""

from __future__ import annotations

import numpy as np


SWEEPS = 100_000           # rounds after which a fit counts as failed; a few tens are usual


def covariate_basis(cov: np.ndarray, share: float | None) -> np.ndarray:
    """Columns spanning the covariates to adjust for: all of them, or leading components up to a variance share."""
    p = cov.shape[0]
    if p == 0:
        return np.zeros((0, 0))
    val, vec = np.linalg.eigh(cov)
    val, vec = val[::-1], vec[:, ::-1]
    ok = val > max(val.max(), 0) * 1e-10
    if share is not None:
        upto = np.cumsum(np.clip(val, 0, None)) / max(np.clip(val, 0, None).sum(), 1e-300)
        ok &= np.arange(p) <= np.searchsorted(upto, share)
    return vec[:, ok]


def enet_fit(gram, cross, pen, ridge, w, tol):
    """One elastic-net solution from a warm start, by coordinate sweeps with a direct finish.

    A few sweeps over the active features settle signs; with the signs fixed the optimum solves a small linear system.
    It is accepted once its signs agree and no idle feature violates the optimality condition.
    """
    diag = np.diag(gram)
    usable = diag > 1e-12
    w = w.copy()
    resid = cross - gram @ w
    limit = tol * max(float(np.abs(cross).max()), 1e-300)
    settled = False
    for _ in range(SWEEPS):
        wrong = usable & (np.abs(resid) > pen + limit) & (w == 0)
        idx = np.flatnonzero((w != 0) | wrong)
        # the optimality gap: active features must sit on their penalty, idle ones inside it
        gap = np.abs(resid[idx] - ridge * w[idx] - pen * np.where(w[idx] != 0, np.sign(w[idx]), np.sign(resid[idx])))
        if not len(idx) or gap.max() <= limit:
            settled = True
            break
        for _ in range(3):
            for j in idx:
                old = w[j]
                raw = resid[j] + diag[j] * old
                new = np.sign(raw) * max(abs(raw) - pen, 0.0) / (diag[j] + ridge)
                if new != old:
                    resid -= gram[:, j] * (new - old)
                    w[j] = new
        act = np.flatnonzero(w)
        if not len(act):
            continue
        sub = gram[np.ix_(act, act)] + ridge * np.eye(len(act))
        sign = np.sign(w[act])
        direct = np.linalg.solve(sub, cross[act] - pen * sign)
        if (direct * sign > 0).all():
            w[:] = 0.0
            w[act] = direct
            resid = cross - gram[:, act] @ direct
            if not (usable & (np.abs(resid) > pen + limit) & (w == 0)).any():
                settled = True
                break
    if not settled:
        raise ArithmeticError("an elastic-net fit did not reach its optimality condition")
    return w


def enet_path(gram, cross, n, alphas, l1=0.5, tol=1e-9):
    """Elastic-net coefficients along a path for several targets.

    Minimises ``|y - Xw|^2 / 2n + a l1 |w|_1 + a (1 - l1) |w|^2 / 2``. ``gram`` (K, K) and ``cross`` (K, P) are
    centred cross-products, ``alphas`` (A, P) falls along its first axis. Returns (A, K, P).
    """
    k, p = cross.shape
    out = np.zeros((len(alphas), k, p))
    for j in range(p):
        w = np.zeros(k)
        for a in range(len(alphas)):
            w = enet_fit(gram, cross[:, j], n * alphas[a, j] * l1, n * alphas[a, j] * (1 - l1), w, tol)
            out[a, :, j] = w
    return out


def alpha_grid(cross, n, l1, count, eps=1e-3):
    """Geometric penalties from the smallest that empties the model, per target."""
    top = np.abs(cross).max(axis=0) / (n * l1)
    top = np.maximum(top, np.finfo(float).resolution)
    return top[None, :] * np.geomspace(1.0, eps, count)[:, None]


def adjusted_products(m, p, basis, centre_c, k):
    """Map block products over [1, C, X, Y] to products over [1, X~, Y~]: the linear map T with A~ = A T.

    ``m`` is the training total. X~ is X minus its fit on [1, C basis], scaled to unit spread; Y~ likewise but not
    scaled. Without covariates only X is centred and scaled. Returns (T, spread of X).
    """
    size = m.shape[0]
    q = basis.shape[1]
    t = np.zeros((size, size - p))
    t[0, 0] = 1.0
    t[1 + p:, 1:] = np.eye(size - 1 - p)
    zmap = np.zeros((size, 1 + q))
    zmap[0, 0] = 1.0
    if q:
        zmap[1:1 + p, 1:] = basis
        zmap[0, 1:] = -centre_c @ basis
    z = zmap if q else zmap[:, :1]
    beta = np.linalg.solve(z.T @ m @ z, z.T @ m[:, 1 + p:])
    fitted = z @ beta
    cols = slice(1, None) if q else slice(1, 1 + k)
    width = fitted.shape[1] if q else k
    t[:, cols] -= fitted[:, :width]
    n = m[0, 0]
    var = np.diag(mapped(m, t, p))[1:1 + k] / n
    sd = np.sqrt(np.maximum(var, 0))
    sd[sd < 1e-10] = 1.0
    t[:, 1:1 + k] /= sd
    return t, sd


def mapped(m, t, p):
    """``t.T @ m @ t`` for a map whose feature and target part is diagonal: one thin product on each side instead of two
    of full size."""
    d = t[1 + p + np.arange(t.shape[1] - 1), 1 + np.arange(t.shape[1] - 1)]
    u = m[:, :1 + p] @ t[:1 + p]
    u[:, 1:] += m[:, 1 + p:] * d
    out = t[:1 + p].T @ u[:1 + p]
    out[1:] += d[:, None] * u[1 + p:]
    return out


def centred(b, k):
    """Centred X'X and X'Y from products over [1, X, Y]."""
    n = b[0, 0]
    s = b[0, 1:]
    c = b[1:, 1:] - np.outer(s, s) / n
    return c[:k, :k], c[:k, k:], n


def enet_cv(blocks, p, k, l1, n_alphas, share):
    """Fit all targets of one fold: choose the penalty by inner block CV, refit on all training rows.

    ``blocks`` are products over [1, C, X, Y] per inner CV block. Returns (map T, coefficients (K, P), intercepts,
    chosen penalties).
    """
    total = sum(blocks)
    n = total[0, 0]
    mean_c = total[0, 1:1 + p] / n
    cov_c = total[1:1 + p, 1:1 + p] / n - np.outer(mean_c, mean_c)
    basis = covariate_basis(cov_c, share)
    t, _ = adjusted_products(total, p, basis, mean_c, k)
    adj = [mapped(b, t, p) for b in blocks]
    whole = sum(adj)
    g, c, _ = centred(whole, k)
    n_t = c.shape[1]
    if k == 0:   # no feature survived: the fold predicts the mean
        return t, np.zeros((0, n_t)), whole[0, 1:] / n, np.zeros(n_t)
    alphas = alpha_grid(c, n, l1, n_alphas)
    mse = np.zeros((n_alphas, n_t))
    used = 0
    for b in adj:
        if b[0, 0] < 0.5 or n - b[0, 0] < 1.5:
            continue
        used += 1
        rest = whole - b
        gi, ci, ni = centred(rest, k)
        w = enet_path(gi, ci, ni, alphas, l1)
        mx, my = rest[0, 1:1 + k] / ni, rest[0, 1 + k:] / ni
        for a in range(n_alphas):
            b0 = my - mx @ w[a]
            wa = w[a]
            xx, xy = b[1:1 + k, 1:1 + k], b[1:1 + k, 1 + k:]
            yy = np.diag(b[1 + k:, 1 + k:])
            sx, sy, nb = b[0, 1:1 + k], b[0, 1 + k:], b[0, 0]
            sse = (yy - 2 * (wa * xy).sum(0) - 2 * b0 * sy + np.einsum("kp,kp->p", wa, xx @ wa)
                   + 2 * b0 * (sx @ wa) + nb * b0 * b0)
            mse[a] += sse / nb
    best = mse.argmin(axis=0) if used else np.zeros(n_t, int)
    path = enet_path(g, c, n, alphas[:best.max() + 1], l1)
    w = np.stack([path[best[j], :, j] for j in range(n_t)], axis=1)
    b0 = whole[0, 1 + k:] / n - (whole[0, 1:1 + k] / n) @ w
    return t, w, b0, alphas[best, np.arange(n_t)]


# ------------------------------------------------------------------ few rows: the dual of the elastic net

ROWS = 200                 # training rows up to which a fold is solved in as many unknowns as it has rows
STEPS = 500                # Newton steps after which a fit counts as failed; three or four are usual
PAIR_VALUES = 1 << 24      # products of row pairs that are kept for a batch of targets; beyond, they are taken when needed
SET_VALUES = 1 << 22       # values of the feature sets that are solved side by side
NEAR = 0.98                # share of the penalty from which a feature is taken for one that can be active


class RowMap:
    """The linear map of :func:`adjusted_products` as what it holds: for each column a line on [1, C] and a scale.

    The square matrix has a row and a column for each feature, which kept features and unions of sets make too many.
    """

    def __init__(self, line: np.ndarray, scale: np.ndarray):
        self.line, self.scale = line, scale

    @staticmethod
    def of(t, p: int) -> RowMap:
        if isinstance(t, RowMap):
            return t
        i = np.arange(t.shape[1] - 1)
        return RowMap(t[:1 + p], t[1 + p + i, 1 + i])

    def apply(self, rows: np.ndarray) -> np.ndarray:
        """Rows over [1, C, X, Y] as rows over [1, X~, Y~]."""
        at = len(self.line)
        out = rows[:, :at] @ self.line
        out[:, 1:] += rows[:, at:] * self.scale
        return out

    def dense(self) -> np.ndarray:
        return np.concatenate([self.line, np.c_[np.zeros(len(self.scale)), np.diag(self.scale)]])

    def __getitem__(self, at):
        return self.dense()[at]


class Columns:
    """Centred features of one problem shared by many targets (r, k), or one matrix for each target (B, r, k).

    The latter are kept feature by feature (B, k, r), so some features of each target are picked as whole runs.
    """

    def __init__(self, x: np.ndarray, by_feature: bool = False):
        self.shared = x.ndim == 2
        self.x = x if self.shared or by_feature else np.ascontiguousarray(x.transpose(0, 2, 1))
        r, self.k = self.x.shape if self.shared else self.x.shape[:0:-1]
        if self.shared:
            self.upper = np.triu_indices(r)
            self.pairs = None
            if x.shape[1] * len(self.upper[0]) <= PAIR_VALUES:
                # single precision is enough for a step's direction; what is solved for is checked in double precision
                self.pairs = np.ascontiguousarray((x[self.upper[0]] * x[self.upper[1]]).T, np.float32)
        self.eye = np.eye(r)
        self.part = (None, None)

    def own(self, at):
        """Matrices of the targets ``at``; they are picked once for as long as the caller hands over the same array."""
        if len(at) == len(self.x):
            return self.x
        if self.part[0] is not at:
            self.part = at, self.x[at]
        return self.part[1]

    def cross(self, theta, at):
        return theta @ self.x if self.shared else np.matmul(self.own(at), theta[:, :, None])[:, :, 0]

    def back(self, w, at):
        return w @ self.x.T if self.shared else np.matmul(w[:, None, :], self.own(at))[:, 0]

    def gram(self, on, at):
        """Products of the rows over the active features of each target."""
        if not self.shared:
            x = self.own(at)
            return np.matmul((x * on[:, :, None]).transpose(0, 2, 1), x)
        if self.pairs is None:
            return np.stack([own @ own.T for own in (self.x[:, o] for o in on)])
        used = np.flatnonzero(on.any(axis=0))
        flat = on[:, used].astype(np.float32) @ self.pairs[used]
        out = np.empty((len(on), *self.eye.shape))
        out[:, self.upper[0], self.upper[1]] = flat
        out[:, self.upper[1], self.upper[0]] = flat
        return out


def _soft(z, pen):
    return z - np.clip(z, -pen, pen)


def dual_fit(cols, y, pen, ridge, theta, tol=1e-10):
    """Elastic-net solutions of a batch of targets from warm starts: (residuals (B, r), coefficients (B, k)).

    With a ridge part the coefficients follow from the residual ``t = y - Xw`` alone, ``w = soft(X't, pen) / ridge``, so the unknowns
    are as many as rows. The residual minimises a convex function whose gradient is piecewise linear: Newton steps with a halving line
    search, all targets of the batch side by side, end at the exact solution once the active features stand still.
    """
    theta = theta.copy()
    w = np.zeros((len(y), cols.k))
    scale = tol * np.maximum(np.abs(y).max(axis=1), 1e-300)
    live = np.arange(len(y))
    p, q, t, target = pen[:, None], ridge[:, None], theta, y
    z = cols.cross(t, live)
    s = _soft(z, p)
    now = _dual_value(t, s, target, q)
    for _ in range(STEPS):
        f = t - target + cols.back(s, live) / q
        open_ = np.abs(f).max(axis=1) > scale[live]
        if not open_.all():
            theta[live[~open_]], w[live[~open_]] = t[~open_], (s[~open_] / q[~open_])
            if not open_.any():
                return theta, w
            live, z, s, f, p, q, t, target, now = (v[open_] for v in (live, z, s, f, p, q, t, target, now))
        step = -np.linalg.solve(cols.gram(s != 0, live) / q[:, :, None] + cols.eye, f[:, :, None])[:, :, 0]
        along = cols.cross(step, live)
        slope = np.einsum("ij,ij->i", f, step)
        tt, zz = t + step, z + along
        ss = _soft(zz, p)
        new = _dual_value(tt, ss, target, q)
        size = 1.0
        bad = np.flatnonzero(new > now + 1e-4 * slope + 1e-12 * np.abs(now))
        while len(bad) and size > 1e-18:
            size /= 2
            tt[bad], zz[bad] = t[bad] + size * step[bad], z[bad] + size * along[bad]
            ss[bad] = _soft(zz[bad], p[bad])
            new[bad] = _dual_value(tt[bad], ss[bad], target[bad], q[bad])
            bad = bad[new[bad] > now[bad] + 1e-4 * size * slope[bad] + 1e-12 * np.abs(now[bad])]
        t, z, s, now = tt, zz, ss, new
    raise ArithmeticError("an elastic-net fit did not settle")


def _dual_value(t, s, target, ridge):
    return np.einsum("ij,ij->i", t, t / 2 - target) + np.einsum("ij,ij->i", s, s) / (2 * ridge[:, 0])


def dual_path(cols, y, n, alphas, l1):
    """Coefficients (B, k) for each row of ``alphas`` (A, B), falling; ``y`` (B, r) centred.

    Residuals follow the penalty in straight pieces, so a fit starts where the line through the two before it leads. A matrix for each
    target is met by leading features only (:func:`_leading_fit`).
    """
    seen, z = [], None if cols.shared else cols.cross(y, np.arange(len(y)))
    for a in alphas:
        start = seen[-1][1] if seen else y
        pen, ridge = n * a * l1, n * a * (1 - l1)
        least = 2 * pen - n * seen[-1][0] * l1 if seen else pen
        if len(seen) == 2:
            (a0, t0, z0), (a1, t1, z1) = seen
            ahead = ((a - a1) / np.minimum(a1 - a0, -1e-300))[:, None]
            start = t1 + ahead * (t1 - t0)
            if not cols.shared:
                z, least = z1 + ahead * (z1 - z0), NEAR * pen
        if cols.shared:
            theta, w = dual_fit(cols, y, pen, ridge, start)
        else:
            theta, w, z = _leading_fit(cols, y, pen, ridge, start, z, least)
        seen = [*seen[-1:], (a, theta, z)]
        yield w


def _leading_fit(cols, y, pen, ridge, start, z, least):
    """:func:`dual_fit` on the features that can be active, each target with a matrix of its own: (residuals, coefficients, X' residuals).

    ``z`` are the products with the residuals where the fit is expected. It takes as many leading features as the target with most of them
    has from ``least`` on. Features left out have no part in the optimum as long as their products stay within the penalty, which is
    looked at for all of them; where one does not, the fit goes on with more features.
    """
    everyone, k = np.arange(len(y)), z.shape[1]
    size = max(1, int((np.abs(z) >= least[:, None]).sum(axis=1).max()))
    if 4 * size >= 3 * k:
        theta, w = dual_fit(cols, y, pen, ridge, start)
        return theta, w, cols.cross(theta, everyone)
    w, todo, theta = np.zeros((len(y), k)), everyone, start.copy()
    z = z.copy()
    while True:
        some = np.argpartition(-np.abs(z[todo]), size - 1, axis=1)[:, :size] if size < k else np.tile(np.arange(k), (len(todo), 1))
        t, part = dual_fit(Columns(cols.own(todo)[np.arange(len(todo))[:, None], some], by_feature=True), y[todo], pen[todo], ridge[todo], theta[todo])
        theta[todo], z[todo] = t, cols.cross(t, todo)
        full = np.zeros((len(todo), k))
        np.put_along_axis(full, some, part, axis=1)
        full[np.isnan(pen[todo])] = np.nan                   # a set with a value that is no number has no fit
        w[todo] = full
        out = np.abs(z[todo]) > pen[todo][:, None]
        np.put_along_axis(out, some, False, axis=1)
        missed = out.any(axis=1)
        if not missed.any():
            return theta, w, z
        # all that are above the penalty now lead, besides those that were met
        lost = todo[missed]
        met = np.zeros((len(todo), k), bool)
        np.put_along_axis(met, some, True, axis=1)
        size = min(k, max(2 * size, int((met | out)[missed].sum(axis=1).max())))
        todo = lost


def row_map(parts, p, k, share) -> RowMap:
    """The map T of :func:`adjusted_products` from the training rows themselves, over [1, C, X, Y]."""
    rows = np.concatenate(parts)
    n, size = rows.shape
    c = rows[:, 1:1 + p]
    mean_c = c.mean(axis=0)
    basis = covariate_basis(c.T @ c / n - np.outer(mean_c, mean_c), share)
    q = basis.shape[1]
    z = np.zeros((1 + p, 1 + q))
    z[0, 0] = 1.0
    if q:
        z[1:, 1:] = basis
        z[0, 1:] = -mean_c @ basis
    seen = rows[:, :1 + p] @ z
    m = size - 1 - p if q else k                       # without covariates only the features are centred
    fitted = z @ np.linalg.solve(seen.T @ seen, seen.T @ rows[:, 1 + p:1 + p + m])
    line = np.zeros((1 + p, size - p))
    line[0, 0] = 1.0
    line[:, 1:1 + m] -= fitted
    x = rows[:, 1 + p:1 + p + k] + rows[:, :1 + p] @ line[:, 1:1 + k]
    sd = np.sqrt(np.maximum((x * x).mean(axis=0), 0))
    sd[sd < 1e-10] = 1.0
    line[:, 1:1 + k] /= sd
    return RowMap(line, np.concatenate([1 / sd, np.ones(size - 1 - p - k)]))


def by_rows(t, part, p, k):
    """(features, targets) of rows over [1, C, X, Y] under a map of :func:`row_map`."""
    m = t.apply(part)[:, 1:]
    return m[:, :k], m[:, k:]


def _choose(columns, targets, sizes, n_alphas, l1):
    """Penalty by inner block CV and refit on all rows for a batch: (coefficients (B, k), intercepts, penalties).

    ``columns`` picks training or held-out rows of the features: called with (rows, centre) it gives the features of these rows less
    ``centre``, (r, k) or (B, r, k); with no centre it uses the rows' own mean and gives (features, mean).
    """
    n, b = targets.shape
    x, mean = columns(np.arange(n), None)
    k = x.shape[-1]
    if k == 0:
        return np.zeros((b, 0)), targets.mean(axis=0), np.zeros(b)
    y = (targets - targets.mean(axis=0)).T
    top = np.abs((y @ x) if x.ndim == 2 else np.matmul(y[:, None, :], x)[:, 0]).max(axis=1) / (n * l1)
    alphas = np.maximum(top, np.finfo(float).resolution)[None, :] * np.geomspace(1.0, 1e-3, n_alphas)[:, None]
    mse, used, end = np.zeros((n_alphas, b)), 0, 0
    for size in sizes:
        held = np.arange(end, end + size)
        end += size
        if not size or n - size < 2:
            continue
        used += 1
        rest = np.setdiff1d(np.arange(n), held)
        xi, mi = columns(rest, None)
        xo, _ = columns(held, mi)
        my = targets[rest].mean(axis=0)
        yi = (targets[rest] - my).T
        truth = (targets[held] - my).T
        for a, w in enumerate(dual_path(Columns(xi), yi, len(rest), alphas, l1)):
            got = w @ xo.T if xo.ndim == 2 else np.matmul(xo, w[:, :, None])[:, :, 0]
            mse[a] += ((truth - got) ** 2).mean(axis=1)
    best = mse.argmin(axis=0) if used else np.zeros(b, int)
    out = np.zeros((b, k))
    for a, w in enumerate(dual_path(Columns(x), y, n, alphas[:best.max() + 1], l1)):
        out[best == a] = w[best == a]
    centre = (mean * out).sum(axis=-1) if mean.ndim == 2 else out @ mean
    return out, targets.mean(axis=0) - centre, alphas[best, np.arange(b)]


def enet_cv_rows(parts, p, k, l1, n_alphas, share):
    """:func:`enet_cv` from the rows of the inner blocks, all targets solved together: (T, coefficients (K, P), intercepts, penalties)."""
    t = row_map(parts, p, k, share)
    x, y = by_rows(t, np.concatenate(parts), p, k)

    def columns(rows, centre):
        own = x[rows]
        mean = own.mean(axis=0) if centre is None else centre
        return own - mean, mean
    w, b0, alpha = _choose(columns, y, [len(b) for b in parts], n_alphas, l1)
    return t, w.T, b0, alpha


def enet_cv_sets(parts, p, k, sets, l1, n_alphas, share):
    """One fit for each feature set (rows of ``sets``: positions among the k features) of the first target, as a batch."""
    t = row_map(parts, p, k, share)
    x, y = by_rows(t, np.concatenate(parts), p, k)

    def fits(some):
        def columns(rows, centre):
            own = x[rows][:, some].transpose(1, 0, 2)
            mean = own.mean(axis=1) if centre is None else centre
            return own - mean[:, None, :], mean
        return _choose(columns, np.repeat(y[:, :1], len(some), axis=1), [len(b) for b in parts], n_alphas, l1)
    step = max(1, SET_VALUES // max(1, len(x) * sets.shape[1]))
    w, b0, alpha = (np.concatenate(v) for v in zip(*[fits(sets[i:i + step]) for i in range(0, len(sets), step)]))
    return t, w, b0, alpha


def leading_scores(blocks, p, k, share, d):
    """Map from [1, C, X] to the ``d`` leading components of adjusted, standardised X."""
    total = sum(blocks)
    n = total[0, 0]
    mean_c = total[0, 1:1 + p] / n
    basis = covariate_basis(total[1:1 + p, 1:1 + p] / n - np.outer(mean_c, mean_c), share)
    t, _ = adjusted_products(total, p, basis, mean_c, k)
    whole = t.T @ total @ t
    g, _, _ = centred(whole, k)
    val, vec = np.linalg.eigh(g)
    d = min(d, k)
    vec = vec[:, ::-1][:, :d]
    val = val[::-1][:d]
    vec = vec / np.sqrt(np.maximum(val / n, 1e-12))
    shift = np.zeros((t.shape[0], d))
    shift[0] = (whole[0, 1:1 + k] / n) @ vec
    return t[:, 1:1 + k] @ vec - shift


def leading_scores_rows(parts, p, k, share, d):
    """:func:`leading_scores` from the rows of a fold with few units, without a product over all features."""
    t = row_map(parts, p, k, share)
    x, _ = by_rows(t, np.concatenate(parts), p, k)
    mean = x.mean(axis=0)
    _, val, vec = np.linalg.svd(x - mean, full_matrices=False)
    d = min(d, len(val))
    axes = vec[:d].T / np.sqrt(np.maximum(val[:d] ** 2 / len(x), 1e-12))
    out = np.concatenate([t.line[:, 1:1 + k] @ axes, t.scale[:k, None] * axes])
    out[0] -= mean @ axes
    return out


def logistic(x, y, strength=1.0, rounds=1000):
    """L2-penalised logistic regression by Newton steps; intercept first and unpenalised."""
    a = np.c_[np.ones(len(x)), x]
    pen = np.r_[0.0, np.full(x.shape[1], 1.0 / strength)]
    w = np.zeros(a.shape[1])

    def loss(v):
        z = a @ v
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (pen * v * v).sum()
    now = loss(w)
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (mu - y) + pen * w
        hess = (a * (mu * (1 - mu))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-12 * max(1.0, abs(now)):
            return w
        now = new
    raise ArithmeticError("a logistic fit did not settle")


def prefix_below(rank, weight, end, under):
    """For each ask the weight of the first ``end`` entries whose ``rank`` is below ``under``: one pass for each bit of the ranks, entries
    parted stably by the bit, the asks following their range."""
    lo, hi = np.zeros(len(end), np.int64), np.asarray(end, np.int64)
    total = np.zeros(len(end), np.int64)
    bits = int(max(rank.max() if len(rank) else 0, under.max() if len(under) else 0)).bit_length()
    rank, weight = np.asarray(rank, np.int64), np.asarray(weight, np.int64)
    for bit in reversed(range(bits)):
        zero = (rank >> bit & 1) == 0
        n = np.concatenate([[0], np.cumsum(zero)])
        w = np.concatenate([[0], np.cumsum(np.where(zero, weight, 0))])
        one = (under >> bit & 1) == 1
        total += np.where(one, w[hi] - w[lo], 0)
        lo, hi = np.where(one, n[-1] + lo - n[lo], n[lo]), np.where(one, n[-1] + hi - n[hi], n[hi])
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, weight = rank[order], weight[order]
    return total
