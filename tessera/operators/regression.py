"""Least squares from one distributed Gram matrix.

All models of a sequence are read off sweeps of [1, y, X]'[1, y, X]: data are
scanned once, then once a fold for cross validation at most (one grouped pass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import f_above, normal_quantile, t_quantile, t_two_sided
from tessera.operators.evaluate import running_totals
from tessera.operators.linalg import gram
from tessera.session import ship

LENGTH_F, FEATURE_F = 1e-6, 1e-5


def design_gram(rows: DataFrame, n_columns: int, y: str = "y", x: str = "x") -> np.ndarray:
    """The Gram matrix of [1, y, x...] over rows without null y."""
    good = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    return gram(good.select(F.concat(F.array(F.lit(1.0), F.col(y).cast("double")), F.col(x).cast("array<double>")).alias("x")), n_columns + 2)


def fold_grams(rows: DataFrame, n_columns: int, folds: int, seed: int = 2837, key: str = "doc_id", y: str = "y", x: str = "x") -> np.ndarray:
    """Gram matrices by fold, in one pass. Folds come from a hash of the key
    and the seed; seed 0 deals keys in turn."""
    ship(rows.sparkSession)
    k = n_columns + 2
    fold = F.pmod(F.col(key), F.lit(folds)) if seed == 0 else F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, k, k))
        for b in batches:
            if b.num_rows:
                f = b.column(0).to_numpy()
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                for g in np.unique(f):
                    part = m[f == g]
                    total[g] += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(total.reshape(-1)), pa.array(np.arange(total.size))], names=["g", "at"])

    good = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    sums = good.select(fold.cast("int").alias("f"), F.concat(F.array(F.lit(1.0), F.col(y).cast("double")), F.col(x).cast("array<double>")).alias("m")).mapInArrow(run, "g double, at long").groupBy("at").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(folds * k * k)
    for r in sums:
        out[r["at"]] = r["g"]
    return out.reshape(folds, k, k)


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The matrix swept on pivot k."""
    d = a[k, k]
    row, column = a[k] / d, a[:, k].copy()
    out = a - np.outer(column, row)
    out[k], out[:, k], out[k, k] = row, -column / d, 1 / d
    return out


@dataclass
class Step:
    """One model of a sequence."""

    name: str
    r2: float
    adj_r2: float
    rss: float
    q: int
    aicc: float
    added: bool


def measures(rss: float, tss: float, n: float, q: int) -> tuple[float, float, float]:
    """R2, adjusted R2 and AICc with q parameters, the constant among them."""
    r2 = 1 - rss / tss if tss > 0 else 0.0
    adj = 1 - (rss / (n - q)) / (tss / (n - 1)) if n > q and tss > 0 else float("nan")
    aicc = n * math.log(max(rss, 1e-300) / n) + 2 * q + (2 * q * (q + 1) / (n - q - 1) if n > q + 1 else float("inf"))
    return r2, adj, aicc


def sequence(g: np.ndarray, names: list[str], least: list[float] | None = None, forced: int = 0) -> list[Step]:
    """Models that add the columns of a Gram matrix [1, y, x...] in turn. A
    column enters if its partial F is over its least value, and unless it is a
    combination of those before it; skipped columns repeat the last model."""
    n, tss = g[0, 0], g[1, 1] - g[0, 1] ** 2 / max(g[0, 0], 1e-300)
    a, q, out = sweep(g, 0) if n > 0 else g, 1, []
    for k, name in enumerate(names):
        at, scale = k + 2, g[k + 2, k + 2]
        free, added = a[at, at], False
        if free > 1e-10 * max(scale, 1e-300) and n > q + 1:
            drop = a[at, 1] ** 2 / free
            rest = a[1, 1] - drop
            f = drop / (rest / (n - q - 1)) if rest > 0 else float("inf")
            if k < forced or f > (least[k] if least else FEATURE_F):
                a, q, added = sweep(a, at), q + 1, True
        out.append(Step(name, *measures(a[1, 1], tss, n, q)[:2], a[1, 1], q, measures(a[1, 1], tss, n, q)[2], added))
    return out


def sequence_r2(rows: DataFrame, names: list[str], length: str | None = "m", degree: int = 5, reverse: bool = False, y: str = "y", x: str = "x") -> list[Step]:
    """R2, adjusted R2, RSS and AICc as powers of centred log length, then
    features in order (or reversed) enter one by one."""
    names = list(names)
    feats = F.reverse(F.col(x)) if reverse else F.col(x)
    order = names[::-1] if reverse else names
    if length:
        mean = rows.where(F.col(y).isNotNull()).agg(F.avg(F.log(length))).first()[0] or 0.0
        z = F.log(F.col(length)) - F.lit(mean)
        feats = F.concat(F.array(*[F.pow(z, F.lit(float(p))) for p in range(1, degree + 1)]), feats.cast("array<double>"))
        order = [f"log_length_{p}" for p in range(1, degree + 1)] + order
    g = design_gram(rows.withColumn("_f", feats), len(order), y, "_f")
    lengths = degree if length else 0
    return sequence(g, order, [LENGTH_F] * lengths + [FEATURE_F] * len(names))


def solve(g: np.ndarray, columns: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant first) on the given columns, and the inverse."""
    at = [0, *[c + 2 for c in columns]]
    inverse = np.linalg.pinv(g[np.ix_(at, at)], rcond=1e-12, hermitian=True)
    return inverse @ g[at, 1], inverse


def ols(rows: DataFrame, names: list[str], y: str = "y", x: str = "x") -> list[dict]:
    """Coefficients with standard errors, t and its p values; the first row
    is the constant and carries the model's measures."""
    g = design_gram(rows, len(names), y, x)
    beta, inverse = solve(g, list(range(len(names))))
    n, q = g[0, 0], len(names) + 1
    at = [0, *range(2, q + 1)]
    rss = max(g[1, 1] - beta @ g[at, 1], 0.0)
    tss = g[1, 1] - g[0, 1] ** 2 / n
    se = np.sqrt(np.maximum(np.diag(inverse) * rss / max(n - q, 1), 0))
    r2, adj, aicc = measures(rss, tss, n, q)
    out = []
    for name, b, s in zip(["(constant)", *names], beta, se, strict=True):
        t = float(b / s) if s > 0 else float("nan")
        out.append({"name": name, "coefficient": float(b), "se": float(s), "t": t, "p": t_two_sided(t, n - q)})
    out[0] |= {"n": n, "r2": r2, "adj_r2": adj, "rss": rss, "aicc": aicc, "sigma": math.sqrt(rss / max(n - q, 1))}
    return out


def predictive_r2(rss: float, tss: float, n: int, k: int) -> tuple[float, float, float]:
    """R2, adjusted R2 and the predictive form with 2k parameters."""
    return 1 - rss / tss, 1 - (rss / (n - k)) / (tss / (n - 1)), 1 - (rss / (n - 2 * k)) / (tss / (n - 1))


def nested_f(rss_small: float, rss_large: float, df_small: int, df_large: int) -> tuple[float, float]:
    """F of the terms that the larger model adds, and P(F or more)."""
    f = ((rss_small - rss_large) / (df_small - df_large)) / (rss_large / df_large)
    return f, f_above(f, df_small - df_large, df_large)


def best_step(steps: list, by: str = "aicc") -> dict:
    """The first model of a sequence with the smallest measure, and its place."""
    value = lambda s: s[by] if isinstance(s, dict) else getattr(s, by)
    at = min((k for k in range(len(steps)) if value(steps[k]) == value(steps[k])), key=lambda k: value(steps[k]))
    one = steps[at]
    return {"place": at + 1, "name": one["name"] if isinstance(one, dict) else one.name, by: float(value(one))}


def increments(steps: list, by: str = "r2") -> list[dict]:
    """What each model of a sequence adds to a measure, and the sum so far."""
    value = lambda s: s[by] if isinstance(s, dict) else getattr(s, by)
    values = [float(value(s)) for s in steps]
    return [{"place": k + 1, "step": v - (values[k - 1] if k else 0.0), "upto": v} for k, v in enumerate(values)]


def largest_t(model: list[dict], k: int = 15) -> list[dict]:
    """The k coefficients of a model (as of ols) with the largest |t|, the
    constant aside; ties by name."""
    rows = [r for r in model if r["name"] != "(constant)" and r["t"] == r["t"]]
    return sorted(rows, key=lambda r: (-abs(r["t"]), r["name"]))[:k]


def group_columns(rows: DataFrame, column: str, levels: int = 1000, x: str = "x") -> tuple[DataFrame, list[str]]:
    """rows with indicators of a factor's levels after x (the most frequent
    level is the base; over `levels` of them is an error), and their names.
    Null is a level of its own."""
    own = F.coalesce(F.col(column).cast("string"), F.lit("(null)"))
    found = [r["v"] for r in rows.groupBy(own.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(levels + 1).collect()]
    if len(found) > levels:
        raise ValueError(f"{column} has more than {levels} levels")
    marks = [F.when(own == v, 1.0).otherwise(0.0) for v in found[1:]]
    base = F.col(x).cast("array<double>")
    return rows.withColumn(x, F.concat(base, F.array(*marks)) if marks else base), [f"{column}={v}" for v in found[1:]]


def trimmed_mse(rows: DataFrame, n_columns: int, folds: int = 10, limit: float = 3.0, seed: int = 1, key: str = "doc_id", y: str = "y", x: str = "x") -> list[dict]:
    """Mean squared error of each held-out fold, where training leaves out rows
    whose residual from a first fit is over `limit` standard errors; the rows
    held out all count."""
    parts = fold_grams(rows, n_columns, folds, seed, key, y, x)
    total, at, out = parts.sum(0), [0, *range(2, n_columns + 2)], []
    fold = F.pmod(F.col(key), F.lit(folds)) if seed == 0 else F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))
    good = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    for f, part in enumerate(parts):
        g = total - part
        beta, _ = solve(g, list(range(n_columns)))
        sigma = math.sqrt(max(g[1, 1] - beta @ g[at, 1], 0.0) / max(g[0, 0] - len(at), 1))
        near = fitted(good.where(fold != f), beta.tolist(), "_fit", x).where(F.abs(F.col(y) - F.col("_fit")) <= limit * sigma)
        own = design_gram(near, n_columns, y, x)
        beta, _ = solve(own, list(range(n_columns)))
        ss = part[1, 1] - 2 * beta @ part[at, 1] + beta @ part[np.ix_(at, at)] @ beta
        out.append({"fold": f, "n": float(part[0, 0]), "trained": float(own[0, 0]), "mse": float(ss / part[0, 0]) if part[0, 0] else float("nan")})
    return out


def indicator_ols(rows: DataFrame, columns: list[str], y: str = "y") -> list[dict]:
    """Least squares of y on columns whose missing (not positive) values are
    replaced by their mean, each beside an indicator of being there."""
    from tessera.operators.evaluate import mean_imputed

    for c in columns:
        rows = mean_imputed(rows, c)
    names = [n for c in columns for n in (c, f"{c}_seen")]
    return ols(rows.withColumn("_x", F.array(*[F.col(n).cast("double") for n in names])), names, y, "_x")


def poisson(rows: DataFrame, names: list[str], y: str = "y", x: str = "x", rounds: int = 50, least: float = 1e-10) -> list[dict]:
    """Poisson regression with log link by iterated weighted least squares: one
    pass over the rows each round, a Gram matrix to the driver. Rows with null
    y or x take no part."""
    good = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(x).cast("array<double>").alias("x"))
    n, mean = good.agg(F.count("*"), F.avg("y")).first()
    beta = np.zeros(len(names) + 1)
    beta[0] = math.log(max(mean or 0.0, 1e-12))
    at = [0, *range(2, len(names) + 2)]
    for _ in range(rounds):
        eta = F.col("_fit")
        work = fitted(good, beta.tolist(), "_fit").withColumn("_w", F.exp(eta / 2)).withColumn("_z", eta + (F.col("y") - F.exp(eta)) / F.exp(eta))
        row = F.transform(F.concat(F.array(F.lit(1.0), F.col("_z")), F.col("x")), lambda v: v * F.col("_w"))
        g = gram(work.select(row.alias("x")), len(names) + 2)
        inverse = np.linalg.pinv(g[np.ix_(at, at)], rcond=1e-12, hermitian=True)
        new = inverse @ g[at, 1]
        moved, beta = np.abs(new - beta).max(), new
        if moved <= least * max(np.abs(beta).max(), 1):
            break
    se = np.sqrt(np.maximum(np.diag(inverse), 0))
    return [{"name": m, "coefficient": float(b), "se": float(e), "z": float(b / e) if e > 0 else float("nan"), "n": float(n)} for m, b, e in zip(["(constant)", *names], beta, se, strict=True)]


def power_law(values: list[float], quadratic: bool = False) -> dict:
    """Least squares of log value on log place (and its square), over positive
    values, as of singular values in falling order."""
    v = np.array([x for x in values if x > 0], float)
    z = np.log(np.arange(1, len(v) + 1))
    a = np.column_stack([np.ones(len(v)), z, z * z] if quadratic else [np.ones(len(v)), z])
    beta = np.linalg.lstsq(a, np.log(v), rcond=None)[0]
    return {"intercept": float(beta[0]), "slope": float(beta[1]), "square": float(beta[2]) if quadratic else 0.0}


def validated_sequence(rows: DataFrame, first: list[str], names: list[str], folds: int = 0, seed: int = 2837, key: str = "doc_id", y: str = "y", x: str = "x") -> list[dict]:
    """R2, RSS, AICc and cross-validated squares of a base model on the columns
    `first`, then with `names` one by one; x holds both in that order."""
    p = len(first) + len(names)
    if folds:
        parts = fold_grams(rows, p, folds, seed, key, y, x)
        g = parts.sum(0)
    else:
        parts, g = np.zeros((0, p + 2, p + 2)), design_gram(rows, p, y, x)
    n, tss, out = g[0, 0], g[1, 1] - g[0, 1] ** 2 / max(g[0, 0], 1e-300), []
    whole = _grow(g, len(first), p)
    held = [_grow(g - part, len(first), p) for part in parts]
    for step, (rss, q, _) in enumerate(whole):
        cv = float("nan")
        if folds:
            cv = 0.0
            for part, models in zip(parts, held, strict=True):
                beta = models[step][2]
                cv += part[1, 1] - 2 * beta @ np.delete(part[1], 1) + beta @ np.delete(np.delete(part, 1, 0), 1, 1) @ beta
        r2, _, aicc = measures(rss, tss, n, q)
        out.append({"step": step, "name": names[step - 1] if step else "(base)", "r2": r2, "rss": rss, "aicc": aicc, "cvss": cv})
    return out


def _grow(g: np.ndarray, first: int, p: int) -> list[tuple[float, int, np.ndarray]]:
    """(RSS, parameters, coefficients over [1, x...]) of the base and of each
    larger model."""
    a, used, out = sweep(g, 0), [0], []
    for k in range(p):
        at = k + 2
        if k >= first:
            out.append(_state(a, used, p))
        if a[at, at] > 1e-10 * max(g[at, at], 1e-300):
            a = sweep(a, at)
            used.append(at)
    out.append(_state(a, used, p))
    return out


def _state(a: np.ndarray, used: list[int], p: int) -> tuple[float, int, np.ndarray]:
    beta = np.zeros(p + 1)
    for at in used:
        beta[0 if at == 0 else at - 1] = a[at, 1]
    return a[1, 1], len(used), beta


def cross_validated_mse(rows: DataFrame, n_columns: int, folds: int = 10, reps: int = 1, seed: int = 1, key: str = "doc_id", y: str = "y", x: str = "x") -> list[dict]:
    """Mean squared error of each held-out fold, for each repetition."""
    out = []
    for rep in range(reps):
        parts = fold_grams(rows, n_columns, folds, seed + rep, key, y, x)
        total = parts.sum(0)
        for f, part in enumerate(parts):
            beta, _ = solve(total - part, list(range(n_columns)))
            at = [0, *range(2, n_columns + 2)]
            ss = part[1, 1] - 2 * beta @ part[at, 1] + beta @ part[np.ix_(at, at)] @ beta
            out.append({"rep": rep, "fold": f, "n": part[0, 0], "mse": float(ss / part[0, 0]) if part[0, 0] else float("nan")})
    return out


def average_runs(runs: DataFrame) -> DataFrame:
    """Cell means of several validation tables (run, step, ...)."""
    values = [c for c in runs.columns if c not in ("run", "step", "name")]
    return runs.groupBy("step").agg(*[F.avg(c).alias(c) for c in values])


def train_test_sequence(train: np.ndarray, test: np.ndarray, sizes: list[int]) -> list[dict]:
    """Squared error on test rows, and R2 on training rows, of models on the
    first k columns, from the two Gram matrices."""
    out = []
    for k in sizes:
        beta, _ = solve(train, list(range(k)))
        at = [0, *range(2, k + 2)]
        sse = test[1, 1] - 2 * beta @ test[at, 1] + beta @ test[np.ix_(at, at)] @ beta
        rss, tss = train[1, 1] - beta @ train[at, 1], train[1, 1] - train[0, 1] ** 2 / train[0, 0]
        out.append({"k": k, "sse": float(sse), "r2": float(1 - rss / tss)})
    return out


def stepwise(g: np.ndarray, names: list[str], forced: int = 0, most: int = 150, bonferroni: bool = True) -> list[dict]:
    """Forward selection on a Gram matrix: the column of largest t enters, until
    none passes the Bonferroni bound on t (or `most` columns are in)."""
    a, q, n, inside, out = sweep(g, 0), 1, g[0, 0], set(), []
    for k in range(forced):
        if a[k + 2, k + 2] > 1e-10 * g[k + 2, k + 2]:
            a, q = sweep(a, k + 2), q + 1
        inside.add(k)
    while len(out) < most and n > q + 1:
        best, top = None, 0.0
        for k in range(len(names)):
            free = a[k + 2, k + 2]
            if k in inside or free <= 1e-10 * max(g[k + 2, k + 2], 1e-300):
                continue
            drop = a[k + 2, 1] ** 2 / free
            t = math.sqrt(drop / max((a[1, 1] - drop) / (n - q - 1), 1e-300))
            if t > top:
                best, top = k, t
        if best is None or (bonferroni and top < t_quantile(1 - 0.025 / max(len(names), 1), n - q - 1)):
            break
        a, q = sweep(a, best + 2), q + 1
        inside.add(best)
        out.append({"step": len(out) + 1, "name": names[best], "t": top, "rss": float(a[1, 1]), "q": q})
    return out


def lasso_path(g: np.ndarray, names: list[str], steps: int = 20, rounds: int = 200) -> list[dict]:
    """Coefficients on standardised columns along falling penalties, by
    coordinate descent on the Gram matrix."""
    n, mean = g[0, 0], g[0] / g[0, 0]
    s = g[1:, 1:] - n * np.outer(mean[1:], mean[1:])
    sd = np.sqrt(np.maximum(np.diag(s)[1:] / n, 1e-300))
    c, r = s[1:, 1:] / n / np.outer(sd, sd), s[0, 1:] / n / sd
    top, beta, out = np.abs(r).max(initial=0), np.zeros(len(names)), []
    for step in range(steps):
        penalty = top * 0.001 ** (step / max(steps - 1, 1))
        for _ in range(rounds):
            before = beta.copy()
            for k in range(len(names)):
                z = r[k] - c[k] @ beta + c[k, k] * beta[k]
                beta[k] = math.copysign(max(abs(z) - penalty, 0), z) / max(c[k, k], 1e-300)
            if np.abs(beta - before).max(initial=0) < 1e-8:
                break
        out += [{"step": step, "penalty": penalty, "name": m, "coefficient": float(b)} for m, b in zip(names, beta, strict=True)]
    return out


def lar_path(g: np.ndarray, names: list[str], most: int | None = None) -> list[dict]:
    """Least angle regression on the Gram matrix, columns standardised: at each
    step the column of largest correlation with the residual joins, and the
    coefficients move along the equiangular direction until another column is
    as correlated. One row a step and column that is in."""
    n, mean = g[0, 0], g[0] / g[0, 0]
    s = g[1:, 1:] - n * np.outer(mean[1:], mean[1:])
    sd = np.sqrt(np.maximum(np.diag(s)[1:] / n, 0))
    free = np.flatnonzero(sd > 1e-12)
    c, r = s[1:, 1:][np.ix_(free, free)] / n / np.outer(sd[free], sd[free]), s[0, 1:][free] / n / sd[free]
    beta, active, out = np.zeros(len(free)), [], []
    for step in range(min(most or len(free), len(free))):
        left = r - c @ beta
        others = [k for k in range(len(free)) if k not in active]
        active.append(max(others, key=lambda k: abs(left[k])))
        top, sign = abs(left[active]).max(), np.sign(left[active])
        if top < 1e-12:
            break
        inverse = np.linalg.pinv(c[np.ix_(active, active)] * np.outer(sign, sign), hermitian=True)
        scale = 1 / math.sqrt(max(inverse.sum(), 1e-300))
        move = np.zeros(len(free))
        move[active] = scale * inverse.sum(1) * sign
        along, reach = c @ move, top / scale
        for k in others:
            if k not in active:
                for gap, slope in ((top - left[k], scale - along[k]), (top + left[k], scale + along[k])):
                    if slope > 1e-12 and 1e-12 < gap / slope < reach:
                        reach = gap / slope
        beta = beta + reach * move
        out += [{"step": step + 1, "name": names[free[k]], "coefficient": float(beta[k])} for k in active]
    return out


def t_summary(ts: list[float], df: float | None = None) -> dict:
    """Bonferroni bound (of t with df degrees of freedom, else normal), expected |t| under no effect, and the slope of sorted
    |t| on half-normal quantiles over the lower quarter."""
    t, p = np.sort(np.abs(np.array([x for x in ts if x == x]))), len(ts)
    q = np.array([NormalDist().inv_cdf(0.5 + 0.5 * (k + 0.5) / len(t)) for k in range(len(t))])
    low = max(2, len(t) // 4)
    slope = float((q[:low] @ t[:low]) / max(q[:low] @ q[:low], 1e-300)) if len(t) else float("nan")
    return {"bound": -NormalDist().inv_cdf(0.025 / max(p, 1)) if df is None else t_quantile(1 - 0.025 / max(p, 1), df), "expected": math.sqrt(2 / math.pi), "half_normal_slope": slope}


def normal_scores(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, q): distinct values with normal quantiles of the middle of
    their ranks, for Q-Q plots. Nulls take no part."""
    n = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    placed = running_totals(n, "value", "n")
    return placed.select("value", "n", normal_quantile((F.col("before") + F.col("n") / 2) / F.col("total")).alias("q"))


def autocorrelation(rows: DataFrame, order: str, column: str, lags: int = 5) -> DataFrame:
    """(lag, r): correlations of a column with itself `lag` rows later, in the
    order of a whole-number key without gaps or repeats: pairs come from an
    equi-join on the key, not from a sorted partition."""
    a = rows.select(F.col(order).alias("_k"), F.col(column).cast("double").alias("a"))
    b = rows.select(F.col(order).alias("_o"), F.col(column).cast("double").alias("b"))
    b = b.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_k", F.col("_o") - F.col("lag")).drop("_o")
    return a.join(b, "_k").groupBy("lag").agg(F.corr("a", "b").alias("r"))


def calibration(rows: DataFrame, degree: int = 5, y: str = "y", fit: str = "fit") -> list[dict]:
    """Least squares of y on powers of the fitted value."""
    x = F.array(*[F.pow(F.col(fit), F.lit(float(p))) for p in range(1, degree + 1)])
    return ols(rows.withColumn("_c", x), [f"fit_{p}" for p in range(1, degree + 1)], y, "_c")


def fitted(rows: DataFrame, coefficients: list[float], out: str = "fit", x: str = "x") -> DataFrame:
    """rows with the fitted value of coefficients, constant first."""
    pairs = F.zip_with(F.col(x).cast("array<double>"), F.array(*[F.lit(float(c)) for c in coefficients[1:]]), lambda a, b: a * b)
    return rows.withColumn(out, F.aggregate(pairs, F.lit(float(coefficients[0])), lambda s, v: s + v))


def lighthouse(rows: DataFrame, names: list[str], targets: list[str], x: str = "x") -> DataFrame:
    """rows with `<target>_hat`: each target regressed on the features where it
    is known, its fitted values for every row."""
    for t in targets:
        beta = [r["coefficient"] for r in ols(rows.where(F.col(t).isNotNull()), names, t, x)]
        rows = fitted(rows, beta, f"{t}_hat", x)
    return rows


def partial_residuals(g: np.ndarray, column: int, others: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of y and of a column on the others: what added-variable
    plots subtract from each."""
    at = [0, *[c + 2 for c in others]]
    inverse = np.linalg.pinv(g[np.ix_(at, at)], hermitian=True)
    return inverse @ g[at, 1], inverse @ g[at, column + 2]


def interactions(rows: DataFrame, n_columns: int, x: str = "x") -> DataFrame:
    """rows with all products of two different columns after x."""
    pairs = [F.col(x)[a] * F.col(x)[b] for a in range(n_columns) for b in range(a + 1, n_columns)]
    return rows.withColumn(x, F.concat(F.col(x).cast("array<double>"), F.array(*pairs))) if pairs else rows


def loess(rows: DataFrame, by: list[str], x: str, y: str, span: float = 0.75) -> DataFrame:
    """(by..., x, y, smooth): local linear fits with tricube weights, one group
    a task: groups are the curves to draw, not the data set."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y]).reset_index(drop=True)
        a, b, k = pdf[x].to_numpy(float), pdf[y].to_numpy(float), max(2, math.ceil(span * len(pdf)))
        out = np.empty(len(pdf))
        for i, at in enumerate(a):
            d = np.abs(a - at)
            h = max(np.partition(d, k - 1)[k - 1] if k <= len(d) else d.max(), 1e-12)
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
            mx, my = np.average(a, weights=w), np.average(b, weights=w)
            sxx = w @ (a - mx) ** 2
            out[i] = my + (w @ ((a - mx) * (b - my)) / sxx * (at - mx) if sxx > 1e-12 else 0)
        return pdf.assign(smooth=out)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, x, y]) + ", smooth double"
    return rows.select(*by, x, y).groupBy(*by).applyInPandas(one, schema)
