"""Survey estimates: naive and bootstrap densities, distance sampling, zero-inflated counts.

Data are summed or grouped in Spark; what is fitted is a few numbers of one stratum."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of resampled transects that a task holds at once.
PICKS = 1_000_000


def naive(transects: DataFrame, key: str = "stratum") -> DataFrame:
    """Animals per 100 ha of each stratum: sum of counts over sum of areas."""
    return transects.groupBy(key).agg((F.sum("count") / F.sum("area_ha") * 100).alias("density"), F.count("*").alias("n"))


def counts(assigned: DataFrame, transects: DataFrame, key: str = "flight_id") -> DataFrame:
    """Points per transect, transects without points included."""
    n = assigned.where("transect_id >= 0").groupBy(key, "transect_id").agg(F.count("*").alias("count"))
    return transects.join(n, [key, "transect_id"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def bootstrap(transects: DataFrame, n_boot: int = 999, seed: int = 42, key: str = "stratum") -> DataFrame:
    """Mean, deviation and 95 % interval of the density over resampled transects; a stratum's transects are one group.

    Resamples are drawn a few at a time, so a task holds its stratum's transects and about PICKS of their numbers; they are the same as if drawn at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, a = pdf["count"].to_numpy(float), pdf["area_ha"].to_numpy(float)
        draw, rows = np.random.default_rng(seed), max(1, PICKS // len(c))
        d = np.empty(n_boot)
        for i in range(0, n_boot, rows):
            pick = draw.integers(0, len(c), (min(rows, n_boot - i), len(c)))
            d[i : i + rows] = c[pick].sum(1) / a[pick].sum(1) * 100
        low, high = np.percentile(d, [2.5, 97.5])
        return pd.DataFrame([(pdf[key].iloc[0], d.mean(), d.std(ddof=1) if n_boot > 1 else 0.0, low, high)], columns=[key, "density", "se", "low", "high"])

    return transects.orderBy(key).groupBy(key).applyInPandas(run, f"{key} {dict(transects.dtypes)[key]}, density double, se double, low double, high double")


def simplex(f, start, step: float = 0.5, rounds: int = 4000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Nelder and Mead's minimum of f."""
    x = [np.asarray(start, float)]
    for i in range(len(x[0])):
        p = x[0].copy()
        p[i] += step if p[i] == 0 else step * max(abs(p[i]), 0.1)
        x.append(p)
    v = [f(p) for p in x]
    for _ in range(rounds):
        order = np.argsort(v, kind="stable")
        x, v = [x[i] for i in order], [v[i] for i in order]
        if abs(v[-1] - v[0]) < tol and max(np.abs(p - x[0]).max() for p in x[1:]) < 1e-8:
            break
        mid = np.mean(x[:-1], axis=0)
        at = lambda k, mid=mid: mid + k * (mid - x[-1])
        r = at(1.0)
        vr = f(r)
        if vr < v[0]:
            e = at(2.0)
            ve = f(e)
            x[-1], v[-1] = (e, ve) if ve < vr else (r, vr)
        elif vr < v[-2]:
            x[-1], v[-1] = r, vr
        else:
            c = at(0.5 if vr < v[-1] else -0.5)
            vc = f(c)
            if vc < min(vr, v[-1]):
                x[-1], v[-1] = c, vc
            else:
                x = [x[0]] + [x[0] + 0.5 * (p - x[0]) for p in x[1:]]
                v = [v[0]] + [f(p) for p in x[1:]]
    i = int(np.argmin(v))
    return x[i], float(v[i])


def hessian(f, p: np.ndarray, eps: float = 1e-4) -> np.ndarray:
    n, h = len(p), np.zeros((len(p), len(p)))
    e = np.eye(n) * eps
    for i in range(n):
        for j in range(n):
            h[i, j] = (f(p + e[i] + e[j]) - f(p + e[i] - e[j]) - f(p - e[i] + e[j]) + f(p - e[i] - e[j])) / (4 * eps * eps)
    return (h + h.T) / 2


def _g(model: str, theta: np.ndarray):
    sigma = math.exp(min(theta[0], 50))
    if model == "half-normal":
        return lambda x: np.exp(-(x**2) / (2 * sigma**2))
    b = 1 + math.exp(min(theta[1], 50))
    return lambda x: -np.expm1(-np.power(np.maximum(x, 1e-12) / sigma, -b))


def _strip(g, w: float) -> float:
    x = np.linspace(0, w, 512)
    y = g(x)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def fit_detection(x: np.ndarray, w: float, model: str = "half-normal", n: np.ndarray | None = None) -> dict:
    """Parameters, effective strip width with its cv, and AIC of a detection function within truncation w; n: how often each distance was seen."""
    n = np.ones(len(x)) if n is None else n
    start = [math.log(max(float(np.sqrt(np.average(x**2, weights=n))), 1e-3))] + [0.0] * (model == "hazard-rate")

    def nll(theta: np.ndarray) -> float:
        g = _g(model, theta)
        s = _strip(g, w)
        return math.inf if s <= 0 else float(-(n * np.log(np.maximum(g(x), 1e-300))).sum() + n.sum() * math.log(s))

    theta, value = simplex(nll, start)
    esw = _strip(_g(model, theta), w)
    grad = np.array([(_strip(_g(model, theta + d), w) - _strip(_g(model, theta - d), w)) / 2e-4 for d in np.eye(len(theta)) * 1e-4])
    try:
        cv = math.sqrt(max(0.0, float(grad @ np.linalg.solve(hessian(nll, theta), grad)))) / esw
    except np.linalg.LinAlgError:
        cv = float("nan")
    return {"model": model, "sigma": math.exp(theta[0]), "esw": esw, "cv_esw": cv, "aic": 2 * value + 2 * len(theta)}


def distance_density(distances: DataFrame, truncation: float | None = None, models: tuple[str, ...] = ("half-normal", "hazard-rate"), key: str = "stratum") -> DataFrame:
    """Density per square kilometre of each stratum from distances (key, distance, effort_m), by the model of least AIC.

    Without a truncation, the 95th percentile of the stratum's distances is it; it is found in Spark, and distances beyond it do not travel.
    Equal distances weigh together, so a fit holds the distinct distances of its stratum."""
    ok = distances.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") >= 0))
    cut = ok.groupBy(key).agg((F.percentile("distance", F.lit(0.95)) if truncation is None else F.lit(float(truncation))).alias("w"), F.max("effort_m").alias("effort"))
    ok = ok.join(cut, key).where("distance <= w").groupBy(key, "distance", "w", "effort").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("distance")
        x, n, w, effort = pdf["distance"].to_numpy(float), pdf["n"].to_numpy(float), float(pdf["w"].iloc[0]), float(pdf["effort"].iloc[0])
        best = min((fit_detection(x, w, m, n) for m in models), key=lambda r: r["aic"])
        seen = int(n.sum())
        d = seen / (2 * best["esw"] * effort) * 1e6
        cv = math.sqrt(1 / seen + best["cv_esw"] ** 2)
        c = math.exp(1.96 * math.sqrt(math.log(1 + cv * cv)))
        return pd.DataFrame([(pdf[key].iloc[0], seen, w, best["model"], best["sigma"], best["esw"], best["aic"], d, cv, d / c, d * c)], columns=[key, "n", "truncation", "model", "sigma", "esw", "aic", "density", "cv", "low", "high"])

    return ok.groupBy(key).applyInPandas(run, f"{key} {dict(distances.dtypes)[key]}, n long, truncation double, model string, sigma double, esw double, aic double, density double, cv double, low double, high double")


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def zinb_nll(p: np.ndarray, y: np.ndarray, x: np.ndarray, n: np.ndarray | float = 1.0) -> float:
    """Negative log likelihood of zero-inflated negative binomial counts, each seen n times: log mean b0 + b1 x, log size, logit of the extra zeros."""
    b0, b1, log_size, gamma = p
    mu, size = np.exp(np.clip(b0 + b1 * x, -30, 30)), math.exp(min(max(log_size, -20), 20))
    zero = 1 / (1 + math.exp(-min(max(gamma, -30), 30)))
    u, at = np.unique(y, return_inverse=True)
    count = (_lgamma(u + size) - math.lgamma(size) - _lgamma(u + 1))[at] + size * np.log(size / (size + mu)) + y * np.log(mu / (size + mu))
    return float(-(n * np.where(y == 0, np.log(zero + (1 - zero) * np.exp(count) + 1e-300), math.log(1 - zero + 1e-300) + count)).sum())


def zinb(transects: DataFrame, key: str = "stratum") -> DataFrame:
    """Density per 100 ha of zero-inflated negative binomial regression of counts on areas, over many starts; se is the root of the summed variances of the transects' means, each by the delta method, and low and high are 1.96 of it away; error tells why there is none.

    Transects of one count and one area weigh together, so a fit holds the distinct pairs of its stratum and not its transects."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["area_ha", "count"])
        y, a, n = pdf["count"].to_numpy(float), pdf["area_ha"].to_numpy(float), pdf["n"].to_numpy(float)
        cols = [key, "density", "se", "low", "high", "error"]
        if n.sum() < 4 or np.ptp(a) == 0:
            return pd.DataFrame([(pdf[key].iloc[0], None, None, None, None, "too few transects or one area")], columns=cols)
        mid = np.average(a, weights=n)
        x = (a - mid) / math.sqrt(np.average((a - mid) ** 2, weights=n))
        f = lambda p: zinb_nll(p, y, x, n)
        m = math.log(max(np.average(y, weights=n), 1e-3))
        best, value = min((simplex(f, [b, s, t, g]) for b in (m, m + 0.7) for s in (0.0, 0.5) for t in (-0.5, 1.0) for g in (-4.0, -1.0, 0.5)), key=lambda r: r[1])
        best, value = simplex(f, best, 0.1)

        def fitted(p: np.ndarray) -> np.ndarray:
            zero = 1 / (1 + math.exp(-min(max(p[3], -30), 30)))
            return (1 - zero) * np.exp(np.clip(p[0] + p[1] * x, -30, 30))

        free = [i for i in range(4) if not (i == 3 and best[3] < -8 or i == 2 and best[2] > 12)]

        def at(q: np.ndarray) -> np.ndarray:
            p = best.copy()
            p[free] = q
            return p

        q = best[free]
        total = float((n * a).sum())
        slope = np.array([(fitted(at(q + d)) - fitted(at(q - d))) / 2e-5 for d in np.eye(len(q)) * 1e-5])
        try:
            each = (slope * np.linalg.solve(hessian(lambda p: f(at(p)), q), slope)).sum(0)  # the variance of each transect's mean
            se = math.sqrt(max(0.0, float((n * each).sum()))) / total * 100
        except np.linalg.LinAlgError:
            se = None
        density = float((n * fitted(best)).sum() / total * 100)
        low, high = (None, None) if se is None else (density - 1.96 * se, density + 1.96 * se)
        return pd.DataFrame([(pdf[key].iloc[0], density, se, low, high, None)], columns=cols)

    pairs = transects.groupBy(key, "count", "area_ha").agg(F.count("*").alias("n"))
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)  # few rows, much work: not to be put together
    return pairs.groupBy(key).applyInPandas(run, f"{key} {dict(transects.dtypes)[key]}, density double, se double, low double, high double, error string")


def population(transects: DataFrame, methods: tuple[str, ...] = ("naive", "bootstrap", "zinb"), study_ha: float = 0.0, n_boot: int = 999, seed: int = 42, key: str = "stratum") -> DataFrame:
    """Per stratum its transects, counts and areas, and the density of each method asked for; with a study area above 0 also the animals in it, and their interval where the method has one."""
    out = transects.groupBy(key).agg(F.count("*").alias("n_transects"), F.sum("count").alias("total_count"), F.sum("area_ha").alias("total_ha"), F.sum((F.col("count") == 0).cast("long")).alias("n_zero"))
    how = {"naive": lambda: naive(transects, key), "bootstrap": lambda: bootstrap(transects, n_boot, seed, key), "zinb": lambda: zinb(transects, key=key)}
    for m in methods:
        d = how[m]()
        have = [c for c in ("density", "low", "high") if c in d.columns]
        cols = [F.col(c).alias(m if c == "density" else f"{m}_{c}") for c in have]
        if study_ha > 0:
            cols += [(F.col(c) * study_ha / 100).alias(f"{m}_animals" + ("" if c == "density" else f"_{c}")) for c in have]
        out = out.join(d.select(key, *cols), key, "left")
    return out
