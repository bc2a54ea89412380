"""Trend surfaces: per group a quadratic surface chosen by backward AIC, an F-test gate, residuals.

Two passes of plain sums per group replace the rows: means and spreads first, then products of
the centred, scaled coordinates. One row a group then goes through a small solver, and the model
is joined back and evaluated as a column expression. Rows must have x, y and the value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..sources.scratch import cut

KEYS = ("source_file", "pass")
#: Exponents of the terms: 1, u, v (always kept), then u*u, v*v, u*v (optional).
TERMS = ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))
OPTIONAL = ("x2", "y2", "xy")
MODEL = "struct<kept:string,coef:array<double>,rss:double,rank:int,p:double,r2:double,aic:double>"
RANK_TOLERANCE = 1e-10


def group_stats(rows: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "soil_moisture") -> DataFrame:
    """Pass 1: n, means and spreads of x and y, mean, least and greatest value of each group."""
    scale = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg("x").alias("x_mean"),
        F.avg("y").alias("y_mean"),
        scale("x").alias("x_scale"),
        scale("y").alias("y_scale"),
        F.avg(value).alias("z_mean"),
        F.min(value).alias("z_min"),
        F.max(value).alias("z_max"),
    )


def guarded(stats: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``small``: too few rows, or fewer than two distinct values."""
    return stats.withColumn("small", (F.col("n") < settings.least_rows) | (F.col("z_min") == F.col("z_max")))


def mean_residuals(rows: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "soil_moisture") -> DataFrame:
    """The intercept-only model: trend_hat is the group's mean, which combines on the map side and is
    joined back, so a large group is many tasks."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("trend_hat"))
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_m.{k}")) for k in keys]
    out = rows.alias("_r").join(means.alias("_m"), same, "left").select("_r.*", "_m.trend_hat")
    return out.withColumn("resid", F.col(value) - F.col("trend_hat"))


def _power(u: Column, v: Column, i: int, j: int) -> Column | None:
    out = None
    for f in [u] * i + [v] * j:
        out = f if out is None else out * f
    return out


def group_sums(rows: DataFrame, stats: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "soil_moisture") -> DataFrame:
    """Pass 2: sums of products of centred and scaled coordinates, and with the centred value."""
    s = stats.where(~F.col("small")).select(*keys, "n", "x_mean", "y_mean", "x_scale", "y_scale", "z_mean")
    j = rows.select(*keys, "x", "y", value).join(s, list(keys))
    u, v, w = (F.col("x") - F.col("x_mean")) / F.col("x_scale"), (F.col("y") - F.col("y_mean")) / F.col("y_scale"), F.col(value) - F.col("z_mean")
    j = j.select(*keys, u.alias("u"), v.alias("v"), w.alias("w"))
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    sums = [F.sum(_power(u, v, i, d - i)).alias(f"s{i}{d - i}") for d in range(1, 5) for i in range(d + 1)]
    sums += [F.sum(w if not d else w * _power(u, v, i, d - i)).alias(f"t{i}{d - i}") for d in range(3) for i in range(d + 1)]
    return j.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("s00"), *sums, F.sum(w * w).alias("tss"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps further on, for x > 0."""
    z = x + 8
    less = np.log(np.prod(x[..., None] + np.arange(8), axis=-1))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - less


def upper_tail(f_ratio, d1, d2) -> np.ndarray:
    """P(F > f_ratio), ``f_ratio`` given as RSS1 / RSS0: the regularised incomplete beta function at
    (d2/2, d1/2), by its continued fraction, for all elements at once."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(f_ratio, np.asarray(d2) / 2, np.asarray(d1) / 2))
    inside = (x > 0) & (x < 1)
    flip = inside & (x > (a + 1) / (a + b + 2))
    y = np.where(inside, np.where(flip, 1 - x, x), 0.5)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(y), 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 500):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + step * d), safe(1 + step / c)
            h = h * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    return np.where(inside, np.clip(np.where(flip, 1 - front * h, front * h), 0.0, 1.0), np.where(x <= 0, 0.0, 1.0))


def _swept(gram: np.ndarray, moment: np.ndarray, tss: np.ndarray, terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares of all groups on ``terms``: coefficients (0 for a term left out), RSS, kept terms.

    One sweep a term over the stacked systems; a term that those before it explain is aliased in its
    group and passed over there."""
    n = len(tss)
    a = np.zeros((n, 7, 7))
    a[:, :6, :6], a[:, :6, 6], a[:, 6, :6], a[:, 6, 6] = gram, moment, moment, tss
    kept = np.zeros((n, 6), bool)
    for t in terms:
        pivot = a[:, t, t].copy()
        on = pivot > RANK_TOLERANCE * np.maximum(gram[:, t, t], 1e-300)
        row = a[:, t, :] / np.where(on, pivot, 1.0)[:, None]
        swept = a - a[:, :, t, None] * row[:, None, :]
        swept[:, t, :] = row
        swept[:, :, t] = -a[:, :, t] / np.where(on, pivot, 1.0)[:, None]
        swept[:, t, t] = 1 / np.where(on, pivot, 1.0)
        a = np.where(on[:, None, None], swept, a)
        kept[:, t] = on
    return np.where(kept, a[:, :6, 6], 0.0), np.maximum(0.0, a[:, 6, 6]), kept


def full_surface(gram: np.ndarray, moment: np.ndarray, tss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, RSS and rank of the whole quadratic surface, for all groups at once."""
    coef, rss, kept = _swept(gram, moment, tss, list(range(6)))
    return coef, rss, kept.sum(axis=1)


def _aic(rss: np.ndarray, rank: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(rss > 0, n * np.log(np.maximum(rss, 1e-320) / n) + 2 * rank, -np.inf)


def solve_groups(gram: np.ndarray, moment: np.ndarray, tss: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Backward selection from the full surface for all groups at once (gram g x 6 x 6, moment g x 6).

    The eight models that selection can reach are fitted by stacked sweeps; then at most three steps
    over arrays take the optional term whose loss lowers the AIC most, the first of equal ones."""
    fits = [_swept(gram, moment, tss, [0, 1, 2, *(t for t in (3, 4, 5) if bits >> (t - 3) & 1)]) for bits in range(8)]
    coef, rss, kept = (np.stack([f[k] for f in fits]) for k in range(3))
    rank = kept.sum(axis=2)
    aic = _aic(rss, rank, n[None, :])
    every = np.arange(len(n))
    at = (kept[7, :, 3:] * np.array([1, 2, 4])).sum(axis=1)  # aliased terms leave first
    # what is left when they have left is the same fit, so its figures are those of the full one
    now, model = aic[7].copy(), np.full(len(n), 7)
    for _ in range(3):
        best, best_aic = np.full(len(n), -1), now.copy()
        for t in range(3):
            to = at & ~(1 << t)
            tried = np.where(at >> t & 1 == 1, aic[to, every], np.inf)
            lower = tried < best_aic
            best, best_aic = np.where(lower, to, best), np.where(lower, tried, best_aic)
        moved = best >= 0
        if not moved.any():
            break
        at, now, model = np.where(moved, best, at), np.where(moved, best_aic, now), np.where(moved, best, model)
    rss, rank, coef = rss[model, every], rank[model, every], coef[model, every]
    d1, d2 = rank - 1, n - rank
    tested = (d1 > 0) & (d2 > 0) & (tss > 0)
    p = upper_tail(rss / np.where(tss > 0, tss, 1.0), np.where(tested, d1, 1), np.where(tested, d2, 1))
    return {"bits": at, "coef": coef, "rss": rss, "rank": rank, "p": np.where(tested, p, np.nan), "r2": np.where(tss > 0, 1 - rss / np.where(tss > 0, tss, 1.0), np.nan), "aic": now}


#: Names of the kept optional terms, by bits.
KEPT = np.array(["+".join(t for k, t in enumerate(OPTIONAL) if bits >> k & 1) or "none" for bits in range(8)], object)


def solve_group(gram: np.ndarray, moment: np.ndarray, tss: float, n: int) -> dict:
    """``solve_groups`` of one group."""
    out = solve_groups(gram[None], moment[None], np.array([tss]), np.array([n]))
    none = lambda v: None if np.isnan(v) else float(v)
    return {"kept": KEPT[out["bits"][0]], "coef": out["coef"][0].tolist(), "rss": float(out["rss"][0]), "rank": int(out["rank"][0]), "p": none(out["p"][0]), "r2": none(out["r2"][0]), "aic": float(out["aic"][0])}


#: Columns of ``group_sums`` that hold the systems.
SUMS = tuple([f"s{i}{d - i}" for d in range(5) for i in range(d + 1)] + [f"t{i}{d - i}" for d in range(3) for i in range(d + 1)] + ["tss"])


def systems(row: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stacked Gram matrices, moments and total sums of squares of a batch of ``SUMS``."""
    gram = np.stack([np.stack([row[f"s{a + c}{b + d}"].to_numpy(float) for c, d in TERMS], axis=1) for a, b in TERMS], axis=1)
    return gram, np.stack([row[f"t{a}{b}"].to_numpy(float) for a, b in TERMS], axis=1), row["tss"].to_numpy(float)


def fit_models(sums: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a group: the selected model, by the solver, for all groups of a batch at once. A group
    whose sums are not finite gives nulls."""

    @F.pandas_udf(MODEL)
    def solve(row: pd.DataFrame) -> pd.DataFrame:
        gram, moment, tss = systems(row)
        fine = np.isfinite(gram).all(axis=(1, 2)) & np.isfinite(moment).all(axis=1) & np.isfinite(tss)
        n = np.maximum(1, np.nan_to_num(row["s00"].to_numpy(float))).astype(np.int64)
        out = solve_groups(np.where(fine[:, None, None], gram, 0), np.where(fine[:, None], moment, 0), np.where(fine, tss, 0), n)
        value = lambda v: pd.Series(np.where(fine, v, np.nan))
        return pd.DataFrame({
            "kept": pd.Series(np.where(fine, KEPT[out["bits"]], None)), "coef": pd.Series([c if ok else None for c, ok in zip(out["coef"], fine)], dtype=object), "rss": value(out["rss"]),
            "rank": pd.Series(out["rank"]).where(pd.Series(fine)).astype("Int32"), "p": value(out["p"]), "r2": value(out["r2"]), "aic": value(out["aic"]),
        })

    solved = sums.select(*keys, "s00", "tss", solve(F.struct(*SUMS)).alias("m")).select(*keys, F.col("s00").cast("long").alias("n_fit"), "tss", "m.*")
    return solved.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in ("rss", "p", "r2", "aic") else c for c in solved.columns])


def fit_surfaces(sums: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a group: n, rss, rank and r2 of the whole quadratic surface, aliased terms left out."""

    @F.pandas_udf("struct<rss:double,rank:int>")
    def solve(row: pd.DataFrame) -> pd.DataFrame:
        _, rss, rank = full_surface(*systems(row))
        return pd.DataFrame({"rss": rss, "rank": rank.astype(np.int32)})

    out = sums.select(*keys, F.col("s00").cast("long").alias("n"), "tss", solve(F.struct(*SUMS)).alias("m"))
    return out.select(*keys, "n", "m.rss", "m.rank", (1 - F.try_divide("m.rss", "tss")).alias("r2"))


def fit_planes(sums: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a group: the plane alone, by Cramer's rule on the centred sums (b1, b2 in scaled
    coordinates, rss, r2), and its p, which is a closed form. Null where all points are on a line."""
    det = F.col("s20") * F.col("s02") - F.col("s11") * F.col("s11")
    det = F.when(det > RANK_TOLERANCE * F.col("s20") * F.col("s02"), det)
    s = sums.withColumn("b1", (F.col("t10") * F.col("s02") - F.col("t01") * F.col("s11")) / det).withColumn("b2", (F.col("t01") * F.col("s20") - F.col("t10") * F.col("s11")) / det)
    s = s.withColumn("rss", F.col("tss") - F.col("b1") * F.col("t10") - F.col("b2") * F.col("t01"))
    share = F.try_divide("rss", "tss")
    return s.select(*keys, "b1", "b2", "rss", (1 - share).alias("r2"), F.pow(share, (F.col("s00") - 3) / 2.0).alias("p"))


def gated(models: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds trend_removed: significant and explaining enough; a null p is not."""
    gate = F.coalesce((F.col("p") < settings.p_limit) & (F.col("r2") > settings.r2_limit), F.lit(False))
    return models.withColumn("trend_removed", gate)


def models_of(rows: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "soil_moisture", settings: Settings = DEFAULT, stats: DataFrame | None = None) -> DataFrame:
    """Every group's guard, model and gate in one row; small groups have no model. One row a group
    is written between the two passes, so that each pass reads the rows once; ``stats`` brings it along."""
    if stats is None:
        stats = cut(guarded(group_stats(rows, keys, value), settings))
    fitted = gated(fit_models(group_sums(rows, stats, keys, value), keys), settings)
    out = stats.join(fitted.drop("n_fit"), list(keys), "left")
    note = F.when(F.col("small"), "small_n_or_constant").when(F.col("kept").isNull(), "error: model failed").otherwise("model_fitted")
    return out.withColumn("trend_removed", F.coalesce("trend_removed", F.lit(False))).withColumn("note", note)


def residuals(rows: DataFrame, models: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "soil_moisture") -> DataFrame:
    """trend_hat, resid, sm_for_kriging and the test columns on every row.

    The models are one row a group; Spark broadcasts them by its own size check, else it shuffles."""
    m = models.select(*keys, "x_mean", "y_mean", "x_scale", "y_scale", "z_mean", "coef", "trend_removed", F.col("p").alias("p_trend"), F.col("r2").alias("r2_trend"))
    j = rows.join(m, list(keys))
    u, v = (F.col("x") - F.col("x_mean")) / F.col("x_scale"), (F.col("y") - F.col("y_mean")) / F.col("y_scale")
    surface = F.col("z_mean") + F.col("coef")[0]
    for t, (a, b) in enumerate(TERMS[1:], start=1):
        surface = surface + F.col("coef")[t] * _power(u, v, a, b)
    j = j.withColumn("trend_hat", F.when(F.col("trend_removed"), surface).otherwise(F.col("z_mean")))
    j = j.withColumn("resid", F.col(value) - F.col("trend_hat"))
    j = j.withColumn("sm_for_kriging", F.when(F.col("trend_removed"), F.col("resid")).otherwise(F.col(value)))
    return j.withColumn("trend_ind", F.col("trend_removed").cast("int")).drop("x_mean", "y_mean", "x_scale", "y_scale", "z_mean", "coef")
