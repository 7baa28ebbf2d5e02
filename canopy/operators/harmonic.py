"""Harmonic regression of time series: least squares in one aggregation, and a robust fit."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUBER, YEAR = 1.345, 365.25


def years_since_first(df: DataFrame, keys: list[str], date: str, name: str = "t") -> DataFrame:
    """``df`` with the years since the first date of its group."""
    first = df.groupBy(*keys).agg(F.min(date).alias("_first"))
    return df.join(first, keys).withColumn(name, F.date_diff(F.col(date).cast("date"), F.col("_first").cast("date")) / YEAR).drop("_first")


def design(t: Column, harmonics: int = 2) -> list[Column]:
    """cos and sin of each harmonic, and 1."""
    return [f(2 * math.pi * k * t) for k in range(1, harmonics + 1) for f in (F.cos, F.sin)] + [F.lit(1.0)]


def moments(df: DataFrame, keys: list[str], y: str, w: str, t: str = "t", harmonics: int = 2) -> DataFrame:
    """Weighted sums of products: a<i>_<j> for i <= j, b<i>, and yy, n, sw, in one aggregation."""
    x = [f"_x{i}" for i in range(2 * harmonics + 1)]
    df = df.withColumns(dict(zip(x, design(F.col(t), harmonics), strict=True)))
    weight, value = F.col(w), F.col(y)
    sums = [F.sum(weight * F.col(x[i]) * F.col(x[j])).alias(f"a{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    sums += [F.sum(weight * F.col(c) * value).alias(f"b{i}") for i, c in enumerate(x)]
    return df.groupBy(*keys).agg(*sums, F.sum(weight * value * value).alias("yy"), F.count("*").alias("n"), F.sum(weight).alias("sw"))


def elimination(size: int) -> list[dict[str, str]]:
    """Stages of Gauss-Jordan elimination on columns a<i>_<j> (i <= j) and b<i>, as SQL; the last gives p<i>."""
    name = lambda i, j: f"a{min(i, j)}_{max(i, j)}" if j < size else f"b{i}"  # noqa: E731  the lower half mirrors the upper one
    stages, at = [], {(i, j): name(i, j) for i in range(size) for j in range(size + 1)}
    for k in range(size):
        stage, after = {}, {}
        for i in range(size):
            for j in range(k + 1, size + 1):
                pivot = f"{at[k, j]} / nullif({at[k, k]}, 0)"
                stage[f"s{k}_{i}_{j}"] = pivot if i == k else f"{at[i, j]} - {at[i, k]} * ({pivot})"
                after[i, j] = f"s{k}_{i}_{j}"
        stages.append(stage)
        at |= after
    stages.append({f"p{i}": at[i, size] for i in range(size)})
    return stages


def solved(sums: DataFrame, harmonics: int = 2) -> DataFrame:
    """``sums`` (of ``moments``) with the parameters p<i>; null where the system has no solution."""
    kept = sums.columns
    for stage in elimination(2 * harmonics + 1):
        sums = sums.select(*kept, *[c for c in sums.columns if c not in kept], *[F.expr(e).alias(n) for n, e in stage.items()])
    return sums.select(*kept, *[f"p{i}" for i in range(2 * harmonics + 1)])


def wrapped(phase: Column) -> Column:
    """An angle in (-pi, pi]."""
    out = F.pmod(phase, F.lit(2 * math.pi))
    return F.when(out > math.pi, out - 2 * math.pi).otherwise(out)


def features(params: DataFrame, harmonics: int = 2) -> dict[str, Column]:
    """Amplitudes, phases and offset of parameters p<i>."""
    out = {f"amplitude_h{k + 1}": F.hypot(f"p{2 * k}", f"p{2 * k + 1}") for k in range(harmonics)}
    out |= {f"phase_h{k + 1}": wrapped(F.atan2(f"p{2 * k + 1}", f"p{2 * k}")) for k in range(harmonics)}
    return out | {"offset": F.col(f"p{2 * harmonics}")}


def fit_series(y: np.ndarray, w: np.ndarray, t: np.ndarray, harmonics: int = 2, max_iter: int = 10, tolerance: float | None = 0.05, percentile: float = 75.0, on_step: Callable[[int, float], None] | None = None) -> np.ndarray:
    """Robust fit of all pixels of a window; y, w: (dates, pixels), t: years.  (amplitudes, phases, offset, variance) of each.

    Weights are the given ones times Huber's; missing values are filled with the pixel's mean at weight 0.  Steps end
    when the percentile of relative parameter changes over the window is below the tolerance (None: never early).
    """
    return fit_together(y.T[None], w.T, t, harmonics, (max_iter,), tolerance, percentile, on_step and (lambda i, c: on_step(i, float(c[0]))))[0][0]


def fit_together(
    y: np.ndarray, w: np.ndarray, t: np.ndarray, harmonics: int = 2, limits: tuple[int, ...] = (10,), tolerance: float | None = 0.05, percentile: float = 75.0, on_step: Callable[[int, np.ndarray], None] | None = None
) -> list[np.ndarray]:
    """``fit_series`` of several measures of a window, each of which ends by itself; y: (measures, pixels, dates), w: (pixels, dates).

    Gives (measures, pixels, features) at each of the limits of steps, which rise; all from one run.
    """
    x = np.stack([f(2 * np.pi * k * t) for k in range(1, harmonics + 1) for f in (np.cos, np.sin)] + [np.ones_like(t)], axis=1)
    size, pixels, dates = x.shape[1], y.shape[1], len(t)
    upper = np.triu_indices(size)

    def square(sums: np.ndarray) -> np.ndarray:
        out = np.empty((sums.shape[1], size, size))
        out[:, upper[0], upper[1]] = out[:, upper[1], upper[0]] = sums.T
        return out

    there = np.nonzero(~np.isnan(y))  # most pixels lack most dates of a window; weights elsewhere are 0
    every = _Cells(there[0] * pixels + there[1], len(y) * pixels, y[there], w[there[1:]], x.T[:, there[2]], upper)
    count = np.bincount(every.series, minlength=every.n)
    mean = every.sums(every.y) / np.maximum(count, 1)
    off_mean = every.y - mean[every.series]
    p = every.sums(np.linalg.pinv(x)[:, there[2]] * off_mean).T + mean[:, None] * np.linalg.pinv(x).sum(axis=1)
    # of the dates that a series lacks, where its value is its mean: sums of products, with which squares of what is left are added
    lacking = square((x[:, upper[0]] * x[:, upper[1]]).sum(axis=0)[:, None] - every.sums(every.xx))
    lacking[count == dates] = 0
    sums, all_x = every.sums(off_mean), x.sum(axis=0)

    def residuals(cells: _Cells, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the parameters leave of the values that are there, and the squares of all dates' rest less its mean."""
        q = p[ids]
        q[:, -1] -= mean[ids]
        rest = cells.y - mean[ids][cells.series] - np.einsum("pc,cp->c", cells.x, q[cells.series])
        level = (sums[ids] - q @ all_x) / dates
        q[:, -1] += level
        beside = np.einsum("ni,nij,nj->n", q, lacking[ids], q)
        return rest, cells.sums((rest - level[cells.series]) ** 2) + np.maximum(beside, 0)

    def features() -> np.ndarray:
        a, b = p[:, 0:-1:2], p[:, 1::2]
        out = np.concatenate([np.hypot(a, b), np.arctan2(b, a), p[:, -1:], residuals(every, np.arange(every.n))[1][:, None] / dates], axis=1)
        out[count == 0] = np.nan
        return out.reshape(len(y), pixels, -1)

    found = [features()] if 0 in limits else []
    cells, ids = every, np.arange(every.n)  # of the measures that have not ended
    rank = percentile / 100 * (pixels * size - 1)
    low, high = int(rank), min(int(rank) + 1, pixels * size - 1)
    for step in range(max(limits)):
        old = p[ids]
        rest, squares = residuals(cells, ids)
        off = np.abs(rest)
        sigma = np.sqrt(squares / (dates - 1)) if dates > 1 else np.zeros(len(ids))
        limit = (HUBER * np.where(sigma == 0, 1e-9, sigma))[cells.series]
        own = cells.w * np.where(off <= limit, 1.0, limit / (off + 1e-9))
        left, right = square(cells.sums(cells.xx * own)), cells.sums(cells.x * (own * cells.y)).T
        good = (left[:, -1, -1] >= 1e-9) & _regular(left)
        new = np.zeros_like(right)
        if good.any():
            new[good] = np.linalg.solve(left[good], right[good][..., None])[..., 0]
        p[ids] = new
        change = np.sort((np.abs(new - old) / np.maximum(np.abs(old), 1e-5)).reshape(-1, pixels * size), axis=1)
        change = np.where(np.isnan(change[:, -1]), np.nan, change[:, low] + (change[:, high] - change[:, low]) * (rank - low))
        if on_step:
            on_step(step, change)
        if step + 1 in limits:
            found.append(features())
        if tolerance is not None:
            more = ~(change < tolerance)
            if not more.any():
                break
            if not more.all():
                kept = np.repeat(more, pixels)
                cells, ids = cells.only(kept), ids[kept]
    return found + [features() for _ in limits[len(found) :]]


class _Cells:
    """Values that are there, in order of their series; ``sums`` adds a row of numbers, or several, by series."""

    def __init__(self, series: np.ndarray, n: int, y: np.ndarray, w: np.ndarray, x: np.ndarray, upper: tuple, xx: np.ndarray | None = None) -> None:
        self.series, self.n, self.y, self.w, self.x, self.upper = series, n, y, w, x, upper
        self.xx = x[upper[0]] * x[upper[1]] if xx is None else xx
        self.start = np.flatnonzero(np.diff(series, prepend=-1))

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((*values.shape[:-1], self.n))
        if len(self.start):
            out[..., self.series[self.start]] = np.add.reduceat(values, self.start, axis=-1)
        return out

    def only(self, kept: np.ndarray) -> _Cells:
        own = kept[self.series]
        return _Cells((np.cumsum(kept) - 1)[self.series[own]], int(kept.sum()), self.y[own], self.w[own], self.x[:, own], self.upper, self.xx[:, own])


def _regular(m: np.ndarray) -> np.ndarray:
    """Which of the symmetric matrices, without negative eigenvalues, have full rank; the determinant tells most, as no eigenvalue exceeds the trace."""
    size = m.shape[-1]
    trace = np.trace(m, axis1=1, axis2=2)
    out = np.linalg.det(m) > 1e-9 * trace**size
    if not out.all():
        out[~out] = np.linalg.matrix_rank(m[~out], hermitian=True) == size
    return out


def robust_fit(df: DataFrame, window: list[str], pixel: list[str], date: str, y: str, w: str, harmonics: int = 2, max_iter: int = 10, tolerance: float | None = 0.05) -> DataFrame:
    """Features of each pixel; the pixels of a window are fitted together, so windows must be of bounded size.

    Dates of a window are those of any of its pixels; a pixel without a value at a date has a missing value there,
    and values of one pixel and date are averaged.
    """
    fits = robust_fits(df, window, pixel, date, [y], w, harmonics, (max_iter,), tolerance)
    return fits.select(*[F.col(c).alias(c.removeprefix(f"{y}_")) if c.startswith(f"{y}_") and c not in (*window, *pixel) else c for c in fits.columns if c != "max_iter"])


def robust_fits(df: DataFrame, window: list[str], pixel: list[str], date: str, ys: list[str], w: str, harmonics: int = 2, limits: tuple[int, ...] = (10,), tolerance: float | None = 0.05) -> DataFrame:
    """``robust_fit`` of several measures with one weight, at several limits of iterations: (keys, max_iter, <y>_<feature>).

    A window's rows reach Python once, for all of its measures and limits.
    """
    names = [f"amplitude_h{k + 1}" for k in range(harmonics)] + [f"phase_h{k + 1}" for k in range(harmonics)] + ["offset", "var_residual"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = [*window, *[c for c in pixel if c not in window]]
    limits = tuple(sorted(set(limits)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = np.zeros(rows.num_rows, np.int64)  # only pixels that are there
        for c in keys[len(window) :]:
            code = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            own = np.unique(own * (code.max() + 1) + code, return_inverse=True)[1]
        _, first = np.unique(own, return_index=True)
        days, at = np.unique(pd.to_datetime(rows.column(date).to_pandas()).to_numpy() if pa.types.is_string(rows.schema.field(date).type) else rows.column(date).to_numpy(), return_inverse=True)

        def cube(column: pa.ChunkedArray) -> np.ndarray:
            found = column.to_numpy()
            there = ~np.isnan(found)
            cell, shape = own[there] * len(days) + at[there], (len(first), len(days))
            n = np.bincount(cell, minlength=shape[0] * shape[1])
            total = np.bincount(cell, found[there], len(n))
            return np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0).reshape(shape)

        t = (days - days[0]) / np.timedelta64(1, "D") / YEAR
        fits = fit_together(np.stack([cube(rows.column(f"_y{k}")) for k in range(len(ys))]), np.nan_to_num(cube(rows.column("_w"))), t, harmonics, limits, tolerance)
        pixels = rows.select(keys).take(first)
        parts = []
        for limit, fit in zip(limits, fits, strict=True):
            values = [pa.array(fit[k, :, i]) for k in range(len(ys)) for i in range(len(names))]
            parts.append(pa.table([*pixels.columns, pa.array(np.full(len(first), limit, np.int32)), *values], names=[*keys, "max_iter", *[f"{y}_{n}" for y in ys for n in names]]))
        return pa.concat_tables(parts)

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["max_iter int"] + [f"`{y}_{n}` double" for y in ys for n in names])
    values = [F.col(c).cast("double").alias(a) for c, a in ((w, "_w"), *((y, f"_y{k}") for k, y in enumerate(ys)))]
    return df.select(*keys, date, *values).groupBy(*window).applyInArrow(run, schema)


def feature_stack(series: DataFrame, window: list[str], pixel: list[str], date: str = "date", max_iter: int = 10, tolerance: float | None = 0.05) -> DataFrame:
    """The 24 stored features of each pixel from its band series: (keys, date, b2, b4, b8, b11, b12, msk_cldprb).

    Bands become reflectances, cloud probability a weight, bands four indices; each index of a window ends its iterations by itself,
    and the six measures are scaled to 16-bit integers.
    """
    return feature_stacks(series, window, pixel, date, (max_iter,), tolerance).drop("max_iter")


def feature_stacks(series: DataFrame, window: list[str], pixel: list[str], date: str = "date", limits: tuple[int, ...] = (10,), tolerance: float | None = 0.05) -> DataFrame:
    """``feature_stack`` at several limits of iterations, named by ``max_iter``, from one run."""
    from canopy.functions import indices as ix
    from canopy.functions import scaling as sc
    from canopy.schemas import BANDS, INDICES

    found = ix.all_indices(*[ix.reflectance(F.col(b)) for b in BANDS])
    keys = [*window, *[c for c in pixel if c not in window]]
    wide = series.select(*keys, date, ix.cloud_weight(ix.reflectance(F.col("msk_cldprb"))).alias("w"), *[found[i].alias(i) for i in INDICES])
    fit = robust_fits(wide, window, pixel, date, list(INDICES), "w", 2, limits, tolerance)
    stored = [sc.scale_feature(F.col(f"{i}_{measure}"), i, kind).alias(f"{i}_{measure}") for i in INDICES for measure, kind in sc.KINDS.items()]
    return fit.select(*keys, "max_iter", *stored)


def compare_iterations(series: DataFrame, window: list[str], pixel: list[str], steps: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(max_iter, feature, total, no_data_pct, min, max, mean, std) of the stored features at several limits of iterations."""
    from canopy.operators.qa import band_stats
    from canopy.schemas import HARMONIC_FEATURES

    stats = band_stats(feature_stacks(series, window, pixel, limits=steps, tolerance=None), ["max_iter"], HARMONIC_FEATURES)
    return stats.select("max_iter", "feature", "total", "no_data_pct", "min", "max", "mean", "std")
