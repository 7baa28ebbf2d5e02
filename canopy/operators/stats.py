"""Summaries, deltas, correlations and histograms."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import mean_of, ratio
from canopy.operators.quantiles import _same, quantiles, with_quantiles
from canopy.operators.ranks import average_ranks


def _all() -> Window:
    """All rows in one group; for tables of summaries."""
    return Window.partitionBy(F.lit(1))


def label_stats(df: DataFrame, tile: str, label: str, region: str, classes: list[int]) -> DataFrame:
    """Counts and shares of each class, total, Shannon index and region of each tile."""
    out = df.groupBy(tile).agg(*[F.count_if(F.col(label) == k).alias(f"count_{k}") for k in classes], F.count_if(F.col(label).isin(classes)).alias("total"), F.min(region).alias(region))
    shares = {f"ratio_{k}": ratio(F.col(f"count_{k}"), F.col("total")) for k in classes}
    entropy = sum((-F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in shares.values()), F.lit(0.0))
    return out.withColumns(shares | {"shannon": entropy})


def deltas(both: DataFrame, columns: list[str], a: str = "_a", b: str = "_b") -> DataFrame:
    """delta_<column> = b - a, z_<column> = delta by its sample deviation over all rows (not centred), and a bucket by +-1."""
    out = both.withColumns({f"delta_{c}": F.col(c + b) - F.col(c + a) for c in columns})
    out = out.withColumns({f"z_{c}": ratio(F.col(f"delta_{c}"), F.stddev_samp(f"delta_{c}").over(_all()), "null") for c in columns})
    bucket = lambda z: F.when(z >= 1, "improved").when(z <= -1, "degraded").when(z.isNotNull(), "stable")
    return out.withColumns({f"bucket_{c}": bucket(F.col(f"z_{c}")) for c in columns})


def safe_corr(x: str, y: str, least: int = 3) -> list[Column]:
    """Aggregates from which ``correlation`` makes Pearson's r of rows that have both."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    return [F.count_if(ok).alias("n"), F.covar_pop(a, b).alias("_cov"), F.stddev_pop(a).alias("_sx"), F.stddev_pop(b).alias("_sy")]


def correlation(df: DataFrame, x: str, y: str, by: list[str] = (), least: int = 3) -> DataFrame:
    """(by, n, r): Pearson's r; null for fewer than ``least`` rows or a constant side."""
    out = df.groupBy(*by).agg(*safe_corr(x, y))
    r = F.when((F.col("n") >= least) & (F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_cov") / (F.col("_sx") * F.col("_sy")))
    return out.select(*by, "n", r.alias("r"))


def average_rank(x: str, by: list[str] = ()) -> Column:
    """Rank with the mean of ties; null for null.  Groups are ranked in one task each, so they must be summaries (else ``ranks.average_ranks``)."""
    order = Window.partitionBy(*(by or [F.lit(1)]), F.col(x).isNull()).orderBy(x)
    ties = Window.partitionBy(*(by or [F.lit(1)]), x)
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)


def correlation_table(df: DataFrame, targets: list[str], covariates: list[str], by: list[str] = (), any_length: bool = False) -> DataFrame:
    """(by, target, covariate, n, pearson, spearman) of each pair, over rows that have both.

    any_length: ranks by ranges, for tables of any length; else each pair is ranked in one task, which is faster for summaries.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("covariate"), F.col(t).cast("double").alias("x"), F.col(c).cast("double").alias("y")) for t, c in itertools.product(targets, covariates)])
    long = df.select(*by, F.inline(pairs)).filter("x is not null and y is not null")
    group = [*by, "target", "covariate"]
    if any_length:
        ranked = long
        for c in ("x", "y"):
            ranked = _same(ranked, average_ranks(long, group, c).withColumnRenamed("rank", f"rank_{c}"), [*group, c])
    else:
        ranked = long.withColumns({f"rank_{c}": average_rank(c, group) for c in ("x", "y")})
    pearson = correlation(ranked, "x", "y", group).withColumnRenamed("r", "pearson")
    spearman = correlation(ranked, "rank_x", "rank_y", group).select(*group, F.col("r").alias("spearman"))
    return pearson.join(spearman, group)


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores over all rows (constant columns: 0) and their mean absolute value."""
    z = {c: F.coalesce(ratio(F.col(c) - F.avg(c).over(_all()), F.stddev_pop(c).over(_all()), "null"), F.lit(0.0)) for c in columns}
    out = df.withColumns({f"z_{c}": x for c, x in z.items()})
    return out.withColumn("mean_abs_z", mean_of([F.abs(f"z_{c}") for c in columns]))


def quartiles(columns: list[str]) -> list[Column]:
    """Median and quartiles of each column."""
    out = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [q[1].alias(f"{c}_median"), q[0].alias(f"{c}_p25"), q[2].alias(f"{c}_p75")]
    return out


def unpivoted(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value) of each column."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))


def subset_drivers(df: DataFrame, subset: Column, columns: list[str]) -> DataFrame:
    """Mean of each column in the subset and elsewhere, difference and percent; largest difference first."""
    long = unpivoted(df.withColumn("_in", subset), ["_in"], columns)
    out = long.groupBy("feature").agg(F.avg(F.when(F.col("_in"), F.col("value"))).alias("mean"), F.avg(F.when(~F.col("_in"), F.col("value"))).alias("reference"))
    difference = F.col("mean") - F.col("reference")
    percent = F.when(F.abs("reference") >= 1e-8, 100 * difference / F.col("reference"))
    return out.withColumns({"difference": difference, "percent": percent}).orderBy(F.abs("difference").desc_nulls_last(), "feature")


def driver_correlations(df: DataFrame, subset: Column, targets: list[str], columns: list[str]) -> DataFrame:
    """The drivers of a subset with the Pearson and Spearman correlation of each with each target inside the subset."""
    means = subset_drivers(df, subset, columns)
    found = correlation_table(df.filter(subset), targets, columns)
    pivoted = found.groupBy(F.col("covariate").alias("feature")).agg(*[F.max(F.when(F.col("target") == t, F.col(m))).alias(f"{m}_{t}") for t in targets for m in ("pearson", "spearman")])
    return means.join(pivoted, "feature", "left").orderBy(F.abs("difference").desc_nulls_last(), "feature")


def missing_weights(df: DataFrame, tile: str, weight: str, top: int = 10) -> DataFrame:
    """Percent of missing weights of all rows (tile null) and of the tiles with most of them (a top-k report)."""
    share = (100 * F.avg(F.col(weight).isNull().cast("double"))).alias("missing_pct")
    tiles = df.groupBy(tile).agg(share).orderBy(F.col("missing_pct").desc(), tile).limit(top)
    return df.agg(share).select(F.lit(None).cast(df.schema[tile].dataType).alias(tile), "missing_pct").unionByName(tiles)


def histogram(df: DataFrame, column: str, bins: int, by: list[str] = ()) -> DataFrame:
    """(by, bin, low, n): equal bins between the smallest and largest value of each group; the last one is closed."""
    by = list(by)
    limits = df.groupBy(*by).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    rows = df.filter(F.col(column).isNotNull())
    rows = rows.join(limits, by) if by else rows.crossJoin(F.broadcast(limits))  # one row without groups
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.groupBy(*by, place.alias("bin"), F.col("_low"), width.alias("_width")).agg(F.count("*").alias("n")).select(*by, "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"), "n")


def describe(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, feature, count, mean, std, min, q25, median, q75, max) with exact quartiles."""
    long, group = unpivoted(df, list(by), columns), [*by, "feature"]
    out = long.groupBy(*group).agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return with_quantiles(out, long, group, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}).select(*group, "count", "mean", "std", "min", "q25", "median", "q75", "max")


def against_baseline(yearly: DataFrame, year: int, columns: list[str], keys: list[str], time: str = "year") -> DataFrame:
    """``yearly`` with delta_<column> to the row of the baseline year with the same keys."""
    base = yearly.filter(F.col(time) == year).select(*keys, *[F.col(c).alias(f"_base_{c}") for c in columns])
    out = yearly.join(base, keys, "left") if keys else yearly.crossJoin(F.broadcast(base.limit(1)))
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"_base_{c}") for c in columns}).drop(*[f"_base_{c}" for c in columns])


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share of the row's rows, share of all rows)."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumns({"row_share": ratio(F.col("n"), F.sum("n").over(Window.partitionBy(row))), "share": ratio(F.col("n"), F.sum("n").over(_all()))})


def pivot_mean(df: DataFrame, row: str, column: str, values: list[str], measure: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(measure))


def region_pixels(df: DataFrame, area: str, region: str, kinds: dict[str, Column]) -> DataFrame:
    """Pixels (area / 100) in all, and of each kind, over all rows (region ALL) and each region, in one pass."""
    sums = [(F.sum(F.when(c, F.col(area)).otherwise(0.0)) / 100).alias(n) for n, c in kinds.items()]
    out = df.groupingSets([[], [F.col(region)]], F.col(region)).agg((F.sum(area) / 100).alias("pixels"), *sums, F.grouping(region).alias("_all"))
    return out.withColumn(region, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(region))).drop("_all")


def density_targets(df: DataFrame, region: str, area: str, current: str) -> DataFrame:
    """Density of each region, and how many are needed to reach the densest one; with a TOTAL row."""
    dense = df.withColumn("density", ratio(F.col(current), F.col(area)))
    target = F.floor(F.max("density").over(_all()) * F.col(area))
    out = dense.withColumn("target", target).withColumn("needed", F.greatest(F.lit(0), F.col("target") - F.col(current)))
    total = out.agg(F.lit("TOTAL").alias(region), F.sum(area).alias(area), F.sum(current).alias(current), F.lit(None).cast("double").alias("density"), F.sum("target").alias("target"), F.sum("needed").alias("needed"))
    return out.select(region, area, current, "density", "target", "needed").unionByName(total)


def skip_reasons(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n) of lists of texts "reason: detail"."""
    reason = F.trim(F.split("r", ":", 2)[0])
    return df.select(F.explode(reasons).alias("r")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def species_by_habit(df: DataFrame, area: str, species: str, habit: str, n: int = 10) -> DataFrame:
    """(species, habit, pixels) of the n species with the largest area (a top-k report)."""
    largest = df.groupBy(species).agg(F.sum(area).alias("_a")).orderBy(F.col("_a").desc(), species).limit(n).select(species)
    return df.join(largest, species, "left_semi").groupBy(species, habit).agg((F.sum(area) / 100).alias("pixels"))


def stretched(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``df`` with <column>_stretched: positive values between two percentiles, as 0..1."""
    limits = quantiles(df.filter(F.col(column) > 0), [], column, [low, high]).select(F.col("q").alias("_q"))
    width = F.col("_q")[1] - F.col("_q")[0]
    out = df.join(F.broadcast(limits), how="left")  # one row, or none
    scaled = F.least(F.greatest(ratio(F.col(column) - F.col("_q")[0], width), F.lit(0.0)), F.lit(1.0))
    return out.withColumn(f"{column}_stretched", scaled).drop("_q")
