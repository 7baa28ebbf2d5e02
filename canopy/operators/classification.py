"""Classification metrics from counts, thresholds and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.numeric import mean_of, ratio

DECIDUOUS, EVERGREEN = 1, 2


def confusion_counts(y_true: Column, y_pred: Column) -> list[Column]:
    """tn, fp, fn, tp; evergreen is positive."""
    cells = {"tn": (DECIDUOUS, DECIDUOUS), "fp": (DECIDUOUS, EVERGREEN), "fn": (EVERGREEN, DECIDUOUS), "tp": (EVERGREEN, EVERGREEN)}
    return [F.count_if((y_true == t) & (y_pred == p)).alias(n) for n, (t, p) in cells.items()]


def binary_metrics(undefined: str = "zero") -> dict[str, Column]:
    """Metrics of columns tn, fp, fn, tp; ``undefined``: what a ratio without a value is, "zero" or "null"."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out: dict[str, Column] = {"accuracy": ratio(tn + tp, tn + fp + fn + tp, undefined)}
    f1s = []
    for name, hit, miss, false in (("deciduous", tn, fp, fn), ("evergreen", tp, fn, fp)):
        out[f"precision_{name}"] = ratio(hit, hit + false, undefined)
        out[f"recall_{name}"] = ratio(hit, hit + miss, undefined)
        f1 = ratio(2 * hit, 2 * hit + false + miss, undefined)
        out[f"f1_{name}"] = f1
        f1s.append(f1)
    both = ("deciduous", "evergreen")
    for m in ("precision", "recall", "f1"):
        parts = [out[f"{m}_{n}"] for n in both]
        out[f"{m}_macro"] = (parts[0] + parts[1]) / 2 if undefined == "zero" else mean_of(parts)
    support = {"deciduous": tn + fp, "evergreen": tp + fn}
    for m in ("precision", "recall", "f1"):
        weighted = sum((F.coalesce(out[f"{m}_{n}"], F.lit(0.0)) * support[n] for n in both[1:]), F.coalesce(out[f"{m}_{both[0]}"], F.lit(0.0)) * support[both[0]])
        out[f"{m}_weighted"] = ratio(weighted, tn + fp + fn + tp, undefined)
    return out


def agreement(undefined: str = "zero") -> dict[str, Column]:
    """Overall accuracy and Cohen's kappa of columns tn, fp, fn, tp.

    "zero": no rows give null, and a chance agreement of 1 gives a kappa of 1 (all agree) or 0.
    "null": both give null.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    accuracy = ratio(tn + tp, total, "null")
    chance = ratio((tn + fp) * (tn + fn) + (fn + tp) * (fp + tp), total * total, "null")
    kappa = ratio(accuracy - chance, 1 - chance, "null")
    if undefined == "zero":
        kappa = F.when(chance == 1, F.when(accuracy == 1, 1.0).otherwise(0.0)).otherwise(kappa)
    return {"overall_accuracy": accuracy, "kappa": kappa}


def national_and_regional(df: DataFrame, region: str, aggregates: list[Column], national: str = "ALL") -> DataFrame:
    """The aggregates over all rows and over each region, in one pass."""
    return df.groupingSets([[], [F.col(region)]], F.col(region)).agg(*aggregates, F.grouping(region).alias("_all")).withColumn(region, F.when(F.col("_all") == 1, national).otherwise(F.col(region))).drop("_all")


def per_class(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", labels: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 of each class (``by`` groups); with ``labels`` (label), absent ones score 0."""
    by = list(by)
    cells = df.groupBy(*by, y_true, y_pred).agg(F.count("*").alias("n"))
    true = cells.groupBy(*by, F.col(y_true).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(0)).alias("hits"))
    pred = cells.groupBy(*by, F.col(y_pred).alias("label")).agg(F.sum("n").alias("predicted"))
    out = true.join(pred, [*by, "label"], "full_outer")
    if labels is not None:
        out = labels.join(out, "label", "left")
    out = out.fillna(0, ["support", "hits", "predicted"])
    return out.select(*by, "label", "support", "hits", "predicted", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def multiclass_summary(classes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, macro and support-weighted means, and balanced accuracy (over classes that occur)."""
    total = F.sum("support")
    aggregates = [total.alias("n"), ratio(F.sum("hits"), total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggregates += [F.avg(m).alias(f"{m}_macro"), ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"{m}_weighted")]
    aggregates.append(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    return classes.groupBy(*by).agg(*aggregates)


def threshold_sweep(df: DataFrame, thresholds: list[float], by: list[str] = (), p: str = "prob", y: str = "y_true") -> DataFrame:
    """tn, fp, fn, tp of p >= t for each threshold; one pass, with one counter for each threshold."""
    at = [F.count_if((F.col(p) >= t) & (F.col(y) == k)).alias(f"k{k}_{i}") for i, t in enumerate(thresholds) for k in (DECIDUOUS, EVERGREEN)]
    sums = [F.count_if(F.col(y) == k).alias(f"n{k}") for k in (DECIDUOUS, EVERGREEN)]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k1_{i}").alias("fp"), F.col(f"k2_{i}").alias("tp"), (F.col("n1") - F.col(f"k1_{i}")).alias("tn"), (F.col("n2") - F.col(f"k2_{i}")).alias("fn")) for i, t in enumerate(thresholds)])
    return df.groupBy(*by).agg(*at, *sums).select(*by, F.inline(rows))


def reliability_bin(p: Column, bins: int = 10) -> Column:
    """Bin of a probability: right-closed edges i * (1 / bins), and 0 in the first bin."""
    edges = F.array(*[F.lit(i * (1 / bins)) for i in range(1, bins)])
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(p > e, 1).otherwise(0))


def reliability(df: DataFrame, bins: int = 10, p: str = "prob", y: str = "y_true") -> DataFrame:
    """(bin, n, fraction, confidence, empirical, midpoint) of each bin; empty bins hold zeros."""
    found = df.groupBy(reliability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg((F.col(y) == EVERGREEN).cast("double")).alias("empirical"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(found, "bin", "left").fillna(0)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return out.select("bin", "n", ratio(F.col("n"), total).alias("fraction"), "confidence", "empirical", ((F.col("bin") + 0.5) / bins).alias("midpoint"))


def calibration_error(curve: DataFrame) -> DataFrame:
    gap = F.abs(F.col("confidence") - F.col("empirical"))
    return curve.agg(F.sum(F.col("fraction") * gap).alias("ece"), F.max(F.when(F.col("n") > 0, gap)).alias("mce"), F.sum("n").alias("n"))


def spread(column: str, prefix: str | None = None) -> list[Column]:
    """Mean, sample deviation, quartiles and count."""
    p = prefix or column
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.avg(column).alias(f"{p}_mean"), F.stddev_samp(column).alias(f"{p}_std"), q[0].alias(f"{p}_q25"), q[1].alias(f"{p}_median"), q[2].alias(f"{p}_q75"), F.count(column).alias(f"{p}_n")]


def confusion_text(df: DataFrame, labels: list[int], names: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> str:
    """The confusion matrix over fixed labels as a text grid; one row for each label reaches the driver."""
    counts = {r[y_true]: r for r in df.filter(F.col(y_true).isin(labels)).groupBy(y_true).pivot(y_pred, labels).count().collect()}
    width = max([8, *map(len, names)]) + 2
    lines = ["".join(x.rjust(width) for x in ["", *names])]
    for label, name in zip(labels, names, strict=True):
        row = counts.get(label)
        lines.append("".join(x.rjust(width) for x in [name, *(str((row and row[str(k)]) or 0) for k in labels)]))
    return "\n".join(lines)
