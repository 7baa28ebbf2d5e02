"""Queries on classification metrics, folds and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import classification as c
from canopy.operators import sampling as s
from canopy.plans.proxies import AREAS_SQL, PIXELS_SQL, areas, pixels, rounded, table, tiles
from canopy.plans.registry import query

_COUNTS = "count(*) FILTER (y_true = 1 AND y_pred = 1) AS tn, count(*) FILTER (y_true = 1 AND y_pred = 2) AS fp, count(*) FILTER (y_true = 2 AND y_pred = 1) AS fn, count(*) FILTER (y_true = 2 AND y_pred = 2) AS tp"
_RATIOS = """SELECT *, coalesce((tn + tp) / nullif(tn + fp + fn + tp, 0), 0) AS accuracy,
  coalesce(tn / nullif(tn + fn, 0), 0) AS precision_deciduous, coalesce(tn / nullif(tn + fp, 0), 0) AS recall_deciduous, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f1_deciduous,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision_evergreen, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_evergreen, coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1_evergreen"""
_ROUNDED = ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for m in ("precision", "recall", "f1") for k in ("deciduous", "evergreen"))
_BUNDLE = "round(accuracy, 6) AS accuracy, " + _ROUNDED + "".join(f", round(({m}_deciduous + {m}_evergreen) / 2, 6) AS {m}_macro, round(coalesce(({m}_deciduous * (tn + fp) + {m}_evergreen * (tp + fn)) / nullif(tn + fp + fn + tp, 0), 0), 6) AS {m}_weighted" for m in ("precision", "recall", "f1"))


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT CASE WHEN grouping(eco_region) = 1 THEN 'ALL' ELSE eco_region END AS eco_region, {_COUNTS} FROM pixels GROUP BY GROUPING SETS ((), (eco_region))),
m AS ({_RATIOS} FROM c) SELECT eco_region, tn, fp, fn, tp, {_BUNDLE} FROM m""")
def region_confusion_metrics(spark, sf_dir):
    """National and per-region metrics of a binary map, in one pass."""
    counts = c.national_and_regional(pixels(spark, sf_dir), "eco_region", c.confusion_counts(F.col("y_true"), F.col("y_pred")))
    return rounded(counts.withColumns(c.binary_metrics()))


@query(f"""WITH {PIXELS_SQL}, t AS (SELECT genus AS label, count(*) AS support, count(*) FILTER (genus = genus_pred) AS hits FROM pixels GROUP BY 1), p AS (SELECT genus_pred AS label, count(*) AS predicted FROM pixels GROUP BY 1),
l AS (SELECT * FROM (VALUES (1), (2), (3), (4)) v(label)),
k AS (SELECT label, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(predicted, 0) AS predicted FROM l LEFT JOIN t USING (label) LEFT JOIN p USING (label)),
m AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM k)
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted,
round(avg(recall), 6) AS recall_macro, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM m""")
def multiclass_metrics(spark, sf_dir):
    """Summary over four classes, one of which never occurs."""
    labels = spark.range(1, 5).select(F.col("id").cast("int").alias("label"))
    return rounded(c.multiclass_summary(c.per_class(pixels(spark, sf_dir), "genus", "genus_pred", labels)))


@query(f"""WITH {PIXELS_SQL}, t AS (SELECT eco_region, genus AS label, count(*) AS support, count(*) FILTER (genus = genus_pred) AS hits FROM pixels GROUP BY 1, 2), p AS (SELECT eco_region, genus_pred AS label, count(*) AS predicted FROM pixels GROUP BY 1, 2)
SELECT eco_region, label, support, hits, predicted, round(coalesce(hits / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(support + predicted, 0), 0), 6) AS f1
FROM t FULL JOIN p USING (eco_region, label)""")
def multiclass_per_class(spark, sf_dir):
    """Scores of each class in each region."""
    return rounded(c.per_class(pixels(spark, sf_dir), "genus", "genus_pred", by=["eco_region"]))


_KAPPA = """a AS (SELECT *, tn + fp + fn + tp AS n, (tn + tp) / nullif(tn + fp + fn + tp, 0) AS oa, (CAST(tn + fp AS DOUBLE) * (tn + fn) + CAST(fn + tp AS DOUBLE) * (fp + tp)) / nullif(CAST(tn + fp + fn + tp AS DOUBLE) * (tn + fp + fn + tp), 0) AS pe FROM c)"""


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT tile_id, {_COUNTS} FROM pixels WHERE l_discount > 0.05 GROUP BY 1), {_KAPPA}
SELECT tile_id, tn, fp, fn, tp, round(oa, 6) AS overall_accuracy, round(CASE WHEN pe = 1 THEN CASE WHEN oa = 1 THEN 1.0 ELSE 0.0 END ELSE (oa - pe) / (1 - pe) END, 6) AS kappa FROM a""")
def metrics_from_counts_kappa(spark, sf_dir):
    """Accuracy and kappa of each tile from its counts."""
    counts = pixels(spark, sf_dir).filter("l_discount > 0.05").groupBy("tile_id").agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred")))
    return rounded(counts.withColumns(c.agreement()))


_THRESHOLDS = [i / 10 for i in range(1, 10)]


@query(f"""WITH {PIXELS_SQL}, t AS (SELECT CAST(v AS DOUBLE) / 10 AS threshold FROM range(1, 10) r(v))
SELECT eco_region, threshold, count(*) FILTER (prob >= threshold AND y_true = 1) AS fp, count(*) FILTER (prob >= threshold AND y_true = 2) AS tp, count(*) FILTER (prob < threshold AND y_true = 1) AS tn, count(*) FILTER (prob < threshold AND y_true = 2) AS fn
FROM pixels CROSS JOIN t GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    """Confusion counts at nine thresholds in each region, in one pass over the pixels."""
    return c.threshold_sweep(pixels(spark, sf_dir), _THRESHOLDS, ["eco_region"])


_BIN = "list_sum([CASE WHEN prob > CAST(e AS DOUBLE) * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END FOR e IN range(1, 10)])"
_CURVE = f"""{PIXELS_SQL}, f AS (SELECT CAST({_BIN} AS INT) AS bin, count(*) AS n, avg(prob) AS confidence, avg(CASE WHEN y_true = 2 THEN 1.0 ELSE 0.0 END) AS empirical FROM pixels GROUP BY 1),
r AS (SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT sum(n) FROM f) AS fraction, coalesce(confidence, 0) AS confidence, coalesce(empirical, 0) AS empirical, (i + 0.5) / 10 AS midpoint FROM range(10) g(i) LEFT JOIN f ON bin = i)"""


@query(f"WITH {_CURVE} SELECT bin, n, round(fraction, 6) AS fraction, round(confidence, 6) AS confidence, round(empirical, 6) AS empirical, round(CAST(midpoint AS DOUBLE), 6) AS midpoint FROM r")
def reliability_bins(spark, sf_dir):
    """Reliability curve with right-closed bins."""
    return rounded(c.reliability(pixels(spark, sf_dir)))


@query(f"WITH {_CURVE} SELECT round(sum(fraction * abs(confidence - empirical)), 6) AS ece, round(max(abs(confidence - empirical)) FILTER (n > 0), 6) AS mce, CAST(sum(n) AS BIGINT) AS n FROM r")
def reliability_ece(spark, sf_dir):
    """Expected and largest calibration error."""
    return rounded(c.calibration_error(c.reliability(pixels(spark, sf_dir))))


_FOLDS_SQL = "folds AS (SELECT s_suppkey AS tile_id, r_name AS eco_region, ntile(5) OVER (PARTITION BY r_name ORDER BY s_suppkey) AS fold FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _folds(spark, sf_dir):
    """Folds in the order of tile ids, which SQL can repeat; models use the hash order."""
    return s.balanced_folds(tiles(spark, sf_dir), "eco_region", "tile_id", 5, order=F.col("tile_id"))


_SPREAD = lambda x: f"round(avg({x}), 6) AS {x}_mean, round(stddev_samp({x}), 6) AS {x}_std, round(quantile_cont({x}, 0.25), 6) AS {x}_q25, round(quantile_cont({x}, 0.5), 6) AS {x}_median, round(quantile_cont({x}, 0.75), 6) AS {x}_q75, count({x}) AS {x}_n"


@query(f"""WITH {PIXELS_SQL}, {_FOLDS_SQL}, c AS (SELECT fold, {_COUNTS} FROM pixels JOIN folds USING (tile_id) GROUP BY 1), m AS ({_RATIOS} FROM c), x AS (SELECT accuracy, (f1_deciduous + f1_evergreen) / 2 AS f1_macro FROM m)
SELECT {_SPREAD("accuracy")}, {_SPREAD("f1_macro")} FROM x""")
def fold_summary_quantiles(spark, sf_dir):
    """Mean, deviation and quartiles of fold metrics."""
    df = s.with_folds(pixels(spark, sf_dir), _folds(spark, sf_dir), "tile_id")
    metrics = df.groupBy("fold").agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred"))).withColumns(c.binary_metrics())
    return rounded(metrics.agg(*c.spread("accuracy"), *c.spread("f1_macro")))


@query(f"""WITH {PIXELS_SQL}, {_FOLDS_SQL}, c AS (SELECT pixels.eco_region, fold, {_COUNTS} FROM pixels JOIN folds USING (tile_id) GROUP BY 1, 2), m AS ({_RATIOS} FROM c)
SELECT eco_region, round(avg((f1_deciduous + f1_evergreen) / 2), 6) AS f1_macro_mean, round(stddev_samp((f1_deciduous + f1_evergreen) / 2), 6) AS f1_macro_std, CAST(sum(tn + fp + fn + tp) AS BIGINT) AS n FROM m GROUP BY 1""")
def region_fold_summary(spark, sf_dir):
    """Mean and deviation over folds in each region."""
    df = s.with_folds(pixels(spark, sf_dir), _folds(spark, sf_dir), "tile_id")
    metrics = df.groupBy("eco_region", "fold").agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred"))).withColumns(c.binary_metrics())
    total = F.sum(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return rounded(metrics.groupBy("eco_region").agg(F.avg("f1_macro").alias("f1_macro_mean"), F.stddev_samp("f1_macro").alias("f1_macro_std"), total.alias("n")))


@query(f"WITH {_FOLDS_SQL} SELECT eco_region, fold, count(*) AS tiles FROM folds GROUP BY ALL")
def fold_assignment_sizes(spark, sf_dir):
    """Tiles of each region in each fold; sizes are those of any order, so hash order is used."""
    return s.balanced_folds(tiles(spark, sf_dir), "eco_region", "tile_id", 5).groupBy("eco_region", "fold").agg(F.count("*").alias("tiles"))


@query(f"""WITH {PIXELS_SQL}, {_FOLDS_SQL}, c AS (SELECT pixels.eco_region, fold, count(*) AS n FROM pixels JOIN folds USING (tile_id) GROUP BY 1, 2),
p AS (SELECT CAST(f AS INT) AS fold, eco_region, CAST(sum(CASE WHEN c.fold = f THEN n ELSE 0 END) AS BIGINT) AS val, CAST(sum(CASE WHEN c.fold <> f THEN n ELSE 0 END) AS BIGINT) AS train FROM c CROSS JOIN range(1, 6) r(f) GROUP BY 1, 2)
SELECT * FROM (SELECT fold, eco_region, train, val, train + val AS total, round(coalesce(100 * train / nullif(sum(train) OVER (PARTITION BY fold), 0), 0), 6) AS train_pct, round(coalesce(100 * val / nullif(sum(val) OVER (PARTITION BY fold), 0), 0), 6) AS val_pct, round(train / nullif(val, 0), 6) AS train_val_ratio FROM p) WHERE train > 0""")
def fold_distribution(spark, sf_dir):
    """Training and validation rows of each region and fold."""
    return rounded(s.fold_distribution(s.with_folds(pixels(spark, sf_dir), _folds(spark, sf_dir), "tile_id")))


_WEIGHTS = f"""{PIXELS_SQL}, d AS (SELECT nullif(eco_region, 'ASIA') AS eco_region FROM pixels), n AS (SELECT eco_region, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT n.eco_region, n, area, CASE WHEN n.eco_region IS NOT NULL THEN coalesce((area / sum(area) OVER ()) / (n / sum(n) OVER ()), 0) END AS zero, coalesce((area / sum(area) OVER ()) / (n / sum(n) OVER ()), 1) AS one FROM n LEFT JOIN {AREAS_SQL} ON areas.eco_region = n.eco_region)"""


def _weighted(spark, sf_dir):
    """Pixels some of which have no region."""
    return pixels(spark, sf_dir).withColumn("eco_region", F.nullif(F.col("eco_region"), F.lit("ASIA")))


@query(f"WITH {_WEIGHTS} SELECT eco_region, n, round(zero, 6) AS raw, round(zero * (sum(n) FILTER (zero IS NOT NULL) OVER ()) / (sum(zero * n) OVER ()), 6) AS weight FROM w")
def eco_sample_weights(spark, sf_dir):
    """Weights that give each region its share of area."""
    return rounded(s.area_weights(_weighted(spark, sf_dir), areas(spark), "eco_region"))


@query(f"WITH {_WEIGHTS} SELECT eco_region, n, round(one, 6) AS raw, round(one * (sum(n) OVER ()) / (sum(one * n) OVER ()), 6) AS weight FROM w")
def eco_sample_weights_filled(spark, sf_dir):
    """The same, with 1 for rows without a known region."""
    return rounded(s.area_weights(_weighted(spark, sf_dir), areas(spark), "eco_region", "one"))


@query(f"""WITH {_WEIGHTS}, x AS (SELECT eco_region, zero * (sum(n) FILTER (zero IS NOT NULL) OVER ()) / (sum(zero * n) OVER ()) AS a, one * (sum(n) OVER ()) / (sum(one * n) OVER ()) AS b FROM w WHERE eco_region IS NOT NULL OR true)
SELECT coalesce(eco_region, 'Unknown') AS eco_region, round(a, 6) AS weight_a, round(b, 6) AS weight_b, round(abs(a - b), 6) AS abs_diff, round(avg(abs(a - b)) OVER (), 6) AS mean_abs_diff FROM x""")
def weight_comparison(spark, sf_dir):
    """Weights of the two rules side by side, with the mean absolute difference."""
    from pyspark.sql import Window

    rows = _weighted(spark, sf_dir)
    a, b = (s.area_weights(rows, areas(spark), "eco_region", m).select(F.coalesce("eco_region", F.lit("Unknown")).alias("eco_region"), F.col("weight").alias(n)) for m, n in (("zero", "weight_a"), ("one", "weight_b")))
    both = a.join(b, "eco_region", "full_outer").withColumn("abs_diff", F.abs(F.col("weight_a") - F.col("weight_b")))
    return rounded(both.withColumn("mean_abs_diff", F.avg("abs_diff").over(Window.partitionBy(F.lit(1)))))


@query(f"WITH {PIXELS_SQL}, n AS (SELECT genus, count(*) AS n FROM pixels GROUP BY 1) SELECT genus, n, round(sum(n) OVER () / n, 6) AS weight FROM n")
def class_weights(spark, sf_dir):
    """All rows by the rows of each class."""
    return rounded(s.class_weights(pixels(spark, sf_dir), "genus"))


@query()
def stratified_sample(spark, sf_dir):
    """100 pixels of each region, split by class into train and test; a sampling operator."""
    rows = table(spark, sf_dir, "orders").withColumn("eco_region", F.col("o_orderpriority"))
    some = s.sample_by(rows, ["eco_region"], ["o_orderkey"], 100)
    return s.stratified_split(some, ["eco_region", "o_orderstatus"], ["o_orderkey"], 0.7).select("o_orderkey", "eco_region", "o_orderstatus", "part")
