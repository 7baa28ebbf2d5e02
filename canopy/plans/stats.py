"""Queries on summaries, deltas and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions.names import leaf_habit
from canopy.operators import classification as c
from canopy.operators import relations as rel
from canopy.operators import stats as st
from canopy.operators.quantiles import with_quantiles
from canopy.plans.classification import _COUNTS, _RATIOS
from canopy.plans.proxies import AREAS_SQL, PIXELS_SQL, areas, pixels, rounded, table
from canopy.plans.registry import query


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT tile_id, count(*) FILTER (genus = 1) AS count_1, count(*) FILTER (genus = 2) AS count_2, count(*) FILTER (genus IN (1, 2)) AS total, min(eco_region) AS eco_region FROM pixels GROUP BY 1),
r AS (SELECT *, coalesce(count_1 / nullif(total, 0), 0) AS ratio_1, coalesce(count_2 / nullif(total, 0), 0) AS ratio_2 FROM c)
SELECT tile_id, count_1, count_2, total, eco_region, round(ratio_1, 6) AS ratio_1, round(ratio_2, 6) AS ratio_2, round(CASE WHEN ratio_1 > 0 THEN -ratio_1 * ln(ratio_1) ELSE 0 END + CASE WHEN ratio_2 > 0 THEN -ratio_2 * ln(ratio_2) ELSE 0 END, 6) AS shannon FROM r""")
def tile_label_stats(spark, sf_dir):
    """Class counts, shares and Shannon index of each tile."""
    return rounded(st.label_stats(pixels(spark, sf_dir), "tile_id", "genus", "eco_region", [1, 2]))


_DELTA_SQL = f"""{PIXELS_SQL}, a0 AS (SELECT tile_id, eco_region, {_COUNTS} FROM pixels WHERE l_discount <= 0.05 GROUP BY 1, 2), a AS (SELECT *, (f1_deciduous + f1_evergreen) / 2 AS f1_macro FROM ({_RATIOS} FROM a0)),
b0 AS (SELECT tile_id, eco_region, {_COUNTS} FROM pixels WHERE l_discount > 0.05 GROUP BY 1, 2), b AS (SELECT *, (f1_deciduous + f1_evergreen) / 2 AS f1_macro FROM ({_RATIOS} FROM b0)),
d AS (SELECT tile_id, eco_region, b.accuracy - a.accuracy AS delta_accuracy, b.f1_macro - a.f1_macro AS delta_f1_macro FROM a JOIN b USING (tile_id, eco_region)),
z AS (SELECT *, delta_accuracy / nullif(stddev_samp(delta_accuracy) OVER (), 0) AS z_accuracy, delta_f1_macro / nullif(stddev_samp(delta_f1_macro) OVER (), 0) AS z_f1_macro FROM d)"""


def _deltas(spark, sf_dir):
    df, sides = pixels(spark, sf_dir), []
    for rule in ("l_discount <= 0.05", "l_discount > 0.05"):
        counts = df.filter(rule).groupBy("tile_id", "eco_region").agg(*c.confusion_counts(F.col("y_true"), F.col("y_pred")))
        m = c.binary_metrics()
        sides.append(counts.select("tile_id", "eco_region", m["accuracy"].alias("accuracy"), m["f1_macro"].alias("f1_macro")))
    both = rel.suffixed(*sides, ["tile_id", "eco_region"], ("_a", "_b"))
    return st.deltas(both, ["accuracy", "f1_macro"])


_BUCKET = lambda z: f"CASE WHEN {z} >= 1 THEN 'improved' WHEN {z} <= -1 THEN 'degraded' WHEN {z} IS NOT NULL THEN 'stable' END"


@query(f"WITH {_DELTA_SQL} SELECT tile_id, eco_region, round(delta_accuracy, 6) AS delta_accuracy, round(delta_f1_macro, 6) AS delta_f1_macro, round(z_accuracy, 6) AS z_accuracy, round(z_f1_macro, 6) AS z_f1_macro, {_BUCKET('z_accuracy')} AS bucket_accuracy, {_BUCKET('z_f1_macro')} AS bucket_f1_macro FROM z")
def tile_delta_buckets(spark, sf_dir):
    """Differences of two maps by tile, scaled, and their buckets."""
    return rounded(_deltas(spark, sf_dir).drop("accuracy_a", "accuracy_b", "f1_macro_a", "f1_macro_b"))


_CONTEXT_SQL = f"""{_DELTA_SQL}, k AS (SELECT l_suppkey AS tile_id, avg(l_extendedprice) AS price, avg(l_tax) AS tax, count(*) AS lines FROM lineitem GROUP BY 1),
x AS (SELECT z.*, price, CASE WHEN tile_id % 5 = 0 THEN NULL ELSE tax END AS tax, CAST(lines AS DOUBLE) AS lines, s_acctbal AS balance FROM z JOIN k USING (tile_id) JOIN supplier ON s_suppkey = tile_id)"""


def _context(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tile_id")).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_tax").alias("tax"), F.count("*").cast("double").alias("lines"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_id"), F.col("s_acctbal").alias("balance"))
    out = rel.left_joins(_deltas(spark, sf_dir), [k, supplier], "tile_id")
    return out.withColumn("tax", F.when(F.col("tile_id") % 5 != 0, F.col("tax")))


@query(f"""WITH {_CONTEXT_SQL}, l AS (SELECT 'delta_accuracy' AS target, unnest(['price', 'tax', 'lines', 'balance']) AS covariate, delta_accuracy AS x, unnest([price, tax, lines, balance]) AS y FROM x UNION ALL SELECT 'delta_f1_macro', unnest(['price', 'tax', 'lines', 'balance']), delta_f1_macro, unnest([price, tax, lines, balance]) FROM x),
r AS (SELECT *, rank() OVER (PARTITION BY target, covariate ORDER BY x) + (count(*) OVER (PARTITION BY target, covariate, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY target, covariate ORDER BY y) + (count(*) OVER (PARTITION BY target, covariate, y) - 1) / 2 AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT target, covariate, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1, 2""")
def delta_corr_pearson_spearman(spark, sf_dir):
    """Pearson and Spearman correlation of deltas with covariates."""
    return rounded(st.correlation_table(_context(spark, sf_dir), ["delta_accuracy", "delta_f1_macro"], ["price", "tax", "lines", "balance"]))


@query(f"""WITH {_CONTEXT_SQL} SELECT eco_region, count(*) AS n, round(avg(delta_accuracy), 6) AS delta_mean, round(stddev_samp(delta_accuracy), 6) AS delta_std, round(count(*) FILTER (delta_accuracy > 0) / count(*), 6) AS improved_share,
round(quantile_cont(delta_accuracy, 0.5), 6) AS delta_accuracy_median, round(quantile_cont(delta_accuracy, 0.25), 6) AS delta_accuracy_p25, round(quantile_cont(delta_accuracy, 0.75), 6) AS delta_accuracy_p75, round(quantile_cont(tax, 0.5), 6) AS tax_median, round(quantile_cont(tax, 0.25), 6) AS tax_p25, round(quantile_cont(tax, 0.75), 6) AS tax_p75 FROM x GROUP BY 1""")
def eco_delta_summary(spark, sf_dir):
    """Deltas and covariates summed up by region."""
    df, d = _context(spark, sf_dir), F.col("delta_accuracy")
    return rounded(df.groupBy("eco_region").agg(F.count("*").alias("n"), F.avg(d).alias("delta_mean"), F.stddev_samp(d).alias("delta_std"), (F.count_if(d > 0) / F.count("*")).alias("improved_share"), *st.quartiles(["delta_accuracy", "tax"])))


@query(f"""WITH {_CONTEXT_SQL}, m AS (SELECT eco_region, quantile_cont(price, 0.5) AS price, quantile_cont(tax, 0.5) AS tax, 7.0 AS constant FROM x GROUP BY 1),
s AS (SELECT *, coalesce((price - avg(price) OVER ()) / nullif(stddev_pop(price) OVER (), 0), 0) AS z_price, coalesce((tax - avg(tax) OVER ()) / nullif(stddev_pop(tax) OVER (), 0), 0) AS z_tax, 0.0 AS z_constant FROM m)
SELECT eco_region, round(price, 6) AS price, round(tax, 6) AS tax, CAST(constant AS DOUBLE) AS constant, round(z_price, 6) AS z_price, round(z_tax, 6) AS z_tax, CAST(z_constant AS DOUBLE) AS z_constant, round((abs(z_price) + abs(z_tax)) / 3, 6) AS mean_abs_z FROM s""")
def context_zscores(spark, sf_dir):
    """z-scores of region medians."""
    medians = _context(spark, sf_dir).groupBy("eco_region").agg(F.percentile("price", F.lit(0.5)).alias("price"), F.percentile("tax", F.lit(0.5)).alias("tax")).withColumn("constant", F.lit(7.0))
    return rounded(st.zscores(medians, ["price", "tax", "constant"]))


@query(f"""WITH {_CONTEXT_SQL}, l AS (SELECT coalesce(z_accuracy >= 1, false) AS i, unnest(['price', 'tax', 'lines', 'balance']) AS feature, unnest([price, tax, lines, balance]) AS v FROM x), m AS (SELECT feature, avg(v) FILTER (i) AS mean, avg(v) FILTER (NOT i) AS reference FROM l GROUP BY 1)
SELECT feature, round(mean, 6) AS mean, round(reference, 6) AS reference, round(mean - reference, 6) AS difference, round(CASE WHEN abs(reference) >= 1e-8 THEN 100 * (mean - reference) / reference END, 6) AS percent FROM m""")
def subset_drivers(spark, sf_dir):
    """Covariates of the improved tiles against all others."""
    return rounded(st.subset_drivers(_context(spark, sf_dir), F.coalesce(F.col("z_accuracy") >= 1, F.lit(False)), ["price", "tax", "lines", "balance"]))


@query("""WITH l AS (SELECT min(o_totalprice) AS low, (max(o_totalprice) - min(o_totalprice)) / 30 AS width FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - low) / width), 29) AS INT) AS bin, low, width FROM orders CROSS JOIN l) SELECT bin, round(low + bin * width, 6) AS low, count(*) AS n FROM b GROUP BY bin, low, width""")
def delta_histogram(spark, sf_dir):
    """30 equal bins."""
    return rounded(st.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 30))


@query("""WITH l AS (SELECT o_orderpriority, min(o_totalprice) AS low, (max(o_totalprice) - min(o_totalprice)) / 15 AS width FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, CAST(least(floor((o_totalprice - low) / width), 14) AS INT) AS bin, low, width FROM orders JOIN l USING (o_orderpriority)) SELECT o_orderpriority, bin, round(low + bin * width, 6) AS low, count(*) AS n FROM b GROUP BY ALL""")
def region_histograms(spark, sf_dir):
    """15 equal bins in each region."""
    return rounded(st.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 15, ["o_orderpriority"]))


@query("""WITH d AS (SELECT p_brand, p_retailprice AS area, CASE p_type WHEN 'LARGE' THEN 'Deciduous' WHEN 'PROMO' THEN 'deciduous mix' WHEN 'SMALL' THEN 'Evergreen' ELSE 'none' END AS habit, p_partkey % 2 = 0 AS insitu FROM part),
g AS (SELECT CASE WHEN grouping(p_brand) = 1 THEN 'ALL' ELSE p_brand END AS p_brand, sum(area) / 100 AS pixels, sum(CASE WHEN insitu THEN area ELSE 0 END) / 100 AS in_situ, sum(CASE WHEN lower(habit) LIKE '%deciduous%' THEN area ELSE 0 END) / 100 AS deciduous, sum(CASE WHEN lower(habit) LIKE '%evergreen%' THEN area ELSE 0 END) / 100 AS evergreen, sum(CASE WHEN habit = 'none' THEN area ELSE 0 END) / 100 AS other FROM d GROUP BY GROUPING SETS ((), (p_brand)))
SELECT p_brand, round(pixels, 4) AS pixels, round(in_situ, 4) AS in_situ, round(deciduous, 4) AS deciduous, round(evergreen, 4) AS evergreen, round(other, 4) AS other FROM g""")
def region_source_pixels(spark, sf_dir):
    """Pixels by source and leaf habit, over all rows and each region in one pass."""
    t = F.col("p_type")
    habit = F.when(t == "LARGE", "Deciduous").when(t == "PROMO", "deciduous mix").when(t == "SMALL", "Evergreen").otherwise("none")
    df = table(spark, sf_dir, "part").withColumn("habit", leaf_habit(habit))
    kinds = {"in_situ": F.col("p_partkey") % 2 == 0} | {k: F.col("habit") == k for k in ("deciduous", "evergreen", "other")}
    return rounded(st.region_pixels(df, "p_retailprice", "p_brand", kinds), 4)


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_type, n, round(n / sum(n) OVER (PARTITION BY p_brand), 6) AS row_share, round(n / sum(n) OVER (), 6) AS share FROM n""")
def coverage_crosstab(spark, sf_dir):
    """Classes against classes, with shares."""
    return rounded(st.crosstab(table(spark, sf_dir, "part"), "p_brand", "p_type"))


@query(f"""WITH {PIXELS_SQL}, t AS (SELECT eco_region, count(DISTINCT tile_id) AS tiles FROM pixels GROUP BY 1), a AS (SELECT t.eco_region, area, tiles, tiles / area AS density FROM t JOIN {AREAS_SQL} ON areas.eco_region = t.eco_region),
n AS (SELECT *, CAST(floor(max(density) OVER () * area) AS BIGINT) AS target FROM a), g AS (SELECT *, greatest(0, target - tiles) AS needed FROM n)
SELECT eco_region, CAST(area AS DOUBLE) AS area, tiles, round(CAST(density AS DOUBLE), 6) AS density, target, needed FROM g UNION ALL SELECT 'TOTAL', CAST(sum(area) AS DOUBLE), CAST(sum(tiles) AS BIGINT), NULL, CAST(sum(target) AS BIGINT), CAST(sum(needed) AS BIGINT) FROM g""")
def area_density_targets(spark, sf_dir):
    """Tiles that each region lacks to be as dense as the densest."""
    t = pixels(spark, sf_dir).groupBy("eco_region").agg(F.countDistinct("tile_id").alias("tiles")).join(F.broadcast(areas(spark)), "eco_region")
    return rounded(st.density_targets(t, "eco_region", "area", "tiles"))


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS eco_region, count(*) AS n, avg(o_totalprice) AS accuracy FROM orders GROUP BY 1, 2), b AS (SELECT eco_region, accuracy AS base FROM y WHERE year = 1998)
SELECT year, eco_region, n, round(accuracy, 6) AS accuracy, round(accuracy - base, 6) AS delta_accuracy FROM y LEFT JOIN b USING (eco_region)""")
def yearly_baseline_delta(spark, sf_dir):
    """Each year against the baseline year of the same region."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("eco_region")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("accuracy"))
    return rounded(st.against_baseline(y, 1998, ["accuracy"], ["eco_region"]))


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, avg(o_totalprice) AS accuracy FROM orders GROUP BY 1) SELECT year, n, round(accuracy, 6) AS accuracy, round(accuracy - (SELECT accuracy FROM y WHERE year = 1998), 6) AS delta_accuracy, NULL::VARCHAR AS eco_region FROM y
UNION ALL SELECT NULL, count(*), round(avg(o_totalprice), 6), NULL, o_orderpriority FROM orders GROUP BY o_orderpriority""")
def yearly_overall_union(spark, sf_dir):
    """All regions against one baseline row, and regional rows that lack some columns."""
    o = table(spark, sf_dir, "orders")
    y = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("accuracy"))
    regional = o.groupBy(F.col("o_orderpriority").alias("eco_region")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("accuracy"))
    return rounded(st.against_baseline(y, 1998, ["accuracy"], []).unionByName(regional, allowMissingColumns=True))


@query("""WITH l AS (SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice']) AS feature, unnest([l_quantity, l_discount, l_extendedprice]) AS v FROM lineitem)
SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM l GROUP BY 1""")
def feature_describe(spark, sf_dir):
    """Count, mean, deviation and exact quartiles of each feature."""
    return rounded(st.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]))


@query("""SELECT p_brand, round(avg(p_retailprice) FILTER (p_type = 'SMALL'), 6) AS "SMALL", round(avg(p_retailprice) FILTER (p_type = 'MEDIUM'), 6) AS "MEDIUM", round(avg(p_retailprice) FILTER (p_type = 'LARGE'), 6) AS "LARGE" FROM part GROUP BY 1""")
def pivot_mean(spark, sf_dir):
    """Means in a table of rows and columns."""
    return rounded(st.pivot_mean(table(spark, sf_dir, "part"), "p_brand", "p_type", ["SMALL", "MEDIUM", "LARGE"], "p_retailprice"))


@query("""WITH o AS (SELECT o_orderpriority AS eco_region, CAST(o_orderkey % 100 AS DOUBLE) AS edge, o_totalprice AS patch, CAST(o_custkey % 10 AS DOUBLE) AS area FROM orders)
SELECT CASE WHEN grouping(eco_region) = 1 THEN 'ALL' ELSE eco_region END AS eco_region, round(avg(edge), 6) AS edge_mean, round(quantile_cont(edge, 0.5), 6) AS edge_median, round(avg(patch), 6) AS patch_mean, round(quantile_cont(patch, 0.5), 6) AS patch_median, sum(area) AS area FROM o GROUP BY GROUPING SETS ((), (eco_region))""")
def coherence_summary(spark, sf_dir):
    """National and regional means and medians of coherence metrics."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("eco_region"), (F.col("o_orderkey") % 100).cast("double").alias("edge"), F.col("o_totalprice").alias("patch"), (F.col("o_custkey") % 10).cast("double").alias("area"))
    out = c.national_and_regional(o, "eco_region", [*[F.avg(m).alias(f"{m}_mean") for m in ("edge", "patch")], F.sum("area").alias("area")])
    both = o.withColumn("eco_region", F.explode(F.array(F.lit("ALL"), "eco_region")))
    for m in ("edge", "patch"):
        out = with_quantiles(out, both, ["eco_region"], m, {f"{m}_median": 0.5})
    return rounded(out)


@query("""SELECT trim(split_part(r, ':', 1)) AS reason, count(*) AS n FROM (SELECT unnest([p_type || ' : ' || p_partkey, p_brand || ': x']) AS r FROM part WHERE p_size < 5) GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    """How often each reason occurs in lists of reasons."""
    part = table(spark, sf_dir, "part").filter("p_size < 5")
    lists = part.select(F.array(F.concat("p_type", F.lit(" : "), F.col("p_partkey")), F.concat("p_brand", F.lit(": x"))).alias("reasons"))
    return st.skip_reasons(lists)


@query("""WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 10) SELECT p_brand, p_type, round(sum(p_retailprice) / 100, 4) AS pixels FROM part WHERE p_brand IN (SELECT p_brand FROM t) GROUP BY 1, 2""")
def species_by_habit(spark, sf_dir):
    """Pixels by habit of the ten largest species (a top-k report)."""
    return rounded(st.species_by_habit(table(spark, sf_dir, "part"), "p_retailprice", "p_brand", "p_type"), 4)


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.02) AS a, quantile_cont(o_totalprice, 0.98) AS b FROM orders WHERE o_totalprice > 0) SELECT o_orderkey, round(least(greatest((o_totalprice - a) / (b - a), 0), 1), 6) AS stretched FROM orders CROSS JOIN q""")
def percentile_stretch(spark, sf_dir):
    """Values between their 2nd and 98th percentile as 0..1."""
    return rounded(st.stretched(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.col("o_totalprice_stretched").alias("stretched")))


@query("""WITH a AS (SELECT n_name AS k, avg(c_acctbal) AS a FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 20 GROUP BY 1), b AS (SELECT n_name AS k, avg(s_acctbal) AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey > 3 GROUP BY 1)
SELECT k, round(a, 6) AS a, round(b, 6) AS b, round(100 * (b - a) / nullif(abs(a), 0), 6) AS relative FROM a FULL JOIN b USING (k)""")
def merged_metrics(spark, sf_dir):
    """Two tables of metrics side by side."""
    nation = table(spark, sf_dir, "nation")
    a = table(spark, sf_dir, "customer").join(F.broadcast(nation.filter("n_nationkey < 20")), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").join(F.broadcast(nation.filter("n_nationkey > 3")), F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("k")).agg(F.avg("s_acctbal").alias("v"))
    return rounded(rel.merged_metrics(a, b, "k", "v"))


@query("""SELECT s_suppkey AS tile_id, s_acctbal / 100 AS perc, s_acctbal AS high_2021, s_acctbal / 2 AS low_2021, s_acctbal - s_acctbal / 2 AS range FROM supplier WHERE s_acctbal / 100 / 100 * 62500 >= 30000""")
def tile_covariates(spark, sf_dir):
    """Tiles with enough labelled pixels, their yearly columns, and a derived range."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile_id"), (F.col("s_acctbal") / 100).alias("perc"), F.col("s_acctbal").alias("high"), (F.col("s_acctbal") / 2).alias("low"))
    yearly = rel.year_suffixed(s.drop("perc"), "tile_id", 2021)
    return rel.spreads(rel.with_enough_pixels(s.select("tile_id", "perc"), 30000).join(yearly, "tile_id"), {"range": ("high_2021", "low_2021")})
