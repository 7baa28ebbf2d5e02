"""Queries on quality control, similarity and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import qa
from canopy.operators import relations as rel
from canopy.operators import similarity as sim
from canopy.plans.proxies import rounded, table, tiles
from canopy.plans.registry import query

_BANDS = {"b2": "l_discount * 100", "b4": "l_tax * 100", "b8": "l_quantity"}


def _banded(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", *[F.round(F.expr(e), 4).alias(b) for b, e in _BANDS.items()])


@query(f"""WITH l AS (SELECT l_suppkey, unnest(['b2', 'b4', 'b8']) AS feature, unnest([{', '.join(f'round({e}, 4)' for e in _BANDS.values())}]) AS v FROM lineitem), a AS (SELECT l_suppkey, feature, count(*) AS total, count(*) FILTER (v <> 0) AS n, min(v) FILTER (v <> 0) AS min, max(v) FILTER (v <> 0) AS max, avg(v) FILTER (v <> 0) AS mean, stddev_pop(v) FILTER (v <> 0) AS std FROM l GROUP BY 1, 2)
SELECT l_suppkey, feature, total, round(100 * (1 - n / total), 6) AS no_data_pct, min, max, round(mean, 6) AS mean, round(std, 6) AS std, round(min / 65535, 6) AS min_scaled, round(max / 65535, 6) AS max_scaled, round(mean / 65535, 6) AS mean_scaled, round(std / 65535, 6) AS std_scaled FROM a""")
def band_qa_stats(spark, sf_dir):
    """No-data share, range, mean and deviation of each band."""
    return rounded(qa.band_stats(_banded(spark, sf_dir), ["l_suppkey"], ["b2", "b4", "b8"]))


_FLAT_SQL = "b AS (SELECT l_suppkey % 10 AS tile, l_suppkey AS file, unnest(range(1, 7)) AS band, unnest([avg(l_discount), avg(l_tax), avg(l_quantity), avg(l_discount) * 2, avg(l_tax) * 3, avg(l_extendedprice)]) AS v FROM lineitem GROUP BY 1, 2)"


def _flat(spark, sf_dir):
    d, t, q, e = (F.avg(c) for c in ("l_discount", "l_tax", "l_quantity", "l_extendedprice"))
    means = F.array(d, t, q, d * 2, t * 3, e)
    files = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("tile"), F.col("l_suppkey").alias("file")).agg(means.alias("v"))
    return files.select("tile", "file", F.posexplode("v").alias("k", "v")).select("tile", "file", (F.col("k") + 1).alias("band"), F.col("v").alias("no_data_pct"), F.col("v").alias("mean"))


_ROLLUP_SQL = f"{_FLAT_SQL}, f AS (SELECT tile, file, avg(v) FILTER (band <= 5) AS nd, avg(v) FILTER (band = 6) AS cloud FROM b GROUP BY 1, 2), m AS (SELECT tile, avg(nd) AS no_data_pct, avg(cloud) / 2185 * 100 AS cloud_pct FROM f GROUP BY 1)"


@query(f"WITH {_ROLLUP_SQL} SELECT tile, band, count(*) AS n, round(avg(v - no_data_pct), 6) AS difference FROM b JOIN m USING (tile) GROUP BY 1, 2")
def qa_nodata_diff(spark, sf_dir):
    """Features minus mosaics, by band."""
    flat = _flat(spark, sf_dir)
    diff = qa.nodata_difference(flat.select("tile", "file", "band", "no_data_pct"), qa.mosaic_rollup(flat))
    return rounded(diff.groupBy("tile", F.col("band").cast("long").alias("band")).agg(F.count("*").alias("n"), F.avg("difference").alias("difference")))


@query(f"WITH {_ROLLUP_SQL} SELECT tile, round(no_data_pct, 6) AS no_data_pct, round(cloud_pct, 4) AS cloud_pct FROM m")
def qa_mosaic_rollup(spark, sf_dir):
    """No data and cloud of each mosaic tile."""
    out = qa.mosaic_rollup(_flat(spark, sf_dir))
    return out.select("tile", F.round("no_data_pct", 6).alias("no_data_pct"), F.round("cloud_pct", 4).alias("cloud_pct"))


@query("""WITH g AS (SELECT p_brand, count(*) AS n, avg(p_size) AS mean, max(p_size) AS max, arg_min(p_partkey, (-p_size, p_partkey)) AS worst FROM part GROUP BY 1) SELECT p_brand, n, round(mean, 6) AS mean, max, worst, mean > (SELECT avg(p_size) FROM part) AS above FROM g""")
def qa_report_tables(spark, sf_dir):
    """Groups with their mean, worst item and whether they lie above the mean."""
    return rounded(qa.report(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey"))


@query("""SELECT CASE WHEN p_size > 0 AND p_size <= 5 THEN '(0, 5]' WHEN p_size > 5 AND p_size <= 10 THEN '(5, 10]' WHEN p_size > 10 AND p_size <= 20 THEN '(10, 20]' WHEN p_size > 20 AND p_size <= 100 THEN '(20, 100]' END AS cloud, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1""")
def qa_cloud_bins(spark, sf_dir):
    """Means in right-closed bins."""
    return rounded(table(spark, sf_dir, "part").groupBy(qa.cloud_bin(F.col("p_size")).alias("cloud")).agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean")))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def qa_nested_json(spark, sf_dir):
    """Values out of JSON documents."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("""WITH x AS (SELECT unnest(range(0, 64)) AS band, unnest(embedding) AS x, vec_id FROM embeddings), y AS (SELECT band, CASE WHEN (vec_id + band) % 50 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(x AS DOUBLE) * 3 END AS x FROM x)
SELECT CAST(band AS INT) AS band, count(*) AS total, count(*) FILTER (isinf(x)) AS non_finite, count(*) FILTER (NOT isinf(x) AND abs(x) > 1) AS outside, round(min(x) FILTER (NOT isinf(x)), 6) AS min, round(max(x) FILTER (NOT isinf(x)), 6) AS max FROM y GROUP BY 1""")
def embedding_band_scan(spark, sf_dir):
    """Non-finite and out-of-range values of each component."""
    v = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 50 == 0, float("inf")).otherwise(x.cast("double") * 3))
    return rounded(qa.vector_scan(table(spark, sf_dir, "embeddings").select(v.alias("v")), "v"))


@query("""WITH p AS (SELECT l_suppkey, l_extendedprice AS y, l_quantity * 1500 AS yhat, 1 - l_tax AS w FROM lineitem), m AS (SELECT l_suppkey, sum(w * y) / sum(w) AS mean FROM p GROUP BY 1) SELECT l_suppkey, round(1 - sum(w * (y - yhat) ** 2) / sum(w * (y - mean) ** 2), 6) AS r2 FROM p JOIN m USING (l_suppkey) GROUP BY 1""")
def weighted_r2(spark, sf_dir):
    """Weighted R2 of each tile."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("yhat"), (1 - F.col("l_tax")).alias("w"))
    return rounded(sim.weighted_r2(df, "y", "yhat", "w", ["l_suppkey"]))


_VECTORS = "x AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2, CAST(embedding[4] AS DOUBLE) AS f0, CAST(embedding[5] AS DOUBLE) AS f1, CAST(embedding[6] AS DOUBLE) AS f2 FROM embeddings)"


def _correlations(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("e0", "e1", "e2", "f0", "f1", "f2"))])
    return sim.feature_correlations(df, ["label"], ["e0", "e1", "e2"], ["f0", "f1", "f2"])


@query(f"""WITH {_VECTORS}, c AS (SELECT label, unnest(['e0', 'e0', 'e0', 'e1', 'e1', 'e1', 'e2', 'e2', 'e2']) AS target, unnest(['f0', 'f1', 'f2', 'f0', 'f1', 'f2', 'f0', 'f1', 'f2']) AS feature,
unnest([corr(e0, f0), corr(e0, f1), corr(e0, f2), corr(e1, f0), corr(e1, f1), corr(e1, f2), corr(e2, f0), corr(e2, f1), corr(e2, f2)]) AS r FROM x GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY label, target ORDER BY abs(r) DESC, feature) AS i FROM c) SELECT label, target, feature, round(r, 6) AS r FROM k WHERE i = 1""")
def best_feature_per_dim(spark, sf_dir):
    """The feature closest to each component in each region."""
    return rounded(sim.closest_feature(_correlations(spark, sf_dir), ["label"]))


@query(f"""WITH {_VECTORS}, c AS (SELECT label, unnest(['f0', 'f1', 'f2', 'f0', 'f1', 'f2', 'f0', 'f1', 'f2']) AS feature, unnest([corr(e0, f0), corr(e0, f1), corr(e0, f2), corr(e1, f0), corr(e1, f1), corr(e1, f2), corr(e2, f0), corr(e2, f1), corr(e2, f2)]) AS r FROM x GROUP BY 1),
g AS (SELECT label, feature, count(*) AS n_pairs, avg(abs(r)) AS mean, min(abs(r)) AS min, max(abs(r)) AS max FROM c GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, feature) AS i FROM g)
SELECT label, feature, n_pairs, round(mean, 6) AS corr_abs_mean, round(min, 6) AS corr_abs_min, round(max, 6) AS corr_abs_max, CAST(i AS INT) AS rank FROM k WHERE i <= 2""")
def group_summary(spark, sf_dir):
    """The two groups with the highest mean correlation in each region."""
    r = F.abs("r")
    groups = _correlations(spark, sf_dir).groupBy("label", "feature").agg(F.count("*").alias("n_pairs"), F.avg(r).alias("corr_abs_mean"), F.min(r).alias("corr_abs_min"), F.max(r).alias("corr_abs_max"))
    return rounded(rel.top_in_group(groups, ["label"], [F.col("corr_abs_mean").desc(), F.col("feature")], 2))


@query()
def ridge_similarity(spark, sf_dir):
    """Out-of-fold R2 of ridge regressions by region and tile, from sums of products."""
    df = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "tile_id").join(tiles(spark, sf_dir), "tile_id").withColumn("w", 1 - F.col("l_tax"))
    r2 = sim.ridge_similarity(df, "eco_region", "tile_id", ["l_quantity", "l_discount", "l_linenumber"], ["l_extendedprice", "l_tax"], "w")
    return rounded(sim.region_means(sim.tile_means(r2)))
