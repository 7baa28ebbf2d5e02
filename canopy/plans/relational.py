"""Queries on joins, sets and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import relations as rel
from canopy.operators import sampling as s
from canopy.plans.proxies import AREAS_SQL, PIXELS_SQL, areas, pixels, rounded, table, tiles
from canopy.plans.registry import query

_TILES_SQL = "tiles AS (SELECT s_suppkey AS tile_id, r_name AS eco_region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT l_orderkey % 50 AS k, eco_region, count(*) AS n FROM pixels GROUP BY ALL), r AS (SELECT k, eco_region, row_number() OVER (PARTITION BY k ORDER BY n DESC, eco_region) AS i FROM c) SELECT k, eco_region FROM r WHERE i = 1""")
def tile_mode_region(spark, sf_dir):
    """Most frequent region of each key, ties to the smallest name."""
    return s.main_region(pixels(spark, sf_dir).withColumn("k", F.col("l_orderkey") % 50), "eco_region", "k")


@query(f"WITH {PIXELS_SQL} SELECT pixels.eco_region, coalesce(CAST(area AS VARCHAR), 'Unknown') <> 'Unknown' AS known, count(*) AS n FROM pixels LEFT JOIN {AREAS_SQL} ON areas.eco_region = pixels.eco_region GROUP BY ALL")
def eco_join_unknown(spark, sf_dir):
    """A lookup in which misses become Unknown."""
    named = areas(spark).select("eco_region", F.col("eco_region").alias("known_name"))
    df = rel.lookup(pixels(spark, sf_dir), F.broadcast(named), "eco_region", "known_name")
    return df.groupBy("eco_region", (F.col("known_name") != "Unknown").alias("known")).agg(F.count("*").alias("n"))


_KEYED_SQL = "k AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_discount) AS d FROM lineitem GROUP BY 1, 2)"


def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"))


@query(f"WITH {_KEYED_SQL}, a AS (SELECT l_orderkey, l_linenumber, q FROM k WHERE l_linenumber <= 5), b AS (SELECT l_orderkey, l_linenumber, d FROM k WHERE l_linenumber >= 3) SELECT l_linenumber, count(*) AS n, round(sum(q), 6) AS q, round(sum(d), 6) AS d FROM a JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1")
def baseline_match_join(spark, sf_dir):
    """One-to-one join on two keys; rows without a match go."""
    k = _keyed(spark, sf_dir)
    joined = rel.one_to_one(k.filter("l_linenumber <= 5").drop("d"), k.filter("l_linenumber >= 3").drop("q"), ["l_orderkey", "l_linenumber"])
    return rounded(joined.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("d").alias("d")))


@query(f"""WITH {PIXELS_SQL}, {_TILES_SQL}, m AS (SELECT DISTINCT tile_id, CAST(tile_id % 5 + 1 AS INT) AS fold FROM tiles WHERE tile_id % 11 <> 0) SELECT fold, count(*) AS n, count(DISTINCT tile_id) AS tiles FROM pixels JOIN m USING (tile_id) GROUP BY 1""")
def manifest_join(spark, sf_dir):
    """Pixels with their fold from a manifest that repeats rows; pixels without one go."""
    t = tiles(spark, sf_dir)
    manifest = t.union(t).filter("tile_id % 11 <> 0").select("tile_id", (F.col("tile_id") % 5 + 1).cast("int").alias("fold")).dropDuplicates(["tile_id"])
    return pixels(spark, sf_dir).join(manifest, "tile_id").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("tile_id").alias("tiles"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey < 18 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers, avg(s_acctbal) AS balance FROM supplier WHERE s_nationkey > 6 GROUP BY 1)
SELECT k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, round(balance, 6) AS balance FROM a FULL JOIN b USING (k)""")
def context_full_outer(spark, sf_dir):
    """A full outer join in which missing counts are 0."""
    a = table(spark, sf_dir, "customer").filter("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_nationkey > 6").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"), F.avg("s_acctbal").alias("balance"))
    return rounded(rel.full_with_zeros(a, b, ["k"], ["customers", "suppliers"]))


@query(f"""WITH {_TILES_SQL}, a AS (SELECT DISTINCT l_suppkey AS tile_id FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1)
SELECT eco_region, count(*) FILTER (tile_id IN (SELECT tile_id FROM a)) AS chosen, count(*) FILTER (tile_id NOT IN (SELECT tile_id FROM a)) AS candidates FROM tiles WHERE eco_region IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1""")
def region_filter_semi_anti(spark, sf_dir):
    """Chosen tiles by semi join, candidates by anti join, in some regions."""
    some = tiles(spark, sf_dir).filter(F.col("eco_region").isin("ASIA", "EUROPE", "AFRICA"))
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_suppkey").alias("tile_id")).distinct()
    both = some.join(wanted, "tile_id", "left_semi").withColumn("kind", F.lit(1)).union(some.join(wanted, "tile_id", "left_anti").withColumn("kind", F.lit(0)))
    return both.groupBy("eco_region").agg(F.count_if(F.col("kind") == 1).alias("chosen"), F.count_if(F.col("kind") == 0).alias("candidates"))


@query("""WITH a AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS a_types FROM part WHERE p_partkey % 3 = 0 AND p_size < 10 GROUP BY 1), b AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS b_types FROM part WHERE p_partkey % 3 = 1 AND p_size < 10 GROUP BY 1)
SELECT p_brand, a_types IS NOT NULL AS in_a, b_types IS NOT NULL AS in_b, coalesce(array_to_string(a_types, ','), '') AS a_types, coalesce(array_to_string(b_types, ','), '') AS b_types, coalesce(a_types <> b_types, false) AS conflict FROM a FULL JOIN b USING (p_brand)""")
def species_conflicts(spark, sf_dir):
    """Kinds of each species in two sources, and where they differ."""
    part = table(spark, sf_dir, "part").filter("p_size < 10")
    sides = {n: part.filter(f"p_partkey % 3 = {k}") for k, n in enumerate("ab")}
    out = rel.key_sets(sides["a"], sides["b"], "p_brand")
    for n, side in sides.items():
        out = out.join(side.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias(f"{n}_types")), "p_brand", "left")
    conflict = F.coalesce(F.col("a_types") != F.col("b_types"), F.lit(False)).alias("conflict")
    return out.select("p_brand", "in_a", "in_b", *[F.coalesce(F.concat_ws(",", f"{n}_types"), F.lit("")).alias(f"{n}_types") for n in "ab"], conflict)


@query("""SELECT (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size < 4 UNION SELECT p_brand FROM part WHERE p_size > 48)) AS united, (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size < 4 INTERSECT SELECT p_brand FROM part WHERE p_size > 48)) AS shared, (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size < 4 EXCEPT SELECT p_brand FROM part WHERE p_size > 48)) AS only_a""")
def key_set_operations(spark, sf_dir):
    """Union, intersection and difference of key sets."""
    part = table(spark, sf_dir, "part")
    keys = rel.key_sets(part.filter("p_size < 4"), part.filter("p_size > 48"), "p_brand")
    return keys.agg(F.count("*").alias("united"), F.count_if(F.col("in_a") & F.col("in_b")).alias("shared"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"))


@query("""WITH old AS (SELECT n_nationkey AS k, n_regionkey AS region, 'old' AS state FROM nation), new AS (SELECT n_nationkey + 100 AS k, n_regionkey AS region, 'new' AS state FROM nation WHERE n_regionkey IN (1, 3))
SELECT region, state, count(*) AS n FROM (SELECT * FROM old WHERE region NOT IN (SELECT region FROM new) UNION ALL SELECT * FROM new) GROUP BY ALL""")
def replace_by_region(spark, sf_dir):
    """New rows take the place of all old rows of their regions."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    new = nation.filter("region in (1, 3)").withColumn("k", F.col("k") + 100).withColumn("state", F.lit("new"))
    return rel.replaced(nation.withColumn("state", F.lit("old")), new, "region").groupBy("region", "state").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS i FROM c)
SELECT p_brand, max(CASE WHEN i = 1 THEN p_type END) AS top1_p_type, max(CASE WHEN i = 1 THEN n END) AS top1_n, max(CASE WHEN i = 2 THEN p_type END) AS top2_p_type, max(CASE WHEN i = 2 THEN n END) AS top2_n, max(CASE WHEN i = 3 THEN p_type END) AS top3_p_type, max(CASE WHEN i = 3 THEN n END) AS top3_n FROM r WHERE i <= 3 GROUP BY 1""")
def top_groups_per_region(spark, sf_dir):
    """The three most frequent groups of each region in one row."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    ranked = rel.top_in_group(counts, ["p_brand"], [F.col("n").desc(), F.col("p_type")], 3)
    return rel.widened(ranked, ["p_brand"], ["p_type", "n"], 3)


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def topk_value_counts(spark, sf_dir):
    """The ten most frequent values (a top-k report)."""
    return rel.value_counts(table(spark, sf_dir, "part"), "p_brand").limit(10)


@query("""SELECT r_name, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, r_name) AS INT) AS place FROM region""")
def custom_region_order(spark, sf_dir):
    """Listed regions first, the rest by name."""
    from pyspark.sql import Window

    keys = rel.listed_first("r_name", ["EUROPE", "ASIA"])
    return table(spark, sf_dir, "region").select("r_name", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys)).cast("int").alias("place"))


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal IS NOT NULL ORDER BY s_suppkey LIMIT 20 OFFSET 10""")
def tile_slice(spark, sf_dir):
    """Tiles from one place to another in their order (a slicing operator)."""
    return table(spark, sf_dir, "supplier").filter("s_acctbal is not null").orderBy("s_suppkey").offset(10).limit(20).select("s_suppkey", "s_name")


@query("""WITH a AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS INT) AS i FROM (SELECT DISTINCT p_type FROM part)), b AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) SELECT a.i, p_type, coalesce(r_name, (SELECT min(r_name) FROM region)) AS r_name FROM a LEFT JOIN b USING (i)""")
def positional_join(spark, sf_dir):
    """The i-th name of one list with the i-th of the other, or with the first."""
    return rel.positional(table(spark, sf_dir, "part"), table(spark, sf_dir, "region"), "p_type", "r_name").withColumn("i", F.col("i").cast("int"))


@query("""WITH e AS (SELECT event_id, ts, value, CASE WHEN user_id % 10 = 0 THEN CAST('nan' AS DOUBLE) WHEN user_id % 10 = 1 THEN CAST('inf' AS DOUBLE) WHEN user_id % 10 = 2 THEN NULL ELSE value END AS v FROM events)
SELECT count(*) AS n, round(sum(v), 6) AS v FROM e WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)""")
def complete_rows(spark, sf_dir):
    """Rows whose numbers are all finite."""
    u = F.col("user_id") % 10
    df = table(spark, sf_dir, "events").withColumn("v", F.when(u == 0, float("nan")).when(u == 1, float("inf")).when(u != 2, F.col("value")))
    return rounded(rel.complete_rows(df, ["v", "value"]).agg(F.count("*").alias("n"), F.sum("v").alias("v")))


@query("""SELECT s.s_suppkey, s.s_nationkey, s.s_acctbal, n.n_name, n.s_acctbal AS s_acctbal_ctx FROM supplier s LEFT JOIN (SELECT n_nationkey AS s_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS s_acctbal FROM nation WHERE n_nationkey <> 7) n USING (s_nationkey)""")
def context_left_join(spark, sf_dir):
    """Rows with a context whose keys are unique; a column that both have gets a suffix."""
    nation = table(spark, sf_dir, "nation").filter("n_nationkey <> 7").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.col("n_regionkey").cast("double").alias("s_acctbal"))
    return rel.with_context(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), nation, ["s_nationkey"])


@query(f"""WITH {PIXELS_SQL} SELECT eco_region, arg_min(l_tax, (l_orderkey, l_linenumber)) AS weight FROM pixels WHERE l_tax > 0.02 GROUP BY 1""")
def first_region_weight(spark, sf_dir):
    """The first weight of each region that isn't missing, by the order of its rows."""
    df = pixels(spark, sf_dir).withColumn("weight", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    return rel.first_of_group(df, "eco_region", "weight", ["l_orderkey", "l_linenumber"])
