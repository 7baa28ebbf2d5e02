"""Queries on scalar functions: scaling, indices, embeddings and names."""

from __future__ import annotations


from pyspark.sql import functions as F

from canopy.functions import indices as ix
from canopy.functions import names as nm
from canopy.functions import scaling as sc
from canopy.operators import relations as rel
from canopy.plans.proxies import GRID_SQL, grid, rounded, table
from canopy.plans.registry import query

# embeddings with values that are out of range, infinite, not a number or null, by rule on vec_id
_RAW_SQL = """raw AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE
  WHEN vec_id % 7 = 0 AND i = 1 THEN CAST('inf' AS DOUBLE) WHEN vec_id % 7 = 1 AND i = 2 THEN CAST('-inf' AS DOUBLE) WHEN vec_id % 7 = 2 AND i = 3 THEN CAST('nan' AS DOUBLE)
  WHEN vec_id % 7 = 3 AND i = 4 THEN NULL ELSE CAST(x AS DOUBLE) * 4 END) AS v FROM embeddings)"""


def _raw(spark, sf_dir):
    bad = {0: (0, float("inf")), 1: (1, float("-inf")), 2: (2, float("nan")), 3: (3, None)}

    def one(x, i):
        out = F.when(F.lit(False), 0.0)
        for k, (at, value) in bad.items():
            out = out.when((F.col("vec_id") % 7 == k) & (i == at), F.lit(value).cast("double"))
        return out.otherwise(x.cast("double") * 4)

    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", one).alias("v"))


def _sums(v):
    """Digest of an array that SQL can repeat: sum, smallest and largest."""
    some = F.filter(v, lambda x: x.isNotNull())
    return [F.round(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), 6), F.round(F.array_min(v), 6), F.round(F.array_max(v), 6)]


@query(f"""WITH {_RAW_SQL}, x AS (SELECT vec_id,
  list_transform(v, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE least(greatest(x, -1), 1) END) AS a,
  list_transform(v, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE least(greatest(x, -1), 1) END) AS b,
  list_transform(v, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE least(greatest(x, -1), 1) END) AS c,
  len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS all_finite FROM raw)
SELECT vec_id, all_finite, round(list_sum(a), 6) AS a_sum, round(list_min(a), 6) AS a_min, round(list_max(a), 6) AS a_max, round(list_sum(b), 6) AS b_sum, round(list_min(b), 6) AS b_min, round(list_max(b), 6) AS b_max,
round(list_sum(c), 6) AS c_sum, round(list_min(c), 6) AS c_min, round(list_max(c), 6) AS c_max FROM x""")
def embedding_sanitize(spark, sf_dir):
    """Three rules for values that are not finite or out of range."""
    v = F.col("v")
    columns = [F.col("vec_id"), sc.all_finite(v).alias("all_finite")]
    for name, rule in (("a", sc.sanitised), ("b", sc.clipped), ("c", sc.guarded)):
        columns += [c.alias(f"{name}_{k}") for c, k in zip(_sums(rule(v)), ("sum", "min", "max"), strict=True)]
    return _raw(spark, sf_dir).select(*columns)


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.4 THEN 0 ELSE CAST(trunc((least(greatest(CAST(x AS DOUBLE), -1), 1) + 1) / 2 * 65535) AS BIGINT) END) AS u FROM embeddings),
r AS (SELECT vec_id, u, list_transform(u, lambda x: CASE WHEN x <> 0 THEN least(greatest(CAST(x AS DOUBLE) / 65535 * 2 - 1, -1), 1) END) AS f FROM s)
SELECT vec_id, CAST(list_sum(u) AS BIGINT) AS stored, round(list_sum(f), 6) AS restored, CAST(list_position(f, list_max(f)) AS INT) AS first_largest, CAST(round_even((list_max(f) + 1) / 2 * 255, 0) AS INT) AS largest_byte, CAST(len(list_filter(f, lambda x: x IS NULL)) AS INT) AS no_data FROM r""")
def embedding_rescale_uint16(spark, sf_dir):
    """Stored 16-bit embeddings back to -1..1, first largest component and bytes."""
    stored = F.transform("embedding", lambda x: F.when(x > 0.4, 0).otherwise(sc.scale(x.cast("double"), -1, 1)))
    df = table(spark, sf_dir, "embeddings").select("vec_id", stored.alias("u")).withColumn("f", sc.rescale_uint16(F.col("u"), 0))
    return df.select(
        "vec_id", F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + x).alias("stored"), _sums(F.col("f"))[0].alias("restored"),
        sc.first_largest(F.col("f")).alias("first_largest"), sc.to_byte((F.array_max("f") + 1) / 2).alias("largest_byte"),
        F.size(F.filter("f", lambda x: x.isNull())).alias("no_data"),
    )


_BANDS = "p_size * 30 AS b2, p_retailprice / 3 AS b4, l_quantity * 60 AS b8, l_extendedprice / 40 AS b11, o_totalprice / 300 AS b12"
_INDEX_SQL = f"""b AS (SELECT l_suppkey AS tile_id, CAST(l_tax * 1000 AS DOUBLE) AS cloud, {_BANDS} FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT tile_id, cloud, b2 / (65535 / 3000) AS b2, b4 / (65535 / 3000) AS b4, b8 / (65535 / 3000) AS b8, b11 / (65535 / 3000) AS b11, b12 / (65535 / 3000) AS b12 FROM b),
i AS (SELECT tile_id, least(greatest((b8 - b4) / (b8 + b4 + 1e-6), -1), 1) AS ndvi, least(greatest(2.5 * (b8 - b4) / (b8 + 6.0 * b4 - 7.5 * b2 + 1.0 + 1e-6), -1), 1) AS evi,
  least(greatest((b8 - b12) / (b8 + b12 + 1e-6), -1), 1) AS nbr, least(greatest(b11 / ((b12 - b8) * (CAST(768 AS DOUBLE) / 1348) + b8 + 1e-6), 0), 5) AS crswir, least(greatest(1 - cloud / 100, 0), 1) AS w FROM r)"""


def _bands(spark, sf_dir):
    lines, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    df = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    raw = {"b2": F.col("p_size") * 30, "b4": F.col("p_retailprice") / 3, "b8": F.col("l_quantity") * 60, "b11": F.col("l_extendedprice") / 40, "b12": F.col("o_totalprice") / 300}
    return df.select(F.col("l_suppkey").alias("tile_id"), (F.col("l_tax") * 1000).alias("cloud"), *[ix.reflectance(c).alias(b) for b, c in raw.items()])


@query(f"WITH {_INDEX_SQL} SELECT tile_id, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in ("ndvi", "evi", "nbr", "crswir", "w")) + " FROM i GROUP BY 1")
def spectral_indices(spark, sf_dir):
    """Indices and cloud weights of every pixel, summed up for each tile."""
    df = _bands(spark, sf_dir).withColumns(ix.all_indices(*[F.col(b) for b in ("b2", "b4", "b8", "b11", "b12")]) | {"w": ix.cloud_weight(F.col("cloud"))})
    wanted = [f(c).alias(f"{c}_{n}") for c in ("ndvi", "evi", "nbr", "crswir", "w") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rounded(df.groupBy("tile_id").agg(F.count("*").alias("n"), *wanted))


_PHASE = "(l_quantity / 50 - 0.5) * 8"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, min({_PHASE}) AS phase, min(l_discount * 12 - 0.1) AS amp, min(l_tax * 40) AS var FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CAST(trunc((least(greatest(phase, -pi()), pi()) + pi()) / (pi() - (-pi())) * 65535) AS INT) AS phase_u, CAST(trunc(least(greatest(amp, 0), 1) / 1 * 65535) AS INT) AS ndvi_u, CAST(trunc(least(greatest(amp, 0), 2.5) / 2.5 * 65535) AS INT) AS crswir_u, CAST(trunc(least(greatest(var, 0), 2) / 2 * 65535) AS INT) AS var_u FROM x)
SELECT l_orderkey, l_linenumber, phase_u, ndvi_u, crswir_u, var_u, round(phase_u / 65535 * (2 * pi()), 6) AS phase, round(phase_u / 65535 * (2 * pi()) - pi(), 6) AS phase_centered, round(ndvi_u / 65535 * 1.0, 6) AS ndvi, round(crswir_u / 65535 * 2.5, 6) AS crswir, round(var_u / 65535 * 2.0, 6) AS variance FROM s""")
def scale_unscale_roundtrip(spark, sf_dir):
    """Features to 16-bit integers and back."""
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min((F.col("l_quantity") / 50 - 0.5) * 8).alias("phase"), F.min(F.col("l_discount") * 12 - 0.1).alias("amp"), F.min(F.col("l_tax") * 40).alias("var"))
    df = df.select("l_orderkey", "l_linenumber", sc.scale_phase(F.col("phase")).alias("phase_u"), sc.scale_feature(F.col("amp"), "ndvi", "amplitude").alias("ndvi_u"), sc.scale_feature(F.col("amp"), "crswir", "offset").alias("crswir_u"), sc.scale_feature(F.col("var"), "ndvi", "variance").alias("var_u"))
    return rounded(df.withColumns({"phase": sc.unscale_phase(F.col("phase_u")), "phase_centered": sc.unscale_phase(F.col("phase_u"), True), "ndvi": sc.unscale_feature(F.col("ndvi_u"), "ndvi", "amplitude"), "crswir": sc.unscale_feature(F.col("crswir_u"), "crswir", "offset"), "variance": sc.unscale_feature(F.col("var_u"), "ndvi", "variance")}))


@query("""SELECT o_orderkey, round(cos(o_orderkey % 629 / 100), 6) AS ndvi_phase_h1_cos, round(sin(o_orderkey % 629 / 100), 6) AS ndvi_phase_h1_sin, round(cos(o_custkey % 629 / 100), 6) AS evi_phase_h2_cos, round(sin(o_custkey % 629 / 100), 6) AS evi_phase_h2_sin, o_totalprice AS ndvi_offset FROM orders""")
def circular_features(spark, sf_dir):
    """Cosine and sine in place of phases."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 629 / 100).alias("ndvi_phase_h1"), (F.col("o_custkey") % 629 / 100).alias("evi_phase_h2"), F.col("o_totalprice").alias("ndvi_offset"))
    return rounded(sc.circular(df, ["ndvi", "evi"]))


@query("""WITH c AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS INT) AS code FROM (SELECT DISTINCT p_type FROM part)), e AS (SELECT p_partkey, code, CASE WHEN p_partkey % 3 = 0 THEN -code ELSE code END AS domain_id FROM part JOIN c USING (p_type))
SELECT p_partkey, e.code, domain_id, p_type FROM e JOIN c ON c.code = e.code""")
def category_encode_decode(spark, sf_dir):
    """Categories to codes from 1, with a sign for the domain, and back to names."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    codes = rel.codes(part, "p_type")
    coded = part.join(codes, "p_type").select("p_partkey", "code", F.when(F.col("p_partkey") % 3 == 0, -F.col("code")).otherwise(F.col("code")).alias("domain_id"))
    return coded.join(codes, "code").select("p_partkey", "code", "domain_id", "p_type")


_WORDS = {"ndvi": "NDVI", "evi": "EVI", "h1": "(1st)", "h2": "(2nd)", "var": "Variance", "residual": "of residuals"}
_FILE_SQL = """f AS (SELECT s_suppkey, 'mosaics/tile_' || s_suppkey || '_training_' || (20230101 + s_suppkey % 28) || '.tif' AS file, 'tile-' || s_suppkey || '-2023_0' || (1 + s_suppkey % 9) || '-15.tif' AS other,
 CASE s_suppkey % 4 WHEN 0 THEN 'ndvi_amplitude_h1' WHEN 1 THEN 'evi_phase_h2' WHEN 2 THEN 'nbr_offset' ELSE 'crswir_var_residual' END AS feature, s_name,
 CASE s_suppkey % 3 WHEN 0 THEN 'Deciduous oak' WHEN 1 THEN 'mixed EVERGREEN' ELSE 'heath' END AS habit, CASE s_suppkey % 3 WHEN 0 THEN 'Massif central' WHEN 1 THEN 'Alpes' ELSE 'Terres rouges' END AS region FROM supplier)"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items())


@query(f"""WITH {_FILE_SQL} SELECT s_suppkey, CAST(nullif(regexp_extract(file, 'tile_(\\d+)_training', 1), '') AS INT) AS tile_id, CAST(nullif(regexp_extract(other, 'tile_(\\d+)_training', 1), '') AS INT) AS no_tile,
CAST(strptime(regexp_extract(file, '_(\\d{{8}})', 1), '%Y%m%d') AS DATE) AS file_date, CAST(replace(regexp_extract(other, '\\d{{4}}_\\d{{2}}-\\d{{2}}'), '_', '-') AS DATE) AS other_date,
split_part(feature, '_', 1) || ':' || substr(feature, strpos(feature, '_') + 1) AS group_label, upper(split_part(feature, '_', 1)) AS index_name, substr(feature, strpos(feature, '_') + 1) AS component,
array_to_string(list_transform(string_split(feature, '_'), lambda w: CASE w {_CASES} ELSE w END), ' ') AS pretty, CAST(regexp_extract(s_name, '(\\d+)', 1) AS INT) AS number, 0 AS no_number,
CASE WHEN lower(habit) LIKE '%deciduous%' THEN 'deciduous' WHEN lower(habit) LIKE '%evergreen%' THEN 'evergreen' ELSE 'other' END AS habit,
CASE region WHEN 'Massif central' THEN 'Massif_central' WHEN 'Alpes' THEN 'Alps' ELSE 'Oceanic Southwest' END AS region FROM f""")
def text_parsing(spark, sf_dir):
    """Tiles, dates, groups, names and regions from texts."""
    key = F.col("s_suppkey")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (key % n + 1).cast("int"))
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.concat(F.lit("mosaics/tile_"), key, F.lit("_training_"), 20230101 + key % 28, F.lit(".tif")).alias("file"),
        F.concat(F.lit("tile-"), key, F.lit("-2023_0"), 1 + key % 9, F.lit("-15.tif")).alias("other"),
        pick(4, "ndvi_amplitude_h1", "evi_phase_h2", "nbr_offset", "crswir_var_residual").alias("feature"),
        pick(3, "Deciduous oak", "mixed EVERGREEN", "heath").alias("habit"), pick(3, "Massif central", "Alpes", "Terres rouges").alias("region"),
    )
    index, component = nm.group_parts(nm.group_label(F.col("feature")))
    return df.select(
        "s_suppkey", nm.tile_id(F.col("file")).alias("tile_id"), nm.tile_id(F.col("other")).alias("no_tile"), nm.file_date(F.regexp_replace("file", "tile_\\d+", "")).alias("file_date"),
        nm.file_date(F.regexp_replace("other", "^tile-\\d+-", "")).alias("other_date"), nm.group_label(F.col("feature")).alias("group_label"), index.alias("index_name"), component.alias("component"),
        nm.pretty(F.col("feature"), _WORDS).alias("pretty"), nm.number_in(F.col("s_name")).alias("number"), nm.number_in(F.col("habit")).alias("no_number"), nm.leaf_habit(F.col("habit")).alias("habit"),
        nm.region_name(F.col("region"), {"Terres_rouges": "Sud-Ouest océanique"}, {"Sud-Ouest océanique": "Oceanic Southwest", "Alpes": "Alps"}).alias("region"),
    )


@query(f"""WITH {GRID_SQL}, x AS (SELECT *, CASE WHEN custom = 0 THEN 0 ELSE 1 END AS mask FROM grid)
SELECT "row", col, CASE WHEN mask = 1 AND prob <> 255 THEN CASE WHEN prob >= 128 THEN 1 ELSE 2 END ELSE 0 END AS forest_class, CASE WHEN ref > 0 AND ref <> 255 THEN custom ELSE 0 END AS masked FROM x""")
def mask_classify(spark, sf_dir):
    """Classes by mask and threshold, and classes under a forest mask."""
    df = grid(spark, sf_dir).withColumn("mask", F.when(F.col("custom") == 0, 0).otherwise(1))
    return df.select("row", "col", ix.forest_class(F.col("mask"), F.col("prob")).alias("forest_class"), ix.masked_class(F.col("custom"), F.col("ref")).alias("masked"))


@query(f"""WITH {GRID_SQL}, x AS (SELECT "row", col, CASE WHEN custom = 0 THEN 0.0 ELSE 1.0 END AS f, CASE WHEN prob = 255 THEN 0.5 ELSE CAST(prob AS DOUBLE) / 255 END AS p FROM grid)
SELECT "row", col, CAST(round_even((1 - f) * 255, 0) AS INT) AS p_nonforest, CAST(round_even(f * p * 255, 0) AS INT) AS p_deciduous, CAST(round_even(f * (1 - p) * 255, 0) AS INT) AS p_evergreen FROM x""")
def soft_labels_hard_mask(spark, sf_dir):
    """Three probabilities in bytes from a hard mask."""
    df = grid(spark, sf_dir)
    return df.select("row", "col", *[c.alias(n) for n, c in ix.soft_labels(F.when(F.col("custom") == 0, 0).otherwise(1), F.col("prob")).items()])


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (k & 1024 = 0 AND k & 2048 = 0 AND s NOT IN (3, 8, 9, 10, 11)) AS clear FROM (SELECT event_type, event_id * 512 % 4096 AS k, user_id % 12 AS s FROM events) GROUP BY 1""")
def cloud_mask(spark, sf_dir):
    """Pixels without cloud bits and cloud classes."""
    df = table(spark, sf_dir, "events")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ix.cloud_free(F.col("event_id") * 512 % 4096, F.col("user_id") % 12)).alias("clear"))


