"""How the concepts of the workflows are found in the benchmark tables; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Area of each region in the area-weight queries; one region has none.
AREAS = {"AFRICA": 30.0, "AMERICA": 60.0, "ASIA": 10.0, "EUROPE": 25.5}
AREAS_SQL = "(VALUES ('AFRICA', 30.0), ('AMERICA', 60.0), ('ASIA', 10.0), ('EUROPE', 25.5)) AS areas(eco_region, area)"
GRID_COLUMNS = 125

PIXELS_SQL = """pixels AS (
  SELECT r_name AS eco_region, l_suppkey AS tile_id, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_extendedprice,
         l_returnflag, l_shipdate, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS y_true,
         CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS y_pred, l_quantity / 50 AS prob,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS genus, 1 + l_linenumber % 3 AS genus_pred
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
GRID_SQL = f"""grid AS (
  SELECT o_orderkey // {GRID_COLUMNS} AS "row", o_orderkey % {GRID_COLUMNS} AS col,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS custom,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 1 WHEN '4' THEN 0 ELSE 255 END AS ref,
         CAST(o_orderkey % 12 AS BIGINT) AS eco, CAST(floor(o_totalprice) AS BIGINT) % 256 AS prob FROM orders)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, eco_region): suppliers and their region; nation and region have 25 and 5 rows at any scale."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("tile_id"), F.col("r_name").alias("eco_region"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as labelled, predicted pixels of tiles."""
    flag = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumnRenamed("l_suppkey", "tile_id")
        .join(tiles(spark, sf_dir), "tile_id")
        .withColumns(
            {
                "y_true": F.when(F.col("l_linestatus") == "F", 1).otherwise(2),
                "y_pred": F.when(F.col("l_quantity") > 25, 2).otherwise(1),
                "prob": F.col("l_quantity") / 50,
                "genus": F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3),
                "genus_pred": 1 + F.col("l_linenumber") % 3,
            }
        )
    )


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AREAS.items()), "eco_region string, area double")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the cells of a raster with classes, a reference, regions and a probability."""
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.floor(key / GRID_COLUMNS).alias("row"), (key % GRID_COLUMNS).alias("col"),
        F.when(status == "F", 1).when(status == "O", 2).otherwise(0).alias("custom"),
        F.when(priority.isin("1", "3"), 1).when(priority == "2", 2).when(priority == "4", 0).otherwise(255).alias("ref"),
        (key % 12).alias("eco"), (F.floor("o_totalprice") % 256).alias("prob"),
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show; without negative zeros."""
    return df.withColumns({f.name: F.round(f.name, places) + 0.0 for f in df.schema if f.dataType.simpleString() in ("double", "float")})
