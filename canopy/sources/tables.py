"""Reading and writing tables: Parquet, CSV, JSON, text lists, and files of tiles."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from html import escape
from operator import and_
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions.names import file_date, tile_id
from canopy.operators.ranks import numbered
from canopy.schemas import QA_DOCUMENT


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, max_rows: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Columns and rows of a Parquet table; ``max_rows``: that many by the hash of the key (a sampling reader)."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    df = df.select(*columns) if columns else df
    if max_rows is None:
        return df
    return df.orderBy(F.xxhash64(*(key or df.columns))).limit(max_rows)


def parquet_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def rewrite(spark: SparkSession, path: str, change: Any) -> None:
    """Replace a table by ``change(table)``: written beside it, then put in its place.

    The old table is deleted last; whenever this stops, it or the new one is there whole, under the path or beside it.
    """
    staged, aside = (f"{path.rstrip('/')}-{uuid.uuid4().hex}-{k}" for k in ("new", "old"))
    change(spark.read.parquet(path)).write.parquet(staged)
    fs, at = _fs(spark, path)
    new, old = (_fs(spark, p)[1] for p in (staged, aside))
    if not fs.rename(at, old):
        raise OSError(f"{path} couldn't be renamed to {aside}")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{staged} couldn't be renamed to {path}")
    fs.delete(old, True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write the partitions that ``df`` has, and leave the others; a run that stops can go on with what is missing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def one_a_key(df: DataFrame, key: list[str], order: list[str] = ()) -> DataFrame:
    """The last row of each key by ``order``, and of equal ones that with the largest hash of all columns."""
    latest = [F.col(c).desc_nulls_last() for c in order] + [F.xxhash64(*df.columns).desc()]
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*latest))).filter("__nth = 1").drop("__nth")


def merge_partitions(df: DataFrame, path: str, by: str, key: list[str], order: list[str] = ()) -> None:
    """Put the rows of ``df`` into a table partitioned by ``by``: old rows of the same key go, wherever they are; all others stay.

    Of rows of ``df`` with one key the last by ``order`` counts.  Written anew are the partitions that ``df`` has and
    those that hold its keys; a partition that is left empty is deleted.  Doing it twice is as doing it once.
    """
    spark = df.sparkSession
    fs, where = _fs(spark, path)
    new = one_a_key(df, key, order)
    if not fs.exists(where):
        return replace_partitions(new, path, by)
    old = spark.read.parquet(path).withColumn(by, F.col(by).cast(df.schema[by].dataType))
    same = reduce(and_, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key))
    keys = new.select(*key).alias("new")
    touched = old.alias("old").join(keys, same, "left_semi").select(by).distinct()
    name = F.col(by).cast("string").alias("name")
    stale = [r["name"] for r in touched.select(name).collect()]  # names of partitions, not rows
    here = F.col(f"old.{by}").eqNullSafe(F.col(f"at.{by}"))
    kept = old.alias("old").join(touched.union(new.select(by)).distinct().alias("at"), here, "left_semi").alias("old").join(keys, same, "left_anti")
    merged = new.unionByName(kept, allowMissingColumns=True)
    full = {r["name"] for r in merged.select(name).distinct().collect()} if stale else set()
    replace_partitions(merged, path, by)
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for value in stale:
        if value not in full:
            fs.delete(_fs(spark, f"{path.rstrip('/')}/{named(by, value)}")[1], True)
    return None


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, places: int = 6) -> None:
    """CSV with doubles to a number of places."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    shown = [F.format_string(f"%.{places}f", c).alias(c) if k in ("double", "float") else F.col(c) for c, k in kinds.items()]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def coerced(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Text columns as numbers where all of their values are numbers; one pass finds out which."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keys]
    if not texts:
        return df
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts if not bad[c]})


def typed_value(text: F.Column) -> dict[str, F.Column]:
    """A value as an integer, else as a double, else as text: three columns, of which at most one isn't null."""
    whole, number = text.try_cast("long"), text.try_cast("double")
    return {"as_long": whole, "as_double": F.when(whole.isNull(), number), "as_text": F.when(number.isNull(), text)}


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """(document): nested quality documents, one file each."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", QA_DOCUMENT).alias("document"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(spark: SparkSession, content: Any, path: str) -> None:
    """One small JSON document, such as metrics or a configuration."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> Any:
    found = spark.read.text(path, wholetext=True).first()
    return json.loads(found["value"] if found else "")


def upsert_document(spark: SparkSession, path: str, key: str, value: Any) -> dict:
    """Put one key into a JSON document; a missing or broken one counts as empty, other errors of reading are raised."""
    fs, where = _fs(spark, path)
    try:
        content = read_document(spark, path) if fs.exists(where) else {}
    except json.JSONDecodeError:
        content = {}
    content = (content if isinstance(content, dict) else {}) | {key: value}
    write_document(spark, content, path)
    return content


def read_feature_list(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names in a text file, one a line; blank lines don't count, others must have the prefix."""
    names = [r["value"].strip() for r in spark.read.text(path).filter(F.trim("value") != "").collect()]
    wrong = [n for n in names if not n.startswith(prefix)]
    if wrong or not names:
        raise ValueError(f"no features in {path}" if not names else f"features without {prefix}: {', '.join(wrong)}")
    return names


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def latest(files: DataFrame, kind: F.Column) -> DataFrame:
    """(kind, path): the newest file of each kind, ties to the last name."""
    return files.groupBy(kind.alias("kind")).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def tile_files(files: DataFrame) -> DataFrame:
    """Files of training tiles, with their tile."""
    return files.withColumn("tile_id", tile_id(F.col("path"))).filter("tile_id is not null")


def tile_configs(files: DataFrame, location: F.Column, least_dates: int = 3) -> DataFrame:
    """(tile_idx, spatial_id, dates, tif_paths): places with enough dates, in date order, numbered by place."""
    dated = files.select(location.alias("spatial_id"), file_date(F.element_at(F.split("path", "/"), -1)).alias("date"), "path").filter("spatial_id is not null and date is not null")
    grouped = dated.groupBy("spatial_id").agg(F.sort_array(F.collect_list(F.struct("date", "path"))).alias("x")).filter(F.size("x") >= least_dates)
    return numbered(grouped, ["spatial_id"], "tile_idx").select(F.col("tile_idx").cast("int").alias("tile_idx"), "spatial_id", F.transform("x.date", lambda d: d.cast("string")).alias("dates"), F.col("x.path").alias("tif_paths"))


def named_bands(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns renamed in order; further ones become band_<i>."""
    return df.toDF(*(names + [f"band_{i + 1}" for i in range(len(names), len(df.columns))])[: len(df.columns)])


def mosaic(parts: list[DataFrame], key: list[str], order: str = "part") -> DataFrame:
    """All parts as one raster; of cells that several have, the first part's."""
    numbered = [p.withColumn(order, F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    others = [c for c in out.columns if c not in (*key, order)]
    return out.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_x")).select(*key, "_x.*")


def geojson(df: DataFrame, ring: str = "ring", properties: list[str] | None = None) -> DataFrame:
    """(value): a GeoJSON feature of each row, one a line; the ring is closed."""
    points = F.transform(F.concat(F.col(ring), F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    wanted = properties if properties is not None else [c for c in df.columns if c != ring]
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*wanted).alias("properties"))).alias("value"))


def geojson_points(df: DataFrame, lon: str, lat: str) -> DataFrame:
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c for c in df.columns if c not in (lon, lat)]).alias("properties"))).alias("value"))


def value_report(cells: DataFrame, value: str = "value", limit: int = 50) -> DataFrame:
    """Values and their counts, at most ``limit`` (a report)."""
    return cells.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(limit)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small table of summaries as Markdown text (a report of at most ``limit`` rows)."""
    rows = df.limit(limit).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows])


def html_report(title: str, sections: dict[str, DataFrame], limit: int = 200) -> str:
    """Tables of summaries under headings as one HTML page (a report of at most ``limit`` rows each)."""
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else escape(str(x))
    parts = []
    for name, df in sections.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{show(x)}</td>" for x in r) + "</tr>" for r in df.limit(limit).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{"".join(parts)}</body></html>'


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """One text, such as a report, in a folder of one file."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
