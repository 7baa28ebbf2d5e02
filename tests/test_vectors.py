"""Vector layers of all formats: round trips, ranges of any size, and files made by hand."""

import datetime
import json
import random
import sqlite3
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from canopy.sources import shapefiles, vectors

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]


def _layer(spark, n=50):
    rows = [(k, f"né {k}", k / 3, k % 2 == 0, datetime.date(2020, 1, 1 + k % 28), [(x + k, y * 1.5) for x, y in SQUARE] if k % 9 else None) for k in range(n)] + [(-1, None, None, None, None, SQUARE)]
    return spark.createDataFrame(rows, "k long, name string, v double, f boolean, d date, ring array<struct<x:double,y:double>>")


def _rings(df):
    out = {}
    for r in df.collect():
        points = None
        if r.polygons is not None:
            assert len(r.polygons) == 1 and r.polygons[0][0][0] == r.polygons[0][0][-1]
            points = sorted({(p.x, p.y) for p in r.polygons[0][0]})
        out[r.k] = (r.name, r.v, r.f, str(r.d) if r.d is not None else None, points)
    return out


def _wanted(df):
    return {r.k: (r.name, r.v, r.f, str(r.d) if r.d is not None else None, r.ring and sorted({(p.x, p.y) for p in r.ring})) for r in df.collect()}


def test_shapefiles_round_trip(spark, tmp_path):
    df = _layer(spark)
    for parts in (3, 1):
        shapefiles.write_shapefiles(df.repartition(parts), f"file://{tmp_path}/shp", projection="LOCAL")
        assert len(list((tmp_path / "shp").glob("*.shp"))) == parts and not list((tmp_path / "shp").glob("_staged*"))
        for records in (7, 20_000):
            assert _rings(shapefiles.read_shapefile(spark, f"{tmp_path}/shp", records)) == _wanted(df)
    assert (tmp_path / "shp" / "part-00000.prj").read_text() == "LOCAL"
    one = vectors.read_vectors(spark, f"{tmp_path}/shp/part-00000.shp")
    assert one.columns == ["k", "name", "v", "f", "d", "kind", "polygons", "x", "y"] and one.count() == 51
    raw = (tmp_path / "shp" / "part-00000.shp").read_bytes()
    assert struct.unpack(">i", raw[24:28])[0] * 2 == len(raw) and struct.unpack("<2i", raw[28:36]) == (1000, 5)
    with pytest.raises(ValueError, match="10 bytes"):
        shapefiles.write_shapefiles(df.withColumn("a_long_name", F.lit(1)), f"{tmp_path}/x")


def test_shapefile_of_points(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 3.5), (2, None, 1.0)], "k int, lon double, lat double")
    shapefiles.write_shapefiles(df.coalesce(1), f"{tmp_path}/p", None, ("lon", "lat"))
    assert {(r.k, r.kind, r.x, r.y) for r in shapefiles.read_shapefile(spark, f"{tmp_path}/p").collect()} == {(1, "Point", 2.5, 3.5), (2, None, None, None)}


def test_shapes_with_holes_and_other_kinds():
    cw, hole, far = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)], [(20, 0), (20, 5), (25, 5), (20, 0)]
    flat = [float(v) for r in (cw, far, hole) for p in r for v in p]
    raw = struct.pack("<i4d2i3i", 5, 0, 0, 25, 9, 3, 13, 0, 5, 9) + struct.pack(f"<{len(flat)}d", *flat)
    kind, polygons, *_ = shapefiles.geometry(raw)
    assert kind == "MultiPolygon" and [len(p) for p in polygons] == [2, 1] and [len(r) for r in polygons[0]] == [5, 4]
    assert shapefiles.geometry(struct.pack("<i3d", 11, 1.0, 2.0, 3.0))[:1] == ("Point",) and shapefiles.geometry(struct.pack("<i", 0)) == (None, None, None, None)
    assert shapefiles.geometry(struct.pack("<i", 13))[0] == "LineString"


def test_geopackages_round_trip(spark, tmp_path):
    df = _layer(spark)
    vectors.write_geopackages(df.repartition(2), f"file://{tmp_path}/g", epsg=2154)
    vectors.write_geopackages(df.repartition(2), f"file://{tmp_path}/g", epsg=2154)  # replaces the first ones
    files = sorted((tmp_path / "g").iterdir())
    assert len(files) == 2
    con = sqlite3.connect(files[0])
    assert con.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and con.execute("SELECT srs_id FROM gpkg_contents").fetchone()[0] == 2154
    con.close()
    for rows in (4, 100_000):
        assert _rings(vectors.read_geopackage(spark, f"{tmp_path}/g", rows=rows)) == _wanted(df)


def test_geopackage_envelopes():
    wkb = struct.pack("<BI2d", 1, 1, 1.0, 2.0)
    for code, numbers in enumerate((0, 4, 6, 6, 8)):
        assert vectors._package_wkb(b"GP\0" + bytes([1 | code << 1]) + struct.pack(f"<i{numbers}d", 0, *range(numbers)) + wkb) == wkb
    assert vectors._package_wkb(None) is None and vectors._package_wkb(b"xx") is None


def test_geoparquet_says_what_it_is(spark, tmp_path):
    vectors.write_geoparquet(_layer(spark).repartition(2), f"file://{tmp_path}/p.parquet", crs={"id": {"authority": "EPSG", "code": 2154}})
    files = list((tmp_path / "p.parquet").iterdir())
    assert len(files) == 2
    for f in files:
        geo = json.loads(pq.read_schema(f).metadata[b"geo"])
        assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["crs"]["id"]["code"] == 2154
    assert _rings(vectors.read_vectors(spark, f"{tmp_path}/p.parquet").drop("xmin", "ymin", "xmax", "ymax")) == _wanted(_layer(spark))


def _collection(rng):
    tricky = ['{"type":"Feature"}', 'a "quoted" [word', "back\\slash\\\\", "}]{[", "é日本", ""]
    features = []
    for k in range(60):
        ring = [[rng.uniform(-9, 9), rng.uniform(-9, 9)] for _ in range(rng.randint(3, 30))]
        g = rng.choice([{"type": "Polygon", "coordinates": [[*ring, ring[0]]]}, {"type": "Point", "coordinates": [k, 1.5]}, None])
        f = {"properties": {"k": k, "s": rng.choice(tricky), "deep": {"x": [{"y": [1, {"z": "]"}]}]}}, "geometry": g, "type": "Feature"}
        features.append(f if k % 2 else dict(reversed(f.items())))
    return {"crs": {"type": "name", "properties": {"name": "urn:x", "list": [{"not": "a feature"}]}}, "type": "FeatureCollection", "features": features, "bbox": [1, 2, 3, 4], "name": "n [{"}


@pytest.mark.parametrize("indent", [None, 2])
def test_collections_are_read_in_ranges_of_any_size(spark, tmp_path, indent):
    whole = _collection(random.Random(1))
    text = json.dumps(whole, indent=indent, ensure_ascii=indent is None)
    (tmp_path / "c.geojson").write_text(text)
    key = lambda r: (r.k, r.s, r.kind, r.x, r.polygons and [len(p) for p in r.polygons[0]])
    expected = sorted(map(key, vectors.read_geojson(spark, f"{tmp_path}/c.geojson", "k int, s string").collect()))
    assert len(expected) == 60 and [e[1] for e in expected] == [f["properties"]["s"] for f in whole["features"]]
    for split in (len(text) // 3, 997, 400):
        assert sorted(map(key, vectors.read_geojson(spark, f"{tmp_path}/c.geojson", "k int, s string", split=split).collect())) == expected, split


def test_ranges_that_begin_anywhere():
    """What a range does is composed of what its parts do, wherever it is cut."""
    raw = json.dumps(_collection(random.Random(2))).encode()[:3000]
    rng = random.Random(3)
    for _ in range(300):
        a = rng.randrange(1, len(raw) - 1)
        while raw[a - 1 : a] == b"\\":
            a += 1
        c1, o1, i1 = vectors._scan(raw[:a], False)
        c2, o2, i2 = vectors._scan(raw[a:], i1)
        assert (c1, (o1[: len(o1) - c2] if c2 else o1) + o2, i2) == vectors._scan(raw, False)


def test_export(spark, tmp_path):
    df = _layer(spark).filter("ring is not null")
    folders = vectors.export_layers(df, f"{tmp_path}/e")
    assert [f.rsplit("/", 1)[1] for f in folders] == ["geojson", "shp", "gpkg"]
    assert _rings(shapefiles.read_shapefile(spark, folders[1])) == _rings(vectors.read_geopackage(spark, folders[2])) == _wanted(df)
    points = spark.createDataFrame([(1, 2.0, 3.0)], "k int, lon double, lat double")
    folders = vectors.export_layers(points, f"{tmp_path}/q")
    assert vectors.read_geopackage(spark, folders[2]).first()[1:] == ("Point", None, 2.0, 3.0) and vectors.read_geojson(spark, folders[0], "k int", lines=True).first().x == 2.0
    folders = vectors.export_layers(points.drop("lat"), f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(folders[0]).columns == ["k", "lon"]
