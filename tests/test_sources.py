import io
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import geo
from canopy.sources import feature_files, rasters, tables, tiff, vectors
from canopy.sources.tables import merge_partitions
from canopy.streaming.incremental import run_available


def test_tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = spark.createDataFrame([(k, k / 3, f"r{k % 2}") for k in range(10)], "k int, x double, r string")
    tables.write_parquet(df, f"{at}/p", ["r"])
    assert tables.read_parquet(spark, f"{at}/p", ["k", "x"], "r = 'r1'").count() == 5
    assert tables.read_parquet(spark, f"{at}/p", max_rows=3, key=["k"]).count() == 3
    tables.replace_partitions(df.filter("r = 'r1'").withColumn("x", F.lit(0.0)), f"{at}/p", "r")
    assert tables.read_parquet(spark, f"{at}/p").count() == 10 and tables.read_parquet(spark, f"{at}/p", where="x = 0").count() == 6
    tables.rewrite(spark, f"{at}/p", lambda t: t.filter("k < 4"))
    assert tables.read_parquet(spark, f"{at}/p").count() == 4
    tables.write_csv(df, f"{at}/c", 4)
    back = tables.read_csv(spark, f"{at}/c")
    assert back.filter("k = 1").first().x == 0.3333 and dict(back.dtypes)["k"] == "int"
    text = spark.createDataFrame([("1", "a"), ("2.5", "b")], "n string, t string")
    assert dict(tables.coerced(text).dtypes) == {"n": "double", "t": "string"}


def test_rewrite_keeps_a_table_when_a_step_fails(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(at)
    with pytest.raises(ZeroDivisionError):
        tables.rewrite(spark, at, lambda t: 1 / 0)
    assert spark.read.parquet(at).count() == 5
    tables.rewrite(spark, at, lambda t: t.filter("id > 0"))
    assert spark.read.parquet(at).count() == 4 and [x.name for x in tmp_path.iterdir()] == ["t"]


def test_documents(spark, tmp_path):
    at = f"file://{tmp_path}/d.json"
    assert tables.upsert_document(spark, at, "2023-01-15", 3.5) == {"2023-01-15": 3.5}
    assert tables.upsert_document(spark, at, "2023-02-15", 1) == {"2023-01-15": 3.5, "2023-02-15": 1}
    (tmp_path / "broken").write_text("{no")
    assert tables.upsert_document(spark, f"file://{tmp_path}/broken", "a", 1) == {"a": 1}
    band = {"band": 1, "name": "B2", "no_data_pct": 1.0, "min": 0.0, "max": 1.0, "mean": 0.5, "std": 0.1}
    (tmp_path / "qa.json").write_text(json.dumps({"2023": {"f.tif": {"bands": [band, band | {"band": 2}]}}}))
    from canopy.operators.qa import flattened

    assert [(r.date, r.file, r.band) for r in flattened(tables.read_qa(spark, f"file://{tmp_path}/qa.json")).collect()] == [("2023", "f.tif", 1), ("2023", "f.tif", 2)]


def test_lists_and_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("embedding_1\n\n embedding_2 \n")
    assert tables.read_feature_list(spark, f"file://{tmp_path}/f.txt", "embedding_") == ["embedding_1", "embedding_2"]
    with pytest.raises(ValueError):
        tables.read_feature_list(spark, f"file://{tmp_path}/f.txt", "ndvi")
    for name in ("A_20230115.tif", "A_20230215.tif", "A_2023-03-15.tif", "B_20230115.tif", "tile_7_training.tif"):
        (tmp_path / name).write_bytes(b"x")
    files = tables.list_files(spark, f"file://{tmp_path}", "*.tif")
    assert [r.tile_id for r in tables.tile_files(files).collect()] == [7]
    configs = tables.tile_configs(files, F.nullif(F.regexp_extract("path", r"([AB])_", 1), F.lit(""))).collect()
    assert len(configs) == 1 and configs[0].tile_idx == 0 and configs[0].dates == ["2023-01-15", "2023-02-15", "2023-03-15"]
    assert tables.latest(files, F.lit("tif")).count() == 1


def test_rasters(spark, tmp_path):
    data = np.arange(2 * 5 * 7, dtype=np.uint16).reshape(2, 5, 7)
    np.save(tmp_path / "a.npy", data)
    rasters.register(spark)
    df = spark.read.format("raster").option("block", 3).option("bands", "2").load(f"{tmp_path}/a.npy")
    assert df.columns == ["path", "row", "col", "band_2"] and df.rdd.getNumPartitions() == 6
    assert {(r.row, r.col): r.band_2 for r in df.collect()} == {(r, c): data[1, r, c] for r in range(5) for c in range(7)}
    part = df.select("row", "col", F.col("band_2").alias("v"))
    merged = tables.mosaic([part.filter("row < 3"), part.withColumn("v", F.lit(-1.0))], ["row", "col"])
    assert merged.count() == 35 and merged.filter("row < 3 and v < 0").count() == 0 and merged.filter("row >= 3 and v >= 0").count() == 0


def test_rasters_are_written_by_windows(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 200, size=(2, 2, 7, 9))
    at = f"file://{tmp_path}/out"
    cells = spark.createDataFrame([(t, r, c, *map(int, data[t, :, r, c])) for t in range(2) for r in range(7) for c in range(9) if (t, r, c) != (0, 0, 4)], "tile int, row int, col int, a int, b int")
    rasters.write_rasters(cells, "tile", ["a", "b"], at, block=4, dtype="uint8", fill=255)
    rasters.write_rasters(cells.filter("tile = 1"), "tile", ["a", "b"], at, block=4, dtype="uint8", fill=255)  # a second run
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["0", "1"] and len(list((tmp_path / "out").rglob("*.npy"))) == 12
    data[0, :, 0, 4] = 255
    for source in (at, f"{tmp_path}/out"):
        got = spark.read.format("raster").option("block", 3).load(source).collect()
        assert len(got) == 126 and all((r.band_1, r.band_2) == tuple(data[int(r.path[-1]), :, r.row, r.col]) for r in got)
    with pytest.raises(Exception, match="follow each other"):
        mixed = cells.select(F.col("tile").cast("string"), "row", "col", "a").orderBy("b", "col", "row").coalesce(1)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        mixed.write.format("raster").mode("append").option("block", 4).save(f"{tmp_path}/mixed")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not list((tmp_path / "mixed").rglob("*.npy"))


def _tiff(order, strips, big, apart=False):
    """A small file of strips written by hand: two bands of 5 x 3 cells, 16 bit, plain."""
    cells = np.arange(30, dtype=f"{order}i2").reshape(2, 5, 3)
    planes = [cells[k : k + 1] for k in range(2)] if apart else [cells]
    parts = [np.ascontiguousarray(p[:, r : r + strips].transpose(1, 2, 0)).tobytes() for p in planes for r in range(0, 5, strips)]
    long, many, begin = (("Q", 20, 16) if big else ("I", 12, 8))
    at = np.cumsum([begin, *map(len, parts)]).tolist()
    tags = [(256, 3, [3]), (257, 3, [5]), (258, 3, [16, 16]), (259, 3, [1]), (273, 4, at[:-1]), (277, 3, [2]), (278, 3, [strips]), (279, 4, [len(p) for p in parts]), (284, 3, [2 if apart else 1]), (339, 3, [2, 2])]
    extra_at = at[-1] + (8 if big else 2) + many * len(tags) + (8 if big else 4)
    extra, entries = b"", b""
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        room = many // 2 - 2
        if len(raw) > room:
            value, extra = struct.pack(f"{order}{long}", extra_at + len(extra)), extra + raw
        else:
            value = raw.ljust(room, b"\0")
        entries += struct.pack(f"{order}HH{long}", tag, kind, len(values)) + value
    head = struct.pack(f"{order}HHHQ", 43, 8, 0, at[-1]) if big else struct.pack(f"{order}HI", 42, at[-1])
    return cells, (b"II" if order == "<" else b"MM") + head + b"".join(parts) + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + struct.pack(f"{order}{long}", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("apart", [False, True])
def test_tiff_files_of_strips(order, big, apart):
    for strips in (1, 2, 5):
        cells, raw = _tiff(order, strips, big, apart)
        f = io.BytesIO(raw)
        layout = tiff.read_layout(f)
        assert (layout.bands, layout.height, layout.width) == cells.shape
        assert (tiff.read_window(f, layout, 0, 0, 5, 3, [1, 2]) == cells).all()
        assert (tiff.read_window(f, layout, 1, 1, 3, 2, [2]) == cells[1:, 1:4, 1:]).all()


def test_lzw_codes():
    example = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])  # that of the format's description
    assert tiff.lzw_encoded(example).hex() == "8001e0408044080c068080"
    rng = random.Random(2)
    for n in (0, 1, 2, 600, 70_000):
        for letters in (1, 2, 256):
            raw = bytes(rng.randrange(letters) for _ in range(n))
            assert tiff.lzw_decoded(tiff.lzw_encoded(raw)) == raw


class _Counting(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


@pytest.mark.parametrize("compression", [None, "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32", "float64"])
def test_tiff_blocks(compression, dtype):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 200, (3, 70, 90)).astype(dtype)
    kind = np.dtype(dtype)
    layout = tiff.Layout(70, 90, 3, kind.newbyteorder("<"), (16, 32), rasters.COMPRESSIONS[compression], 1 if compression is None else 3 if kind.kind == "f" else 2, tags={tiff.NO_DATA: (b"7\0",)})
    blocks = []
    for r in range(0, 70, 16):
        for c in range(0, 90, 32):
            part = np.zeros((3, 16, 32), dtype)
            inner = data[:, r : r + 16, c : c + 32]
            part[:, : inner.shape[1], : inner.shape[2]] = inner
            blocks.append(tiff.encoded(part, layout))
    blocks[4] = b""  # isn't stored
    data[:, 16:32, 32:64] = 7
    layout.counts = [len(b) for b in blocks]
    f = _Counting(tiff.header(layout) + b"".join(blocks))
    found = tiff.read_layout(f)
    assert (tiff.read_window(f, found, 0, 0, 70, 90, [1, 2, 3]) == data).all()
    for _ in range(20):
        r, c = int(rng.integers(0, 70)), int(rng.integers(0, 90))
        h, w = int(rng.integers(1, 71 - r)), int(rng.integers(1, 91 - c))
        assert (tiff.read_window(f, found, r, c, h, w, [3, 1]) == data[[2, 0], r : r + h, c : c + w]).all()
    f.bytes_read = 0
    tiff.read_window(f, found, 33, 65, 10, 20, [2])
    assert f.bytes_read == found.counts[2 * 3 + 2]  # its own block only


@pytest.mark.parametrize(("dtype", "compression"), [("float32", "deflate"), ("uint16", "lzw"), ("int16", None)])
def test_geotiffs(spark, tmp_path, dtype, compression):
    rng = np.random.default_rng(6)
    data = rng.integers(0, 1000, (2, 2, 50, 70)).astype(dtype)
    rows = [(t, r, c, *map(float, data[t, :, r, c])) for t in range(2) for r in range(50) for c in range(70) if (t, r, c) != (0, 3, 4) and not (t == 1 and r < 16 and 16 <= c < 32)]
    data[0, :, 3, 4] = data[1, :, :16, 16:32] = 9
    cells = spark.createDataFrame(rows, "t int, row int, col int, a double, b double")
    for _ in range(2):  # a second run replaces the files
        rasters.write_geotiffs(cells, "t", ["a", "b"], f"file://{tmp_path}/out", block=16, dtype=dtype, fill=9, compression=compression, corner=(600_000.0, 6_200_000.0), epsg=2154)
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["0.tif", "1.tif"]
    with open(tmp_path / "out" / "1.tif", "rb") as f:
        layout = tiff.read_layout(f)
    assert layout.tags[tiff.TIE_POINT][3:5] == (600_000.0, 6_200_000.0) and layout.tags[tiff.PIXEL_SCALE][:2] == (10.0, 10.0) and layout.tags[tiff.GEO_KEYS][-1] == 2154
    assert layout.counts[1] == 0 and (layout.height, layout.width, layout.dtype) == (50, 70, np.dtype(dtype))
    rasters.register(spark)
    got = spark.read.format("raster").option("block", 24).load(f"{tmp_path}/out").collect()
    assert len(got) == 7000 and all((r.band_1, r.band_2) == tuple(data[int(r.path[-5]), :, r.row, r.col]) for r in got)
    one = spark.read.format("raster").option("bands", "2").load(f"{tmp_path}/out/0.tif")
    assert one.agg(F.sum("band_2")).first()[0] == data[0, 1].astype(float).sum()


def test_rasters_by_relative_paths(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    np.save("a.npy", np.arange(60.0).reshape(1, 6, 10))
    part = rasters.RasterWindow("a.npy", 2, 3, 2, 4)
    assert (rasters._read(part, [1]) == np.arange(60.0).reshape(1, 6, 10)[:, 2:4, 3:7]).all() and rasters._shape("a.npy") == (1, 6, 10)


def test_feature_files(spark, tmp_path):
    from canopy.operators.harmonic import feature_stack
    from canopy.schemas import BANDS, HARMONIC_FEATURES

    rng = np.random.default_rng(4)
    rows = []
    for t in ("north", "south"):
        (tmp_path / "in" / t).mkdir(parents=True)
        for m in range(1, 13):
            data = rng.integers(200, 6000, size=(6, 3, 5)).astype(np.uint16)
            data[5] = rng.integers(0, 40, size=(3, 5)) * 100
            np.save(tmp_path / "in" / t / f"S2_2023{m:02d}15.npy", data)
            rows += [(t, r, c, f"2023-{m:02d}-15", *map(int, data[:, r, c])) for r in range(3) for c in range(5)]
    series = spark.createDataFrame(rows, "tile string, row int, col int, date string, " + ", ".join(f"{b} int" for b in [*BANDS, "msk_cldprb"])).withColumn("date", F.to_date("date"))
    feature_files.write_features(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", block=2)
    got = {(r.path[-5:], r.row, r.col): [r[f"band_{k}"] for k in range(1, 25)] for r in spark.read.format("raster").load(f"file://{tmp_path}/out").collect()}
    want = {(r.tile, r.row, r.col): [r[f] or 0 for f in HARMONIC_FEATURES] for r in feature_stack(series, ["tile"], ["row", "col"]).collect()}
    assert got == want and len(got) == 30


def test_vectors(spark, tmp_path):
    at = f"file://{tmp_path}"
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, square), (2, [(x + 10, y) for x, y in square]), (3, None)], "k int, ring array<struct<x:double,y:double>>")
    tables.geojson(df.filter("k < 3")).write.text(f"{at}/lines")
    again = vectors.outer_rings(vectors.read_geojson(spark, f"{at}/lines", "k int", lines=True))
    assert {(r.k, r.kind, tuple((p.x, p.y) for p in r.ring)) for r in again.collect()} == {(r.k, "Polygon", tuple((p.x, p.y) for p in r.ring)) for r in df.filter("k < 3").collect()}
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    shell = [*map(list, square), list(square[0])]
    shapes = [("MultiPolygon", [[shell, hole], [shell]]), ("Point", [5, 6]), ("LineString", [[0, 0], [1, 1]]), None]
    made = [{"type": "Feature", "properties": {"k": k}, "geometry": s and {"type": s[0], "coordinates": s[1]}} for k, s in enumerate(shapes)]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": made}))
    (tmp_path / "d.json").write_text(json.dumps(made[1]))
    got = sorted((r.k, r.kind, r.polygons and [len(p) for p in r.polygons], r.x) for r in vectors.read_geojson(spark, f"{at}/[cd].json", "k int").collect())
    assert got == [(0, "MultiPolygon", [2, 1], None), (1, "Point", None, 5.0), (1, "Point", None, 5.0), (2, "LineString", None, None), (3, None, None, None)]
    vectors.write_geoparquet(df, f"{at}/p")
    back = vectors.read_geoparquet(spark, f"{at}/p", where="xmin >= 10 OR k = 3")
    assert back.columns == ["k", "xmin", "ymin", "xmax", "ymax", "kind", "polygons", "x", "y"]
    rows = {r.k: r for r in back.collect()}
    assert set(rows) == {2, 3} and rows[3].polygons is None and len(rows[2].polygons[0][0]) == 5
    ring = vectors.outer_rings(back).withColumn("a", geo.area(F.col("ring"))).first()
    assert (ring.k, ring.a, len(ring.ring)) == (2, 16.0, 4)


def test_wkb_of_other_dimensions():
    import struct

    pack = lambda order, code, *v, form="": struct.pack(f"{order}BI{form}", int(order == "<"), code, *v)
    assert vectors._geometry(pack("<", 1, 1.0, 2.0, form="2d")) == ("Point", None, 1.0, 2.0)
    assert vectors._geometry(pack(">", 1001, 1.0, 2.0, 3.0, form="3d")) == ("Point", None, 1.0, 2.0)
    assert vectors._geometry(pack("<", 0xA0000001, 2154, 1.0, 2.0, 3.0, form="I3d")) == ("Point", None, 1.0, 2.0)
    one = pack(">", 3, 1, 3, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, form="II6d")
    kind, polygons, *_ = vectors._geometry(struct.pack("<BII", 1, 6, 2) + one + one)
    assert kind == "MultiPolygon" and [len(p[0]) for p in polygons] == [3, 3]
    assert vectors._geometry(None)[0] is None and vectors._geometry(b"")[0] is None and vectors._geometry(one[:30])[0] is None


def test_geojson_and_reports(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "k int, ring array<struct<x:double,y:double>>")
    g = json.loads(tables.geojson(df).first().value)
    assert g["properties"] == {"k": 1} and g["geometry"]["coordinates"][0][0] == g["geometry"]["coordinates"][0][-1]
    assert tables.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")).splitlines()[-1] == "| 1 | 0.5000 |"
    assert tables.named_bands(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), ["x"]).columns == ["x", "band_2", "band_3"]


def test_incremental_runs(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, r string").write.parquet(f"{at}/in")
    args = (spark, f"{at}/in", "k int, r string", f"{at}/out", f"{at}/state", "r", ["k"])
    run_available(*args)
    spark.createDataFrame([(3, "b"), (2, "b")], "k int, r string").write.mode("append").parquet(f"{at}/in")
    run_available(*args)
    run_available(*args)
    assert sorted((r.k, r.r) for r in spark.read.parquet(f"{at}/out").collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_a_key_that_moves_or_repeats_stands_once(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    new = lambda *x: spark.createDataFrame(x, "k int, n int, r string")
    merge_partitions(new((1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (None, 1, "b"), (3, 2, "c")), at, "r", ["k"], ["n"])
    assert {(r.k, r.n, r.r) for r in spark.read.parquet(at).collect()} == {(1, 1, "a"), (2, 1, "a"), (3, 2, "c"), (None, 1, "b")}
    for _ in range(2):  # twice is as once
        merge_partitions(new((1, 2, "b"), (3, 3, "a"), (4, 1, None), (5, 1, "x/y z")), at, "r", ["k"], ["n"])
        found = {(r.k, r.n, r.r) for r in spark.read.parquet(at).collect()}
        assert found == {(1, 2, "b"), (2, 1, "a"), (3, 3, "a"), (None, 1, "b"), (4, 1, None), (5, 1, "x/y z")}
    assert "r=c" not in os.listdir(f"{tmp_path}/t")  # its only key went elsewhere
    merge_partitions(new((4, 2, "a"), (5, 2, "a"), (None, 2, "a")), at, "r", ["k"])
    assert {(r.k, r.n, r.r) for r in spark.read.parquet(at).collect()} == {(1, 2, "b"), (2, 1, "a"), (3, 3, "a"), (None, 2, "a"), (4, 2, "a"), (5, 2, "a")}
    merge_partitions(new((7, 1, "q"), (7, 5, "p"), (7, 3, "q")), at, "r", ["k"], ["n"])
    assert [(r.n, r.r) for r in spark.read.parquet(at).filter("k = 7").collect()] == [(5, "p")]


def test_html_reports(spark, tmp_path):
    page = tables.html_report("A & B", {"Counts <1>": spark.createDataFrame([("x<y", 0.123456, None)], "k string, v double, n int")})
    assert "<title>A &amp; B</title>" in page and "<td>x&lt;y</td><td>0.1235</td><td></td>" in page and "<h2>Counts &lt;1&gt;</h2>" in page
    tables.write_text(spark, page, f"file://{tmp_path}/r")
    assert next((tmp_path / "r").glob("part-*")).read_text().strip() == page
