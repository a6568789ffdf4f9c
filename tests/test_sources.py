import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutgrove.sources import graph_files, volumes


def test_mesh_edge_list_and_graph_round_trip(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack("<iid", *r) for r in [(0, 1, 0.5), (1, 2, 0.25)]))
    df = graph_files.read_mesh(spark, str(tmp_path / "a.bin"))
    assert sorted(map(tuple, df.collect())) == [(0, 1, 0.5), (1, 2, 0.25)]
    graph_files.save_graph(df, str(tmp_path / "g"))
    assert graph_files.load_graph(spark, str(tmp_path / "g")).count() == 2
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception):
        graph_files.read_mesh(spark, str(tmp_path / "bad.bin")).collect()


def test_cutouts(spark):
    v = spark.range(27).selectExpr("id % 3 x", "id div 3 % 3 y", "id div 9 z", "id seg")
    assert volumes.cutout(v, (0, 2, 0, 2, 1, 2)).count() == 4
    inverse = volumes.inverse_cutout(v, (0, 2, 0, 2, 1, 2))
    assert inverse.count() == 27 and inverse.filter("seg = 0").count() == 4


def test_slices_to_files_and_back(spark, tmp_path):
    from cutgrove.sources import rasters

    df = spark.range(60).selectExpr("id % 5 x", "(id div 5) % 4 y", "id div 20 z", "cast(id * 3 - 7 as double) value")
    want = sorted(map(tuple, df.collect()))
    for suffix in ("tif", "parquet", "csv"):
        path = f"{tmp_path}/volume.{suffix}"
        rasters.save(df, path)
        assert sorted(map(tuple, rasters.load(spark, path).select("x", "y", "z", "value").collect())) == want
    grey = df.withColumn("value", F.abs("value"))
    rasters.save(grey, f"{tmp_path}/volume.pgm")
    assert sorted(map(tuple, rasters.load(spark, f"{tmp_path}/volume.pgm").select("x", "y", "z", "value").collect())) == sorted(map(tuple, grey.collect()))


def test_image_codecs():
    from cutgrove.sources import rasters

    for dtype in ("u1", "<u2", "<i4", "<f4", "<f8"):
        pages = [np.arange(12).reshape(3, 4).astype(dtype), np.arange(10).reshape(2, 5).astype(dtype)]
        got = rasters.decode_tiff(rasters.encode_tiff(pages))
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(got, pages)) and len(got) == 2
    colour = np.arange(24).reshape(2, 4, 3).astype("u1")
    assert np.array_equal(rasters.decode_pnm(rasters.encode_pnm([colour]))[0], colour)
    assert rasters.decode_pnm(b"P2 # text\n2 2\n9\n1 2\n3 4\n")[0].tolist() == [[1, 2], [3, 4]]
    for bad in (rasters.decode_tiff, rasters.decode_pnm):
        with pytest.raises(ValueError):
            bad(b"nothing of the kind")


def test_catalogue_and_cache(spark, tmp_path):
    from cutgrove.sources import catalog

    c = catalog.Catalogue(spark, str(tmp_path))
    assert c.names() == []
    c.add("a", x=1)
    with pytest.raises(ValueError):
        c.add("a", x=2)
    c.update("a", y="t")
    assert catalog.Catalogue(spark, str(tmp_path)).get("a") == {"x": "1", "y": "t"}
    c.remove("a")
    with pytest.raises(KeyError):
        c.get("a")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for sigma in (1.6, 1.6, 4.2):
        assert catalog.cached(spark, str(tmp_path), "f", {"sigma": sigma}, build).count() == 3
    assert len(calls) == 2


def test_input_numbers_and_parameters(spark):
    from cutgrove.sources import volumes

    df = spark.createDataFrame([(1, 2)], "raw long, pm long")
    assert df.select(volumes.input_channel(df, 1, ("raw", "pm"))).first()[0] == 2.0
    with pytest.raises(IndexError):
        volumes.input_channel(df, 2, ("raw", "pm"))
    with pytest.raises(ValueError):
        volumes.parameters(spark, ignore_gt=(-1,))
