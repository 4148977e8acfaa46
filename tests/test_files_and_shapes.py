"""Readers, sinks, streams, curves and partitions: small cases by hand, and queries against DuckDB."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselark.operators import community as M
from tesselark.operators import curves as R
from tesselark.plans import catalog, files, shapes, views
from tesselark.sources import readers, sinks
from tesselark.sources.files import platform, repeats


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


NAMES = [n for m in (files, shapes) for n in vars(m) if n in catalog.SQL]


@pytest.mark.parametrize("name", NAMES)
def test_queries_agree_with_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    value = lambda v: None if v != v else round(v, 4) + 0.0 if isinstance(v, float) else v
    key = lambda df: sorted((tuple(map(value, r)) for r in df[cols].itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_matrix_market_with_a_corner_like_its_sizes(spark, tmp_path):
    rows = [("b1", "f1", 1.0), ("b2", "f1", 5.0), ("b2", "f2", 3.0)]
    sinks.write_matrix_market(spark.createDataFrame(rows, "barcode string, feature string, n double"), str(tmp_path / "m"))
    assert sorted(tuple(r) for r in readers.matrix_market(spark, str(tmp_path / "m")).select("barcode", "feature", "n").collect()) == rows
    assert sorted(os.listdir(tmp_path / "m"))[-3:] == ["barcodes.tsv", "features.tsv", "matrix.mtx"]
    some = spark.createDataFrame([("b2",)], "barcode string")
    assert readers.matrix_market(spark, str(tmp_path / "m"), some).count() == 2


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"{'name' * (k % 7)}{k}" if k % 50 else "" for k in range(1000)]
    (tmp_path / "names.tsv").write_bytes("".join(v + ("\r\n" if k % 3 else "\n") for k, v in enumerate(lines)).encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(kept, ("700b", "1b")):
            spark.conf.set(k, v)
        found = readers.numbered_lines(spark, str(tmp_path / "names.tsv"))
        assert found.rdd.getNumPartitions() > 10 and sorted(map(tuple, found.collect())) == list(enumerate(lines))
        rows = [(f"b{k % 90:02}", f"f{k % 7}", float(k)) for k in range(1, 500)]
        sinks.write_matrix_market(spark.createDataFrame(rows, "barcode string, feature string, n double"), str(tmp_path / "m"))
        assert sorted(map(tuple, readers.matrix_market(spark, str(tmp_path / "m")).collect())) == sorted((b, f, sum(n for c, g, n in rows if (b, f) == (c, g))) for b, f in {r[:2] for r in rows})
        names = (tmp_path / "m" / "barcodes.tsv").read_text().splitlines()
        assert names == sorted(names) and len(names) == 90
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    sinks.write_matrix_market(spark.createDataFrame([], "barcode string, feature string, n double"), str(tmp_path / "e"))
    assert readers.matrix_market(spark, str(tmp_path / "e")).count() == 0


def test_cells_of_a_wide_file_are_counted_once(spark, sf_dir, monkeypatch):
    made, make = [], views.cells
    monkeypatch.setattr(views, "cells", lambda s, d: made.append(0) or make(s, d).withColumn("n", F.col("n") + 0 * counted(F.col("n"))))
    calls = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda n: calls.add(1) or 0, "long")
    rows = catalog.QUERIES["file_wide_counts"](spark, sf_dir).count()
    assert len(made) == 1 and calls.value == rows  # not again for the known cells, nor for the names of columns


def test_spot_counts_are_read_once(spark, sf_dir):
    sample = files._spot_sample(spark, sf_dir)
    assert all("spot_counts" in p for p in [*sample.counts.inputFiles(), *sample.weights.inputFiles()])
    assert sample.weights.count() > 0


def test_layouts(spark, tmp_path):
    for name in ("v/spatial", "v/filtered_feature_bc_matrix", "x/transcripts.parquet", "c/flatFiles", "r/rep2", "r/rep10"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "c/flatFiles/s_tx_file.csv").write_text("fov,x_global_px,y_global_px,target\n1,10,20,g\n1,,5,g\n")
    for k in (2, 10):
        (tmp_path / f"r/rep{k}/edges.tsv").write_text("gene_a\tgene_b\tweight\na\tb\t1\n")
    assert [platform(spark, str(tmp_path / k))["platform"] for k in "vxc"] == ["visium", "xenium", "cosmx"]
    with pytest.raises(ValueError):
        platform(spark, str(tmp_path / "r"))
    assert [n for n, _ in repeats(spark, str(tmp_path / "r"), "edges.tsv")] == [2, 10]
    m = readers.field_molecules(spark, platform(spark, str(tmp_path / "c"))["molecules"]).collect()
    assert [(round(r.x, 3), r.feature, r.qv, r.nucleus_distance) for r in m] == [(1.203, "g", float("inf"), 0.0)]


def test_outline(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("# a\nX,Y\n0,0\n0,0\n4,0\n4,4\n")
    assert readers.outline(spark, str(p)) == [(0, 0), (4, 0), (4, 4), (0, 0)]
    p.write_text("X,Y\n0,0\n4,0\n")
    with pytest.raises(ValueError):
        readers.outline(spark, str(p))


def test_module_numbers(spark):
    d = spark.createDataFrame([(" 7",), ("mod12",), ("x",), (None,), ("-1",)], "m string")
    assert [r[0] for r in d.select(readers.module_number("m")).collect()] == [7, 12, None, None, -1]


def test_coordinates_either_way(spark, tmp_path):
    rows = [("c1", "g1", 2.0), ("c1", "g1", 1.0), ("c2", "g2", 4.0), ("c3", "g1", 0.0), (None, "g1", 3.0), ("c2", None, 3.0), ("c2", "g3", None)]
    cells = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "barcode string")
    for k, names in enumerate((["Barcode", "gene", "count"], ["i", "j", "x"])):
        path = str(tmp_path / str(k))
        spark.createDataFrame(rows, "u string, v string, w double").toDF(*names).write.parquet(path)
        assert sorted(map(tuple, readers.coordinates(spark, path, cells).collect())) == [("c1", "g1", 3.0), ("c2", "g2", 4.0)]


def test_images_and_their_pixels(spark, tmp_path):
    import struct

    from tesselark.sources import readers

    head = lambda w, h: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02"
    (tmp_path / "hires.png").write_bytes(head(2000, 70_000))
    (tmp_path / "lowres.png").write_bytes(head(600, 480))
    (tmp_path / "broken.png").write_bytes(b"GIF89a")
    (tmp_path / "empty.png").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in readers.image_headers(spark, str(tmp_path / "*.png")).collect()}
    assert got == {"hires.png": (2000, 70_000), "lowres.png": (600, 480)}
    pts = spark.createDataFrame([(1, 20.0, 30.0), (2, 20.0, 900.0), (3, None, 1.0), (4, 10.0, 10.0)], "id int, x double, y double")
    top = {r.id: (r.px, r.py) for r in readers.image_window(pts, 100, 50, 0.5, 20, 20).collect()}
    below = {r.id: (r.px, r.py) for r in readers.image_window(pts, 100, 50, 0.5, 20, 20, from_top=False).collect()}
    assert top == {1: (20.0, 40.0), 4: (0.0, 0.0)} and below == {1: (20.0, 10.0), 4: (0.0, 50.0)}


def test_counts_of_known_cells(spark):
    from tesselark.sources import readers

    counts = spark.createDataFrame([("a", "p", 1), ("a", "NegPrb1", 2), ("b", "p", 3), (None, "p", 4), ("a", "q", 5)], "cell string, feature string, n int")
    cells = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("c", 1.0), (None, 1.0)], "cell string, x double")
    rows = lambda df: sorted((r.cell, r.feature, r.n) for r in df.collect())
    assert rows(readers.cell_counts(counts, cells)) == [("a", "NegPrb1", 2), ("a", "p", 1), ("a", "q", 5)]
    assert rows(readers.cell_counts(counts, cells, ["p", "NegPrb1"], "^NegPrb")) == [("a", "p", 1)]
    assert rows(readers.cell_counts(counts, cells.limit(0))) == []
