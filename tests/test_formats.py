"""Documents as Spark data sources: pushed filters open fewer files, and all formats equal the readers' tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThan, StringContains
from pyspark.sql.types import StructType

from lumastack.sources import documents, formats, images


@pytest.fixture
def folder(tmp_path, spark):
    formats.register(spark)
    for name, rows in (("a", ["my photo.jpg 0 0 2", "p 3 0 4"]), ("b.c", ["q 1 1 1"])):
        (tmp_path / f"{name}.lp").write_text("\n".join([str(len(rows)), *rows]))
    (tmp_path / "dataset=z").mkdir()
    (tmp_path / "dataset=z" / "part-0.txt").write_text("1\nz 0 1 0\n")
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


def test_light_lists(spark, folder):
    df = spark.read.format("light_list").load(f"file://{folder}")
    assert df.columns == ["dataset", "light_id", "filename", "lx", "ly", "lz"]
    got = sorted(map(tuple, df.collect()))
    assert [r[:3] for r in got] == [("a", 0, "my photo.jpg"), ("a", 1, "p"), ("b.c", 0, "q"), ("z", 0, "z")]
    assert got[1][3:] == (0.6, 0.0, 0.8)
    single = spark.read.format("light_list").load(f"{folder}/a.lp")
    assert sorted(map(str, documents.read_lp(spark, f"file://{folder}/a.lp").collect())) == sorted(map(str, single.collect()))


def test_pushed_filters_open_fewer_files(spark, folder):
    (folder / "broken.lp").write_text("9\nno\n")
    df = spark.read.format("light_list").load(str(folder))
    with pytest.raises(Exception, match="broken.lp"):
        df.collect()
    assert df.where("dataset = 'a' and light_id > 0").select("filename").collect()[0][0] == "p"  # the broken file stays closed
    assert df.where(F.col("dataset").isin("a", "z")).count() == 3
    assert df.where("dataset = 'nobody'").count() == 0
    assert spark.read.format("light_list").option("strict", "false").load(str(folder)).count() == 4


def test_partitions_by_files(folder):
    read = lambda **o: formats._LightList(StructType.fromDDL(formats.LightLists.fields), {"path": str(folder), **o})
    assert [len(p.files) for p in read().partitions()] == [3]
    assert [len(p.files) for p in read(partitionBytes="1").partitions()] == [1, 1, 1]
    r = read()
    left = list(r.pushFilters([EqualTo(("dataset",), "a"), LessThan(("light_id",), 1), StringContains(("filename",), "x"), In(("dataset",), ("a", "b.c"))]))
    assert left == [StringContains(("filename",), "x")]
    assert [n for p in r.partitions() for n, _ in p.files] == ["a"]
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 1


def test_json_documents(spark, tmp_path):
    formats.register(spark)
    dome = {"lightConfiguration": "spherical", "directions": [{"x": 0, "y": 0, "z": 1}, {"x": 1, "y": 0, "z": 0}], "positionsSphere": [{"x": 5, "y": 6, "z": 7}]}
    project = {"images": [{"filename": "i", "skip": True}, {"filename": "j", "visible": False}]}
    for kind, doc in (("domes", dome), ("projects", project), ("headers", {"lights": [0, 0, 1, 1, 0, 0]})):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "d.json").write_text(json.dumps(doc))
    load = lambda name, at: sorted(map(tuple, spark.read.format(name).load(f"{tmp_path}/{at}").collect()))
    assert load("dome_lights", "domes") == [("d", 0, 0.0, 0.0, 1.0, 5.0, 6.0, 7.0), ("d", 1, 1.0, 0.0, 0.0, None, None, None)]
    assert load("project_images", "projects") == [("d", 0, "i", True, True), ("d", 1, "j", False, False)]
    assert load("header_lights", "headers") == [("d", 0, 0.0, 0.0, 1.0), ("d", 1, 1.0, 0.0, 0.0)]


def test_legacy_files(spark, tmp_path):
    formats.register(spark)
    q = np.random.default_rng(1).integers(0, 256, (3, 4, 18))
    rows = spark.createDataFrame([("d", x, y, q[y, x].tolist()) for y in range(3) for x in range(4)], "dataset string, x int, y int, q array<int>")
    head = spark.createDataFrame([("d", 4, 3, [1.0] * 6, [0.0] * 6)], "dataset string, width int, height int, scale array<double>, bias array<double>")
    (tmp_path / "d.ptm").write_bytes(images.write_legacy(rows, head, "ptm").first()["content"])
    got = spark.read.format("legacy_planes").load(str(tmp_path)).where("y = 1").collect()
    assert {(r["x"], r["y"]): r["q"] for r in got} == {(x, 1): q[1, x].tolist() for x in range(4)}


@pytest.mark.parametrize("fmt", ["ptm", "hsh"])
def test_legacy_files_in_pieces(spark, fmt):
    """No row holds a whole file, and pieces are read wherever they are cut."""
    q = np.random.default_rng(2).integers(0, 256, (7, 5, 18))
    rows = spark.createDataFrame([("d", x, y, q[y, x].tolist()) for y in range(7) for x in range(5)], "dataset string, x int, y int, q array<int>").repartition(3)
    head = spark.createDataFrame([("d", 5, 7, [1.0 + i for i in range(6)], [i / 255 for i in range(6)])], "dataset string, width int, height int, scale array<double>, bias array<double>")
    pieces = images.legacy_pieces(rows, head, fmt, band=10)
    made = sorted((r["at"], bytes(r["content"])) for r in pieces.collect())
    assert len(made) == (13 if fmt == "ptm" else 5) and max(len(c) for _, c in made[1:]) <= 10 * 18
    data = bytes(images.write_legacy(rows, head, fmt).first()["content"])
    assert data == b"".join(c for _, c in made) and (images.parse_legacy("d", data)[1] == q).all()
    cuts = [0, len(made[0][1]) + 3, *range(len(made[0][1]) + 50, len(data), 71), len(data)]
    again = spark.createDataFrame([("d", a, data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "dataset string, at long, content binary")
    for table in (pieces, again):
        found, px = images.legacy_piece_tables(table, band=15)
        assert found.first()["scale"] == [1.0 + i for i in range(6)]
        got = {(r["x"], r["y"]): r["q"] for r in px.collect()}
        assert got == {(x, y): q[y, x].tolist() for y in range(7) for x in range(5)}
