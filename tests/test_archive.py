"""Packed archives: bodies come back whole, and one tile is read by its range."""

import random

import pytest

from lumastack.operators import archive, pyramid

SCHEMA = "dataset string, plane int, level int, col int, row int, payload binary"


@pytest.fixture(scope="module")
def tiles(spark):
    rng = random.Random(2)
    rows = [(d, p, level, c, r, rng.randbytes(rng.randint(0, 400)) + b"\n\x00\xff"[: rng.randint(0, 3)]) for d in ("a b/c", "7") for p in range(3) for level in range(2) for c in range(5) for r in range(4)]
    rows.append(("a b/c", 0, 9, 0, 0, None))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("interleaved", [False, True])
@pytest.mark.parametrize("part_bytes", [700, 1 << 20])
def test_archives(spark, tiles, tmp_path, interleaved, part_bytes):
    rows, df = tiles
    path = f"file://{tmp_path}/x"
    index = archive.write_archive(df, path, interleaved=interleaved, part_bytes=part_bytes).collect()
    want = {r[:5]: r[5] or b"" for r in rows}
    got = {tuple(r[:5]): bytes(r["payload"]) for r in archive.read_archive(spark, path).collect()}
    assert got == want
    for owner in {r["archive"] for r in index}:
        own = sorted((r for r in index if r["archive"] == owner), key=lambda r: r["seq"])
        assert [r["seq"] for r in own] == list(range(len(own)))
        place = lambda r: (r["level"], r["row"], r["col"], r["plane"]) if interleaved else (r["level"], r["row"], r["col"])
        assert own == sorted(own, key=place)
        offset = 0
        for r in own:
            assert r["offset"] == offset and r["size"] == len(want[r["dataset"], r["plane"], r["level"], r["col"], r["row"]])
            offset += r["size"]
    for key in random.Random(1).sample(sorted(want), 3):
        assert archive.fetch_tile(spark, path, *key) == want[key]
    assert archive.fetch_tile(spark, path, "nobody", 0, 0, 0, 0) is None


def test_a_tile_is_a_small_part_of_its_file(spark, tmp_path):
    raster = spark.range(120 * 90).selectExpr("'d' AS dataset", "cast(id % 120 AS int) AS x", "cast(id div 120 AS int) AS y", "cast(id % 251 AS int) AS r", "cast(id % 13 AS int) AS g", "7 AS b")
    tiles = pyramid.cut_tiles(pyramid.pyramid(raster, 120, 90, 8), 120, 90, 8, 1)
    path = f"file://{tmp_path}/x"
    index = archive.write_archive(tiles, path).collect()
    total = sum(r["size"] for r in index)
    assert max(r["size"] for r in index) < total / 100
    body = archive.fetch_tile(spark, path, "d", 0, 3, 2, 1)
    assert body == bytes(tiles.where("level = 3 and col = 2 and row = 1").first()["payload"])


def test_an_empty_archive(spark, tiles, tmp_path):
    path = f"file://{tmp_path}/x"
    assert archive.write_archive(tiles[1].limit(0), path).count() == 0
