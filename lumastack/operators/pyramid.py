"""Image pyramids, tiles and packed indexes. Rasters hold integers 0 to 255 in r, g, b."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..prefix import running_starts
from ..shared import stored
from .blocks import SIZE, Axis, Block, blockwise

CHANNELS = ("r", "g", "b")
TAPS = [(-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)]  # fixed values: offset and weight of 16


def downsample(raster: DataFrame, width: int, height: int, *, size: int = SIZE // 2) -> DataFrame:
    """Half the size by a separable 1-4-6-4-1 filter; an image with a side below 2 has no half.

    Output i reads the sources 2i - 1 to 2i + 3, clamped; each pass is rounded to 8 bits. Blocks of the half are made of the
    sources that they cover, two more on either side. A source that is missing counts as 0.
    """
    if width < 2 or height < 2:
        return raster.where("false")
    axis = lambda n: Axis.reading(n // 2, size, n, lambda a, b: (2 * a - 1, 2 * b + 3))

    def halved(v: np.ndarray, first: int, out: int, start: int, n: int) -> np.ndarray:
        """Along the last axis; ``first`` is the first output, ``start`` the first source at hand, ``n`` the number of all."""
        at = 2 * np.arange(first, first + out) + 1
        return (sum(w * v[..., np.clip(at + tap, 0, n - 1) - start] for tap, w in TAPS) + 8) // 16

    def kernel(block: Block) -> dict[str, object]:
        out = {}
        for c in CHANNELS:
            rows = halved(block.values[c].astype(np.int64), block.x0, block.w, block.at[0], width)
            out[c] = np.ascontiguousarray(halved(rows.T, block.y0, block.h, block.at[1], height).T).astype(np.int32)
        return block.pixels(out)

    return blockwise(raster, list(CHANNELS), axis(width), axis(height), kernel, "x int, y int, r int, g int, b int")


def level_sizes(width: int, height: int, side: int) -> list[tuple[int, int]]:
    """(width, height) of the levels, smallest first: halved, at least 1, until both sides fit a tile."""
    sizes = [(width, height)]
    while max(sizes[-1]) > side:
        sizes.append(tuple(max(1, v // 2) for v in sizes[-1]))
    return sizes[::-1]


def n_levels(width: int, height: int, side: int) -> int:
    return len(level_sizes(width, height, side))


def pyramid(raster: DataFrame, width: int, height: int, side: int, checkpoint: bool = False) -> DataFrame:
    """(dataset, level, x, y, r, g, b) of all levels, 0 the smallest; each level is a quarter of the next.

    Levels are built one from another; with ``checkpoint`` each is stored in the shared folder.
    """
    sizes = level_sizes(width, height, side)
    now, out = raster.select("dataset", "x", "y", *CHANNELS), None
    for level in range(len(sizes) - 1, -1, -1):
        part = now.select("dataset", F.lit(level).alias("level"), "x", "y", *CHANNELS)
        out = part if out is None else out.unionByName(part)
        if level:
            now = downsample(now, *sizes[level])
            if checkpoint:
                now = stored(now)
    return out


def _touched(v: str, n: int, size: int):
    """Blocks of the half's outputs that read source ``v``: outputs i with 2i - 1 <= v <= 2i + 3, inside n // 2."""
    low = F.greatest(F.lit(0), F.ceil((F.col(v) - 3) / 2)).cast("int")
    high = F.least(F.lit(n // 2 - 1), F.floor((F.col(v) + 1) / 2)).cast("int")
    return F.when(low <= high, F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))).otherwise(F.array().cast("array<int>"))


def refresh_pyramid(pyramids: DataFrame, changed: DataFrame, width: int, height: int, side: int, *, size: int = SIZE // 2) -> tuple[DataFrame, DataFrame]:
    """The pyramid after some pixels of the whole image have changed, and (dataset, level, x, y) of all that differ.

    ``pyramids`` are the stored levels, ``changed`` the new values (dataset, x, y, r, g, b) of pixels that the image has. What
    has changed in a level marks the blocks of the next one that read it; only these are made again, from the sources that
    they read, and of them only pixels with another value mark blocks further on. All else is kept as it is.
    """
    sizes, rows = level_sizes(width, height, side), ["dataset", "x", "y", *CHANNELS]
    block = ["dataset", "_bx", "_by"]
    top = len(sizes) - 1
    before = pyramids.where(F.col("level") == top).select(*rows)
    other = lambda a, b: a.join(b.select("dataset", "x", "y", *(F.col(c).alias("_" + c) for c in CHANNELS)), ["dataset", "x", "y"]).where(" or ".join(f"{c} <> _{c}" for c in CHANNELS)).select(*rows)
    fresh = stored(other(changed.select(*rows), before))
    out, touched = None, None
    for level in range(top, -1, -1):
        now = before.join(fresh, ["dataset", "x", "y"], "left_anti").unionByName(fresh)
        part, marks = now.withColumn("level", F.lit(level)), fresh.select("dataset", F.lit(level).alias("level"), "x", "y")
        out, touched = (part, marks) if out is None else (out.unionByName(part), touched.unionByName(marks))
        if not level:
            break
        w, h = sizes[level]
        spread = lambda df, w=w, h=h: df.withColumn("_bx", F.explode(_touched("x", w, size))).withColumn("_by", F.explode(_touched("y", h, size)))
        dirty = spread(fresh.select("dataset", "x", "y")).select(*block).distinct()
        sources = spread(now).join(dirty, block, "left_semi").select(*rows).distinct()
        own = lambda df: df.withColumns({"_bx": F.floor(F.col("x") / size).cast("int"), "_by": F.floor(F.col("y") / size).cast("int")})
        made = own(downsample(sources, w, h, size=size)).join(dirty, block, "left_semi")
        before = pyramids.where(F.col("level") == level - 1).select(*rows)
        fresh = stored(other(made, before))
    return out.select("dataset", "level", "x", "y", *CHANNELS), touched


def tile_grid(datasets: DataFrame, width: int, height: int, side: int, overlap: int) -> DataFrame:
    """(dataset, plane, level, col, row, x0, y0, w, h) of all tiles of images of one size; no pixel is read."""
    rows = [(level, w, h) for level, (w, h) in enumerate(level_sizes(width, height, side))]
    sizes = datasets.sparkSession.createDataFrame(rows, "level int, lw int, lh int")
    grid = datasets.select("dataset").distinct().join(F.broadcast(sizes))
    grid = grid.withColumn("col", F.explode(F.sequence(F.lit(0), F.floor((F.col("lw") - 1) / side).cast("int")))).withColumn("row", F.explode(F.sequence(F.lit(0), F.floor((F.col("lh") - 1) / side).cast("int"))))
    start = lambda v: F.greatest(F.lit(0), F.col(v) * side - overlap)
    end = lambda v, n: F.least((F.col(v) + 1) * side + overlap, F.col(n))
    return grid.select("dataset", F.lit(0).alias("plane"), "level", "col", "row", start("col").alias("x0"), start("row").alias("y0"), (end("col", "lw") - start("col")).alias("w"), (end("row", "lh") - start("row")).alias("h"))


def cut_tiles(pyramids: DataFrame, width: int, height: int, side: int, overlap: int = 0, *, pad: bool = False) -> DataFrame:
    """Tiles with raw RGB payloads: (dataset, plane, level, col, row, x0, y0, w, h, payload).

    With ``pad`` all tiles are side x side and black beyond the image, as TIFF wants them (use ``tiff_side``).
    """
    out, schema = None, "col int, row int, x0 int, y0 int, w int, h int, payload binary"
    for level, (lw, lh) in enumerate(level_sizes(width, height, side)):
        axis = lambda n: Axis.near(n, side, overlap)

        def kernel(block: Block) -> dict[str, object]:
            down, across = block.known.shape
            image = np.zeros((side, side, 3) if pad else (down, across, 3), np.uint8)
            image[:down, :across] = np.stack([block.values[c] for c in CHANNELS], axis=2)
            return {"col": [block.col], "row": [block.row], "x0": [block.at[0]], "y0": [block.at[1]], "w": [across], "h": [down], "payload": [image.tobytes()]}

        part = blockwise(pyramids.where(F.col("level") == level), list(CHANNELS), axis(lw), axis(lh), kernel, schema).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out.select("dataset", F.lit(0).alias("plane"), "level", "col", "row", "x0", "y0", "w", "h", "payload")


def tiff_side(side: int) -> int:
    """A tile side as TIFF wants it: a multiple of 16."""
    return -(-side // 16) * 16


def cut_tiles_padded(pyramids: DataFrame, width: int, height: int, side: int) -> DataFrame:
    return cut_tiles(pyramids, width, height, tiff_side(side), 0, pad=True)


def tile_paths(tiles: DataFrame, layout: str, *, from_smallest: bool = True) -> DataFrame:
    """Tiles with their ``path`` in a layout: deepzoom, google or zoomify (numbered from the smallest level)."""
    if layout == "deepzoom":
        return tiles.withColumn("path", F.format_string("%d/%d_%d.jpg", "level", "col", "row"))
    if layout == "google":
        return tiles.withColumn("path", F.format_string("%d/%d/%d.jpg", "level", "row", "col"))
    ranked = tiles.withColumns({"_level": F.col("level") if from_smallest else -F.col("level"), "_one": F.lit(1).cast("long")})
    ranked = running_starts(ranked, ["dataset", "plane", "_level", "row", "col"], {"_at": "_one"})
    first = ranked.groupBy("dataset", "plane").agg(F.min("_at").alias("_first"))
    numbered = ranked.join(F.broadcast(first), ["dataset", "plane"])
    return numbered.withColumn("path", F.format_string("TileGroup%d/%d-%d-%d.jpg", F.floor((F.col("_at") - F.col("_first")) / 256).cast("int"), "level", "col", "row")).drop("_level", "_one", "_at", "_first")


def pack_index(tiles: DataFrame, size: str = "size") -> DataFrame:
    """The index of a packed archive: tiles by level, row, column with running offsets, (dataset, plane, seq, ..., offset, size)."""
    rows = tiles.select("dataset", "plane", "level", "col", "row", F.col(size).cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    rows = running_starts(rows, ["dataset", "plane", "level", "row", "col"], {"offset": "size", "seq": "one"})
    first = rows.groupBy("dataset", "plane").agg(F.min("offset").alias("o"), F.min("seq").alias("s"))
    rows = rows.join(first, ["dataset", "plane"])
    return rows.select("dataset", "plane", (F.col("seq") - F.col("s")).alias("seq"), "level", "col", "row", (F.col("offset") - F.col("o")).alias("offset"), "size")


def interleave_index(index: DataFrame) -> DataFrame:
    """The planes of an index in one archive, tile by tile: (dataset, seq, plane, stride, offset, size)."""
    rows = running_starts(index.select("dataset", "seq", "plane", "size"), ["dataset", "seq", "plane"], {"offset": "size"})
    facts = rows.groupBy("dataset").agg(F.count_distinct("plane").alias("stride"), F.min("offset").alias("o"))
    return rows.join(facts, "dataset").select("dataset", "seq", "plane", (F.col("offset") - F.col("o")).alias("offset"), "size", "stride")


def pyramid_metadata(tiles: DataFrame, width: int, height: int, side: int, overlap: int, fmt: str = "jpg") -> DataFrame:
    """(dataset, n_tiles, n_levels, dzi, zoomify, tzi): the descriptions of a pyramid in three layouts."""
    got = tiles.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_tiles"), F.count_distinct("level").alias("n_levels"))
    dzi = F.lit(f'<Image TileSize="{side}" Overlap="{overlap}" Format="{fmt}"><Size Width="{width}" Height="{height}"/></Image>')
    zoom = F.format_string(f'<IMAGE_PROPERTIES WIDTH="{width}" HEIGHT="{height}" NUMTILES="%d" NUMIMAGES="1" VERSION="1.8" TILESIZE="{side}"/>', "n_tiles")
    fixed = {"tilesize": side, "overlap": overlap, "format": fmt, "width": width, "height": height}
    tzi = F.concat(F.lit(json.dumps(fixed, separators=(",", ":"))[:-1] + ',"nlevels":'), F.col("n_levels").cast("string"), F.lit("}"))
    return got.select("dataset", "n_tiles", "n_levels", dzi.alias("dzi"), zoom.alias("zoomify"), tzi.alias("tzi"))


def stack_planes(raster: DataFrame, height: int) -> DataFrame:
    """Planes (dataset, plane, x, y, ...) one below the other."""
    return raster.withColumn("y", (F.col("y") + F.col("plane") * height).cast("int"))
