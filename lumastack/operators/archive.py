"""Packed tile archives: the bodies of tiles in few files, an index by byte, and reads of single tiles.

An archive holds the tiles of a plane (or, interleaved, of all planes of a dataset, tile by tile) in the order of its index.
It is cut into parts of about ``part_bytes``, each written by one task through Spark's committing writer, so a lost task
leaves nothing half written; a line end closes each body. The index is a table beside them: it tells a tile's place in the
archive without line ends, as ``pack_index`` does, and its part and the byte there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..prefix import running_starts
from ..shared import removed, shared_dir, stored

KEYS = ["dataset", "plane", "level", "col", "row"]


def write_archive(tiles: DataFrame, path: str, *, interleaved: bool = False, part_bytes: int = 64 << 20) -> DataFrame:
    """Write tiles (dataset, plane, level, col, row, payload) below ``path``, and give their index.

    (archive, dataset, plane, level, col, row, seq, offset, size, part, at): ``archive`` is a number of the dataset and plane
    (or of the dataset), ``at`` the first byte in the part's file.
    """
    spark, kept = tiles.sparkSession, shared_dir(tiles.sparkSession)
    owner = ["dataset"] if interleaved else ["dataset", "plane"]
    order = [*owner, "level", "row", "col", *([] if "plane" in owner else ["plane"])]
    bodies = stored(tiles.select(*KEYS, F.xxhash64(*owner).alias("archive"), F.coalesce("payload", F.lit(b"")).alias("payload")), kept)
    rows = bodies.select("archive", *KEYS, F.length("payload").cast("long").alias("size")).withColumns({"_one": F.lit(1).cast("long"), "_closed": F.col("size") + 1})
    rows = running_starts(rows, order, {"offset": "size", "seq": "_one", "_byte": "_closed"})
    first = rows.groupBy("archive").agg(F.min("offset").alias("_o"), F.min("seq").alias("_s"), F.min("_byte").alias("_b"))
    rows = rows.join(first, "archive").withColumns({"offset": F.col("offset") - F.col("_o"), "seq": F.col("seq") - F.col("_s"), "_byte": F.col("_byte") - F.col("_b")})
    rows = rows.withColumn("part", F.expr(f"cast(_byte div {part_bytes} as int)"))
    begins = rows.groupBy("archive", "part").agg(F.min("_byte").alias("_begin"))
    rows = rows.join(begins, ["archive", "part"]).select("archive", *KEYS, "seq", "offset", "size", "part", (F.col("_byte") - F.col("_begin")).alias("at"))
    rows.write.mode("overwrite").parquet(f"{path}/index")
    index = spark.read.schema(rows.schema).parquet(f"{path}/index")
    placed = bodies.join(index.select("archive", *KEYS, "part", "seq"), ["archive", *KEYS])
    placed = placed.repartition("archive", "part").sortWithinPartitions("archive", "part", "seq")
    placed.select("archive", "part", F.col("payload").cast("string").alias("value")).write.mode("overwrite").partitionBy("archive", "part").text(f"{path}/bodies")
    removed(spark, kept)
    return index


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of an archive folder: (dataset, plane, level, col, row, seq, payload). Parts are cut inside their rows."""
    index = spark.read.parquet(f"{path}/index")
    cuts = index.groupBy("archive", "part").agg(F.collect_list(F.struct(*KEYS, "seq", "at", "size")).alias("cuts"))
    files = spark.read.format("binaryFile").load(f"{path}/bodies/*/*/part-*")
    number = lambda k, t: F.regexp_extract("path", rf"/{k}=(-?\d+)/", 1).cast(t).alias(k)
    parts = files.select(number("archive", "long"), number("part", "int"), "content").join(cuts, ["archive", "part"])
    body = F.transform("cuts", lambda e: F.struct(*(e[k].alias(k) for k in (*KEYS, "seq")), F.substring(F.col("content"), e["at"].cast("int") + 1, e["size"].cast("int")).alias("payload")))
    return parts.select(F.explode(body).alias("t")).select("t.*")


def fetch_tile(spark: SparkSession, path: str, dataset: str, plane: int, level: int, col: int, row: int) -> bytes | None:
    """One tile, read by its byte range; None if the archive has none there. The index is filtered in its files, one range is read."""
    here = (F.col("dataset") == dataset) & (F.col("plane") == plane) & (F.col("level") == level) & (F.col("col") == col) & (F.col("row") == row)
    found = spark.read.parquet(f"{path}/index").where(here).select("archive", "part", "at", "size").head()
    if found is None:
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bodies/archive={found['archive']}/part={found['part']}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    (file,) = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")]
    stream = store.open(file)
    try:
        stream.seek(int(found["at"]))
        return bytes(stream.readNBytes(int(found["size"])))
    finally:
        stream.close()
