"""Readers and writers of light lists, domes, projects and dataset headers. A document is a dataset, named by its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def _dataset() -> Column:
    """What a folder ``dataset=...`` says, as the writers make it, else the file's name without its ending."""
    path = F.input_file_name()
    folder = F.regexp_extract(path, r"/dataset=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))



def parse_lp(texts: DataFrame, *, strict: bool = True) -> DataFrame:
    """Rows (dataset, text) of light lists to (dataset, light_id, filename, lx, ly, lz) with unit directions.

    The first line is a count of 1 to 1000; each line's last three words are numbers, what precedes is the file name. A bad
    count, line, number or a direction shorter than 1e-4 is an error, or with ``strict=False`` drops the document or line.
    """
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = texts.select("dataset", lines.alias("lines")).withColumn("n", F.try_element_at("lines", F.lit(1)).try_cast("int"))
    good = F.coalesce((F.col("n") >= 1) & (F.col("n") <= 1000) & (F.size("lines") > F.col("n")), F.lit(False))
    if strict:
        rows = rows.withColumn("n", F.when(good, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("bad light count in "), F.col("dataset"))).cast("int")))
    else:
        rows = rows.where(good)
    rows = rows.select("dataset", F.posexplode(F.slice("lines", F.lit(2), F.col("n"))).alias("light_id", "line"))
    words = F.split("line", r"\s+")
    number = lambda k: F.try_element_at(words, F.lit(-k)).try_cast("double")
    rows = rows.select("dataset", "light_id", F.regexp_extract("line", r"^(.*?)\s+\S+\s+\S+\s+\S+$", 1).alias("filename"), number(3).alias("x"), number(2).alias("y"), number(1).alias("z"))
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    fine = F.coalesce((n >= 1e-4) & (F.col("filename") != ""), F.lit(False))
    if not strict:
        rows = rows.where(fine)
    at = lambda c: F.when(fine, F.col(c) / n).otherwise(F.raise_error(F.concat(F.lit("bad light in "), F.col("dataset"), F.lit(" at "), F.col("light_id").cast("string"))).cast("double"))
    return rows.select("dataset", "light_id", "filename", at("x").alias("lx"), at("y").alias("ly"), at("z").alias("lz"))


def read_lp(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Light lists at ``path``, a dataset a file."""
    texts = spark.read.text(path, wholetext=True).select(_dataset().alias("dataset"), F.col("value").alias("text"))
    return parse_lp(texts, strict=strict)


def lp_texts(lights: DataFrame) -> DataFrame:
    """(dataset, text) of lights (dataset, light_id, filename, lx, ly, lz); a zero direction is an error. At most 1000 lights a dataset."""
    zero = (F.col("lx") == 0) & (F.col("ly") == 0) & (F.col("lz") == 0)
    line = F.when(zero, F.raise_error(F.lit("a light has no direction")).cast("string")).otherwise(F.concat_ws(" ", "filename", "lx", "ly", "lz"))
    rows = lights.withColumn("line", line).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("light_id", "line"))).alias("l"))
    return rows.select("dataset", F.concat_ws("\n", F.concat(F.array(F.size("l").cast("string")), F.transform("l", lambda e: e["line"]))).alias("text"))


def write_lp(lights: DataFrame, path: str) -> None:
    """Write light lists, a folder ``dataset=...`` each."""
    lp_texts(lights).withColumnRenamed("text", "value").write.mode("overwrite").partitionBy("dataset").text(path)


def domes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dome rows to (domes, lights); an unknown configuration counts as directional."""
    kind = F.when(F.col("lightConfiguration").isin("directional", "spherical", "lights3d"), F.col("lightConfiguration")).otherwise("directional")
    docs = docs.withColumn("lightConfiguration", kind)
    vectors = "array<struct<x:double,y:double,z:double>>"
    lists = F.arrays_zip(*(F.coalesce(c, F.array().cast(vectors)).alias(c) for c in ("directions", "positionsSphere", "positions3d")))
    rows = docs.select("dataset", "lightConfiguration", F.posexplode(lists).alias("light_id", "e"))
    position = F.when(F.col("lightConfiguration") == "spherical", F.col("e.positionsSphere")).when(F.col("lightConfiguration") == "lights3d", F.col("e.positions3d"))
    rows = rows.withColumn("p", position)
    lights = rows.select("dataset", "light_id", *(F.col(f"e.directions.{k}").alias(f"l{k}") for k in "xyz"), *(F.col(f"p.{k}").alias(f"p{k}") for k in "xyz"))
    return docs.select("dataset", "label", "notes", "imageWidth", "domeDiameter", "verticalOffset", "lightConfiguration"), lights


def parse_dome(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (dataset, text) of dome documents."""
    return domes_of(texts.select("dataset", F.from_json("text", schema.DOME).alias("d")).select("dataset", "d.*"))


def read_dome(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return domes_of(spark.read.json(path, schema=schema.DOME, multiLine=True).withColumn("dataset", _dataset()))


def dome_texts(domes: DataFrame, lights: DataFrame) -> DataFrame:
    """(dataset, text) of dome documents."""
    vec = lambda a: F.struct(*(F.col(f"{a}{k}").alias(k) for k in "xyz"))
    rows = lights.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("light_id", vec("l").alias("d"), vec("p").alias("p")))).alias("l"))
    rows = domes.join(rows, "dataset", "left")
    positions = F.transform("l", lambda e: e["p"])
    fields = ["label", "notes", "imageWidth", "domeDiameter", "verticalOffset", "lightConfiguration", F.transform("l", lambda e: e["d"]).alias("directions")]
    fields += [F.when(F.col("lightConfiguration") == "spherical", positions).alias("positionsSphere"), F.when(F.col("lightConfiguration") == "lights3d", positions).alias("positions3d")]
    return rows.select("dataset", F.to_json(F.struct(*fields)).alias("text"))


def write_dome(domes: DataFrame, lights: DataFrame, path: str) -> None:
    dome_texts(domes, lights).withColumnRenamed("text", "value").write.mode("overwrite").partitionBy("dataset").text(path)


def project_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Project rows to tables: projects, images, lenses, crops, spheres, sphere_border, measures, align_offsets, whites, domes, lights."""
    each = lambda c: docs.select("dataset", F.posexplode(c).alias("i", "e"))
    spheres = each("spheres").withColumnRenamed("i", "sphere_id")
    domes, lights = domes_of(docs.where("dome is not null").select("dataset", "dome.*"))
    aligns = each("aligns").select("dataset", F.col("i").alias("align_id"), F.posexplode("e.offsets").alias("light_id", "o"))
    return {
        "projects": docs.select("dataset", "version", "authors", "platform", "created", "width", "height", "folder", "forcedInputColorspace"),
        "images": each("images").select("dataset", F.col("i").alias("light_id"), "e.filename", F.coalesce("e.skip", F.lit(False)).alias("skip"), F.coalesce("e.visible", F.lit(True)).alias("visible")),
        "lenses": docs.where("lens is not null").select("dataset", "lens.*"),
        "crops": docs.where("crop is not null").select("dataset", "crop.*"),
        "spheres": spheres.select("dataset", "sphere_id", F.get("e.center", F.lit(0)).alias("cx"), F.get("e.center", F.lit(1)).alias("cy"), "e.radius", "e.smallradius", "e.inner"),
        "sphere_border": spheres.select("dataset", "sphere_id", F.explode("e.border").alias("b")).select("dataset", "sphere_id", F.get("b", F.lit(0)).alias("x"), F.get("b", F.lit(1)).alias("y")),
        "measures": each("measures").select("dataset", F.col("i").alias("measure_id"), "e.unit", "e.length", *(F.get(f"e.{a}", F.lit(k)).alias(n) for a, k, n in (("first", 0, "x1"), ("first", 1, "y1"), ("second", 0, "x2"), ("second", 1, "y2")))),
        "align_offsets": aligns.select("dataset", "align_id", "light_id", F.get("o", F.lit(0)).alias("ox"), F.get("o", F.lit(1)).alias("oy")),
        "whites": each("whites").select("dataset", F.col("i").alias("white_id"), "e.rect", "e.r", "e.g", "e.b"),
        "domes": domes,
        "lights": lights,
    }


def parse_project(texts: DataFrame) -> dict[str, DataFrame]:
    return project_tables(texts.select("dataset", F.from_json("text", schema.PROJECT).alias("d")).select("dataset", "d.*"))


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return project_tables(spark.read.json(path, schema=schema.PROJECT, multiLine=True).withColumn("dataset", _dataset()))


def info_texts(headers: DataFrame, lights: DataFrame, planes: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """(dataset, text) of dataset headers. Light values have 3 decimals; rbf tells its sigma and bilinear its resolution."""
    flat = lights.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("light_id", *(F.round(c, 3).alias(c) for c in ("lx", "ly", "lz"))))).alias("l"))
    flat = flat.select("dataset", F.flatten(F.transform("l", lambda e: F.array(e["lx"], e["ly"], e["lz"]))).alias("lights"))
    wide = planes.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("plane", "range", "scale", "bias"))).alias("p"))
    pick = lambda k: F.transform("p", lambda e: e[k])
    of = F.array(F.struct(F.when(F.col("type").isin("rbf", "bilinear"), pick("range")).alias("range"), pick("scale").alias("scale"), pick("bias").alias("bias")))
    rows = headers.join(flat, "dataset", "left").join(wide, "dataset", "left")
    if basis is not None:
        rows = rows.join(basis.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("plane", "dim", "q"))).alias("q")).select("dataset", F.transform("q", lambda e: e["q"]).alias("basis")), "dataset", "left")
    ycc = F.col("colorspace") == "mycc"
    fields = ["width", "height", "format", "type", "colorspace", F.when(F.col("type") == "rbf", F.col("sigma")).alias("sigma"), F.when(F.col("type") == "bilinear", F.col("resolution")).alias("resolution")]
    fields += ["pixelSizeInMM", F.when(~ycc, F.col("nplanes")).alias("nplanes"), F.when(ycc, F.col("yccplanes")).alias("yccplanes"), "quality", "colorprofile", "lights", of.alias("materials")]
    return rows.select("dataset", F.to_json(F.struct(*fields, *(["basis"] if basis is not None else []))).alias("text"))


def parse_info(texts: DataFrame) -> dict[str, DataFrame]:
    """Rows (dataset, text) of headers to tables headers, lights, planes and basis; a basis plane p > 0 is (v - 127) / range[p - 1]."""
    docs = texts.select("dataset", F.from_json("text", schema.INFO).alias("d")).select("dataset", "d.*")
    third = lambda k: F.filter("lights", lambda _, i: i % 3 == k)
    lights = docs.select("dataset", F.posexplode(F.arrays_zip(*(third(k).alias(n) for k, n in enumerate(("lx", "ly", "lz"))))).alias("light_id", "e")).select("dataset", "light_id", "e.lx", "e.ly", "e.lz")
    one = F.get("materials", F.lit(0))
    planes = docs.select("dataset", F.posexplode(F.arrays_zip(one["scale"].alias("scale"), one["bias"].alias("bias"))).alias("plane", "e"), one["range"].alias("ranges"))
    planes = planes.select("dataset", "plane", "e.scale", "e.bias", F.get("ranges", F.col("plane")).alias("range"))
    dims = F.size("lights")
    basis = docs.where("basis is not null").select("dataset", dims.alias("dims"), one["range"].alias("range"), F.posexplode("basis").alias("k", "v"))
    plane = F.floor(F.col("k") / F.col("dims")).cast("int")
    value = F.when(plane == 0, F.col("v").cast("double")).otherwise((F.col("v") - 127) / F.get("range", plane - 1))
    basis = basis.select("dataset", plane.alias("plane"), (F.col("k") % F.col("dims")).cast("int").alias("dim"), value.alias("value"))
    return {"headers": docs.drop("lights", "basis", "materials"), "lights": lights, "planes": planes, "basis": basis}


def read_info(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_info(spark.read.text(path, wholetext=True).select(_dataset().alias("dataset"), F.col("value").alias("text")))


def write_info(path: str, *tables: DataFrame) -> None:
    info_texts(*tables).withColumnRenamed("text", "value").write.mode("overwrite").partitionBy("dataset").text(path)
