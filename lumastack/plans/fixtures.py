"""Captures derived from the star-schema tables: every query reads these, and each has a twin in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stack import to_pixels

LIGHTS = np.array([[(2 * i - 3) / 5, (2 * j - 3) / 5, 0.0] for j in range(4) for i in range(4)])
LIGHTS[:, 2] = np.sqrt(1 - LIGHTS[:, 0] ** 2 - LIGHTS[:, 1] ** 2)
POSITIONS = LIGHTS * 400.0


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    """(width, height) of the raster that the orders make."""
    n = table(spark, d, "orders").count()
    w = 50 if n <= 1500 else 150 if n <= 15000 else 500
    return w, n // w


def lights(spark: SparkSession, d: str, datasets: tuple[str, ...] = ("F", "O", "P")) -> DataFrame:
    """16 directions (and positions 400 away), for each dataset."""
    i, j = F.col("id") % 4, F.floor(F.col("id") / 4)
    x, y = (2 * i - 3) / F.lit(5.0), (2 * j - 3) / F.lit(5.0)
    rows = spark.range(16).select(F.col("id").cast("int").alias("light_id"), x.alias("lx"), y.alias("ly"), F.sqrt(1 - x * x - y * y).alias("lz"))
    rows = rows.withColumns({p: F.col(v) * 400.0 for p, v in (("px", "lx"), ("py", "ly"), ("pz", "lz"))})
    return rows.withColumn("dataset", F.explode(F.array(*map(F.lit, datasets))))


def _orders(spark: SparkSession, d: str, dataset: str | None) -> DataFrame:
    w, _ = sizes(spark, d)
    k = F.col("o_orderkey")
    a, b = (F.col("o_custkey") % 41 - 20) / F.lit(80.0), (F.floor("o_totalprice").cast("long") % 41 - 20) / F.lit(80.0)
    name = F.lit(dataset) if dataset else F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(name.alias("dataset"), k.cast("long").alias("k"), (k % w).cast("int").alias("x"), F.floor(k / w).cast("int").alias("y"), a.alias("a"), b.alias("b"), F.floor("o_totalprice").cast("long").alias("p"), F.col("o_custkey").cast("long").alias("c"))
    return rows


def truth(spark: SparkSession, d: str, dataset: str | None = None) -> DataFrame:
    """The true normals of the stack."""
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1)
    return _orders(spark, d, dataset).select("dataset", "k", "x", "y", (F.col("a") / n).alias("nx"), (F.col("b") / n).alias("ny"), (1 / n).alias("nz"))


def stack(spark: SparkSession, d: str, dataset: str | None = None, *, specular: bool = False, rounded: bool = False) -> DataFrame:
    """Samples of a Lambertian surface under the 16 lights; with ``specular`` one sample in 17 has a highlight of 120."""
    rows = truth(spark, d, dataset).join(F.broadcast(lights(spark, d, ("-",)).drop("dataset")))
    v = 200 * F.greatest(F.lit(0.0), F.col("nx") * F.col("lx") + F.col("ny") * F.col("ly") + F.col("nz") * F.col("lz"))
    if specular:
        v = v + F.when((F.col("k") + F.col("light_id")) % 17 == 0, 120.0).otherwise(0.0)
    if rounded:
        v = F.floor(v + 0.5).cast("double")
    return rows.select("dataset", "light_id", "x", "y", v.alias("r"), (0.8 * v).alias("g"), (0.6 * v).alias("b"))


def pixels(spark: SparkSession, d: str, dataset: str | None = None, **kind) -> DataFrame:
    return to_pixels(stack(spark, d, dataset, **kind), 16)


def raster(spark: SparkSession, d: str, dataset: str | None = "d") -> DataFrame:
    """An integer image."""
    r, g = (F.col("p") % 256).cast("int"), (F.col("c") % 256).cast("int")
    return _orders(spark, d, dataset).select("dataset", "x", "y", r.alias("r"), g.alias("g"), F.floor((r + g) / 2).cast("int").alias("b"))


def height_size(spark: SparkSession, d: str) -> tuple[int, int]:
    n = table(spark, d, "part").count()
    w = 20 if n <= 200 else 50 if n <= 2000 else 200
    return w, n // w


def heights(spark: SparkSession, d: str) -> DataFrame:
    w, _ = height_size(spark, d)
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.lit("d").alias("dataset"), (k % w).cast("int").alias("x"), F.floor(k / w).cast("int").alias("y"), F.col("p_size").cast("double").alias("s"))
    return rows.select("dataset", "x", "y", (F.col("s") + 0.01 * F.col("x") * F.col("x") - 0.02 * F.col("x") * F.col("y") + 0.1 * F.col("y")).alias("z"))


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Samples that miss lights: at most seven a pixel."""
    w, _ = sizes(spark, d)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("e"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("s"))
    k = F.col("l_orderkey")
    return rows.select(F.lit("d").alias("dataset"), (F.col("l_linenumber") - 1).cast("int").alias("light_id"), (k % w).cast("int").alias("x"), F.floor(k / w).cast("int").alias("y"), (F.floor("e").cast("long") % 256).cast("double").alias("r"), (F.col("q").cast("int") * 5 % 256).cast("double").alias("g"), (F.round(F.col("s") * 100).cast("int") * 20 % 256).cast("double").alias("b"))


def images(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("dataset"), c.cast("int").alias("light_id"), F.col("c_name").alias("filename"), F.col("c_mktsegment").alias("format"),
        (1000 + F.when(c % 7 == 0, 500).otherwise(0)).alias("width"), F.lit(800).alias("height"), F.when(c % 11 == 0, 50.0).otherwise(35.0).alias("focal35"),
        F.lit(True).alias("valid"), (F.col("c_acctbal") < 0).alias("skip"), (c % 13 != 0).alias("visible"),
    )


def measures(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey").cast("double")
    return table(spark, d, "supplier").select((F.col("s_nationkey") % 5).cast("string").alias("dataset"), s.alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("x2"), F.col("s_nationkey").cast("double").alias("y2"), F.abs("s_acctbal").cast("double").alias("length"))


def border(spark: SparkSession, d: str, noise: float = 0.001) -> DataFrame:
    """Border points of spheres: noisy circles, one for each nation, of its customers."""
    t = F.col("c_custkey") * 0.7
    r = 50 + F.col("c_nationkey") + F.lit(noise) * (F.col("c_custkey") % 5)
    return table(spark, d, "customer").select(F.lit("d").alias("dataset"), F.col("c_nationkey").cast("int").alias("sphere_id"), (100 + r * F.cos(t)).alias("x"), (80 + r * F.sin(t)).alias("y"))


def turned_border(spark: SparkSession, d: str) -> DataFrame:
    """Border points of turned ellipses, one for each nation: axes 60 + k and 30 + k / 2, turned by 10 + 6 k degrees."""
    k, t = F.col("c_nationkey"), F.col("c_custkey") * 0.7
    u, v, a = (60 + k) * F.cos(t), (30 + k / 2) * F.sin(t), F.radians(10.0 + 6 * k)
    x, y = 100 + k + u * F.cos(a) - v * F.sin(a), 80 - k + u * F.sin(a) + v * F.cos(a)
    return table(spark, d, "customer").select(F.lit("d").alias("dataset"), k.cast("int").alias("sphere_id"), x.alias("x"), y.alias("y"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of 64 lights, from the embeddings."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(127.5 + 255 * e.cast("double")))))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("k"), v.alias("v"))
    turn = lambda n: F.concat(F.slice("v", n + 1, 64 - n), F.slice("v", 1, n)) if n else F.col("v")
    return rows.select(F.lit("d").alias("dataset"), (F.col("k") % 50).cast("int").alias("x"), F.floor(F.col("k") / 50).cast("int").alias("y"), turn(0).alias("r"), turn(21).alias("g"), turn(42).alias("b"))


# The same in SQL: common table expressions, joined as queries need them.
_W = "(SELECT CASE WHEN count(*) <= 1500 THEN 50 WHEN count(*) <= 15000 THEN 150 ELSE 500 END FROM orders)"
_H = "(SELECT CASE WHEN count(*) <= 200 THEN 20 WHEN count(*) <= 2000 THEN 50 ELSE 200 END FROM part)"
CTE = {
    "w": f"w AS (SELECT CAST({_W} AS INT) AS w, CAST((SELECT count(*) FROM orders) // {_W} AS INT) AS h)",
    "lights": "lights AS (SELECT ds.dataset, CAST(4*j+i AS INT) AS light_id, (2*i-3)/5.0::DOUBLE AS lx, (2*j-3)/5.0::DOUBLE AS ly, sqrt(1 - ((2*i-3)/5.0::DOUBLE)**2 - ((2*j-3)/5.0::DOUBLE)**2) AS lz FROM range(4) a(i), range(4) b(j), (VALUES ('F'),('O'),('P')) ds(dataset))",
    "lightpos": "lightpos AS (SELECT *, lx*400 AS px, ly*400 AS py, lz*400 AS pz FROM lights)",
    "ord": "ord AS (SELECT o_orderstatus AS dataset, o_orderkey AS k, CAST(o_orderkey % w AS INT) AS x, CAST(o_orderkey // w AS INT) AS y, (o_custkey % 41 - 20)/80.0::DOUBLE AS a, (CAST(floor(o_totalprice) AS BIGINT) % 41 - 20)/80.0::DOUBLE AS b, CAST(floor(o_totalprice) AS BIGINT) AS p, o_custkey AS c FROM orders, w)",
    "truth": "truth AS (SELECT dataset, k, x, y, a/sqrt(a*a+b*b+1) AS nx, b/sqrt(a*a+b*b+1) AS ny, 1/sqrt(a*a+b*b+1) AS nz FROM ord)",
    "base": "base AS (SELECT t.dataset, l.light_id, t.k, t.x, t.y, 200*greatest(0.0, nx*lx+ny*ly+nz*lz) AS v FROM truth t JOIN lights l ON l.dataset = t.dataset)",
    "stack": "stack AS (SELECT dataset, light_id, x, y, v AS r, 0.8::DOUBLE*v AS g, 0.6::DOUBLE*v AS b FROM base)",
    "raster": "raster AS (SELECT 'd' AS dataset, x, y, CAST(p % 256 AS INT) AS r, CAST(c % 256 AS INT) AS g, CAST((p % 256 + c % 256) // 2 AS INT) AS b FROM ord)",
    "hw": f"hw AS (SELECT CAST({_H} AS INT) AS w, CAST((SELECT count(*) FROM part) // {_H} AS INT) AS h)",
    "heights": "heights AS (SELECT 'd' AS dataset, x, y, s + 0.01::DOUBLE*x*x - 0.02::DOUBLE*x*y + 0.1::DOUBLE*y AS z FROM (SELECT CAST(p_partkey % w AS INT) AS x, CAST(p_partkey // w AS INT) AS y, CAST(p_size AS DOUBLE) AS s FROM part, hw))",
    "sparse": "sparse AS (SELECT 'd' AS dataset, CAST(l_linenumber-1 AS INT) AS light_id, CAST(l_orderkey % w AS INT) AS x, CAST(l_orderkey // w AS INT) AS y, CAST(CAST(floor(max(l_extendedprice)) AS BIGINT) % 256 AS DOUBLE) AS r, CAST(CAST(max(l_quantity) AS INT)*5 % 256 AS DOUBLE) AS g, CAST(CAST(round(max(l_discount)*100) AS INT)*20 % 256 AS DOUBLE) AS b FROM lineitem, w GROUP BY l_orderkey, l_linenumber, w)",
    "images": "images AS (SELECT CAST(c_nationkey AS VARCHAR) AS dataset, CAST(c_custkey AS INT) AS light_id, c_name AS filename, c_mktsegment AS format, CAST(1000 + CASE WHEN c_custkey % 7 = 0 THEN 500 ELSE 0 END AS INT) AS width, 800 AS height, CASE WHEN c_custkey % 11 = 0 THEN 50.0::DOUBLE ELSE 35.0::DOUBLE END AS focal35, c_acctbal < 0 AS skip, c_custkey % 13 <> 0 AS visible FROM customer)",
    "measures": "measures AS (SELECT CAST(s_nationkey % 5 AS VARCHAR) AS dataset, CAST(s_suppkey AS DOUBLE) AS x1, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS x2, CAST(s_nationkey AS DOUBLE) AS y2, CAST(abs(s_acctbal) AS DOUBLE) AS length FROM supplier)",
    "border": "border AS (SELECT 'd' AS dataset, CAST(c_nationkey AS INT) AS sphere_id, 100 + (50 + c_nationkey + 0.001::DOUBLE*(c_custkey % 5))*cos(c_custkey*0.7::DOUBLE) AS x, 80 + (50 + c_nationkey + 0.001::DOUBLE*(c_custkey % 5))*sin(c_custkey*0.7::DOUBLE) AS y FROM customer)",
}
_NEEDS = {"lightpos": ["lights"], "ord": ["w"], "truth": ["ord"], "base": ["truth", "lights"], "stack": ["base"], "raster": ["ord"], "heights": ["hw"], "sparse": ["w"]}


def sql(names: str, body: str) -> str:
    """A query on fixtures: their expressions, then ``body``, which may start with further ones and a comma."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in done:
            done.append(name)

    for name in names.split():
        add(name)
    body = body.strip()
    return "WITH " + ", ".join(CTE[n] for n in done) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
