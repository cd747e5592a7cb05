"""Queries on preparation, stacks, aggregates and normals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..operators import aggregate as A
from ..operators import normals as N
from ..operators import prepare as P
from ..operators import stack as S
from . import fixtures as X
from .fixtures import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; minus zero is zero."""
    names = names or tuple(f.name for f in df.schema if f.dataType.simpleString() == "double")
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in names})


R = lambda e, n=6: f"round({e}, {n}) + 0.0"


@query("n1_normals_l2", sql("stack", f"""
    WITH m AS (SELECT s.dataset, x, y, sum(lx*lx) xx, sum(lx*ly) xy, sum(lx*lz) xz, sum(ly*ly) yy, sum(ly*lz) yz, sum(lz*lz) zz,
        sum((r+g+b)/3*lx) bx, sum((r+g+b)/3*ly) by_, sum((r+g+b)/3*lz) bz FROM stack s JOIN lights l ON l.dataset = s.dataset AND l.light_id = s.light_id GROUP BY 1,2,3),
    v AS (SELECT dataset, x, y, (yy*zz-yz*yz)*bx+(xz*yz-xy*zz)*by_+(xy*yz-xz*yy)*bz AS a, (xz*yz-xy*zz)*bx+(xx*zz-xz*xz)*by_+(xy*xz-xx*yz)*bz AS b, (xy*yz-xz*yy)*bx+(xy*xz-xx*yz)*by_+(xx*yy-xy*xy)*bz AS c FROM m)
    SELECT dataset, x, y, {R('a/sqrt(a*a+b*b+c*c)')} AS nx, {R('b/sqrt(a*a+b*b+c*c)')} AS ny, {R('c/sqrt(a*a+b*b+c*c)')} AS nz FROM v"""))  # fmt: skip
def n1(spark, d):
    return rounded(N.normals_l2(X.stack(spark, d), X.lights(spark, d)))


@query("n1_s11_encoded_normals", sql("truth", """SELECT dataset, x, y, CAST(round(round((nx+1)/2*255,9)) AS INT) AS r, CAST(round(round((ny+1)/2*255,9)) AS INT) AS g, CAST(round(round((nz+1)/2*255,9)) AS INT) AS b FROM truth"""))
def n1_s11(spark, d):
    return N.encode_normals(N.fix_normals(N.normals_l2(X.stack(spark, d), X.lights(spark, d))))


@query("n1_normals_positional", sql("stack lightpos", f"""WITH q AS (SELECT s.dataset, x, y, (r+g+b)/3 AS v, px-0.1::DOUBLE*(x-w/2.0::DOUBLE) AS a, py-0.1::DOUBLE*(h-1-y-h/2.0::DOUBLE) AS b, pz AS c FROM stack s JOIN lightpos l ON l.dataset=s.dataset AND l.light_id=s.light_id, w), u AS (SELECT dataset, x, y, v, a/sqrt(a*a+b*b+c*c) AS lx, b/sqrt(a*a+b*b+c*c) AS ly, c/sqrt(a*a+b*b+c*c) AS lz FROM q),
    m AS (SELECT dataset, x, y, sum(lx*lx) xx, sum(lx*ly) xy, sum(lx*lz) xz, sum(ly*ly) yy, sum(ly*lz) yz, sum(lz*lz) zz, sum(v*lx) bx, sum(v*ly) by_, sum(v*lz) bz FROM u GROUP BY 1,2,3),
    v AS (SELECT dataset, x, y, (yy*zz-yz*yz)*bx+(xz*yz-xy*zz)*by_+(xy*yz-xz*yy)*bz AS a, (xz*yz-xy*zz)*bx+(xx*zz-xz*xz)*by_+(xy*xz-xx*yz)*bz AS b, (xy*yz-xz*yy)*bx+(xy*xz-xx*yz)*by_+(xx*yy-xy*xy)*bz AS c FROM m)
    SELECT dataset, x, y, {R('a/sqrt(a*a+b*b+c*c)')} AS nx, {R('b/sqrt(a*a+b*b+c*c)')} AS ny, {R('c/sqrt(a*a+b*b+c*c)')} AS nz FROM v"""))
def n1p(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(N.normals_l2_positional(X.stack(spark, d), X.lights(spark, d), width=w, height=h, pixel=0.1))


@query("n6_weighted_direction", sql("stack", """WITH m AS (SELECT s.dataset, x, y, sum((r+g+b)*lx) a, sum((r+g+b)*ly) b, sum((r+g+b)*lz) c FROM stack s JOIN lights l ON l.dataset = s.dataset AND l.light_id = s.light_id GROUP BY 1,2,3)
    SELECT dataset, x, y, CAST(floor(round(255*(a/sqrt(a*a+b*b+c*c)+1)/2,9)) AS INT) AS r, CAST(floor(round(255*(b/sqrt(a*a+b*b+c*c)+1)/2,9)) AS INT) AS g, CAST(floor(round(255*(c/sqrt(a*a+b*b+c*c)+1)/2,9)) AS INT) AS b FROM m"""))
def n6(spark, d):
    return N.normals_weighted(X.stack(spark, d), X.lights(spark, d))


@query("n7_fix_normals", sql("truth", f"""WITH q AS (SELECT dataset, x, y, CASE WHEN k % 10 = 0 THEN 0.0 ELSE nx END AS a, ny AS b, CASE WHEN k % 7 = 0 OR nz < 0.001 THEN 0.001 ELSE nz END AS c, k % 10 = 0 OR k % 7 = 0 AS f FROM truth)
    SELECT dataset, x, y, {R('CASE WHEN f THEN a/sqrt(a*a+b*b+c*c) ELSE a END')} AS nx, {R('CASE WHEN f THEN b/sqrt(a*a+b*b+c*c) ELSE b END')} AS ny, {R('CASE WHEN f THEN c/sqrt(a*a+b*b+c*c) ELSE c END')} AS nz FROM q"""))
def n7(spark, d):
    t = X.truth(spark, d)
    t = t.withColumns({"nx": F.when(F.col("k") % 10 == 0, float("nan")).otherwise(F.col("nx")), "nz": F.when(F.col("k") % 7 == 0, -0.2).otherwise(F.col("nz"))}).drop("k")
    return rounded(N.fix_normals(t))


@query("n8_angular_error", sql("truth", f"""SELECT dataset, x, y, CASE WHEN k % 5 = 0 THEN 0.0 ELSE {R('degrees(acos(greatest(-1.0, least(nz, 1.0))))', 4)} END AS degrees FROM truth"""))
def n8(spark, d):
    t = X.truth(spark, d)
    up = t.select("dataset", "x", "y", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return rounded(N.angular_error(t.drop("k"), up, t.select("dataset", "x", "y", (F.col("k") % 5).alias("mask"))), digits=4)


@query("n9_resize_grid", sql("truth", f"""WITH o AS (SELECT gx, gy, gx*(w-1)/29.0::DOUBLE AS sx, gy*(h-1)/19.0::DOUBLE AS sy, w, h FROM w, range(30) a(gx), range(20) b(gy)),
    c AS (SELECT gx, gy, least(floor(sx)+dx, w-1) AS cx, least(floor(sy)+dy, h-1) AS cy, (CASE WHEN dx=1 THEN sx-floor(sx) ELSE 1-(sx-floor(sx)) END)*(CASE WHEN dy=1 THEN sy-floor(sy) ELSE 1-(sy-floor(sy)) END) AS wt FROM o, range(2) e(dx), range(2) f(dy))
    SELECT 'd' AS dataset, CAST(gx AS INT) AS x, CAST(gy AS INT) AS y, {R('sum(wt*nx)')} AS nx, {R('sum(wt*ny)')} AS ny, {R('sum(wt*nz)')} AS nz FROM c JOIN truth t ON t.x = cx AND t.y = cy GROUP BY gx, gy"""))
def n9(spark, d):
    return rounded(N.resize_normals(X.truth(spark, d, "d"), X.sizes(spark, d), (30, 20)))


@query("s11_normals_16bit", sql("truth", """SELECT dataset, x, y, CAST(trunc(round((nx+1)/2*65535,9)) AS INT) AS r, CAST(trunc(round((ny+1)/2*65535,9)) AS INT) AS g, CAST(trunc(round((nz+1)/2*65535,9)) AS INT) AS b FROM truth"""))
def s11(spark, d):
    return N.encode_normals(X.truth(spark, d), 16)


@query("s11_decode_normals", sql("raster", f"""SELECT dataset, x, y, {R('r/255.0::DOUBLE*2-1')} AS nx, {R('g/255.0::DOUBLE*2-1')} AS ny, {R('b/255.0::DOUBLE*2-1')} AS nz FROM raster"""))
def s11d(spark, d):
    return rounded(N.decode_normals(X.raster(spark, d)))


# Stacks and joins by position


@query("j1_attach_lights", sql("stack", f"""SELECT s.dataset, s.light_id, x, y, {R('r')} AS r, {R('lx')} AS lx, {R('ly')} AS ly, {R('lz')} AS lz FROM stack s JOIN lights l ON l.dataset = s.dataset AND l.light_id = s.light_id"""))
def j1(spark, d):
    return rounded(S.attach_lights(X.stack(spark, d), X.lights(spark, d)).select("dataset", "light_id", "x", "y", "r", "lx", "ly", "lz"))


@query("j2_to_pixels", sql("sparse", """SELECT dataset, x, y, max(CASE WHEN light_id=0 THEN r END) AS r0, max(CASE WHEN light_id=3 THEN g END) AS g3, max(CASE WHEN light_id=6 THEN b END) AS b6, CAST(count(*) AS BIGINT) AS n FROM sparse GROUP BY 1,2,3"""))
def j2(spark, d):
    p = S.to_pixels(X.sparse(spark, d), 7, incomplete="null")
    return p.select("dataset", "x", "y", F.get("r", F.lit(0)).alias("r0"), F.get("g", F.lit(3)).alias("g3"), F.get("b", F.lit(6)).alias("b6"), F.size(F.filter("r", lambda v: v.isNotNull())).cast("long").alias("n"))


@query("j2_complete_pixels", sql("stack", f"""SELECT dataset, x, y, {R('sum(r*(light_id+1))')} AS r, {R('sum(g*(light_id+1))')} AS g FROM stack GROUP BY 1,2,3"""))
def j2c(spark, d):
    p = X.pixels(spark, d)
    dot = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v).alias(c)
    return rounded(p.select("dataset", "x", "y", dot("r"), dot("g")))


_RAW = "raw AS (SELECT CAST(l_orderkey % w AS INT) AS x, CAST(l_orderkey // w AS INT) AS y, CAST(l_linenumber-1 AS INT) AS light_id, CAST(l_partkey % 256 AS DOUBLE) AS r, CAST(l_suppkey % 256 AS DOUBLE) AS g, CAST(l_quantity AS DOUBLE) AS b FROM lineitem, w WHERE l_linenumber <= 3), top AS (SELECT *, row_number() OVER (PARTITION BY x, y, light_id ORDER BY r DESC, g DESC, b DESC) AS k FROM raw)"


@query("j2_repeated_samples", sql("w", f"WITH {_RAW}, p AS (SELECT x, y FROM top WHERE k=1 GROUP BY 1,2 HAVING count(*)=3) SELECT top.x, top.y, light_id, r, g, b FROM top JOIN p ON p.x=top.x AND p.y=top.y WHERE k=1"))
def j2r(spark, d):
    """Samples that repeat and miss lights: three lights, of the lines of orders."""
    w, _ = X.sizes(spark, d)
    k = F.col("l_orderkey")
    rows = X.table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.lit("d").alias("dataset"), (F.col("l_linenumber") - 1).cast("int").alias("light_id"), (k % w).cast("int").alias("x"), F.floor(k / w).cast("int").alias("y"), (F.col("l_partkey") % 256).cast("double").alias("r"), (F.col("l_suppkey") % 256).cast("double").alias("g"), F.col("l_quantity").cast("double").alias("b"))
    return S.to_samples(S.to_pixels(rows, 3)).drop("dataset")


@query("j2_to_samples", sql("stack", f"""SELECT dataset, light_id, x, y, {R('r')} AS r, {R('g')} AS g, {R('b')} AS b FROM stack"""))
def j2s(spark, d):
    return rounded(S.to_samples(X.pixels(spark, d)))


@query("j5_neighbours", sql("raster", """SELECT a.dataset, a.x, a.y, CAST(sum(n.r) AS BIGINT) AS r FROM raster a, w, range(3) i(i), range(3) j(j), raster n WHERE n.x = greatest(0, least(a.x+i-1, w-1)) AND n.y = greatest(0, least(a.y+j-1, h-1)) GROUP BY 1,2,3"""))
def j5(spark, d):
    w, h = X.sizes(spark, d)
    near = S.neighbours(X.raster(spark, d), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)], w, h, ["r"])
    return near.groupBy("dataset", "x", "y").agg(F.sum("r").alias("r"))


@query("j6_grid_nodes", sql("raster", f"""WITH g AS (SELECT dataset, x, y, 14*x/CAST(w AS DOUBLE) AS u, 14*y/CAST(h AS DOUBLE) AS v FROM raster, w), f AS (SELECT *, least(floor(u),13) AS i, least(floor(v),13) AS j FROM g)
    SELECT dataset, x, y, CAST((j+dy)*15+i+dx AS INT) AS node, {R('(CASE WHEN dx=1 THEN u-i ELSE 1-(u-i) END)*(CASE WHEN dy=1 THEN v-j ELSE 1-(v-j) END)')} AS weight FROM f, range(2) a(dx), range(2) b(dy)"""))
def j6(spark, d):
    return rounded(S.grid_nodes(X.raster(spark, d), *X.sizes(spark, d)))


@query("j7_assign_tiles", sql("raster", """WITH t AS (SELECT CAST(c AS INT) AS c, CAST(q AS INT) AS q FROM w, range(20) a(c), range(20) b(q) WHERE c < (w+63)//64 AND q < (h+63)//64)
    SELECT c AS col, q AS row, count(*) AS n, CAST(sum(r) AS BIGINT) AS total FROM raster, t WHERE x >= c*64-2 AND x < (c+1)*64+2 AND y >= q*64-2 AND y < (q+1)*64+2 GROUP BY 1,2"""))
def j7(spark, d):
    return S.assign_tiles(X.raster(spark, d), *X.sizes(spark, d), 64, 2).groupBy("col", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("total"))


# Preparation


@query("p1_validate_images", sql("images", """WITH f AS (SELECT dataset, format FROM (SELECT dataset, format, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, min(light_id)) k FROM images GROUP BY 1,2) WHERE k=1),
    i AS (SELECT images.* FROM images JOIN f ON f.dataset=images.dataset AND f.format=images.format),
    z AS (SELECT dataset, width, height FROM (SELECT dataset, width, height, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, min(light_id)) k FROM i GROUP BY 1,2,3) WHERE k=1),
    o AS (SELECT dataset, focal35 FROM (SELECT dataset, focal35, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, min(light_id)) k FROM i GROUP BY 1,2) WHERE k=1)
    SELECT i.dataset, light_id, i.width, i.width=z.width AND i.height=z.height AND i.focal35=o.focal35 AS valid, skip OR i.width<>z.width AS skip FROM i JOIN z ON z.dataset=i.dataset JOIN o ON o.dataset=i.dataset"""))
def p1(spark, d):
    return P.validate_images(X.images(spark, d)).select("dataset", "light_id", "width", "valid", "skip")


@query("p2_select_images", sql("images", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY light_id) - 1 AS slot FROM images WHERE NOT skip), v AS (SELECT * FROM s WHERE visible AND slot < 16)
    SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY slot) - 1 AS INT) AS light_id, filename, CAST(slot AS DOUBLE) AS lx FROM v"""))
def p2(spark, d):
    i = X.images(spark, d)
    lights = i.select("dataset").distinct().join(F.broadcast(spark.range(16).select(F.col("id").cast("int").alias("light_id"), F.col("id").cast("double").alias("lx"))))
    return P.select_images(i, lights).select("dataset", "light_id", "filename", "lx")


@query("p3_check_counts", sql("images", """SELECT dataset, count(*) AS n_images, CAST(count(*) FILTER (WHERE visible) AS BIGINT) AS n_lights, count(*) = count(*) FILTER (WHERE visible) AS ok FROM images GROUP BY 1"""))
def p3(spark, d):
    i = X.images(spark, d)
    return P.check_counts(i, i.where("visible"))


@query("p4_drop_light", sql("stack", """SELECT dataset, light_id, count(*) AS n FROM stack WHERE light_id <> 5 GROUP BY 1,2"""))
def p4(spark, d):
    return P.drop_light(X.stack(spark, d), 5).groupBy("dataset", "light_id").agg(F.count(F.lit(1)).alias("n"))


@query("p5_crop", sql("raster", """SELECT dataset, CAST(x-10 AS INT) AS x, CAST(y-5 AS INT) AS y, r, g, b FROM raster WHERE x>=10 AND x<40 AND y>=5 AND y<25"""))
def p5(spark, d):
    return P.crop(X.raster(spark, d), 10, 5, 30, 20)


@query("p6_apply_offsets", sql("stack", f"""WITH o AS (SELECT light_id, CAST(light_id % 3 - 1 AS INT) AS ox, CAST(light_id % 5 - 2 AS INT) AS oy FROM lights WHERE dataset='F')
    SELECT s.dataset, s.light_id, CAST(x-ox-1 AS INT) AS x, CAST(y-oy-2 AS INT) AS y, {R('r')} AS r FROM stack s JOIN o ON o.light_id=s.light_id, w WHERE x-ox>=1 AND x-ox<w-1 AND y-oy>=2 AND y-oy<h-2"""))
def p6(spark, d):
    o = X.lights(spark, d).select("dataset", "light_id", (F.col("light_id") % 3 - 1).alias("ox"), (F.col("light_id") % 5 - 2).alias("oy"))
    return rounded(P.apply_offsets(X.stack(spark, d), o, *X.sizes(spark, d)).select("dataset", "light_id", "x", "y", "r"))


_C = P.Crop(12, 7, 30, 20, 30.0)


@query("p7_crop_coordinates", sql("raster", f"""SELECT x, y, {R('cos(radians(30))*(x-w/2.0::DOUBLE)-sin(radians(30))*(y-h/2.0::DOUBLE)+(cos(radians(30))*w+sin(radians(30))*h)/2-12')} AS cx, {R('sin(radians(30))*(x-w/2.0::DOUBLE)+cos(radians(30))*(y-h/2.0::DOUBLE)+(sin(radians(30))*w+cos(radians(30))*h)/2-7')} AS cy, CAST(x AS DOUBLE) AS ix, CAST(y AS DOUBLE) AS iy FROM raster, w"""))
def p7(spark, d):
    w, h = X.sizes(spark, d)
    cx, cy = P.img_to_crop(F.col("x"), F.col("y"), _C, w, h)
    rows = X.raster(spark, d).select("x", "y", cx.alias("cx"), cy.alias("cy"))
    ix, iy = P.crop_to_img(F.col("cx"), F.col("cy"), _C, w, h)
    return rounded(rows.withColumns({"ix": ix, "iy": iy}))


@query("p8_rotate_crop", sql("truth", f"""WITH p AS (SELECT w, h, radians(30) AS a, cos(radians(30))*w+sin(radians(30))*h AS bw, sin(radians(30))*w+cos(radians(30))*h AS bh FROM w),
    o AS (SELECT gx, gy, cos(a)*(gx+12-bw/2)+sin(a)*(gy+7-bh/2)+w/2.0::DOUBLE AS sx, -sin(a)*(gx+12-bw/2)+cos(a)*(gy+7-bh/2)+h/2.0::DOUBLE AS sy, w, h FROM p, range(30) e(gx), range(20) f(gy)),
    c AS (SELECT gx, gy, greatest(0,least(floor(sx)+dx,w-1)) AS cx, greatest(0,least(floor(sy)+dy,h-1)) AS cy, (CASE WHEN dx=1 THEN sx-floor(sx) ELSE 1-(sx-floor(sx)) END)*(CASE WHEN dy=1 THEN sy-floor(sy) ELSE 1-(sy-floor(sy)) END) AS wt FROM o, range(2) e(dx), range(2) f(dy))
    SELECT 'd' AS dataset, CAST(gx AS INT) AS x, CAST(gy AS INT) AS y, {R('sum(wt*nx)')} AS nx, {R('sum(wt*ny)')} AS ny, {R('sum(wt*nz)')} AS nz FROM c JOIN truth t ON t.x=cx AND t.y=cy GROUP BY gx, gy"""))
def p8(spark, d):
    return rounded(P.rotate_crop(X.truth(spark, d, "d"), _C, *X.sizes(spark, d)))


@query("p9_rotate_lights", sql("stack", f"""SELECT l.dataset, l.light_id, {R('cos(radians(-20))*lx-sin(radians(-20))*ly')} AS lx, {R('sin(radians(-20))*lx+cos(radians(-20))*ly')} AS ly, {R('lz')} AS lz, count(*) AS n FROM lights l JOIN stack s ON s.dataset=l.dataset AND s.light_id=l.light_id GROUP BY ALL"""))
def p9(spark, d):
    s = X.stack(spark, d).groupBy("dataset", "light_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.rotate_lights(X.lights(spark, d), 20).join(s, ["dataset", "light_id"]).select("dataset", "light_id", "lx", "ly", "lz", "n"))


@query("p10_quarter_turns", sql("raster", """SELECT dataset, CAST(h-1-y AS INT) AS x, x AS y, r, 90 AS turn FROM raster, w UNION ALL SELECT dataset, y AS x, CAST(w-1-x AS INT) AS y, r, 270 AS turn FROM raster, w"""))
def p10(spark, d):
    w, h = X.sizes(spark, d)
    a, b = (P.rotate_raster(X.raster(spark, d), w, h, c).select("dataset", "x", "y", "r", F.lit(t).alias("turn")) for c, t in ((True, 90), (False, 270)))
    return a.union(b)


@query("p10_turn_lights", sql("stack", f"""SELECT l.dataset, l.light_id, {R('-ly')} AS lx, {R('lx')} AS ly, count(*) AS n FROM lights l JOIN stack s ON s.dataset=l.dataset AND s.light_id=l.light_id GROUP BY ALL"""))
def p10l(spark, d):
    s = X.stack(spark, d).groupBy("dataset", "light_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.quarter_turn_lights(X.lights(spark, d), 90).join(s, ["dataset", "light_id"]).select("dataset", "light_id", "lx", "ly", "n"))


@query("p11_vignetting", sql("stack", f"""SELECT dataset, light_id, x, y, {R("r/pow(cos(atan2(sqrt(pow((x-(w-1)/2.0::DOUBLE)*0.1::DOUBLE,2)+pow((y-(h-1)/2.0::DOUBLE)*0.1::DOUBLE,2)), 50.0::DOUBLE)),4)")} AS r FROM stack, w"""))
def p11(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(P.correct_vignetting(X.stack(spark, d), width=w, height=h, focal=50.0, pixel=0.1).select("dataset", "light_id", "x", "y", "r"))


_REL = "SELECT s.dataset, s.light_id, x, y, r, cos(radians(-15))*(px-0.1::DOUBLE*(x-w/2.0::DOUBLE))-sin(radians(-15))*(py-0.1::DOUBLE*(h-1-y-h/2.0::DOUBLE)) AS rx, sin(radians(-15))*(px-0.1::DOUBLE*(x-w/2.0::DOUBLE))+cos(radians(-15))*(py-0.1::DOUBLE*(h-1-y-h/2.0::DOUBLE)) AS ry, pz AS rz FROM stack s JOIN lightpos l ON l.dataset=s.dataset AND l.light_id=s.light_id, w"


@query("p12_relative_light", sql("stack lightpos", f"""WITH q AS ({_REL}) SELECT dataset, light_id, x, y, {R('rx')} AS rx, {R('ry')} AS ry, {R('rz')} AS rz FROM q"""))
def p12(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(P.relative_light(X.stack(spark, d), X.lights(spark, d), width=w, height=h, pixel=0.1, angle=15).select("dataset", "light_id", "x", "y", "rx", "ry", "rz"))


@query("p13_falloff", sql("stack lightpos", f"""WITH q AS ({_REL}) SELECT dataset, light_id, x, y, {R('r*(rx*rx+ry*ry+rz*rz)/(SELECT avg(px*px+py*py+pz*pz) FROM lightpos)')} AS r FROM q"""))
def p13(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(P.correct_falloff(X.stack(spark, d), X.lights(spark, d), width=w, height=h, pixel=0.1, angle=15).select("dataset", "light_id", "x", "y", "r"))


@query("p14_normalize_focal", """SELECT c_custkey AS light_id, round(CASE WHEN c_custkey % 3 = 0 THEN 35.0::DOUBLE WHEN c_custkey % 3 = 1 THEN 20.0::DOUBLE*43.27::DOUBLE/sqrt(pow(6000/(CAST(100+c_nationkey AS DOUBLE))*(CASE WHEN c_custkey % 2 = 0 THEN 10.0::DOUBLE ELSE 25.4::DOUBLE END),2)+pow(4000/(CAST(100+c_nationkey AS DOUBLE))*(CASE WHEN c_custkey % 2 = 0 THEN 10.0::DOUBLE ELSE 25.4::DOUBLE END),2)) ELSE 20.0::DOUBLE END, 6) AS focal_eq, round(43.27::DOUBLE/sqrt(1500.0::DOUBLE*1500+1000.0::DOUBLE*1000), 6) AS virtual_pixel FROM customer""")
def p14(spark, d):
    c = F.col("c_custkey")
    res = F.when(c % 3 == 1, (100 + F.col("c_nationkey")).cast("double"))
    i = X.table(spark, d, "customer").select(c.alias("light_id"), F.lit(20.0).alias("focal"), F.when(c % 3 == 0, 35.0).alias("focal35"), res.alias("plane_res_x"), res.alias("plane_res_y"), F.when(c % 2 == 0, 3).otherwise(2).alias("plane_unit"), F.lit(1500).alias("width"), F.lit(1000).alias("height"), F.lit(6000).alias("orig_width"), F.lit(4000).alias("orig_height"))
    return rounded(P.normalize_focal(i).select("light_id", "focal_eq", "virtual_pixel"))


@query("p15_view_direction", sql("raster", f"""SELECT x, y, {R('(x-(w-1)/2.0::DOUBLE)/sqrt(pow(x-(w-1)/2.0::DOUBLE,2)+pow((h-1)/2.0::DOUBLE-y,2)+1000000)')} AS vx, {R('((h-1)/2.0::DOUBLE-y)/sqrt(pow(x-(w-1)/2.0::DOUBLE,2)+pow((h-1)/2.0::DOUBLE-y,2)+1000000)')} AS vy, {R('-1000/sqrt(pow(x-(w-1)/2.0::DOUBLE,2)+pow((h-1)/2.0::DOUBLE-y,2)+1000000)')} AS vz FROM raster, w"""))
def p15(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(P.view_direction(X.raster(spark, d), width=w, height=h, focal_px=1000.0).select("x", "y", "vx", "vy", "vz"))


@query("p15_rotate_normal", sql("truth", f"""WITH q AS (SELECT x, y, nx, ny, nz, (x-(w-1)/2.0::DOUBLE) AS a, ((h-1)/2.0::DOUBLE-y) AS b FROM truth, w), v AS (SELECT *, a/sqrt(a*a+b*b+1e6) AS vx, b/sqrt(a*a+b*b+1e6) AS vy, -1000/sqrt(a*a+b*b+1e6) AS vz FROM q),
    u AS (SELECT *, sqrt(vx*vx+vy*vy) AS s, -vy/nullif(sqrt(vx*vx+vy*vy),0) AS ux, vx/nullif(sqrt(vx*vx+vy*vy),0) AS uy FROM v)
    SELECT x, y, {R('CASE WHEN s<1e-5 THEN nx ELSE nx*-vz+uy*nz*s+ux*(ux*nx+uy*ny)*(1+vz) END')} AS nx, {R('CASE WHEN s<1e-5 THEN ny ELSE ny*-vz-ux*nz*s+uy*(ux*nx+uy*ny)*(1+vz) END')} AS ny, {R('CASE WHEN s<1e-5 THEN nz ELSE nz*-vz+(ux*ny-uy*nx)*s END')} AS nz FROM u"""))
def p15r(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(P.rotate_normal(P.view_direction(X.truth(spark, d, "d"), width=w, height=h, focal_px=1000.0)).select("x", "y", "nx", "ny", "nz"))


@query("p16_ycbcr_and_lifting", sql("raster", f"""SELECT x, y, {R('(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b)/255')} AS yy, {R('(b-(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b))/255/1.772::DOUBLE+0.5')} AS cb, {R('(r-(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b))/255/1.402::DOUBLE+0.5')} AS cr, {R('b+(r-b)/2.0::DOUBLE+(g-(b+(r-b)/2.0::DOUBLE))/2')} AS ly, CAST(r-b AS DOUBLE) AS co, {R('g-(b+(r-b)/2.0::DOUBLE)')} AS cg, CAST(r AS DOUBLE) AS r2, CAST(g AS DOUBLE) AS g2, CAST(b AS DOUBLE) AS b2 FROM raster"""))
def p16(spark, d):
    c = [F.col(k).cast("double") for k in "rgb"]
    y, cb, cr = color.rgb_to_ycbcr(*(v / 255 for v in c))
    ly, co, cg = color.to_ycc(*c)
    rows = X.raster(spark, d).select("x", "y", y.alias("yy"), cb.alias("cb"), cr.alias("cr"), ly.alias("ly"), co.alias("co"), cg.alias("cg"))
    back = color.ycc_to_rgb(F.col("ly"), F.col("co"), F.col("cg"))
    return rounded(rows.withColumns(dict(zip(("r2", "g2", "b2"), back, strict=True))))


@query("p17_convert_color", sql("raster", """SELECT x, y, CAST(round(255*(CASE WHEN r/255.0::DOUBLE<=0.04045 THEN r/255.0::DOUBLE/12.92 ELSE pow((r/255.0::DOUBLE+0.055)/1.055,2.4) END)) AS DOUBLE) AS r FROM raster"""))
def p17(spark, d):
    return P.convert_color(X.raster(spark, d), "srgb", "linear-srgb").select("x", "y", "r")


_WIDE = color.Profile(((0.5767, 0.1856, 0.1882), (0.2973, 0.6274, 0.0753), (0.0270, 0.0707, 0.9911)), 2.2)


def _profile_sql() -> str:
    """A wide gamut of exponent 2.2 to linear sRGB: solved from the target's matrix by Cramer's rule."""
    m = [[f"({v}::DOUBLE)" for v in row] for row in color.SRGB_TO_XYZ]
    det = lambda q: f"({q[0][0]}*({q[1][1]}*{q[2][2]}-{q[1][2]}*{q[2][1]})-{q[0][1]}*({q[1][0]}*{q[2][2]}-{q[1][2]}*{q[2][0]})+{q[0][2]}*({q[1][0]}*{q[2][1]}-{q[1][1]}*{q[2][0]}))"
    xyz = ", ".join(f"{a}::DOUBLE*lr+{b}::DOUBLE*lg+{c}::DOUBLE*lb AS t{i}" for i, (a, b, c) in enumerate(_WIDE.to_xyz))
    part = lambda k: f"greatest(0, least(255, round(255*{det([[f't{i}' if j == k else m[i][j] for j in range(3)] for i in range(3)])}/{det(m)})))"
    return f"WITH li AS (SELECT x, y, pow(r/255.0::DOUBLE,2.2) AS lr, pow(g/255.0::DOUBLE,2.2) AS lg, pow(b/255.0::DOUBLE,2.2) AS lb FROM raster), ci AS (SELECT x, y, {xyz} FROM li) SELECT x, y, {', '.join(f'CAST({part(k)} AS DOUBLE) + 0.0 AS {c}' for k, c in enumerate('rgb'))} FROM ci"


@query("p17_matrix_profile", sql("raster", _profile_sql()))
def p17m(spark, d):
    return P.convert_color(X.raster(spark, d), _WIDE, "linear-srgb").select("x", "y", *((F.col(c) + 0.0).alias(c) for c in "rgb"))


@query("p18_check_profiles", sql("images", """SELECT dataset, count(DISTINCT format) AS n_profiles, count(DISTINCT format) = 1 AS ok FROM images GROUP BY 1"""))
def p18(spark, d):
    return P.check_profiles(X.images(spark, d), "format")


@query("p19_gray", sql("raster", f"""SELECT x, y, {R('(r+g+b)/3.0::DOUBLE')} AS mean, CAST((11*r+16*g+5*b)//32 AS INT) AS q FROM raster"""))
def p19(spark, d):
    c = [F.col(k) for k in "rgb"]
    return rounded(X.raster(spark, d).select("x", "y", color.gray(*c).alias("mean"), color.gray(*c, "integer").alias("q")), "mean")


@query("p20_apply_mask", sql("truth", f"""SELECT dataset, x, y, {R('CASE WHEN k % 3 = 1 THEN nx ELSE 0 END')} AS nx, {R('CASE WHEN k % 3 = 1 THEN ny ELSE 0 END')} AS ny, {R('CASE WHEN k % 3 = 1 THEN nz ELSE 0 END')} AS nz FROM truth"""))
def p20(spark, d):
    t = X.truth(spark, d)
    mask = t.where("k % 3 < 2").select("dataset", "x", "y", (F.col("k") % 3).alias("mask"))
    return rounded(P.apply_mask(t.drop("k"), mask))


# Aggregates

_B = lambda e: f"CAST(greatest(0, least(round(round({e},9)),255)) AS INT)"


@query("a1_mean_image", sql("stack", f"SELECT dataset, x, y, {_B('avg(r)')} AS r, {_B('avg(g)')} AS g, {_B('avg(b)')} AS b FROM stack GROUP BY 1,2,3"))
def a1(spark, d):
    return A.mean_image(X.stack(spark, d))


@query("a2_median_image", sql("sparse", f"SELECT dataset, x, y, {_B('list_sort(list(r))[7*count(*)//8+1]')} AS r, {_B('list_sort(list(g))[7*count(*)//8+1]')} AS g, {_B('list_sort(list(b))[7*count(*)//8+1]')} AS b FROM sparse GROUP BY 1,2,3"))
def a2(spark, d):
    return A.median_image(X.sparse(spark, d))


@query("a3_max_image", sql("sparse", "SELECT dataset, x, y, max(r) AS r, max(g) AS g, max(b) AS b FROM sparse GROUP BY 1,2,3"))
def a3(spark, d):
    return A.max_image(X.sparse(spark, d))


@query("a4_albedo_median", sql("sparse", "SELECT dataset, x, y, CAST(list_sort(list(r))[CAST(floor((count(*)-1)*66/100.0) AS BIGINT)+1] AS INT) AS r, CAST(list_sort(list(g))[CAST(floor((count(*)-1)*66/100.0) AS BIGINT)+1] AS INT) AS g, CAST(list_sort(list(b))[CAST(floor((count(*)-1)*66/100.0) AS BIGINT)+1] AS INT) AS b FROM sparse GROUP BY 1,2,3"))
def a4(spark, d):
    return A.albedo(X.sparse(spark, d))


@query("a4_albedo_mean", sql("stack", "SELECT dataset, x, y, CAST(trunc(round(avg(r),9)) AS INT) AS r, CAST(trunc(round(avg(g),9)) AS INT) AS g, CAST(trunc(round(avg(b),9)) AS INT) AS b FROM stack GROUP BY 1,2,3"))
def a4m(spark, d):
    return A.albedo(X.stack(spark, d), "mean")


@query("a5_plane_ranges", sql("stack", f"""WITH r AS (SELECT dataset, light_id AS plane, r AS v, row_number() OVER (PARTITION BY dataset, light_id ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY dataset, light_id) AS n FROM stack)
    SELECT dataset, plane, n, {R('max(CASE WHEN k = least(floor((1-0.995::DOUBLE)/2*n), n-1) THEN v END)')} AS vmin, {R('max(CASE WHEN k = least(floor((1+0.995::DOUBLE)/2*n), n-1) THEN v END)')} AS vmax FROM r GROUP BY 1,2,3"""))
def a5(spark, d):
    return rounded(A.plane_ranges(X.stack(spark, d).select("dataset", F.col("light_id").alias("plane"), F.col("r").alias("value"))))


@query("a6_channel_histogram", sql("raster", """SELECT dataset, channel, CAST(v*257*20//65536 AS INT) AS bin, count(*) AS n FROM (SELECT dataset, 'r' AS channel, r AS v FROM raster UNION ALL SELECT dataset, 'g', g FROM raster UNION ALL SELECT dataset, 'b', b FROM raster) GROUP BY 1,2,3"""))
def a6(spark, d):
    return A.channel_histogram(X.raster(spark, d).withColumns({c: F.col(c) * 257 for c in "rgb"}))


@query("a6_white_grid", sql("raster", f"""WITH c AS (SELECT CAST(least(x*5//w,4) AS INT) AS col, CAST(least(y*4//h,3) AS INT) AS row, r*257 AS r, g*257 AS g, b*257 AS b, g*257//1311 AS bin FROM raster, w),
    e AS (SELECT DISTINCT col, row FROM c), hh AS (SELECT e.col, e.row, q.bin, count(c.r) AS n FROM e CROSS JOIN range(50) q(bin) LEFT JOIN c ON c.col=e.col AND c.row=e.row AND c.bin=q.bin GROUP BY 1,2,3),
    p AS (SELECT *, sum(n) OVER (PARTITION BY col,row ORDER BY bin DESC) AS passed, sum(n) OVER (PARTITION BY col,row) AS al FROM hh),
    k AS (SELECT *, max(CASE WHEN passed*10>=al THEN n END) OVER (PARTITION BY col,row ORDER BY bin DESC) AS peak FROM p),
    t AS (SELECT col,row, CAST(coalesce(max(CASE WHEN passed*10>=al AND n*10<peak AND bin>0 THEN bin END),49) AS INT) AS threshold FROM k GROUP BY 1,2)
    SELECT c.col, c.row, threshold, {R('avg(CASE WHEN g>=threshold*1311 THEN r END)')} AS r, {R('avg(CASE WHEN g>=threshold*1311 THEN g END)')} AS g FROM c JOIN t ON t.col=c.col AND t.row=c.row GROUP BY 1,2,3"""))
def a6w(spark, d):
    return rounded(A.white_grid(X.raster(spark, d).withColumns({c: F.col(c) * 257 for c in "rgb"}), *X.sizes(spark, d), 5, 4).select("col", "row", "threshold", "r", "g"))


@query("a7_histogram_fix", sql("stack", f"""WITH v AS (SELECT dataset, light_id % 3 AS channel, CAST(greatest(0,least(floor((r/150+1)/0.05::DOUBLE),59)) AS INT) AS bin FROM stack), c AS (SELECT dataset, channel, bin, count(*) AS n FROM v GROUP BY 1,2,3),
    k AS (SELECT *, sum(n) OVER (PARTITION BY dataset,channel ORDER BY bin) AS below, sum(n) OVER (PARTITION BY dataset,channel) AS al FROM c), p AS (SELECT dataset, channel, min(bin) AS bin FROM k WHERE below*20>=al*19 GROUP BY 1,2)
    SELECT dataset, {R('max(bin*0.05::DOUBLE-1)')} AS p95, {R('CASE WHEN max(bin*0.05::DOUBLE-1)>1 THEN 1/max(bin*0.05::DOUBLE-1) ELSE 1 END')} AS scale FROM p GROUP BY 1"""))
def a7(spark, d):
    return rounded(A.histogram_fix(X.stack(spark, d).select("dataset", (F.col("light_id") % 3).alias("channel"), (F.col("r") / 150).alias("v"))))


@query("a8_mean_light_distance", sql("stack lightpos", f"""SELECT l.dataset, {R('avg(px*px+py*py+pz*pz)')} AS d2, count(*) AS n FROM stack s JOIN lightpos l ON l.dataset=s.dataset AND l.light_id=s.light_id GROUP BY 1"""))
def a8(spark, d):
    n = X.stack(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.mean_light_distance(X.lights(spark, d)).join(n, "dataset"))


@query("a8_average_directions", sql("truth", f"""SELECT dataset, CAST(k % 16 AS INT) AS light_id, {R('coalesce(avg(CASE WHEN k % 4 <> 0 THEN nx END),0)')} AS lx, {R('coalesce(avg(CASE WHEN k % 4 <> 0 THEN ny END),0)')} AS ly, {R('coalesce(avg(CASE WHEN k % 4 <> 0 THEN nz END),0)')} AS lz FROM truth GROUP BY 1,2"""))
def a8d(spark, d):
    on = F.col("k") % 4 != 0
    rows = X.truth(spark, d).select("dataset", (F.col("k") % 16).cast("int").alias("light_id"), *(F.when(on, F.col(a)).otherwise(0.0).alias(b) for a, b in (("nx", "lx"), ("ny", "ly"), ("nz", "lz"))))
    return rounded(A.average_directions(rows))


@query("a9_pixel_size", sql("measures", f"""SELECT dataset, {R('avg(length/sqrt(pow(x2-x1,2)+pow(y2-y1,2)))')} AS pixel_size, {R('avg(length/sqrt(pow(x2-x1,2)+pow(y2-y1,2)))*1000', 3)} AS image_width FROM measures WHERE sqrt(pow(x2-x1,2)+pow(y2-y1,2))>0 AND length>0 GROUP BY 1"""))
def a9(spark, d):
    return rounded(rounded(A.pixel_size(X.measures(spark, d), 1000), "image_width", digits=3), "pixel_size")


@query("a10_mean_offsets", sql("sparse lights", f"""WITH o AS (SELECT light_id, avg(r) AS ox, avg(g) AS oy FROM sparse GROUP BY 1) SELECT l.light_id, {R('coalesce(ox,0)')} AS ox, {R('coalesce(oy,0)')} AS oy FROM lights l LEFT JOIN o ON o.light_id=l.light_id WHERE l.dataset='F'"""))
def a10(spark, d):
    marks = X.sparse(spark, d).select("dataset", "light_id", F.col("r").alias("ox"), F.col("g").alias("oy"))
    return rounded(A.mean_offsets(marks, X.lights(spark, d, ("d",))).select("light_id", "ox", "oy"))


_RB = "WITH q AS (SELECT dataset, x-w/2.0::DOUBLE AS u, h/2.0::DOUBLE-y AS v, nx, ny, nz FROM truth, w WHERE nz>=0.7171), r AS (SELECT dataset, CAST(floor(sqrt(u*u+v*v+1)/10) AS INT) AS bin, count(*) AS n, avg((u*nx+v*ny+nz)/sqrt(u*u+v*v+1)) AS slope FROM q GROUP BY 1,2)"


@query("a11_radial_bins", sql("truth", f"{_RB} SELECT dataset, bin, n, {R('slope')} AS slope FROM r"))
def a11(spark, d):
    return rounded(A.radial_bins(X.truth(spark, d), *X.sizes(spark, d), 10.0))


@query("a11_radial_line", sql("truth", f"{_RB} SELECT dataset, {R('regr_slope(slope,(bin+0.5)*10)',8)} AS m, {R('regr_intercept(slope,(bin+0.5)*10)')} AS q FROM r GROUP BY 1"))
def a11l(spark, d):
    return rounded(rounded(A.radial_line(A.radial_bins(X.truth(spark, d), *X.sizes(spark, d), 10.0), 10.0), "m", digits=8), "q")


_CIRCLE = """WITH s AS (SELECT sphere_id, CAST(count(*) AS DOUBLE) n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(y*y) syy, sum(x*y) sxy, sum(x*x*x) sxxx, sum(y*y*y) syyy, sum(x*y*y) sxyy, sum(x*x*y) sxxy FROM border GROUP BY 1),
    t AS (SELECT *, n*sxx-sx*sx AS a, n*sxy-sx*sy AS b, n*syy-sy*sy AS d, (n*(sxxx+sxyy)-sx*(sxx+syy))/2 AS e, (n*(sxxy+syyy)-sy*(sxx+syy))/2 AS f FROM s),
    c AS (SELECT sphere_id, n, (e*d-b*f)/(a*d-b*b) AS cx, (a*f-b*e)/(a*d-b*b) AS cy, sx, sy, sxx, syy FROM t WHERE n>=3),
    k AS (SELECT sphere_id, CAST(n AS BIGINT) AS n, cx, cy, sqrt(cx*cx+cy*cy+(sxx+syy-2*cx*sx-2*cy*sy)/n) AS radius FROM c)"""


@query("a13_fit_circle", sql("border", f"{_CIRCLE} SELECT sphere_id, n, {R('cx',4)} AS cx, {R('cy',4)} AS cy, {R('radius',4)} AS radius FROM k"))
def a13(spark, d):
    return rounded(A.fit_circle(X.border(spark, d)).drop("dataset"), digits=4)


@query("a15_shared_ranges", sql("sparse", f"""WITH p AS (SELECT CAST(x % 3 AS INT) AS ds, light_id AS plane, avg(r)+1 AS scale, avg(g)/255 AS bias FROM sparse GROUP BY 1,2) SELECT plane, {R('min(-bias*scale)')} AS vmin, {R('max((1-bias)*scale)')} AS vmax FROM p GROUP BY 1"""))
def a15(spark, d):
    planes = X.sparse(spark, d).groupBy((F.col("x") % 3).cast("string").alias("dataset"), F.col("light_id").alias("plane")).agg((F.avg("r") + 1).alias("scale"), (F.avg("g") / 255).alias("bias"))
    return rounded(A.shared_ranges(planes))


@query("a16_circle_residual", sql("border", f"{_CIRCLE} SELECT b.sphere_id, {R('sqrt(avg(pow(sqrt(pow(x-cx,2)+pow(y-cy,2))-radius,2)))/max(radius)')} AS residual, sqrt(avg(pow(sqrt(pow(x-cx,2)+pow(y-cy,2))-radius,2)))/max(radius) < 0.05 AS ill FROM border b JOIN k ON k.sphere_id=b.sphere_id GROUP BY 1"))
def a16(spark, d):
    return rounded(A.circle_residual(X.border(spark, d)).drop("dataset"))
