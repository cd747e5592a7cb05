"""Queries on light bases, fits, quantising, rendering and quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import light_bases as LB
from ..functions.algebra import pinv
from ..operators import fit as C
from ..operators import render as V
from . import fixtures as X
from .core import R, rounded
from .fixtures import LIGHTS, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def values(name: str, columns: str, rows) -> str:
    """A small matrix made on the driver, as a table expression."""
    body = ", ".join("(" + ", ".join(repr(float(v)) + "::DOUBLE" if isinstance(v, float | np.floating) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def long(coeff: DataFrame, digits: int = 4) -> DataFrame:
    """Coefficients a row each, rounded."""
    return rounded(coeff.select("dataset", "x", "y", F.posexplode("c").alias("p", "v")), digits=digits)


def matrix(name: str, m: np.ndarray) -> str:
    return values(name, "i, j, w", [(i, j, m[i, j]) for i in range(m.shape[0]) for j in range(m.shape[1])])


_PI = "pi()"
_L = "SELECT s.dataset, s.light_id, count(*) AS n, any_value(lx) AS lx, any_value(ly) AS ly, any_value(lz) AS lz FROM stack s JOIN lights l ON l.dataset=s.dataset AND l.light_id=s.light_id GROUP BY 1,2"


def _seen(spark, d) -> DataFrame:
    """The lights that the stack's samples have."""
    n = X.stack(spark, d).groupBy("dataset", "light_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(X.lights(spark, d), ["dataset", "light_id"])


def _terms(rows: DataFrame, w) -> DataFrame:
    return rounded(rows.select("dataset", "light_id", F.posexplode(w).alias("p", "v")))


@query("c1_ptm_weights", sql("stack", f"WITH s AS ({_L}) SELECT dataset, light_id, p, {R('[1.0::DOUBLE, lx, ly, lx*lx, lx*ly, ly*ly, lx*lx*lx, lx*lx*ly, lx*ly*ly][p+1]')} AS v FROM s, (SELECT CAST(range AS INT) AS p FROM range(9))"))
def c1(spark, d):
    return _terms(_seen(spark, d), LB.ptm_weights(F.col("lx"), F.col("ly"), 9))


@query("c2_hsh_weights", sql("stack", f"""WITH s AS ({_L}), a AS (SELECT *, CASE WHEN atan2(ly,lx)<0 THEN atan2(ly,lx)+2*{_PI} ELSE atan2(ly,lx) END AS f, cos(least(acos(lz),{_PI}/2-0.01)) AS c FROM s), b AS (SELECT *, sqrt(greatest(c-c*c,0)) AS q FROM a)
    SELECT dataset, light_id, p, {R(f'[1/sqrt(2*{_PI}), sqrt(6/{_PI})*cos(f)*q, sqrt(1.5/{_PI})*(2*c-1), sqrt(6/{_PI})*sin(f)*q, sqrt(30/{_PI})*cos(2*f)*(c*c-c), sqrt(30/{_PI})*cos(f)*(2*c-1)*q, sqrt(2.5/{_PI})*(1-6*c+6*c*c), sqrt(30/{_PI})*sin(f)*(2*c-1)*q, sqrt(30/{_PI})*sin(2*f)*(c*c-c)][p+1]')} AS v FROM b, (SELECT CAST(range AS INT) AS p FROM range(9))"""))
def c2(spark, d):
    return _terms(_seen(spark, d), LB.hsh_weights(F.col("lx"), F.col("ly"), F.col("lz")))


@query("c3_sh_weights", sql("stack", f"""WITH s AS ({_L}), a AS (SELECT *, atan2(ly,lx) AS f, lz AS c, sqrt(1-lz*lz) AS q, 0.5*sqrt(3/{_PI}) AS ka, sqrt(15/{_PI}) AS kb FROM s)
    SELECT dataset, light_id, p, {R(f'[0.5/sqrt({_PI}), ka*sin(f)*q, ka*c, ka*cos(f)*q, 0.25*kb*sin(2*f)*q*q, 0.5*kb*q*c*sin(f), 0.25*sqrt(5/{_PI})*(3*c*c-1), 0.5*kb*q*c*cos(f), 0.25*kb*q*q*cos(2*f)][p+1]')} AS v FROM a, (SELECT CAST(range AS INT) AS p FROM range(9))"""))
def c3(spark, d):
    return _terms(_seen(spark, d), LB.sh_weights(F.col("lx"), F.col("ly"), F.col("lz")))


@query("c4_rbf_weights", sql("truth lights", f"""WITH q AS (SELECT k, nx, ny, nz FROM truth), e AS (SELECT k, light_id, exp(-((nx-lx)*(nx-lx)+(ny-ly)*(ny-ly)+(nz-lz)*(nz-lz))/0.09::DOUBLE) AS e FROM q, lights WHERE lights.dataset='P'),
    f AS (SELECT *, e/sum(e) OVER (PARTITION BY k) AS w FROM e) SELECT k, light_id, {R('w/sum(w) OVER (PARTITION BY k)')} AS weight FROM f WHERE w>0.001"""))
def c4(spark, d):
    return rounded(C.rbf_weight_rows(X.truth(spark, d), LIGHTS, 0.3, keys=("k",)))


@query("c5_bilinear_weights", sql("truth", f"""WITH u AS (SELECT k, greatest(0,least(((nx+ny)/(abs(nx)+abs(ny)+abs(nz))+1)/2*7,7)) AS u, greatest(0,least(((ny-nx)/(abs(nx)+abs(ny)+abs(nz))+1)/2*7,7)) AS v FROM truth), f AS (SELECT *, least(floor(u),6) AS i, least(floor(v),6) AS j FROM u)
    SELECT k, CAST((j+dy)*8+i+dx AS INT) AS node, {R('(CASE WHEN dx=1 THEN u-i ELSE 1-(u-i) END)*(CASE WHEN dy=1 THEN v-j ELSE 1-(v-j) END)')} AS weight FROM f, range(2) a(dx), range(2) b(dy)"""))
def c5(spark, d):
    w = LB.bilinear_weights(F.col("nx"), F.col("ny"), F.col("nz"), 8)
    return rounded(X.truth(spark, d).select("k", F.explode(w).alias("c")).select("k", "c.node", "c.weight"))


@query("l9_octahedral_map", sql("truth", f"""SELECT k, {R('greatest(0,least(((nx+ny)/(abs(nx)+abs(ny)+abs(nz))+1)/2*7,7))')} AS u, {R('greatest(0,least(((ny-nx)/(abs(nx)+abs(ny)+abs(nz))+1)/2*7,7))')} AS v FROM truth"""))
def l9(spark, d):
    u, v = LB.to_octa(F.col("nx"), F.col("ny"), F.col("nz"), 8)
    return rounded(X.truth(spark, d).select("k", u.alias("u"), v.alias("v")))


_PTM = pinv(C.weights_of(LIGHTS, "ptm", 6))
_CH = "unnest([r,g,b]) AS v, unnest([0,1,2]) AS ch"


def _fit_sql(m: np.ndarray) -> str:
    return sql("stack", f"WITH {matrix('m', m)}, c AS (SELECT dataset, x, y, light_id, {_CH} FROM stack) SELECT dataset, x, y, CAST(i*3+ch AS INT) AS p, {R('sum(w*v)', 4)} AS v FROM c JOIN m ON j=light_id GROUP BY 1,2,3,4")


@query("c8_fit_ptm", _fit_sql(_PTM))
def c8(spark, d):
    return long(C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6))


@query("c8_fit_hsh", _fit_sql(pinv(C.weights_of(LIGHTS, "hsh", 9))))
def c8h(spark, d):
    return long(C.fit_poly(X.pixels(spark, d), LIGHTS, "hsh", 9))


@query("c8_fit_sh", _fit_sql(pinv(C.weights_of(LIGHTS, "sh", 9))))
def c8s(spark, d):
    return long(C.fit_poly(X.pixels(spark, d), LIGHTS, "sh", 9))


_WL = 0.25 - (np.arcsin(LIGHTS[:, 2]) / (np.pi / 2) - 0.5) ** 2


@query("c9_fit_lrgb", sql("stack", f"""WITH {matrix('m', _PTM)}, {values('wl', 'light_id, u', [(i, v) for i, v in enumerate(_WL / _WL.sum())])},
    b AS (SELECT dataset, x, y, sum(u*r) AS br, sum(u*g) AS bg, sum(u*b) AS bb FROM stack JOIN wl ON wl.light_id=stack.light_id GROUP BY 1,2,3)
    SELECT dataset, x, y, p, {R('v', 4)} AS v FROM (SELECT dataset, x, y, unnest([br,bg,bb]) AS v, unnest([0,1,2])::INT AS p FROM b
    UNION ALL SELECT s.dataset, s.x, s.y, sum(w*(r+g+b)/((br+bg+bb)/255)) AS v, CAST(i+3 AS INT) AS p FROM stack s JOIN b ON b.dataset=s.dataset AND b.x=s.x AND b.y=s.y JOIN m ON j=light_id GROUP BY 1,2,3,5)"""))
def c9(spark, d):
    return long(C.fit_lrgb(X.pixels(spark, d), LIGHTS, 6))


@query("c10_fit_ycc", sql("stack", f"""WITH {matrix('m', _PTM)}, t AS (SELECT dataset, x, y, i, sum(w*r)/255 AS r, sum(w*g)/255 AS g, sum(w*b)/255 AS b FROM stack JOIN m ON j=light_id GROUP BY 1,2,3,4),
    q AS (SELECT *, 0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b AS yy FROM t)
    SELECT dataset, x, y, CAST(i AS INT) AS p, {R('yy', 4)} AS v FROM q UNION ALL SELECT dataset, x, y, 6, {R('avg((b-yy)/1.772::DOUBLE+0.5)', 4)} FROM q WHERE i<3 GROUP BY 1,2,3 UNION ALL SELECT dataset, x, y, 7, {R('avg((r-yy)/1.402::DOUBLE+0.5)', 4)} FROM q WHERE i<3 GROUP BY 1,2,3"""))
def c10(spark, d):
    return long(C.fit_ycc(C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6), 6))


_MAP = C.resample_map(LIGHTS, 8, 0.3)


@query("c6_c7_resample", sql("stack", f"""WITH {matrix('m', _MAP)} SELECT dataset, x, y, CAST(i AS INT) AS p, {R('sum(w*r)', 4)} AS v FROM stack JOIN m ON j=light_id GROUP BY 1,2,3,4"""))
def c7(spark, d):
    return long(C.resample(X.pixels(spark, d), _MAP).withColumn("c", F.col("r")))


def _nodes() -> str:
    """The terms' maps at the grid's nodes for each size of the raster: seen from pixels of 0.1 mm, lights at POSITIONS."""
    rows = []
    for w, h in ((50, 30), (150, 100), (500, 300)):
        for n, d in enumerate(C.node_lights(X.POSITIONS, w, h, 0.1)):
            rows.append(f"({w}, {n}, '{' '.join(repr(float(v)) for v in np.linalg.pinv(C.weights_of(d, 'ptm', 6)).ravel())}')")
    split = "CAST(string_split(t, ' ') AS DOUBLE[])"
    return f"m AS (SELECT size, node, (p-1)//16 AS i, (p-1)%16 AS j, k FROM (SELECT size, node, unnest({split}) AS k, generate_subscripts({split}, 1) AS p FROM (VALUES {', '.join(rows)}) z(size, node, t)))"


@query("c14_fit_positional", sql("stack", f"""WITH {_nodes()}, u AS (SELECT s.dataset, s.x, s.y, light_id, r, g, b, w.w AS size, 14.0::DOUBLE*x/w.w AS u, 14.0::DOUBLE*y/h AS v FROM stack s, w),
    f AS (SELECT *, least(floor(u), 13) AS a, least(floor(v), 13) AS c FROM u), n AS (SELECT f.*, CAST((c+dy)*15+a+dx AS INT) AS node, (CASE WHEN dx=1 THEN u-a ELSE 1-(u-a) END)*(CASE WHEN dy=1 THEN v-c ELSE 1-(v-c) END) AS share FROM f, range(2) p(dx), range(2) q(dy)),
    t AS (SELECT dataset, x, y, i, sum(share*k*r) AS r, sum(share*k*g) AS g, sum(share*k*b) AS b FROM n JOIN m ON m.size=n.size AND m.node=n.node AND m.j=n.light_id GROUP BY 1,2,3,4)
    SELECT dataset, x, y, CAST(i*3+ch AS INT) AS p, {R('CASE ch WHEN 0 THEN r WHEN 1 THEN g ELSE b END', 4)} AS v FROM t, range(3) e(ch)"""))
def c14(spark, d):
    w, h = X.sizes(spark, d)
    return long(C.fit_poly_3d(X.pixels(spark, d), X.POSITIONS, "ptm", 6, width=w, height=h, pixel=0.1))


@query("c15_sample_pixels", sql("raster", "SELECT y, CAST(w // 4 AS BIGINT) AS n FROM raster, w GROUP BY y, w"))
def c15(spark, d):
    w, h = X.sizes(spark, d)
    return C.sample_pixels(X.pixels(spark, d, "d"), w, h, 500, 48).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query("a12_covariance_trace", """WITH v AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), q AS (SELECT vec_id, greatest(0.0::DOUBLE, least(255.0::DOUBLE, round(127.5+255*CAST(e AS DOUBLE)))) AS v, i FROM v)
    SELECT round(3*sum(s), 3) AS trace FROM (SELECT i, var_samp(v) AS s FROM q GROUP BY i)""")
def a12(spark, d):
    _, cov = C.covariance(X.vectors(spark, d), ["r", "g", "b"])
    n = X.vectors(spark, d).limit(1)
    return n.select(F.round(F.lit(float(np.trace(cov))), 3).alias("trace"))


@query("c11_pca_basis")
def c11(spark, d):
    pixels = X.vectors(spark, d)
    mean, basis = C.pca_basis(pixels, 9)
    return long(C.project(pixels, mean, basis), 3)


@query("c12_pca_basis_ycc")
def c12(spark, d):
    pixels = X.vectors(spark, d)
    return long(C.project_ycc(pixels, C.pca_basis_ycc(pixels, (5, 2, 2)), (5, 2, 2)), 3)


_AXES = np.linalg.qr(np.random.default_rng(3).normal(size=(48, 4)))[0].T


@query("c13_project", sql("stack", f"""WITH {matrix('m', _AXES)}, c AS (SELECT dataset, x, y, light_id, {_CH} FROM stack) SELECT dataset, x, y, CAST(i AS INT) AS p, {R('sum(w*(v-100))', 4)} AS v FROM c JOIN m ON j=ch*16+light_id GROUP BY 1,2,3,4"""))
def c13(spark, d):
    return long(C.project(X.pixels(spark, d), np.full(48, 100.0), _AXES))


_PLANES = "p AS (SELECT dataset, light_id AS plane, min(r) AS lo, max(r) AS hi FROM stack GROUP BY 1,2), z AS (SELECT dataset, plane, (hi-lo)/255 AS scale, -lo/(hi-lo) AS bias, lo, hi FROM p)"


def _planes(spark, d) -> DataFrame:
    ranges = X.stack(spark, d).groupBy("dataset", F.col("light_id").alias("plane")).agg(F.min("r").alias("vmin"), F.max("r").alias("vmax"))
    return C.finalize_planes(ranges)


def _coeff(spark, d) -> DataFrame:
    return X.pixels(spark, d).select("dataset", "x", "y", F.col("r").alias("c"))


@query("c16_finalize_planes", sql("stack", f"""WITH p AS (SELECT dataset, light_id AS plane, min(r) AS lo, max(r) AS hi FROM stack GROUP BY 1,2), q AS (SELECT dataset, plane, min(lo) OVER (PARTITION BY dataset, plane//3) AS lo, max(hi) OVER (PARTITION BY dataset, plane//3) AS hi FROM p)
    SELECT dataset, plane, {R('lo')} AS vmin, {R('hi')} AS vmax, {R('CASE WHEN plane<3 THEN 1 ELSE (hi-lo)/255 END')} AS scale, {R('CASE WHEN plane<3 THEN 0 ELSE -lo/(hi-lo) END')} AS bias FROM q"""))
def c16(spark, d):
    ranges = X.stack(spark, d).groupBy("dataset", F.col("light_id").alias("plane")).agg(F.min("r").alias("vmin"), F.max("r").alias("vmax"))
    return rounded(C.finalize_planes(ranges, common=True, base=3))


_Q = "CAST(greatest(0,least(trunc(round(255*(r/255/scale+bias),9)),255)) AS INT)"


@query("c19_quantize", sql("stack", f"WITH {_PLANES} SELECT s.dataset, x, y, light_id AS p, {_Q} AS q, {R(f'255*({_Q}/255.0::DOUBLE-bias)*scale')} AS v FROM stack s JOIN z ON z.dataset=s.dataset AND z.plane=s.light_id"))
def c19(spark, d):
    planes = _planes(spark, d)
    coded = C.quantize(_coeff(spark, d), planes)
    both = coded.join(C.dequantize(coded, planes), ["dataset", "x", "y"])
    return rounded(both.select("dataset", "x", "y", F.posexplode(F.arrays_zip("q", "c")).alias("p", "e")).select("dataset", "x", "y", "p", "e.q", F.col("e.c").alias("v")))


@query("c17_merge_rtis", sql("stack", f"""WITH {_PLANES}, g AS (SELECT plane, min(-bias*scale) AS lo, max((1-bias)*scale) AS hi FROM z GROUP BY 1), q AS (SELECT s.dataset, x, y, light_id, {_Q} AS q, scale, bias FROM stack s JOIN z ON z.dataset=s.dataset AND z.plane=s.light_id)
    SELECT dataset, x, y, light_id AS p, CAST(greatest(0,least(trunc(round(255*((q/255.0::DOUBLE-bias)*scale/(hi-lo)-lo/(hi-lo)),9)),255)) AS INT) AS q FROM q JOIN g ON plane=light_id"""))
def c17(spark, d):
    planes = _planes(spark, d)
    merged, _ = C.merge_rtis(C.quantize(_coeff(spark, d), planes), planes)
    return merged.select("dataset", "x", "y", F.posexplode("q").alias("p", "q"))


_BASIS = "b AS (SELECT 'd' AS dataset, CAST(plane AS INT) AS plane, CAST(dim AS INT) AS dim, v FROM (SELECT x % 5 AS plane, light_id AS dim, CASE WHEN x % 5 = 0 THEN avg(r) ELSE (avg(r)-100)/300 END AS v FROM stack GROUP BY 1,2))"


@query("c18_quantize_basis", sql("stack", f"WITH {_BASIS}, r AS (SELECT plane, 127/max(abs(v)) AS rg FROM b WHERE plane>0 GROUP BY 1) SELECT b.plane, dim, CAST(trunc(CASE WHEN b.plane=0 THEN round(v,9) ELSE round(127+rg*v,9) END) AS INT) AS q, {R('rg')} AS range FROM b LEFT JOIN r ON r.plane=b.plane"))
def c18(spark, d):
    v = F.avg("r")
    b = X.stack(spark, d).groupBy((F.col("x") % 5).alias("plane"), F.col("light_id").alias("dim")).agg(v.alias("v"))
    b = b.select(F.lit("d").alias("dataset"), "plane", "dim", F.when(F.col("plane") == 0, F.col("v")).otherwise((F.col("v") - 100) / 300).alias("value"))
    return rounded(C.quantize_basis(b).select("plane", "dim", "q", "range"))


@query("c20_legacy_order", sql("sparse", f"""WITH t AS (SELECT light_id AS term, avg(r) AS scale, avg(g)/255 AS bias FROM sparse WHERE light_id<6 GROUP BY 1), o AS (SELECT * FROM (VALUES (5,0),(3,1),(4,2),(0,3),(2,4),(1,5)) v(term, inn))
    SELECT CAST(inn*3+ch AS INT) AS plane, {R('scale')} AS scale, {R('bias')} AS bias FROM t JOIN o ON o.term=t.term, range(3) c(ch)"""))
def c20(spark, d):
    t = X.sparse(spark, d).where("light_id < 6").groupBy("dataset", F.col("light_id").alias("term")).agg(F.avg("r").alias("scale"), (F.avg("g") / 255).alias("bias"))
    return rounded(C.legacy_to_planes(t).drop("dataset"))


@query("c20_planes_to_legacy", sql("sparse", f"SELECT light_id AS term, {R('avg(r)')} AS scale, CAST(floor(avg(g)+0.5) AS INT) AS bias FROM sparse WHERE light_id<6 GROUP BY 1"))
def c20b(spark, d):
    t = X.sparse(spark, d).where("light_id < 6").groupBy("dataset", F.col("light_id").alias("term")).agg(F.avg("r").alias("scale"), (F.avg("g") / 255).alias("bias"))
    return rounded(C.planes_to_legacy(C.legacy_to_planes(t)).drop("dataset"))


# Rendering and quality

_REQ = np.array([[0.1, 0.2, 0.0], [-0.3, 0.1, 0.0], [0.0, -0.4, 0.0]])
_REQ[:, 2] = np.sqrt(1 - (_REQ**2).sum(axis=1))
_WR = C.weights_of(_REQ, "ptm", 6) @ _PTM
_WA = C.weights_of(LIGHTS, "ptm", 6) @ _PTM
_BYTE = lambda e: f"CAST(greatest(0,least(trunc(round({e},9)),255)) AS INT)"


@query("r1_illuminate_rgb", sql("stack", f"WITH {matrix('m', _WR)} SELECT dataset, CAST(i AS INT) AS light_id, x, y, {_BYTE('round(sum(w*r),5)')} AS r, {_BYTE('round(sum(w*g),5)')} AS g, {_BYTE('round(sum(w*b),5)')} AS b FROM stack JOIN m ON j=light_id GROUP BY 1,2,3,4"))
def r1(spark, d):
    c = C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6).withColumn("c", F.transform("c", lambda v: F.round(v, 8)))
    return V.illuminate(c, V.light_rows(spark, C.weights_of(_REQ, "ptm", 6)))


@query("j3_coefficients_by_lights", sql("ord", "SELECT CAST(i AS INT) AS light_id, count(*) AS n FROM ord, range(3) a(i) GROUP BY 1"))
def j3(spark, d):
    c = C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6)
    return V.illuminate(c, V.light_rows(spark, C.weights_of(_REQ, "ptm", 6))).groupBy("light_id").agg(F.count(F.lit(1)).alias("n"))


@query("r1_illuminate_lrgb", sql("stack", f"""WITH {matrix('m', _WR)}, {values('wl', 'light_id, u', [(i, v) for i, v in enumerate(_WL / _WL.sum())])}, b AS (SELECT dataset, x, y, sum(u*r) AS br, sum(u*g) AS bg, sum(u*b) AS bb FROM stack JOIN wl ON wl.light_id=stack.light_id GROUP BY 1,2,3),
    l AS (SELECT s.dataset, s.x, s.y, i, any_value(br) AS br, any_value(bg) AS bg, any_value(bb) AS bb, sum(w*(r+g+b))/any_value((br+bg+bb)/255) AS luma FROM stack s JOIN b ON b.dataset=s.dataset AND b.x=s.x AND b.y=s.y JOIN m ON j=light_id GROUP BY 1,2,3,4)
    SELECT dataset, CAST(i AS INT) AS light_id, x, y, {_BYTE('luma*br/255')} AS r, {_BYTE('luma*bg/255')} AS g, {_BYTE('luma*bb/255')} AS b FROM l"""))
def r1l(spark, d):
    return V.illuminate(C.fit_lrgb(X.pixels(spark, d), LIGHTS, 6), V.light_rows(spark, C.weights_of(_REQ, "ptm", 6)), "lrgb")


@query("r1_illuminate_ycc", sql("stack", f"""WITH {matrix('m', _WR)}, {matrix('q', _PTM[:3])}, t AS (SELECT dataset, x, y, q.i, sum(w*r)/255 AS r, sum(w*g)/255 AS g, sum(w*b)/255 AS b FROM stack JOIN q ON j=light_id GROUP BY 1,2,3,4),
    k AS (SELECT dataset, x, y, avg((b-(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b))/1.772::DOUBLE) AS cb, avg((r-(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b))/1.402::DOUBLE) AS cr FROM t GROUP BY 1,2,3),
    l AS (SELECT dataset, x, y, i, sum(w*(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b))/255 AS yy FROM stack JOIN m ON j=light_id GROUP BY 1,2,3,4)
    SELECT l.dataset, CAST(i AS INT) AS light_id, l.x, l.y, {_BYTE('255*(yy+1.402::DOUBLE*cr)')} AS r, {_BYTE('255*(yy-0.299::DOUBLE*(yy+1.402::DOUBLE*cr)-0.114::DOUBLE*(yy+1.772::DOUBLE*cb))/0.587::DOUBLE')} AS g, {_BYTE('255*(yy+1.772::DOUBLE*cb)')} AS b FROM l JOIN k ON k.dataset=l.dataset AND k.x=l.x AND k.y=l.y"""))
def r1y(spark, d):
    return V.illuminate(C.fit_ycc(C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6), 6), V.light_rows(spark, C.weights_of(_REQ, "ptm", 6)), "ycc")


def _pca_lights(spark, d, n):
    pixels = X.pixels(spark, d)
    mean, basis = C.pca_basis(pixels, n)
    of = lambda v: np.stack([v[c * 16 + np.arange(16)] for c in range(3)], axis=1)
    w = np.stack([of(b) for b in basis], axis=1).reshape(16, n * 3)
    return C.project(pixels, mean, basis), V.light_rows(spark, w, of(mean))


@query("r1_illuminate_mrgb")
def r1m(spark, d):
    c, rows = _pca_lights(spark, d, 6)
    return V.illuminate(c, rows, "mrgb")


@query("r1_illuminate_mycc")
def r1my(spark, d):
    pixels, planes = X.pixels(spark, d), (5, 2, 2)
    bases, order = C.pca_basis_ycc(pixels, planes), C.ycc_plane_order(planes)
    coeff = C.project_ycc(pixels, bases, planes)
    w = np.stack([bases[c][1][p] for c, p in order], axis=1)
    return V.illuminate(coeff, V.light_rows(spark, w, np.stack([m for m, _ in bases], axis=1)), "mycc", base=planes[1])


@query("c7_resample_positional")
def c7p(spark, d):
    w, h = X.sizes(spark, d)
    at = C.node_lights(X.POSITIONS, w, h, 0.1)
    maps = np.stack([C.resample_map(v, 8, 0.3) for v in at])
    return long(C.blended(X.pixels(spark, d), maps, w, h))


_ERR = f"e AS (SELECT s.dataset, i AS light_id, s.x, s.y, {_BYTE('round(sum(w*s.r),5)')} AS r, {_BYTE('round(sum(w*s.g),5)')} AS g, {_BYTE('round(sum(w*s.b),5)')} AS b FROM stack s JOIN m ON j=s.light_id GROUP BY 1,2,3,4), q AS (SELECT s.dataset, s.light_id, s.x, s.y, pow(s.r-e.r,2)+pow(s.g-e.g,2)+pow(s.b-e.b,2) AS d2 FROM stack s JOIN e ON e.dataset=s.dataset AND e.light_id=s.light_id AND e.x=s.x AND e.y=s.y)"


def _errors(spark, d):
    c = C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6, keep=True).withColumn("c", F.transform("c", lambda v: F.round(v, 8)))
    return V.pixel_errors(c, C.weights_of(LIGHTS, "ptm", 6))


@query("q1_reconstruction_error", sql("stack", f"WITH {matrix('m', _WA)}, {_ERR} SELECT dataset, light_id, {R('avg(d2)/3', 4)} AS mse, {R('20*log10(255)-10*log10(avg(d2)/3)', 4)} AS psnr, {R('sqrt(avg(d2)/3)', 4)} AS rmse FROM q GROUP BY 1,2"))
def q1(spark, d):
    return rounded(V.light_errors(_errors(spark, d))[0], digits=4)


@query("q2_error_map", sql("stack", f"WITH {matrix('m', _WA)}, {_ERR} SELECT dataset, x, y, {R('sqrt(sum(d2)/48)', 4)} AS error FROM q GROUP BY 1,2,3"))
def q2(spark, d):
    return rounded(V.pixel_error_map(_errors(spark, d)), digits=4)


@query("q2_error_ramp", sql("stack", f"""WITH {matrix('m', _WA)}, {_ERR}, t AS (SELECT dataset, x, y, CAST(floor(255*least(greatest(round(sqrt(sum(d2)/48), 4)/4, 0), 1)) AS INT) AS t FROM q GROUP BY 1,2,3)
    SELECT dataset, x, y, CASE WHEN t<128 THEN 0 ELSE 2*t-256 END AS r, CASE WHEN t<128 THEN 2*t ELSE 511-2*t END AS g, CASE WHEN t<128 THEN 255-2*t ELSE 0 END AS b FROM t"""))
def q2r(spark, d):
    return V.error_ramp(rounded(V.pixel_error_map(_errors(spark, d)), digits=4), 0.0, 4.0)


_KEEP = [i for i in range(16) if i != 5]
_W5 = C.weights_of(LIGHTS[[5]], "ptm", 6) @ pinv(C.weights_of(LIGHTS[_KEEP], "ptm", 6))


@query("q3_leave_one_out", sql("stack", f"""WITH {values('m', 'j, w', [(_KEEP[j], _W5[0, j]) for j in range(15)])}, e AS (SELECT dataset, x, y, {_BYTE('round(sum(w*r),5)')} AS r, {_BYTE('round(sum(w*g),5)')} AS g, {_BYTE('round(sum(w*b),5)')} AS b FROM stack JOIN m ON j=light_id GROUP BY 1,2,3)
    SELECT e.dataset, {R('avg(pow(s.r-e.r,2)+pow(s.g-e.g,2)+pow(s.b-e.b,2))/3', 2)} AS mse FROM e JOIN stack s ON s.dataset=e.dataset AND s.x=e.x AND s.y=e.y AND s.light_id=5 GROUP BY 1"""))
def q3(spark, d):
    return rounded(V.leave_one_out(X.pixels(spark, d), LIGHTS, "ptm", 6, 5).select("dataset", "mse"), digits=2)


_LOO = []
for _k in range(16):
    _rest = [i for i in range(16) if i != _k]
    _row = C.weights_of(LIGHTS[[_k]], "ptm", 6) @ pinv(C.weights_of(LIGHTS[_rest], "ptm", 6))
    _LOO += [(_k, _rest[j], _row[0, j]) for j in range(15)]


@query("q3_every_light", sql("stack", f"""WITH {values('m', 'k, j, w', _LOO)}, e AS (SELECT dataset, k, x, y, {_BYTE('round(sum(w*r),5)')} AS r, {_BYTE('round(sum(w*g),5)')} AS g, {_BYTE('round(sum(w*b),5)')} AS b FROM stack JOIN m ON j=light_id GROUP BY 1,2,3,4)
    SELECT e.dataset, CAST(e.k AS INT) AS k, {R('avg(pow(s.r-e.r,2)+pow(s.g-e.g,2)+pow(s.b-e.b,2))/3', 2)} AS mse FROM e JOIN stack s ON s.dataset=e.dataset AND s.x=e.x AND s.y=e.y AND s.light_id=e.k GROUP BY 1,2"""))
def q3_all(spark, d):
    return rounded(V.leave_each_out(X.pixels(spark, d), LIGHTS, "ptm", 6).select("dataset", "k", "mse"), digits=2)


_W3 = C.weights_of(V.THREE, "ptm", 6) @ _PTM


@query("r2_normals_from_coefficients", sql("stack", f"""WITH {matrix('m', np.linalg.inv(V.THREE) @ _W3)}, n AS (SELECT dataset, x, y, sum(CASE WHEN i=0 THEN w*(r+g+b) END) AS a, sum(CASE WHEN i=1 THEN w*(r+g+b) END) AS b, sum(CASE WHEN i=2 THEN w*(r+g+b) END) AS c FROM stack JOIN m ON j=light_id GROUP BY 1,2,3)
    SELECT dataset, x, y, {R('a/sqrt(a*a+b*b+c*c)')} AS nx, {R('b/sqrt(a*a+b*b+c*c)')} AS ny, {R('c/sqrt(a*a+b*b+c*c)')} AS nz FROM n"""))
def r2(spark, d):
    return rounded(V.normals_from_coefficients(C.fit_poly(X.pixels(spark, d), LIGHTS, "ptm", 6), C.weights_of(V.THREE, "ptm", 6)))


@query("r3_hillshade", sql("heights", f"""WITH n AS (SELECT a.x, a.y, (CASE WHEN i=0 OR j=0 THEN 2 ELSE 1 END)*i*b.z AS gx, (CASE WHEN i=0 OR j=0 THEN 2 ELSE 1 END)*j*b.z AS gy FROM heights a, hw, (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j), heights b WHERE (i<>0 OR j<>0) AND b.x=greatest(0,least(a.x+i,w-1)) AND b.y=greatest(0,least(a.y+j,h-1))), g AS (SELECT x, y, sum(gx)/16 AS gx, sum(gy)/16 AS gy FROM n GROUP BY 1,2)
    SELECT x, y, {R('(-gx*0.3::DOUBLE-gy*0.4::DOUBLE+0.8660254::DOUBLE)/sqrt(gx*gx+gy*gy+1)')} AS shade FROM g"""))
def r3(spark, d):
    w, h = X.height_size(spark, d)
    return rounded(V.hillshade(X.heights(spark, d), w, h, (0.3, 0.4, 0.8660254), 2.0).drop("dataset"))


@query("r4_dstretch")
def r4(spark, d):
    return V.dstretch(X.raster(spark, d), *X.sizes(spark, d))


@query("r5_stack_planes", sql("raster", "SELECT x, CAST(y+p*h AS INT) AS y, CAST(p AS INT) AS plane, r FROM raster, w, range(3) a(p)"))
def r5(spark, d):
    from ..operators.pyramid import stack_planes

    _, h = X.sizes(spark, d)
    rows = X.raster(spark, d).withColumn("plane", F.explode(F.array(*map(F.lit, range(3)))))
    return stack_planes(rows, h).select("x", "y", "plane", "r")
