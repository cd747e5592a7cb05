"""Queries on lights from spheres, alignment, pyramids, robust normals, flattening, integration, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import gray
from ..operators import align as M
from ..operators import archive as AR
from ..operators import flatten as FL
from ..operators import integrate as I
from ..operators import lights as L
from ..operators import pyramid as T
from ..operators import robust as B
from ..operators.grids import gaussian_blur
from ..shared import shared_dir, stored
from ..sources import documents as D
from ..sources import formats as FM
from ..sources import images as IM
from ..sources import surfaces as SF
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


# Lights. Spheres are one for each nation of suppliers, on the raster of the orders' image.

_SPH = "spheres AS (SELECT CAST(n_nationkey AS INT) AS sphere_id, 20.0::DOUBLE + 4*n_nationkey AS cx, 30.0::DOUBLE + n_nationkey AS cy, 12.0::DOUBLE AS radius FROM nation)"


def _spheres(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return X.table(spark, d, "nation").select(F.lit("d").alias("dataset"), k.cast("int").alias("sphere_id"), (20.0 + 4 * k).alias("cx"), (30.0 + k).cast("double").alias("cy"), F.lit(12.0).alias("radius"))


def _photos(spark, d) -> DataFrame:
    """Samples of two images: the raster and its negative."""
    r = X.raster(spark, d)
    dark = r.select("dataset", F.lit(1).alias("light_id"), "x", "y", *((F.col(c) / 3).cast("int").alias(c) for c in "rgb"))
    return r.select("dataset", F.lit(0).alias("light_id"), "x", "y", "r", "g", "b").union(dark)


_IN = "12*sin(radians(50))"


@query("l1_inner_rect", f"WITH {_SPH} SELECT sphere_id, {R(_IN)} AS inner, CAST(floor(cx-{_IN}) AS INT) AS \"left\", CAST(floor(cy-{_IN}) AS INT) AS top, CAST(ceil(cx+{_IN}) AS INT) AS \"right\", CAST(ceil(cy+{_IN}) AS INT) AS bottom FROM spheres".replace(" AS inner", ' AS "inner"'))
def l1(spark, d):
    return rounded(L.inner_rect(_spheres(spark, d)).select("sphere_id", "inner", "left", "top", "right", "bottom"))


_FOUND = f"""{_SPH}, ph AS (SELECT 0 AS light_id, x, y, r, g, b FROM raster UNION ALL SELECT 1, x, y, r//3, g//3, b//3 FROM raster),
    q AS (SELECT sphere_id, light_id, x, y, (11*r+16*g+5*b)//32 AS v, ceil(cx+{_IN})-floor(cx-{_IN}) AS wide, (ceil(cx+{_IN})-floor(cx-{_IN}))*(ceil(cy+{_IN})-floor(cy-{_IN})) AS area FROM ph JOIN spheres ON x>=floor(cx-{_IN}) AND x<ceil(cx+{_IN}) AND y>=floor(cy-{_IN}) AND y<ceil(cy+{_IN}) AND pow(x-cx,2)+pow(y-cy,2)<=pow({_IN},2)),
    t AS (SELECT sphere_id, light_id, max(v) AS peak, max(area) AS area, max(wide) AS wide FROM q GROUP BY 1,2), k AS (SELECT t.sphere_id, t.light_id, th, peak, t.area, count(q.v) AS n, sum(x) AS sx, sum(y) AS sy FROM t, (SELECT 110+10*range AS th FROM range(14)), q WHERE q.sphere_id=t.sphere_id AND q.light_id=t.light_id AND q.v>=th GROUP BY ALL),
    b AS (SELECT sphere_id, light_id, coalesce(max(CASE WHEN n>=area/200 THEN th END), min(th)) AS th FROM k GROUP BY 1,2),
    fd AS (SELECT t.sphere_id, t.light_id, wide, CASE WHEN peak>=127 THEN z.th ELSE 0 END AS th, CASE WHEN peak>=127 THEN sx/CAST(n AS DOUBLE) ELSE 0 END AS hx, CASE WHEN peak>=127 THEN sy/CAST(n AS DOUBLE) ELSE 0 END AS hy FROM t LEFT JOIN (SELECT k.sphere_id, k.light_id, k.th, n, sx, sy FROM k JOIN b ON b.sphere_id=k.sphere_id AND b.light_id=k.light_id AND b.th=k.th) z ON z.sphere_id=t.sphere_id AND z.light_id=t.light_id)"""


@query("l2_detect_highlights", sql("raster", f"WITH {_FOUND} SELECT sphere_id, light_id, {R('hx')} AS hx, {R('hy')} AS hy FROM fd"))
def l2(spark, d):
    return rounded(L.detect_highlights(_photos(spark, d), _spheres(spark, d)).select("sphere_id", "light_id", "hx", "hy"))


def _refined_sql(rounds: int = 6) -> str:
    """Window after window: the barycentre of the bright pixels near the last one, until the window is small."""
    steps = ["r0 AS (SELECT *, ceil(wide/2.0::DOUBLE) AS radius, th=0 AS done FROM fd)"]
    for i in range(rounds):
        near = f"SELECT r.sphere_id, r.light_id, sum(q.v) AS n, sum(q.x*q.v) AS sx, sum(q.y*q.v) AS sy FROM r{i} r JOIN q ON q.sphere_id=r.sphere_id AND q.light_id=r.light_id AND q.v>=r.th AND abs(q.x-r.hx)<=radius AND abs(q.y-r.hy)<=radius WHERE NOT done GROUP BY 1,2"
        stop = "r.done OR coalesce(n,0)=0"
        steps.append(f"r{i + 1} AS (SELECT r.sphere_id, r.light_id, wide, th, CASE WHEN {stop} THEN hx ELSE sx/CAST(n AS DOUBLE) END AS hx, CASE WHEN {stop} THEN hy ELSE sy/CAST(n AS DOUBLE) END AS hy, ceil(radius/2) AS radius, {stop} OR radius<=ceil(0.02::DOUBLE*wide) AS done FROM r{i} r LEFT JOIN ({near}) z ON z.sphere_id=r.sphere_id AND z.light_id=r.light_id)")
    return ", ".join(steps) + f" SELECT sphere_id, light_id, round(hx, 6) + 0.0 AS hx, round(hy, 6) + 0.0 AS hy FROM r{rounds}"


@query("l3_refine_highlights", sql("raster", f"WITH {_FOUND}, {_refined_sql()}"))
def l3(spark, d):
    found = L.detect_highlights(_photos(spark, d), _spheres(spark, d))
    return rounded(L.refine_highlights(_photos(spark, d), _spheres(spark, d), found).select("sphere_id", "light_id", "hx", "hy"))


_HL = "hl AS (SELECT sphere_id, CAST(x % 16 AS INT) AS light_id, avg(x) AS hx, avg(y) AS hy, any_value(cx) AS cx, any_value(cy) AS cy FROM raster JOIN spheres ON pow(x-cx,2)+pow(y-cy,2)<100 AND r>200 GROUP BY 1,2)"


def _highlights(spark, d) -> DataFrame:
    s = _spheres(spark, d)
    rows = X.raster(spark, d).where("r > 200").join(F.broadcast(s), "dataset")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return rows.where(dx * dx + dy * dy < 100).groupBy("dataset", "sphere_id", (F.col("x") % 16).cast("int").alias("light_id")).agg(F.avg("x").alias("hx"), F.avg("y").alias("hy"))


_DIR = f"{_HL}, dr AS (SELECT sphere_id, light_id, (hx-cx)/12 AS a, (cy-hy)/12 AS b FROM hl), dd AS (SELECT sphere_id, light_id, a, b, sqrt(greatest(1-a*a-b*b,0)) AS c FROM dr), dl AS (SELECT sphere_id, light_id, 2*c*a AS lx, 2*c*b AS ly, 2*c*c-1 AS lz, a, b, c FROM dd)"


@query("l4_highlight_directions", sql("raster", f"WITH {_SPH}, {_DIR} SELECT sphere_id, light_id, {R('lx')} AS lx, {R('ly')} AS ly, {R('lz')} AS lz FROM dl"))
def l4(spark, d):
    return rounded(_directions(spark, d).select("sphere_id", "light_id", "lx", "ly", "lz"))


def _directions(spark, d) -> DataFrame:
    w, h = X.sizes(spark, d)
    return L.highlight_directions(_highlights(spark, d), _spheres(spark, d), width=w, height=h)


@query("l4_perspective_directions")
def l4p(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(L.highlight_directions(_highlights(spark, d), _spheres(spark, d), width=w, height=h, focal_px=400.0).select("sphere_id", "light_id", "lx", "ly", "lz"))


@query("l5_combine_directions", sql("raster", f"WITH {_SPH}, {_DIR} SELECT light_id, {R('avg(lx)')} AS lx, {R('avg(ly)')} AS ly, {R('avg(lz)')} AS lz FROM dl GROUP BY 1"))
def l5(spark, d):
    return rounded(L.combine_directions(_directions(spark, d)).drop("dataset"))


@query("l6_sphere_positions", sql("raster", f"WITH {_SPH}, {_DIR} SELECT light_id, {R('avg(lx)*300')} AS px, {R('avg(ly)*300')} AS py, {R('avg(lz)*300+20')} AS pz FROM dl GROUP BY 1"))
def l6(spark, d):
    return rounded(L.sphere_positions(L.combine_directions(_directions(spark, d)), 600.0, 20.0).select("light_id", "px", "py", "pz"))


def _rays(spark, d) -> DataFrame:
    rows = _directions(spark, d).join(F.broadcast(_spheres(spark, d)), ["dataset", "sphere_id"])
    return rows.select("dataset", "sphere_id", "light_id", "lx", "ly", "lz", (F.col("cx") + 12 * F.col("sx")).alias("ox"), (F.col("cy") + 12 * F.col("sy")).alias("oy"), (12 * F.col("sz")).alias("oz"))


_RAY = f"{_DIR}, ry AS (SELECT dl.sphere_id, light_id, lx, ly, lz, cx+12*a AS ox, cy+12*b AS oy, 12*c AS oz FROM dl JOIN spheres ON spheres.sphere_id=dl.sphere_id)"


@query("l7_dome_intersections", sql("raster", f"""WITH {_SPH}, {_RAY}, t AS (SELECT *, -(ox*lx+oy*ly+(oz-20)*lz)+sqrt(greatest(pow(ox*lx+oy*ly+(oz-20)*lz,2)-(ox*ox+oy*oy+pow(oz-20,2)-90000),0)) AS t FROM ry)
    SELECT light_id, {R('avg(ox+t*lx)', 4)} AS px, {R('avg(oy+t*ly)', 4)} AS py, {R('avg(oz+t*lz)', 4)} AS pz FROM t GROUP BY 1"""))
def l7(spark, d):
    return rounded(L.dome_intersections(_rays(spark, d), 600.0, 20.0).drop("dataset"), digits=4)


_NEAREST = f"""{_RAY}, s AS (SELECT light_id, sum(1-lx*lx)+1e-9 AS a, sum(-lx*ly) AS b, sum(-lx*lz) AS c, sum(1-ly*ly)+1e-9 AS d, sum(-ly*lz) AS e, sum(1-lz*lz)+1e-9 AS f,
    sum((1-lx*lx)*ox-lx*ly*oy-lx*lz*oz) AS u, sum(-lx*ly*ox+(1-ly*ly)*oy-ly*lz*oz) AS v, sum(-lx*lz*ox-ly*lz*oy+(1-lz*lz)*oz) AS q FROM ry GROUP BY 1),
    z AS (SELECT *, a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c) AS det FROM s),
    p AS (SELECT light_id, (u*(d*f-e*e)-b*(v*f-e*q)+c*(v*e-d*q))/det AS px, (a*(v*f-e*q)-u*(b*f-e*c)+c*(b*q-v*c))/det AS py, (a*(d*q-v*e)-b*(b*q-v*c)+u*(b*e-d*c))/det AS pz FROM z),
    o AS (SELECT *, row_number() OVER (ORDER BY radius)-1 AS k, count(*) OVER () AS n FROM (SELECT *, sqrt(px*px+py*py+pz*pz) AS radius FROM p)), g AS (SELECT *, max(CASE WHEN k=n//2 THEN radius END) OVER () AS mid FROM o),
    h AS (SELECT *, (CASE WHEN abs(radius-mid)>0.1::DOUBLE*mid THEN mid/radius ELSE 1 END)*(CASE WHEN pz<0 THEN -1 ELSE 1 END) AS gain FROM g)"""


@query("l8_parallax_positions", sql("raster", f"WITH {_SPH}, {_NEAREST} SELECT light_id, {R('px*gain', 3)} AS px, {R('py*gain', 3)} AS py, {R('pz*gain', 3)} AS pz FROM h"))
def l8(spark, d):
    return rounded(L.parallax_positions(_rays(spark, d)).drop("dataset"), digits=3)


@query("a14_fit_ellipse", sql("border", f"SELECT sphere_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN 50.0::DOUBLE + sphere_id END AS major FROM border GROUP BY 1"))
def a14(spark, d):
    e = L.fit_ellipse(X.border(spark, d, 0.0))
    return e.select("sphere_id", "n", (F.round(F.round((F.col("major") + F.col("minor")) / 2, 1), 1) + 0.0).alias("major"))


@query("a14_turned_ellipses", """SELECT CAST(c_nationkey AS INT) AS sphere_id, count(*) AS n, CASE WHEN count(*) >= 5 THEN 100.0::DOUBLE + c_nationkey END AS cx, CASE WHEN count(*) >= 5 THEN 80.0::DOUBLE - c_nationkey END AS cy,
    CASE WHEN count(*) >= 5 THEN 60.0::DOUBLE + c_nationkey END AS major, CASE WHEN count(*) >= 5 THEN 30.0::DOUBLE + c_nationkey / 2.0::DOUBLE END AS minor, CASE WHEN count(*) >= 5 THEN 10.0::DOUBLE + 6 * c_nationkey END AS angle FROM customer GROUP BY c_nationkey""")
def a14_turned(spark, d):
    return rounded(L.fit_ellipse(X.turned_border(spark, d)).drop("dataset"), digits=3)


# Alignment: windows of 40 x 20 pixels that tile the image, each a dataset; the other image is the same, two right and one up.

def _windows(spark, d) -> tuple[DataFrame, DataFrame]:
    g = X.raster(spark, d).select("dataset", "x", "y", gray(F.col("r"), F.col("g"), F.col("b"), "integer").alias("v"))
    tile = F.concat_ws("-", F.floor(F.col("x") / 40).cast("string"), F.floor(F.col("y") / 20).cast("string"))
    cut = lambda df: df.select(tile.alias("dataset"), F.lit(0).alias("light_id"), (F.col("x") % 40).alias("x"), (F.col("y") % 20).alias("y"), "v")
    other = g.select((F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), "v").where("x >= 0 and y >= 0")
    return cut(g).drop("light_id"), cut(other)


_PAIR = """g AS (SELECT x, y, (11*r+16*g+5*b)//32 AS v FROM raster), rf AS (SELECT x//40 AS tx, y//20 AS ty, x%40 AS x, y%20 AS y, v FROM g), ot AS (SELECT (x-2)//40 AS tx, (y-1)//20 AS ty, (x-2)%40 AS x, (y-1)%20 AS y, v FROM g WHERE x>=2 AND y>=1),
    pr AS (SELECT CAST(rf.tx AS VARCHAR) || '-' || CAST(rf.ty AS VARCHAR) AS dataset, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, rf.v AS a, ot.v AS b FROM rf, (SELECT range-3 AS dx FROM range(7)), (SELECT range-3 AS dy FROM range(7)), ot WHERE rf.x>=3 AND rf.x<37 AND rf.y>=3 AND rf.y<17 AND ot.tx=rf.tx AND ot.ty=rf.ty AND ot.x=rf.x+dx AND ot.y=rf.y+dy)"""
_MI = f"{_PAIR}, jt AS (SELECT dataset, dx, dy, a, b, count(*) AS n FROM pr GROUP BY ALL), mg AS (SELECT *, sum(n) OVER (PARTITION BY dataset,dx,dy,a) AS na, sum(n) OVER (PARTITION BY dataset,dx,dy,b) AS nb, sum(n) OVER (PARTITION BY dataset,dx,dy) AS al FROM jt), sc AS (SELECT dataset, dx, dy, sum(n/CAST(al AS DOUBLE)*ln(CAST(n AS DOUBLE)*al/(na*nb))) AS score FROM mg GROUP BY ALL)"
_BEST = "SELECT dataset, dx, dy, round(score,6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(score,9) DESC, dy, dx) AS k FROM sc) WHERE k=1"


@query("m1_mutual_information", sql("raster", f"WITH {_MI} SELECT dataset, dx, dy, {R('score')} AS score FROM sc"))
def m1(spark, d):
    return rounded(M.align_by_mi(*_windows(spark, d), 40, 20, 3)[1].select("dataset", "dx", "dy", "score"))


@query("m2_align_by_mi", sql("raster", f"WITH {_MI} {_BEST} AND score > 0"))
def m2(spark, d):
    return rounded(M.align_by_mi(*_windows(spark, d), 40, 20, 3)[0].select("dataset", "dx", "dy", "score"))


@query("m3_align_by_ncc", sql("raster", f"WITH {_PAIR}, sc AS (SELECT dataset, dx, dy, coalesce(sum(CAST(a AS DOUBLE)*b)/nullif(sqrt(sum(CAST(a AS DOUBLE)*a)*sum(CAST(b AS DOUBLE)*b)),0),0) AS score FROM pr GROUP BY ALL) {_BEST}"))
def m3(spark, d):
    return rounded(M.align_by_ncc(*_windows(spark, d), 40, 20, 3)[0].select("dataset", "dx", "dy", "score"))


@query("m4_offset_errors", """WITH e AS (SELECT c_nationkey, c_custkey % 5 - c_custkey % 3 AS ex, c_custkey % 7 - c_custkey % 2 AS ey FROM customer)
    SELECT CAST(c_nationkey AS VARCHAR) AS dataset, count(*) AS n, round(sqrt(avg(ex*ex)),6) AS rmse_x, CAST(max(abs(ey)) AS BIGINT) AS max_y, CAST(sum(CASE WHEN sqrt(ex*ex+ey*ey)>=2 THEN 1 ELSE 0 END) AS BIGINT) AS over2, round(100.0::DOUBLE*sum(CASE WHEN sqrt(ex*ex+ey*ey)>=3 THEN 1 ELSE 0 END)/count(*),6) AS pct3 FROM e GROUP BY 1""")
def m4(spark, d):
    c = X.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("dataset"), F.col("c_custkey").alias("light_id"), F.col("c_custkey").alias("k"))
    found = c.select("dataset", "light_id", (F.col("k") % 5).alias("dx"), (F.col("k") % 7).alias("dy"))
    true = c.select("dataset", "light_id", (F.col("k") % 3).alias("dx"), (F.col("k") % 2).alias("dy"))
    return rounded(M.offset_errors(found, true).select("dataset", "n", "rmse_x", F.col("max_y").cast("long").alias("max_y"), "over2", "pct3"))


def _turn_sql(turn: int, x: str, y: str) -> str:
    pairs = f"SELECT a.g AS a, b.g AS b FROM raster a, w, raster b WHERE b.x={x} AND b.y={y}"
    return f"SELECT {turn} AS turn, sum(n/CAST(al AS DOUBLE)*ln(CAST(n AS DOUBLE)*al/(na*nb))) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS al FROM (SELECT a, b, count(*) AS n FROM ({pairs}) GROUP BY 1,2))"


# turned back by 90 degrees the thumb is the image again, by -90 it stands on its head
@query("m5_detect_quarter_turn", sql("raster", f"WITH s AS ({_turn_sql(90, 'a.x', 'a.y')} UNION ALL {_turn_sql(-90, 'w-1-a.x', 'h-1-a.y')}) SELECT 7 AS light_id, turn, {R('score')} AS score FROM s ORDER BY round(score,9) DESC, turn DESC LIMIT 1"))
def m5(spark, d):
    w, h = X.sizes(spark, d)
    target = X.raster(spark, d).select("dataset", "x", "y", F.col("g").alias("v"))
    thumb = target.select("dataset", F.lit(7).alias("light_id"), F.col("y").alias("x"), (w - 1 - F.col("x")).alias("y"), "v")
    return rounded(M.detect_quarter_turn(target, thumb, w, h).select("light_id", "turn", "score"))


# Pyramids


def _down_sql(src: str, w: str, h: str, name: str) -> str:
    tap = "(VALUES (-2,1),(-1,4),(0,6),(1,4),(2,1)) t(o,k)"
    x = f"{name}x AS (SELECT CAST(i AS INT) AS x, y, (sum(k*r)+8)//16 AS r, (sum(k*g)+8)//16 AS g, (sum(k*b)+8)//16 AS b FROM {w} ww, (SELECT unnest(range((SELECT greatest(w, h) FROM {w}))) AS i) q, {tap}, {src} s WHERE i < ww.w//2 AND s.x=greatest(0,least(2*i+1+o,ww.w-1)) GROUP BY i, y)"
    y = f"{name} AS (SELECT x, CAST(i AS INT) AS y, CAST((sum(k*r)+8)//16 AS INT) AS r, CAST((sum(k*g)+8)//16 AS INT) AS g, CAST((sum(k*b)+8)//16 AS INT) AS b FROM {h} hh, (SELECT unnest(range((SELECT greatest(w, h) FROM {h}))) AS i) q, {tap}, {name}x s WHERE i < hh.h//2 AND s.y=greatest(0,least(2*i+1+o,hh.h-1)) GROUP BY x, i)"
    return f"{x}, {y}"


@query("t1_downsample", sql("raster", f"WITH {_down_sql('raster', 'w', 'w', 'd1')} SELECT * FROM d1"))
def t1(spark, d):
    return T.downsample(X.raster(spark, d), *X.sizes(spark, d)).select("x", "y", "r", "g", "b")


@query("t2_levels", sql("w ord", "WITH RECURSIVE l AS (SELECT w, h, 0 AS n FROM w UNION ALL SELECT greatest(1,w//2), greatest(1,h//2), n+1 FROM l WHERE greatest(w,h)>64) SELECT CAST(max(n)+1 AS INT) AS levels, (SELECT count(*) FROM ord) AS pixels FROM l").replace("WITH w", "WITH RECURSIVE w", 1).replace(", RECURSIVE l", ", l"))
def t2(spark, d):
    w, h = X.sizes(spark, d)
    return X.raster(spark, d).agg(F.count(F.lit(1)).alias("pixels")).select(F.lit(T.n_levels(w, h, 64)).alias("levels"), "pixels")


@query("t3_pyramid", sql("raster", f"""WITH w2 AS (SELECT w//2 AS w, h//2 AS h FROM w), {_down_sql('raster', 'w', 'w', 'd1')}, {_down_sql('d1', 'w2', 'w2', 'd2')}
    SELECT 2 AS level, count(*) AS n, CAST(sum(r*(x+1)+g*(y+1)+b) AS BIGINT) AS checksum FROM raster UNION ALL SELECT 1, count(*), CAST(sum(r*(x+1)+g*(y+1)+b) AS BIGINT) FROM d1 UNION ALL SELECT 0, count(*), CAST(sum(r*(x+1)+g*(y+1)+b) AS BIGINT) FROM d2"""))
def t3(spark, d):
    w, h = X.sizes(spark, d)
    p = T.pyramid(X.raster(spark, d), w, h, max(w, h) // 4 + 1)
    c = F.col
    return p.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(c("r") * (c("x") + 1) + c("g") * (c("y") + 1) + c("b")).alias("checksum"))


_NEWER = "SELECT x, y, CASE WHEN x>=10 AND x<20 AND y>=5 AND y<12 THEN 255-r ELSE r END AS r, g, b FROM raster"


@query("t3_refreshed_pyramid", sql("raster", f"""WITH newer AS ({_NEWER}), w2 AS (SELECT w//2 AS w, h//2 AS h FROM w), {_down_sql('newer', 'w', 'w', 'd1')}, {_down_sql('d1', 'w2', 'w2', 'd2')}
    SELECT 2 AS level, count(*) AS n, CAST(sum(r*(x+1)+g*(y+1)+b) AS BIGINT) AS checksum FROM newer UNION ALL SELECT 1, count(*), CAST(sum(r*(x+1)+g*(y+1)+b) AS BIGINT) FROM d1 UNION ALL SELECT 0, count(*), CAST(sum(r*(x+1)+g*(y+1)+b) AS BIGINT) FROM d2"""))
def t3_refreshed(spark, d):
    """A patch of the image changes, and the stored pyramid follows."""
    w, h = X.sizes(spark, d)
    side = max(w, h) // 4 + 1
    old = stored(T.pyramid(X.raster(spark, d), w, h, side))
    patch = X.raster(spark, d).where("x >= 10 and x < 20 and y >= 5 and y < 12").withColumn("r", 255 - F.col("r"))
    p, c = T.refresh_pyramid(old, patch, w, h, side, size=16)[0], F.col
    return p.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(c("r") * (c("x") + 1) + c("g") * (c("y") + 1) + c("b")).alias("checksum"))


def _tiles(spark, d, overlap: int = 1) -> DataFrame:
    w, h = X.sizes(spark, d)
    return T.cut_tiles(T.pyramid(X.raster(spark, d), w, h, 64), w, h, 64, overlap)


def _grid(spark, d) -> DataFrame:
    return T.tile_grid(X.raster(spark, d), *X.sizes(spark, d), 64, 1)


# All levels in SQL: down from the whole image while a side is above 64 (six halvings, so for sides up to 4,096).
_HALVES = range(2, 8)
_TILES = "(SELECT unnest(range((SELECT greatest(w, h)//64+1 FROM w))) AS {0})"
_LEVELS = f"""{', '.join(f"w{k} AS (SELECT w//2 AS w, h//2 AS h FROM {f'w{k - 1}' if k > 2 else 'w'})" for k in _HALVES)}, {', '.join(_down_sql('raster' if k == 2 else f'd{k - 2}', *(['w' if k == 2 else f'w{k - 1}'] * 2), f'd{k - 1}') for k in _HALVES)},
    lv AS (SELECT 0 AS k, w AS lw, h AS lh FROM w {' '.join(f"UNION ALL SELECT {k - 1}, a.w, a.h FROM w{k} a, {f'w{k - 1}' if k > 2 else 'w'} b WHERE greatest(b.w, b.h)>64" for k in _HALVES)}),
    gr AS (SELECT k, CAST((SELECT max(k) FROM lv) - k AS INT) AS level, lw, lh, CAST(c AS INT) AS col, CAST(q AS INT) AS row FROM lv, {_TILES.format('c')} a, {_TILES.format('q')} b WHERE c<(lw+63)//64 AND q<(lh+63)//64),
    px AS (SELECT 0 AS k, x, y, r, g, b FROM raster {' '.join(f"UNION ALL SELECT {k - 1}, x, y, r, g, b FROM d{k - 1}" for k in _HALVES)})"""
_HEX = "format('{:02x}{:02x}{:02x}', r, g, b)"


@query("t4_cut_tiles", sql("raster", f"""WITH {_LEVELS}, tl AS (SELECT *, greatest(0,col*64-1) AS x0, greatest(0,row*64-1) AS y0, least((col+1)*64+1,lw) AS x1, least((row+1)*64+1,lh) AS y1 FROM gr)
    SELECT level, col, row, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1-x0 AS INT) AS w, CAST(y1-y0 AS INT) AS h, CAST(3*(x1-x0)*(y1-y0) AS INT) AS bytes, md5(unhex(string_agg({_HEX}, '' ORDER BY y, x))) AS digest FROM tl JOIN px ON px.k=tl.k AND x>=x0 AND x<x1 AND y>=y0 AND y<y1 GROUP BY level, col, row, x0, y0, x1, y1"""))
def t4(spark, d):
    return _tiles(spark, d).select("level", "col", "row", "x0", "y0", "w", "h", F.length("payload").alias("bytes"), F.md5("payload").alias("digest"))


_T4 = SQL["t4_cut_tiles"]


@query("t7_archive_bodies", _T4)
def t7_bodies(spark, d):
    """All tiles written as packed archives, and cut out of them again."""
    path = shared_dir(spark)
    tiles = _tiles(spark, d)
    AR.write_archive(tiles, path, part_bytes=1 << 16)
    back = AR.read_archive(spark, path).join(_grid(spark, d), ["dataset", "plane", "level", "col", "row"])
    return back.select("level", "col", "row", "x0", "y0", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.length("payload").alias("bytes"), F.md5("payload").alias("digest"))


@query("t4_top_tiles", sql("raster", """WITH t AS (SELECT CAST(c AS INT) AS col, CAST(q AS INT) AS row, CAST(greatest(0,c*64-1) AS INT) AS x0, CAST(greatest(0,q*64-1) AS INT) AS y0, CAST(least((c+1)*64+1,w)-greatest(0,c*64-1) AS INT) AS w, CAST(least((q+1)*64+1,h)-greatest(0,q*64-1) AS INT) AS h FROM w, (SELECT unnest(range((SELECT greatest(w, h)//64+1 FROM w))) AS c) a, (SELECT unnest(range((SELECT greatest(w, h)//64+1 FROM w))) AS q) b WHERE c<(w+63)//64 AND q<(h+63)//64)
    SELECT col, row, x0, y0, w, h, CAST(3*w*h AS INT) AS bytes FROM t"""))
def t4t(spark, d):
    w, h = X.sizes(spark, d)
    top = T.n_levels(w, h, 64) - 1
    return _tiles(spark, d).where(F.col("level") == top).select("col", "row", "x0", "y0", "w", "h", F.length("payload").alias("bytes"))


@query("t5_tile_paths", sql("raster", f"WITH {_LEVELS} SELECT level || '/' || col || '_' || row || '.jpg' AS deepzoom, level || '/' || row || '/' || col || '.jpg' AS google FROM gr"))
def t5(spark, d):
    a = T.tile_paths(_grid(spark, d), "deepzoom").withColumnRenamed("path", "deepzoom")
    return T.tile_paths(a, "google").select("deepzoom", F.col("path").alias("google"))


@query("t5_zoomify_paths", sql("raster", f"WITH {_LEVELS} SELECT level, col, row, 'TileGroup' || ((row_number() OVER (ORDER BY level, row, col) - 1) // 256) || '/' || level || '-' || col || '-' || row || '.jpg' AS path FROM gr"))
def t5z(spark, d):
    return T.tile_paths(_grid(spark, d), "zoomify").select("level", "col", "row", "path")


@query("t6_padded_tiles", sql("raster", f"""WITH {_LEVELS}, cell AS (SELECT CAST(range % 64 AS INT) AS i, CAST(range // 64 AS INT) AS j FROM range(4096))
    SELECT level, col, row, 12288 AS bytes, md5(unhex(string_agg(CASE WHEN px.x IS NULL THEN '000000' ELSE {_HEX} END, '' ORDER BY j, i))) AS digest FROM gr CROSS JOIN cell LEFT JOIN px ON px.k=gr.k AND px.x=col*64+i AND px.y=row*64+j GROUP BY level, col, row"""))
def t6(spark, d):
    w, h = X.sizes(spark, d)
    return T.cut_tiles_padded(T.pyramid(X.raster(spark, d), w, h, 64), w, h, 60).select("level", "col", "row", F.length("payload").alias("bytes"), F.md5("payload").alias("digest"))


_IDX = "t AS (SELECT CAST(l_linenumber AS INT) AS plane, CAST(l_orderkey % 3 AS INT) AS level, CAST(l_orderkey % 11 AS INT) AS col, CAST(l_orderkey % 13 AS INT) AS row, CAST(max(l_quantity)*100+1 AS BIGINT) AS size FROM lineitem GROUP BY 1,2,3,4), ix AS (SELECT plane, row_number() OVER w - 1 AS seq, level, col, row, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS \"offset\", size FROM t WINDOW w AS (PARTITION BY plane ORDER BY level,row,col))"


def _index(spark, d) -> DataFrame:
    k = F.col("l_orderkey")
    t = X.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("plane"), (k % 3).cast("int").alias("level"), (k % 11).cast("int").alias("col"), (k % 13).cast("int").alias("row")).agg((F.max("l_quantity") * 100 + 1).cast("long").alias("size"))
    return T.pack_index(t.withColumn("dataset", F.lit("d")))


@query("t7_pack_index", f'WITH {_IDX.replace("OVER (w ROWS", "OVER (PARTITION BY plane ORDER BY level,row,col ROWS")} SELECT plane, seq, level, col, row, "offset", size FROM ix')
def t7(spark, d):
    return _index(spark, d).drop("dataset")


@query("t8_interleave_index", f'WITH {_IDX.replace("OVER (w ROWS", "OVER (PARTITION BY plane ORDER BY level,row,col ROWS")} SELECT seq, plane, CAST(coalesce(sum(size) OVER (ORDER BY seq,plane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS "offset", size, (SELECT count(DISTINCT plane) FROM ix) AS stride FROM ix')
def t8(spark, d):
    return T.interleave_index(_index(spark, d)).drop("dataset")


@query("s14_pyramid_metadata", sql("raster", f"""WITH {_LEVELS}, n AS (SELECT count(*) AS n_tiles, count(DISTINCT level) AS n_levels FROM gr)
    SELECT n_tiles, n_levels, '<Image TileSize="64" Overlap="1" Format="jpg"><Size Width="' || w || '" Height="' || h || '"/></Image>' AS dzi,
    '<IMAGE_PROPERTIES WIDTH="' || w || '" HEIGHT="' || h || '" NUMTILES="' || n_tiles || '" NUMIMAGES="1" VERSION="1.8" TILESIZE="64"/>' AS zoomify,
    '{{"tilesize":64,"overlap":1,"format":"jpg","width":' || w || ',"height":' || h || ',"nlevels":' || n_levels || '}}' AS tzi FROM n, w"""))
def s14(spark, d):
    w, h = X.sizes(spark, d)
    return T.pyramid_metadata(_grid(spark, d), w, h, 64, 1).drop("dataset")


# Robust normals, flattening and integration


@query("n2_normals_robust")
def n2(spark, d):
    return rounded(B.normals_robust(X.pixels(spark, d, specular=True), LIGHTS))


@query("n3_normals_l1")
def n3(spark, d):
    return rounded(B.normals_l1(X.pixels(spark, d, specular=True), LIGHTS))


@query("n4_normals_sbl")
def n4(spark, d):
    return rounded(B.normals_sbl(X.pixels(spark, d, specular=True), LIGHTS))


@query("n5_normals_rpca")
def n5(spark, d):
    return rounded(B.normals_rpca(X.pixels(spark, d, specular=True), LIGHTS), digits=4)


@query("f1_flatten_radial", sql("truth", f"""WITH q AS (SELECT dataset, x-w/2.0::DOUBLE AS u, h/2.0::DOUBLE-y AS v, nx, ny, nz FROM truth, w WHERE nz>=0.7171), b AS (SELECT dataset, floor(sqrt(u*u+v*v+1)/10) AS bin, avg((u*nx+v*ny+nz)/sqrt(u*u+v*v+1)) AS s FROM q GROUP BY 1,2), l AS (SELECT dataset, regr_slope(s,(bin+0.5)*10) AS m, regr_intercept(s,(bin+0.5)*10) AS q FROM b GROUP BY 1),
    z AS (SELECT t.dataset, x, y, sqrt(pow(x-w/2.0::DOUBLE,2)+pow(h/2.0::DOUBLE-y,2)) AS d, x-w/2.0::DOUBLE AS u, h/2.0::DOUBLE-y AS v, nx, ny, nz, m, q FROM truth t JOIN l ON l.dataset=t.dataset, w), r AS (SELECT dataset, x, y, nx-(m*d+q)*coalesce(u/nullif(d,0),0) AS a, ny-(m*d+q)*coalesce(v/nullif(d,0),0) AS b, nz AS c FROM z)
    SELECT dataset, x, y, {R('a/sqrt(a*a+b*b+c*c)')} AS nx, {R('b/sqrt(a*a+b*b+c*c)')} AS ny, {R('c/sqrt(a*a+b*b+c*c)')} AS nz FROM r"""))
def f1(spark, d):
    return rounded(FL.flatten_radial(X.truth(spark, d).drop("k"), *X.sizes(spark, d), 10.0))


def _residual_sql() -> str:
    """The six terms made orthogonal one after another, and the heights less their share of each."""
    steps = ["o0 AS (SELECT x, y, z, 1.0::DOUBLE AS t0, u AS t1, v AS t2, u*u AS t3, v*v AS t4, u*v AS t5 FROM (SELECT x, y, z, (x-w/2.0::DOUBLE)/w AS u, (y-h/2.0::DOUBLE)/w AS v FROM heights, hw))"]
    for k in range(6):
        less = lambda c: f"{c} - t{k}*(sum({c}*t{k}) OVER ())/(sum(t{k}*t{k}) OVER ()) AS {c}"  # noqa: B023, E731
        steps.append(f"o{k + 1} AS (SELECT x, y, {', '.join([less('z'), *(less(f't{j}') for j in range(k + 1, 6))])} FROM o{k})")
    return ", ".join(steps)


_MOMENTS = "SELECT count(*) AS n, round(avg(z), 5) + 0.0 AS mean, round(avg(z*x), 5) + 0.0 AS against_x, round(avg(z*x*y), 5) + 0.0 AS against_xy, round(avg(z*z), 5) + 0.0 AS square FROM o6"


@query("f2_flatten_quadratic", sql("heights", f"WITH {_residual_sql()} {_MOMENTS}"))
def f2(spark, d):
    z = FL.flatten_quadratic(X.heights(spark, d), *X.height_size(spark, d))
    c = F.col
    return rounded(z.agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.avg(c("z") * c("x")).alias("against_x"), F.avg(c("z") * c("x") * c("y")).alias("against_xy"), F.avg(c("z") * c("z")).alias("square")), digits=5)


@query("f2_quadratic_residual", sql("heights", f"WITH {_residual_sql()} SELECT 'd' AS dataset, x, y, {R('z')} AS z FROM o6"))
def f2r(spark, d):
    return rounded(FL.flatten_quadratic(X.heights(spark, d), *X.height_size(spark, d)))


def _blur_sql(src: str, columns: tuple[str, ...], sigma: float) -> str:
    """The recursion along rows and back, then along columns and back: expressions fx, bx, fy, by on ``src`` (x, y, columns)."""
    q = 0.98711 * sigma - 0.96330
    b = [1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3, 2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3, -(1.4281 * q**2 + 1.26661 * q**3), 0.422205 * q**3]
    k = [repr(v / b[0]) + "::DOUBLE" for v in b[1:]]
    gain = repr(1 - sum(b[1:]) / b[0]) + "::DOUBLE"
    out = []
    for name, axis, other, step in (("fx", "x", "y", 1), ("bx", "x", "y", -1), ("fy", "y", "x", 1), ("by", "y", "x", -1)):
        first = ", ".join(f"{c}, {c}, {c}" for c in columns)
        then = ", ".join(f"{gain}*s.{c}+{k[0]}*f.{c}+{k[1]}*f.{c}_1+{k[2]}*f.{c}_2, f.{c}, f.{c}_1" for c in columns)
        names = ", ".join(f"{c}, {c}_1, {c}_2" for c in columns)
        edge = "0" if step > 0 else f"(SELECT max({axis}) FROM {src})"
        out.append(f"{name}(x, y, {names}) AS (SELECT x, y, {first} FROM {src} WHERE {axis}={edge} UNION ALL SELECT s.x, s.y, {then} FROM {name} f JOIN {src} s ON s.{other}=f.{other} AND s.{axis}=f.{axis}{step:+d})")
        src = name
    return ", ".join(out)


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("i5_gaussian_blur", _recursive(sql("truth", f"WITH {_blur_sql('truth', ('nx', 'ny'), 3.0)} SELECT 'd' AS dataset, x, y, {R('nx')} AS nx, {R('ny')} AS ny FROM \"by\"".replace(' by(', ' "by"(').replace(' by f', ' "by" f'))))
def i5(spark, d):
    return rounded(gaussian_blur(X.truth(spark, d, "d"), ["nx", "ny"], 3.0))


@query("f3_flatten_blur", _recursive(sql("truth", f"""WITH sl AS (SELECT x, y, nx/nz AS sx, ny/nz AS sy FROM truth), {_blur_sql('sl', ('sx', 'sy'), 3.0)}, d AS (SELECT sl.x, sl.y, sl.sx-b.sx AS a, sl.sy-b.sy AS b FROM sl JOIN "by" b ON b.x=sl.x AND b.y=sl.y)
    SELECT 'd' AS dataset, x, y, {R('a/sqrt(a*a+b*b+1)')} AS nx, {R('b/sqrt(a*a+b*b+1)')} AS ny, {R('1/sqrt(a*a+b*b+1)')} AS nz FROM d""".replace(' by(', ' "by"(').replace(' by f', ' "by" f'))))
def f3(spark, d):
    return rounded(FL.flatten_blur(X.truth(spark, d, "d").drop("k"), 3.0))


def _dft(src: str, out: str, axis: str, size: str, pairs: tuple[tuple[str, str], ...], forward: bool, only: str = "true") -> str:
    """One axis of a discrete Fourier transform of ``src`` (x, y, fields) by its definition; ``only`` limits the places."""
    other = "y" if axis == "x" else "x"
    s = 1 if forward else -1
    angle = f"2*pi()*((i*s.{axis}) % n)/n"
    scale = "" if forward else "/any_value(n)"
    fields = ", ".join(f"sum(s.{a}*cs+({s})*s.{b}*sn){scale} AS {a}, sum(s.{b}*cs-({s})*s.{a}*sn){scale} AS {b}" for a, b in pairs)
    return f"{out} AS (SELECT {'i AS x, y' if axis == 'x' else 'x, i AS y'}, {fields} FROM (SELECT s.*, i, n, cos({angle}) AS cs, sin({angle}) AS sn FROM {src} s, (SELECT CAST({size} AS BIGINT) AS n, CAST(unnest(range(CAST({size} AS BIGINT))) AS BIGINT) AS i FROM gs) WHERE {only}) s GROUP BY i, {other})"


def _fourier_sql() -> str:
    """n.x and n.y as one complex field, mirrored by a fifth without its edge, high-passed, cut and shrunk back."""
    ab = (("a", "b"),)
    return f"""gs AS (SELECT w, h, least(CAST(floor(w*0.2::DOUBLE) AS INT), w-1) AS kx, least(CAST(floor(h*0.2::DOUBLE) AS INT), h-1) AS ky FROM w), th AS (SELECT x, y, nx, ny, acos(greatest(-1,least(nz,1))) AS t FROM truth),
    f0 AS (SELECT x, y, nx*st AS a, ny*st AS b FROM (SELECT *, CASE WHEN sin(t)>1e-9 THEN t/sin(t) ELSE 1 END AS st FROM th)),
    f1 AS (SELECT i AS x, y, a, b FROM f0, gs, (SELECT unnest(range((SELECT w+2*kx FROM gs))) AS i) WHERE x=CASE WHEN i<kx THEN kx-i WHEN i<kx+w THEN i-kx ELSE w-2-(i-kx-w) END),
    f2 AS (SELECT x, i AS y, a, b FROM f1, gs, (SELECT unnest(range((SELECT h+2*ky FROM gs))) AS i) WHERE y=CASE WHEN i<ky THEN ky-i WHEN i<ky+h THEN i-ky ELSE h-2-(i-ky-h) END),
    {_dft('f2', 'f3', 'x', 'w+2*kx', ab, True)}, {_dft('f3', 'f4', 'y', 'h+2*ky', ab, True)},
    f5 AS (SELECT x, y, a*g AS a, b*g AS b FROM (SELECT f4.*, 1-exp(-(pow(least(x,w+2*kx-x),2)+pow(least(y,h+2*ky-y),2))/18.0::DOUBLE) AS g FROM f4, gs)),
    {_dft('f5', 'f6', 'y', 'h+2*ky', ab, False, 'i>=(SELECT ky FROM gs) AND i<(SELECT ky+h FROM gs)')}, {_dft('f6', 'f7', 'x', 'w+2*kx', ab, False, 'i>=(SELECT kx FROM gs) AND i<(SELECT kx+w FROM gs)')},
    f8 AS (SELECT CAST(x-kx AS INT) AS x, CAST(y-ky AS INT) AS y, a*k AS nx, b*k AS ny FROM (SELECT f7.*, kx, ky, CASE WHEN sqrt(a*a+b*b)>1e-9 THEN sin(least(sqrt(a*a+b*b),pi()/2))/sqrt(a*a+b*b) ELSE 1 END AS k FROM f7, gs))"""


@query("f4_flatten_fourier", sql("truth", f"WITH {_fourier_sql()} SELECT 'd' AS dataset, x, y, {R('nx')} AS nx, {R('ny')} AS ny, {R('sqrt(greatest(0,1-nx*nx-ny*ny))')} AS nz FROM f8"))
def f4(spark, d):
    return rounded(FL.flatten_fourier(X.truth(spark, d, "d"), *X.sizes(spark, d), 3.0))


def _step(w: int, h: int) -> int:
    return w * h // 8 - 13


def _picked(spark, d) -> list:
    """Eight picked points, spread over the image."""
    step = _step(*X.sizes(spark, d))
    rows = X.truth(spark, d, "d").where(f"k % {step} = 7 and k < {8 * step}").orderBy("k").collect()
    return [(r["x"], r["y"], r["nx"], r["ny"], r["nz"]) for r in rows]


def _fitted_sql(source: str, values: dict[str, str], terms: list[tuple[str, ...]]) -> str:
    """``source`` (x, y, u, v, pick, rest) with ``values`` less their best fit on the picks, as o0, o1, ...; terms made orthogonal one by one.

    Each value is a list of components, as is each term; picks weigh all components alike.
    """
    names = list(values)
    n = len(names)
    first = ", ".join([*(f"{e} AS {c}" for c, e in values.items()), *(f"{t[i]} AS t{j}_{i}" for j, t in enumerate(terms) for i in range(n))])
    steps = [f"o0 AS (SELECT *, {first} FROM {source})"]
    for j in range(len(terms)):
        dot = lambda a, b: "sum(" + "+".join(f"{p}*{q}" for p, q in zip(a, b, strict=True)) + ") FILTER (WHERE pick) OVER ()"
        of = [f"t{j}_{i}" for i in range(n)]
        less = lambda cs: [f"{c}-{t}*({dot(cs, of)})/({dot(of, of)}) AS {c}" for c, t in zip(cs, of, strict=True)]  # noqa: B023, E731
        later = [less([f"t{q}_{i}" for i in range(n)]) for q in range(j + 1, len(terms))]
        steps.append(f"o{j + 1} AS (SELECT * EXCLUDE ({', '.join([*names, *(f't{q}_{i}' for q in range(j, len(terms)) for i in range(n))])}), {', '.join([*less(names), *(e for part in later for e in part)])} FROM o{j})")
    return ", ".join(steps)


_POINTS = f"""pk AS (SELECT x, y, k % (w*h//8-13) = 7 AND k < 8*(w*h//8-13) AS pick, (x-w/2.0::DOUBLE)/w AS u, (h/2.0::DOUBLE-y)/w AS v, nx, ny, nz, -nx/nz AS tx, -ny/nz AS ty FROM truth, w),
    {_fitted_sql('pk', {'rx': 'tx', 'ry': 'ty'}, [('2*u', '0*u'), ('v', 'u'), ('0*u', '2*v'), ('4*u*u*u', '0*u'), ('2*u*v*v', '2*u*u*v'), ('0*u', '4*v*v*v')])},
    md AS (SELECT x, y, nx, ny, nz, -(tx-rx)/s AS a, -(ty-ry)/s AS b, 1/s AS c, 1/(1+1/s) AS k FROM (SELECT *, sqrt(pow(tx-rx,2)+pow(ty-ry,2)+1) AS s FROM o6))"""


@query("f6_flatten_points_normals", sql("truth", f"WITH {_POINTS} SELECT 'd' AS dataset, x, y, {R('nx*(1-a*a*k)-ny*a*b*k-nz*a')} AS nx, {R('-nx*a*b*k+ny*(1-b*b*k)-nz*b')} AS ny, {R('nx*a+ny*b+nz*c')} AS nz FROM md"))
def f6(spark, d):
    w, h = X.sizes(spark, d)
    return rounded(FL.flatten_points_normals(X.truth(spark, d, "d").drop("k"), FL.point_model(_picked(spark, d), w, h, False), w, h))


_HPOINTS = f"""pk AS (SELECT x, y, z, (x-w/2.0::DOUBLE)/w AS u, (h/2.0::DOUBLE-y)/w AS v, (y*w+x) % (w*h//12-3) = 2 AND y*w+x < 12*(w*h//12-3) AS pick FROM heights, hw),
    {_fitted_sql('pk', {'rz': 'z'}, [('1.0::DOUBLE',), ('u*u',), ('u*v',), ('v*v',), ('u*u*u*u',), ('u*u*v*v',), ('v*v*v*v',), ('u',), ('v',)])}"""


@query("f7_flatten_points_heights", sql("heights", f"WITH {_HPOINTS} SELECT 'd' AS dataset, x, y, {R('rz-avg(rz) OVER ()')} AS z FROM o9"))
def f7(spark, d):
    w, h = X.height_size(spark, d)
    step = w * h // 12 - 3  # twelve picked points, spread over the field
    rows = X.heights(spark, d).where(f"(y * {w} + x) % {step} = 2 and y * {w} + x < {12 * step}").orderBy("y", "x").collect()
    return rounded(FL.flatten_points_heights(X.heights(spark, d), FL.point_model([(r["x"], r["y"], r["z"]) for r in rows], w, h, True), w, h))


def _integral_sql() -> str:
    """Slopes mirrored by half the short side, with a changed sign along their own axis; divided by the frequencies."""
    pq = (("pr", "pi_"), ("qr", "qi"))
    side = lambda v, k, n: f"CASE WHEN i<{k} THEN {k}-1-i WHEN i<{k}+{n} THEN i-{k} ELSE {n}-1-(i-{k}-{n}) END={v}"
    freq = lambda v, n: f"(CASE WHEN {v}<=({n}-1)//2 THEN {v} ELSE {v}-({n}) END)/CAST({n} AS DOUBLE)"
    return f"""gs AS (SELECT w, h, least(w,h)//2 AS k FROM w), f0 AS (SELECT x, y, nx/nz AS p, -ny/nz AS q FROM truth),
    f1 AS (SELECT i AS x, y, CASE WHEN i<k OR i>=k+w THEN -p ELSE p END AS p, q FROM f0, gs, (SELECT unnest(range((SELECT w+2*k FROM gs))) AS i) WHERE {side('x', 'k', 'w')}),
    f2 AS (SELECT x, i AS y, p AS pr, 0.0::DOUBLE AS pi_, CASE WHEN i<k OR i>=k+h THEN -q ELSE q END AS qr, 0.0::DOUBLE AS qi FROM f1, gs, (SELECT unnest(range((SELECT h+2*k FROM gs))) AS i) WHERE {side('y', 'k', 'h')}),
    {_dft('f2', 'f3', 'x', 'w+2*k', pq, True)}, {_dft('f3', 'f4', 'y', 'h+2*k', pq, True)},
    f5 AS (SELECT x, y, (fx*pi_+fy*qi)/(fx*fx+fy*fy+1e-12) AS pr, -(fx*pr+fy*qr)/(fx*fx+fy*fy+1e-12) AS pi_ FROM (SELECT f4.*, {freq('x', 'w+2*k')} AS fx, {freq('y', 'h+2*k')} AS fy FROM f4, gs)),
    {_dft('f5', 'f6', 'y', 'h+2*k', pq[:1], False, 'i>=(SELECT k FROM gs) AND i<(SELECT k+h FROM gs)')}, {_dft('f6', 'f7', 'x', 'w+2*k', pq[:1], False, 'i>=(SELECT k FROM gs) AND i<(SELECT k+w FROM gs)')}"""


@query("i1_integrate_fft", sql("truth", f"WITH {_integral_sql()} SELECT 'd' AS dataset, CAST(x-k AS INT) AS x, CAST(y-k AS INT) AS y, {R('pr/(2*pi())', 4)} AS z FROM f7, gs"))
def i1(spark, d):
    return rounded(I.integrate_fft(X.truth(spark, d, "d"), *X.sizes(spark, d)), digits=4)


@query("i2_integrate_bilateral")
def i2(spark, d):
    return rounded(I.integrate_bilateral(X.truth(spark, d, "d"), *X.sizes(spark, d), 2.0), digits=3)


@query("i3_integrate_tiled")
def i3(spark, d):
    return rounded(I.integrate_tiled(X.truth(spark, d, "d"), *X.sizes(spark, d), tile=64, pad=8), digits=3)


# Sources and sinks, on documents made of the tables


def _lights_of_nations(spark, d) -> DataFrame:
    """Lights for each nation and each thousand of supplier keys, so that a list has at most a thousand."""
    from pyspark.sql import Window

    block = F.concat_ws("-", F.col("s_nationkey").cast("string"), F.floor(F.col("s_suppkey") / 1000).cast("string"))
    s = X.table(spark, d, "supplier").withColumn("dataset", block)
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy("s_suppkey")) - 1)
    v = [(F.col("s_suppkey") % 7 - 3).cast("double"), (F.col("s_suppkey") % 5 - 2).cast("double"), F.lit(4.0)]
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + 16)
    return s.select("dataset", F.col("k").cast("int").alias("light_id"), F.concat(F.lit("photo "), F.col("s_name")).alias("filename"), *((c / n).alias(k) for c, k in zip(v, ("lx", "ly", "lz"), strict=True)))


_SUP = "sl AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY s_suppkey) - 1 AS INT) AS light_id FROM (SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS dataset, s_suppkey, 'photo ' || s_name AS filename, CAST(s_suppkey % 7 - 3 AS DOUBLE) AS a, CAST(s_suppkey % 5 - 2 AS DOUBLE) AS b FROM supplier))"
_SLS = f"WITH {_SUP} SELECT dataset, light_id, filename, {R('a/sqrt(a*a+b*b+16)')} AS lx, {R('b/sqrt(a*a+b*b+16)')} AS ly, {R('4/sqrt(a*a+b*b+16)')} AS lz FROM sl"


@query("s1_s2_light_lists", _SLS)
def s1(spark, d):
    path = shared_dir(spark)
    D.write_lp(_lights_of_nations(spark, d), path)
    return rounded(D.read_lp(spark, path))


@query("s3_s4_domes", _SLS.replace("SELECT dataset, light_id, filename,", "SELECT dataset, light_id,"))
def s3(spark, d):
    lights = _lights_of_nations(spark, d).withColumns({"px": F.col("lx") * 300, "py": F.col("ly") * 300, "pz": F.col("lz") * 300})
    domes = lights.select("dataset").distinct().select("dataset", F.col("dataset").alias("label"), F.lit("").alias("notes"), F.lit(100.0).alias("imageWidth"), F.lit(600.0).alias("domeDiameter"), F.lit(0.0).alias("verticalOffset"), F.lit("spherical").alias("lightConfiguration"))
    path = shared_dir(spark)
    D.write_dome(domes, lights, path)
    return rounded(D.read_dome(spark, path)[1].select("dataset", "light_id", "lx", "ly", "lz"))


@query("s5_projects", sql("images", "SELECT dataset, light_id, filename, skip, visible FROM (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY light_id) - 1 AS INT) AS light_id, filename, skip, visible FROM images)"))
def s5(spark, d):
    i = X.images(spark, d).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("light_id", "filename", "skip", "visible"))).alias("l"))
    images = F.transform("l", lambda e: F.struct(e["filename"].alias("filename"), e["skip"].alias("skip"), e["visible"].alias("visible")))
    text = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(100).alias("width"), F.lit(80).alias("height"), images.alias("images")))
    path = shared_dir(spark)
    i.select("dataset", text.alias("value")).write.partitionBy("dataset").text(path)
    return D.read_project(spark, path)["images"].withColumn("light_id", F.col("light_id").cast("int"))


@query("s7_info_headers", f"WITH {_SUP} SELECT dataset, light_id, round(a/sqrt(a*a+b*b+16), 3) + 0.0 AS lx, round(b/sqrt(a*a+b*b+16), 3) + 0.0 AS ly FROM sl")
def s7(spark, d):
    lights = _lights_of_nations(spark, d)
    head = lights.select("dataset").distinct().select("dataset", F.lit(100).alias("width"), F.lit(80).alias("height"), F.lit("jpg").alias("format"), F.lit("ptm").alias("type"), F.lit("rgb").alias("colorspace"), F.lit(None).cast("double").alias("sigma"), F.lit(None).cast("int").alias("resolution"), F.lit(0.1).alias("pixelSizeInMM"), F.lit(18).alias("nplanes"), F.lit(None).cast("array<int>").alias("yccplanes"), F.lit(95).alias("quality"), F.lit("srgb").alias("colorprofile"))
    planes = lights.select("dataset", F.col("light_id").alias("plane"), F.lit(None).cast("double").alias("range"), F.col("lz").alias("scale"), F.col("lx").alias("bias"))
    path = shared_dir(spark)
    D.write_info(path, head, lights, planes)
    return rounded(D.read_info(spark, path)["lights"].select("dataset", "light_id", "lx", "ly"), digits=3)


def _loaded(spark, name: str, path: str) -> DataFrame:
    FM.register(spark)
    return spark.read.format(name).load(path)


@query("s1_light_list_format", _SLS)
def s1_format(spark, d):
    path = shared_dir(spark)
    D.write_lp(_lights_of_nations(spark, d), path)
    return rounded(_loaded(spark, "light_list", path))


@query("s3_dome_format", f"WITH {_SUP} SELECT dataset, light_id, {R('a/sqrt(a*a+b*b+16)')} AS lx, {R('300*a/sqrt(a*a+b*b+16)')} AS px FROM sl WHERE light_id < 9")
def s3_format(spark, d):
    """The first lights of all domes; the bound goes into the source."""
    lights = _lights_of_nations(spark, d).withColumns({"px": F.col("lx") * 300, "py": F.col("ly") * 300, "pz": F.col("lz") * 300})
    domes = lights.select("dataset").distinct().select("dataset", F.col("dataset").alias("label"), F.lit("").alias("notes"), F.lit(100.0).alias("imageWidth"), F.lit(600.0).alias("domeDiameter"), F.lit(0.0).alias("verticalOffset"), F.lit("spherical").alias("lightConfiguration"))
    path = shared_dir(spark)
    D.write_dome(domes, lights, path)
    return rounded(_loaded(spark, "dome_lights", path).where("light_id < 9").select("dataset", "light_id", "lx", "px"))


@query("s5_project_format", sql("images", "SELECT dataset, light_id, filename, skip, visible FROM (SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY light_id) - 1 AS INT) AS light_id, filename, skip, visible FROM images)"))
def s5_format(spark, d):
    i = X.images(spark, d).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("light_id", "filename", "skip", "visible"))).alias("l"))
    images = F.transform("l", lambda e: F.struct(e["filename"].alias("filename"), e["skip"].alias("skip"), e["visible"].alias("visible")))
    path = shared_dir(spark)
    i.select("dataset", F.to_json(F.struct(F.lit(1).alias("version"), images.alias("images"))).alias("value")).write.partitionBy("dataset").text(path)
    return _loaded(spark, "project_images", path)


@query("s6_image_stack", sql("raster", "SELECT x, y, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM raster"))
def s6(spark, d):
    w, h = X.sizes(spark, d)
    lines = X.raster(spark, d).groupBy("dataset", "y").agg(F.sort_array(F.collect_list(F.struct("x", "b", "g", "r"))).alias("l"))
    bgr = F.unhex(F.array_join(F.transform("l", lambda e: F.concat(*(F.lpad(F.hex(e[c]), 2, "0") for c in "bgr"))), ""))
    images = lines.select("dataset", F.col("y").alias("light_id"), F.lit(w).alias("width"), F.lit(1).alias("height"), F.lit(3).alias("channels"), bgr.alias("data"))
    return IM.decoded_stack(images).select("x", F.col("light_id").alias("y"), "r", "g", "b")


@query("s6_read_stack", sql("raster", "SELECT x, y, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM raster"))
def s6r(spark, d):
    """Image files, one for each line of the raster, written and read back."""
    w, _ = X.sizes(spark, d)
    path = shared_dir(spark)
    lines = X.raster(spark, d).groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "b", "g", "r"))).alias("l"))
    bgr = F.unhex(F.array_join(F.transform("l", lambda e: F.concat(*(F.lpad(F.hex(e[c]), 2, "0") for c in "bgr"))), ""))
    IM.write_bitmaps(lines.select(F.format_string("line%06d", "y").alias("name"), F.lit(w).alias("width"), F.lit(1).alias("height"), bgr.alias("data")), path)
    return IM.read_stack(spark, path, "d").select("x", F.col("light_id").alias("y"), "r", "g", "b")


def _coded(spark, d) -> DataFrame:
    c = F.col
    q = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: ((c("r") * (i + 1) + c("g") * i) % 256).cast("int"))
    return X.raster(spark, d).select("dataset", "x", "y", q.alias("q"))


_COD = "SELECT x, y, CAST(i AS INT) AS p, CAST((r*(i+1)+g*i) % 256 AS INT) AS q FROM raster, range(18) a(i)"


@query("s8_plane_images", sql("raster", _COD))
def s8(spark, d):
    path = shared_dir(spark)
    IM.write_planes(_coded(spark, d), path)
    return IM.read_planes(spark, path, 18).select("x", "y", F.posexplode("q").alias("p", "q"))


def _legacy(spark, d, fmt: str) -> DataFrame:
    w, h = X.sizes(spark, d)
    head = _coded(spark, d).select("dataset").distinct().select("dataset", F.lit(w).alias("width"), F.lit(h).alias("height"), F.array(*[F.lit(float(i + 1)) for i in range(6)]).alias("scale"), F.array(*[F.lit(i / 255) for i in range(6)]).alias("bias"))
    pieces = stored(IM.legacy_pieces(_coded(spark, d), head, fmt))  # both headers and pixels are read from them
    return IM.legacy_piece_tables(pieces)[1].select("x", "y", F.posexplode("q").alias("p", "q"))


@query("s9_s10_legacy_ptm", sql("raster", _COD))
def s9(spark, d):
    return _legacy(spark, d, "ptm")


@query("s9_s10_legacy_hsh", sql("raster", _COD))
def s9h(spark, d):
    return _legacy(spark, d, "hsh")


@query("s12_heightmap", sql("heights", f"WITH e AS (SELECT min(z) AS a, max(z) AS b FROM heights) SELECT x, y, {R('(z-a)/(b-a)')} AS z, {R('b-(z-a)')} AS inverted FROM heights, e"))
def s12(spark, d):
    h = X.heights(spark, d)
    inv = SF.invert_z(h).withColumnRenamed("z", "inverted")
    return rounded(SF.heightmap(h, True).join(inv, ["dataset", "x", "y"]).drop("dataset"))


@query("s12_height_tiles", sql("heights", "SELECT CAST(x//32 AS INT) AS col, CAST(y//32 AS INT) AS row, CAST(count(*) AS INT) AS n, 4096 AS bytes FROM heights GROUP BY 1,2"))
def s12t(spark, d):
    return SF.height_tiles(X.heights(spark, d), 32).select("col", "row", "n", F.length("payload").alias("bytes"))


@query("s12_read_tiles", sql("heights", "SELECT x, y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 5) + 0.0 AS z FROM heights"))
def s12_read(spark, d):
    """All heights packed into tiles of 4-byte floats, and read out of them again."""
    return rounded(SF.tile_heights(SF.height_tiles(X.heights(spark, d), 32), *X.height_size(spark, d), 32).drop("dataset"), digits=5)


@query("s13_mesh_vertices", sql("heights", f"SELECT CAST(y*w+x AS BIGINT) AS vertex, {R('(x-(w-1)/2.0::DOUBLE)*2')} AS vx, {R('((h-1-y)-(h-1)/2.0::DOUBLE)*2')} AS vy, {R('-z*2')} AS vz, {R('x/CAST(w-1 AS DOUBLE)')} AS s, {R('(h-1-y)/CAST(h-1 AS DOUBLE)')} AS t FROM heights, hw"))
def s13(spark, d):
    return rounded(SF.mesh(X.heights(spark, d), *X.height_size(spark, d), 2.0)[0].drop("dataset"))


@query("s13_mesh_faces", sql("heights", "SELECT p AS a, CASE WHEN k=0 THEN p+w ELSE p+w+1 END AS b, CASE WHEN k=0 THEN p+w+1 ELSE p+1 END AS c FROM (SELECT CAST(y*w+x AS BIGINT) AS p, w FROM heights, hw WHERE x<w-1 AND y<h-1), range(2) q(k)"))
def s13f(spark, d):
    return SF.mesh(X.heights(spark, d), *X.height_size(spark, d))[1].drop("dataset")


