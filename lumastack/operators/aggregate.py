"""Images and numbers gathered over lights, pixels, marks and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import removed, shared_dir, stored

CHANNELS = ("r", "g", "b")
BUCKETS = 1000


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(v, F.lit(255))).cast("int")


def mean_image(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset", "x", "y").agg(*(_byte(F.round(F.round(F.avg(c), 9))).alias(c) for c in CHANNELS))


def order_statistic(samples: DataFrame, index, finish) -> DataFrame:
    """Per pixel and channel the sorted value at ``index(n)``, 0-based, put through ``finish``."""
    rows = samples.groupBy("dataset", "x", "y").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in CHANNELS))
    return rows.select("dataset", "x", "y", *(finish(F.element_at(c, (index(F.size(c)) + 1).cast("int"))).alias(c) for c in CHANNELS))


def median_image(samples: DataFrame) -> DataFrame:
    """The value at 7/8 of the sorted ones."""
    return order_statistic(samples, lambda n: F.floor(n * 7 / 8), lambda v: _byte(F.round(F.round(v, 9))))


def max_image(samples: DataFrame) -> DataFrame:
    return samples.groupBy("dataset", "x", "y").agg(*(F.max(c).alias(c) for c in CHANNELS))


def albedo(samples: DataFrame, method: str = "median", pct: float = 66.0) -> DataFrame:
    """The ``pct`` order statistic, or the mean; truncated to 8 bits."""
    trunc = lambda v: _byte(F.round(v, 9).cast("int"))
    if method == "mean":
        return samples.groupBy("dataset", "x", "y").agg(*(trunc(F.avg(c)).alias(c) for c in CHANNELS))
    return order_statistic(samples, lambda n: F.floor((n - 1) * pct / 100), trunc)


def plane_ranges(coeff: DataFrame, q: float = 0.995, *, accuracy: int | None = None, small: int = 100_000) -> DataFrame:
    """(dataset, plane, n, vmin, vmax) of rows (dataset, plane, value): two exact order statistics of each plane.

    Ranks come from counts, so that no task sorts a plane: the interval that holds a rank is cut into ``BUCKETS`` equal parts,
    whose counts tell the part that holds it, and so on until that part has at most ``small`` values or a single one; only
    these are ranked. A plane whose values lie close together but for a few outliers takes one or two rounds more. With
    ``accuracy`` the ranks are approximate and need one pass.
    """
    low, high = (1 - q) / 2, (1 + q) / 2
    keys = ["dataset", "plane"]
    if accuracy:
        out = coeff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [low, high], accuracy).alias("p"))
        out = out.select(*keys, "n", F.col("p")[0].alias("vmin"), F.col("p")[1].alias("vmax"))
    else:
        spark = coeff.sparkSession
        kept = shared_dir(spark)
        coeff = stored(coeff.select(*keys, "value"), kept)  # every round reads the values; what makes them runs once
        whole = coeff.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
        rank = lambda which, f: F.struct(F.lit(which).alias("which"), F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1).alias("at"))
        open_ = whole.withColumn("r", F.explode(F.array(rank(0, low), rank(1, high)))).select(*keys, "n", F.col("r.which").alias("which"), F.col("r.at").alias("at"), "a", "b", F.col("n").alias("c"))
        path = shared_dir(spark)
        state = stored(open_, path)
        while state.where((F.col("c") > small) & (F.col("a") < F.col("b"))).limit(1).count():
            inside = coeff.join(state, keys).where((F.col("value") >= F.col("a")) & (F.col("value") <= F.col("b")))
            part = F.coalesce(F.least(F.floor(F.try_divide(F.col("value") - F.col("a"), F.col("b") - F.col("a")) * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0)).cast("int")
            parts = inside.groupBy(*keys, "which", part.alias("part")).agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("a"), F.max("value").alias("b"), F.max("n").alias("n"), F.max("at").alias("at"))
            before = F.coalesce(F.sum("k").over(Window.partitionBy(*keys, "which").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            held = parts.withColumn("before", before).where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("k")))
            step = shared_dir(spark)
            state = stored(held.select(*keys, "n", "which", (F.col("at") - F.col("before")).alias("at"), "a", "b", F.col("k").alias("c")), step)
            removed(spark, path)
            path = step
        # parts of one value have it; of the others the few values are ranked
        few = coeff.join(state.where("a < b"), keys).where((F.col("value") >= F.col("a")) & (F.col("value") <= F.col("b")))
        ranked = few.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "which").orderBy("value")) - 1).where("k = at")
        both = ranked.select(*keys, "n", "which", "value").unionByName(state.where("not a < b").select(*keys, "n", "which", F.col("a").alias("value")))
        out = stored(both.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("which") == 0, F.col("value"))).alias("vmin"), F.max(F.when(F.col("which") == 1, F.col("value"))).alias("vmax")))
        removed(spark, kept, path)
    return out.withColumn("vmax", F.when(F.col("vmax") <= F.col("vmin"), F.col("vmin") + 1e-6).otherwise(F.col("vmax")))


def channel_histogram(raster: DataFrame, bins: int = 20, top: int = 65536) -> DataFrame:
    """(dataset, channel, bin, n) of the channels, ``bins`` bins up to ``top``."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in CHANNELS])).alias("e")
    rows = raster.select("dataset", entries).select("dataset", "e.channel", F.floor(F.col("e.v") * bins / top).cast("int").alias("bin"))
    return rows.groupBy("dataset", "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


def white_grid(raster: DataFrame, width: int, height: int, cols: int = 15, rows: int = 11, *, bins: int = 50, top: int = 65536) -> DataFrame:
    """Per grid cell the white threshold of the green histogram and the mean colour above it.

    From the top bin down, once a tenth of the pixels is passed, the fullest bin is tracked; the threshold is the first bin
    with less than a tenth of it (bin 0 is not visited; without one, the last bin).
    """
    step = top // bins + 1
    cell = raster.withColumns({"col": F.least(F.floor(F.col("x") * cols / width), F.lit(cols - 1)).cast("int"), "row": F.least(F.floor(F.col("y") * rows / height), F.lit(rows - 1)).cast("int"), "bin": F.floor(F.col("g") / step).cast("int")})
    keys = ["dataset", "col", "row"]
    found = cell.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = found.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    hist = every.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("bin"))
    hist = hist.withColumn("passed", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    hist = hist.withColumn("open", F.col("passed") * 10 >= F.col("all"))
    hist = hist.withColumn("peak", F.max(F.when(F.col("open"), F.col("n"))).over(down))
    stop = F.max(F.when(F.col("open") & (F.col("n") * 10 < F.col("peak")) & (F.col("bin") > 0), F.col("bin")))
    level = hist.groupBy(*keys).agg(F.coalesce(stop, F.lit(bins - 1)).alias("threshold"))
    above = cell.join(F.broadcast(level), keys)
    lit = F.col("g") >= F.col("threshold") * step
    return above.groupBy(*keys).agg(F.max("threshold").alias("threshold"), *(F.avg(F.when(lit, F.col(c))).alias(c) for c in CHANNELS))


def histogram_fix(coeff: DataFrame) -> DataFrame:
    """Scale of each dataset by its top-light histogram: rows (dataset, channel, v) with v the value under the top light / 255.

    60 bins of 0.05 from -1; where the bin of the 95th percentile ends above 1, coefficients are divided by it.
    """
    bins = coeff.withColumn("bin", F.greatest(F.lit(0), F.least(F.floor((F.col("v") + 1) / 0.05), F.lit(59))).cast("int")).groupBy("dataset", "channel", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dataset", "channel").orderBy("bin")
    bins = bins.withColumn("below", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("dataset", "channel")))
    p95 = bins.where("below * 20 >= all * 19").groupBy("dataset", "channel").agg(F.min("bin").alias("bin"))
    top = p95.groupBy("dataset").agg(F.max(F.col("bin") * 0.05 - 1).alias("p95"))
    return top.withColumn("scale", F.when(F.col("p95") > 1, 1 / F.col("p95")).otherwise(1.0))


def average_directions(directions: DataFrame) -> DataFrame:
    """Per light the mean over spheres of the directions that are not zero, not normalised again; zero where there are none."""
    there = (F.col("lx") != 0) | (F.col("ly") != 0) | (F.col("lz") != 0)
    return directions.groupBy("dataset", "light_id").agg(*(F.coalesce(F.avg(F.when(there, F.col(c))), F.lit(0.0)).alias(c) for c in ("lx", "ly", "lz")))


def pixel_size(measures: DataFrame, width: int) -> DataFrame:
    """(dataset, pixel_size, image_width) in mm, from measures with both ends set and a positive length and distance."""
    d = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2.0)))
    rows = measures.withColumn("d", d).where("d > 0 and length > 0")
    return rows.groupBy("dataset").agg(F.avg(F.col("length") / F.col("d")).alias("pixel_size")).withColumn("image_width", F.col("pixel_size") * width)


def mean_offsets(offsets: DataFrame, lights: DataFrame) -> DataFrame:
    """Per image the mean of its alignment marks; (0, 0) without marks."""
    mean = offsets.groupBy("dataset", "light_id").agg(F.avg("ox").alias("ox"), F.avg("oy").alias("oy"))
    rows = lights.select("dataset", "light_id").join(mean, ["dataset", "light_id"], "left")
    return rows.select("dataset", "light_id", F.coalesce("ox", F.lit(0.0)).alias("ox"), F.coalesce("oy", F.lit(0.0)).alias("oy"))


def radial_bins(normals: DataFrame, width: int, height: int, bin_size: float = 100.0, floor: float = 0.7171) -> DataFrame:
    """(dataset, bin, n, slope): the mean outward component of upward normals by the length of (x, y, 1) from the centre."""
    x, y = F.col("x") - width / 2, height / 2 - F.col("y")
    n = F.sqrt(x * x + y * y + 1)
    out = (x * F.col("nx") + y * F.col("ny") + F.col("nz")) / n
    rows = normals.where(F.col("nz") >= floor).select("dataset", F.floor(n / bin_size).cast("int").alias("bin"), out.alias("out"))
    return rows.groupBy("dataset", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("out").alias("slope"))


def radial_line(bins: DataFrame, bin_size: float = 100.0) -> DataFrame:
    """(dataset, m, q): the least-squares line over the bins' centres; empty bins do not count."""
    center = (F.col("bin") + 0.5) * bin_size
    return bins.groupBy("dataset").agg(F.regr_slope("slope", center).alias("m"), F.regr_intercept("slope", center).alias("q"))


def fit_circle(border: DataFrame) -> DataFrame:
    """(dataset, sphere_id, n, cx, cy, radius) of border points, least squares by power sums; null if degenerate."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    terms = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y, "sxxx": x * x * x, "syyy": y * y * y, "sxyy": x * y * y, "sxxy": x * x * y}
    s = border.groupBy("dataset", "sphere_id").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(v).alias(k) for k, v in terms.items()))
    c = F.col
    a = c("n") * c("sxx") - c("sx") * c("sx")
    b = c("n") * c("sxy") - c("sx") * c("sy")
    d = c("n") * c("syy") - c("sy") * c("sy")
    e = (c("n") * (c("sxxx") + c("sxyy")) - c("sx") * (c("sxx") + c("syy"))) / 2
    f = (c("n") * (c("sxxy") + c("syyy")) - c("sy") * (c("sxx") + c("syy"))) / 2
    det = F.nullif(a * d - b * b, F.lit(0.0))
    s = s.withColumns({"cx": F.try_divide(e * d - b * f, det), "cy": F.try_divide(a * f - b * e, det)})
    r2 = c("cx") * c("cx") + c("cy") * c("cy") + (c("sxx") + c("syy") - 2 * c("cx") * c("sx") - 2 * c("cy") * c("sy")) / c("n")
    return s.where("n >= 3").select("dataset", "sphere_id", c("n").cast("long").alias("n"), "cx", "cy", F.sqrt(F.greatest(r2, F.lit(0.0))).alias("radius"))


def circle_residual(points: DataFrame) -> DataFrame:
    """(dataset, sphere_id, residual, ill): RMS distance to the fitted circle over its radius; 1 if there is no circle."""
    fit = fit_circle(points)
    rows = points.join(fit.drop("n"), ["dataset", "sphere_id"], "left")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d = F.sqrt(dx * dx + dy * dy) - F.col("radius")
    out = rows.groupBy("dataset", "sphere_id").agg(F.coalesce(F.try_divide(F.sqrt(F.avg(d * d)), F.max("radius")), F.lit(1.0)).alias("residual"))
    return out.withColumn("ill", F.col("residual") < 0.05)


def shared_ranges(planes: DataFrame) -> DataFrame:
    """(plane, vmin, vmax) over all datasets, of rows with scale and bias."""
    return planes.groupBy("plane").agg(F.min(-F.col("bias") * F.col("scale")).alias("vmin"), F.max((1 - F.col("bias")) * F.col("scale")).alias("vmax"))
