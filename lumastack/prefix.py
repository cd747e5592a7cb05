"""Prefix sums over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


def exclusive_starts(df: DataFrame, order: list[str], value: str, start: str, partitions: int | None = None) -> DataFrame:
    """Add ``start``: the sum of ``value`` over all rows before this one by ``order``, without one global window."""
    return running_starts(df, order, {start: value}, partitions)


def running_starts(df: DataFrame, order: list[str], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add for each (name, value) of ``sums`` a column ``name``: the sum of ``value`` over all rows before this one by ``order``.

    Rows are range-partitioned and sorted; each partition's total is summed over the (few) partitions before it, and a
    window inside the partition adds the rest. The rows are stored first, as both passes must see one partitioning.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumns({f"_in{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(sums.values())})
    for i, (name, v) in enumerate(sums.items()):
        before = prefix_of_parts(cut.groupBy("_part").agg(F.sum(v).alias("_sum")))
        rows = rows.join(before, "_part", "left").withColumn(name, F.col(f"_in{i}") + F.coalesce("_before", F.lit(0))).drop("_before")
    return rows.drop("_part", *(f"_in{i}" for i in range(len(sums))))


def prefix_of_parts(sums: DataFrame) -> DataFrame:
    """(_part, _sum) -> (_part, _before), in two levels, so that no task sees more than the square root of the parts."""
    width = 512
    sums = sums.withColumn("_block", F.expr(f"_part div {width}"))
    w = Window.partitionBy("_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("_block").agg(F.sum("_sum").alias("_bsum"))
    wb = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_bsum").over(wb), F.lit(0)).alias("_bbefore"))
    inner = sums.withColumn("_ibefore", F.coalesce(F.sum("_sum").over(w), F.lit(0)))
    return inner.join(blocks, "_block").select("_part", (F.col("_ibefore") + F.col("_bbefore")).alias("_before"))
