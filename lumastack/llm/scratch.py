"""Ranges of documents, and the prefix sums and shared folder of the library."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..prefix import exclusive_starts, prefix_of_parts
from ..shared import removed, shared_dir, stored

__all__ = ["ORDER", "exclusive_starts", "first_keys", "keyed", "part_of", "prefix_of_parts", "range_of", "removed", "shared_dir", "stored"]

#: A total order of documents: null ids first, then the id, and a hash of the text among ties.
ORDER = ["known", "id", "tie"]


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, known, id, tie) of documents; null texts are empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.select("*", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"))


def first_keys(rows: DataFrame, n: int) -> list[tuple]:
    """The first keys (by ``ORDER``) of at most ``n`` ranges of about as many rows each; only these reach the driver."""
    keys = rows.select(*ORDER).repartitionByRange(n, *ORDER).withColumn("part", F.spark_partition_id())
    return sorted(tuple(r["h"]) for r in keys.groupBy("part").agg(F.min(F.struct(*ORDER)).alias("h")).collect())


def part_of(heads: list[tuple], key: tuple) -> int:
    """The number of the range that a key falls in."""
    return max(bisect_right(heads, key) - 1, 0)


def range_of(heads: list[tuple]) -> Callable:
    """(part, first): the number of the range that a key (known, id, tie) falls in, and whether it is the range's first."""

    @F.pandas_udf("part int, first boolean")
    def found(known: pd.Series, doc_id: pd.Series, tie: pd.Series) -> pd.DataFrame:
        keys = list(zip(known.tolist(), doc_id.tolist(), tie.tolist(), strict=True))
        part = [part_of(heads, k) for k in keys]
        return pd.DataFrame({"part": pd.array(part, "int32"), "first": [k == heads[p] for k, p in zip(keys, part, strict=True)]})

    return found
