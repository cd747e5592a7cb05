"""Normals of captures whose samples arrive as a stream: moment sums a pixel, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.normals import normals_l2


def streaming_normals(samples: DataFrame, lights: DataFrame) -> DataFrame:
    """A streaming version of the least-squares normals: write it in update or complete mode.

    Every pixel's state is nine sums, however many lights its capture has; a pixel's normal is null until three independent
    lights have come. A sample that arrives twice counts twice: drop repeats first where the source may send them.
    """
    return normals_l2(samples, lights)
