"""Spans and windows: interval containment by binned endpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(spans: DataFrame, windows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Every span (keys, start, end) with each window (keys, w_start, w_end) of the same keys that holds all of it.

    An equi-join on the keys and a bin: a span lies in the bin of its start, a window in all bins that it touches, so a pair
    meets at most once, and only spans and windows of a neighbourhood meet. Choose `width` near the usual window: then a window
    has two bins, and a bin few windows. Ends are exclusive; empty spans and spans with a null end lie in no window. A key with
    many spans is spread over its bins.
    """
    own = spans.where("start < end").withColumn("__bin", F.floor(F.col("start") / F.lit(width)))
    first, last = F.floor(F.col("w_start") / F.lit(width)), F.floor((F.col("w_end") - 1) / F.lit(width))
    held = windows.where("w_start < w_end").withColumn("__bin", F.explode(F.sequence(first, last)))
    return own.join(held, [*keys, "__bin"]).where("start >= w_start and end <= w_end").drop("__bin")


def windows_with_spans(windows: DataFrame, inside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every window with `spans`: its spans (from `contained`) in order, counted from the start of the window."""
    place = F.struct((F.col("start") - F.col("w_start")).alias("start"), (F.col("end") - F.col("w_start")).alias("end"))
    own = inside.groupBy(*keys, "w_start", "w_end").agg(F.array_sort(F.collect_list(place)).alias("spans"))
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0)
    return windows.join(own, [*keys, "w_start", "w_end"], "left").withColumn("spans", F.coalesce("spans", none))


def left_out(spans: DataFrame, inside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The spans that no window holds."""
    return spans.join(inside.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")
