"""Picks and tables of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import cumulative


def greedy_picks(records: DataFrame, steps: list[tuple[str, str]], key: str) -> DataFrame:
    """(kind, key): for each step the record of the largest value among those not picked yet, the least key of equals.

    One job a step; each brings one row to the driver.
    """
    used: list = []
    rows = []
    for kind, value in steps:
        left = records.filter(~F.col(key).isin(used)) if used else records
        best = left.filter(F.col(value).isNotNull()).orderBy(F.desc(value), key).select(key).limit(1).collect()
        if best:
            used.append(best[0][0])
            rows.append((kind, best[0][0]))
    return records.sparkSession.createDataFrame(rows, f"kind string, {key} {records.schema[key].dataType.simpleString()}")


def upper_median(records: DataFrame, value: str, key: str) -> DataFrame:
    """The record at place n // 2 of the order by value, ties by key; keys are distinct. Places come from sums over
    ranges of the order, so no task holds all records."""
    placed = cumulative(records.withColumns({"__order": F.struct(value, key), "__one": F.lit(1)}), "__order", {"__one": "__place"})
    n = records.agg(F.count("*").alias("__n"))
    return placed.crossJoin(F.broadcast(n)).filter(F.col("__place") == F.floor(F.col("__n") / 2) + 1).drop("__order", "__one", "__place", "__n")


def snapshot_frames(frames: DataFrame, p: list[str]) -> DataFrame:
    """(video_id, low, nominal, high): each regime's most confident frame, else the middle row's."""
    conf = F.greatest(*p)
    w = Window.partitionBy("video_id").orderBy("frame_index")
    placed = frames.withColumns({"__at": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy("video_id"))})
    pick = lambda k: F.coalesce(-F.max(F.when(F.col("label") == k, F.struct(conf.alias("c"), (-F.col("frame_index")).alias("f")))).getField("f"), F.min(F.when(F.col("__at") == F.floor(F.col("__n") / 2), F.col("frame_index"))))
    return placed.groupBy("video_id").agg(*[pick(k).alias(n) for k, n in enumerate(("low", "nominal", "high"))])


def hexagons(rows: DataFrame, x: str, y: str, grid: int) -> DataFrame:
    """(hex_x, hex_y, n, log_n): counts by the nearer of two offset lattices, grid columns wide."""
    box = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rows = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).crossJoin(F.broadcast(box))  # the box is one row
    tall = int(grid / 3**0.5)
    u = (F.col("x") - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-12)) * grid
    v = (F.col("y") - F.col("y0")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-12)) * tall
    a, b, c, d = F.round(u), F.round(v), F.floor(u) + 0.5, F.floor(v) + 0.5
    near = lambda p, q: (u - p) * (u - p) + 3 * (v - q) * (v - q)
    first = near(a, b) < near(c, d)
    cell = rows.select(F.when(first, a).otherwise(c).alias("hex_x"), F.when(first, b).otherwise(d).alias("hex_y"))
    return cell.groupBy("hex_x", "hex_y").agg(F.count("*").alias("n")).withColumn("log_n", F.log10("n"))
