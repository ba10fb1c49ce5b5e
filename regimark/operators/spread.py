"""Windows over videos that are longer than a task: videos are cut into stretches of frame numbers.

Trailing windows get the rows before a stretch as a halo. Runs are found in each stretch, and those at its borders are
joined with their neighbours'. What goes through one task for a whole video are a few rows a stretch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.store import stored
from .events import MIN_EVENT_FRAMES
from .windows import ROLLING_FRAMES

STRETCH = 65_536
STAGE = ["video_id", "__stretch"]


def by_stretch() -> WindowSpec:
    return Window.partitionBy(*STAGE).orderBy("frame_index")


def with_halo(frames: DataFrame, rows: int, stretch: int = STRETCH) -> DataFrame:
    """frames with their stretch, and again in each later stretch for which they are among the `rows` rows before it.

    __halo tells these copies. A video may leave out numbers, so such rows may lie several stretches back.
    """
    cut = frames.withColumn("__stretch", F.floor(F.col("frame_index") / stretch))
    first, last = (F.row_number().over(Window.partitionBy(*STAGE).orderBy(o)) for o in (F.asc("frame_index"), F.desc("frame_index")))
    edges = cut.withColumns({"__first": first, "__last": last}).filter((F.col("__first") == 1) | (F.col("__last") <= rows))
    # Between a row and the first one of a later stretch lie edges alone if there are fewer than `rows`.
    ahead = Window.partitionBy("video_id").orderBy("frame_index").rowsBetween(1, rows)
    later = F.array_distinct(F.filter(F.collect_list("__stretch").over(ahead), lambda s: s > F.col("__stretch")))
    halo = edges.withColumn("__later", later).withColumn("__stretch", F.explode("__later")).drop("__first", "__last", "__later")
    return cut.withColumn("__halo", F.lit(False)).unionByName(halo.withColumn("__halo", F.lit(True)))


def trailing(frames: DataFrame, rows: int, columns: Callable[[WindowSpec], dict[str, Column]], stretch: int = STRETCH) -> DataFrame:
    """frames with columns over windows of up to `rows` rows that end at theirs; columns(spec) makes them."""
    wide = with_halo(frames, rows - 1, stretch)
    return wide.withColumns(columns(by_stretch())).filter("NOT __halo").drop("__stretch", "__halo")


def temporal_features(frames: DataFrame, area: str = "threshold_area", intensity: str = "mean_intensity", total: str = "total_intensity", x: str = "centroid_x", y: str = "centroid_y", stretch: int = STRETCH) -> DataFrame:
    """What windows.with_temporal gives."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        zero, back = F.lit(0.0), w.rowsBetween(1 - ROLLING_FRAMES, 0)
        change = {c: F.col(v) - F.lag(v).over(w) for c, v in (("delta_area", area), ("delta_mean_intensity", intensity), ("delta_total_intensity", total))}
        dx, dy = (F.col(v) - F.lag(v).over(w) for v in (x, y))
        rolling = {f"rolling_{n}_{s}": f(v).over(back) for n, v in (("area", area), ("intensity", intensity)) for s, f in (("mean", F.avg), ("std", F.stddev_pop))}
        return {c: F.coalesce(v, zero) for c, v in change.items()} | {"centroid_motion": F.coalesce(F.sqrt(dx * dx + dy * dy), zero)} | rolling

    return trailing(frames, ROLLING_FRAMES, columns, stretch)


def gap_segments(frames: DataFrame, gap: int = 1, stretch: int = STRETCH) -> DataFrame:
    """What windows.gap_segments gives: the number of gaps before a frame, from those of the stretches before its own."""
    wide = with_halo(frames, 1, stretch)
    new = F.coalesce((F.col("frame_index") - F.lag("frame_index").over(by_stretch()) > gap).cast("long"), F.lit(0))
    cut = stored(wide.withColumn("__new", new).filter("NOT __halo").drop("__halo"), "stretches")
    upto = F.sum("__new").over(by_stretch().rowsBetween(Window.unboundedPreceding, 0))
    before = cut.groupBy(*STAGE).agg(F.sum("__new").alias("__gaps"))
    earlier = F.sum("__gaps").over(Window.partitionBy("video_id").orderBy("__stretch")) - F.col("__gaps")
    before = before.select(F.col("video_id").alias("__video"), F.col("__stretch").alias("__s"), earlier.alias("__before"))
    same = F.col("video_id").eqNullSafe(F.col("__video")) & (F.col("__stretch") == F.col("__s"))
    return cut.withColumn("segment", upto).join(before, same).withColumn("segment", F.col("segment") + F.col("__before")).select(*frames.columns, "segment")


def events(frames: DataFrame, flag: Column, min_frames: int = MIN_EVENT_FRAMES, stretch: int = STRETCH) -> DataFrame:
    """What events.events gives: runs of flagged frames in a row, of min_frames or more.

    A run that begins or ends at a border of its stretch meets those beside it, of which a stretch has two at most.
    """
    hits = frames.filter(flag).select("video_id", "frame_index", F.floor(F.col("frame_index") / stretch).alias("__stretch"))
    island = F.col("frame_index") - F.row_number().over(by_stretch())
    runs = hits.withColumn("island", island).groupBy(*STAGE, "island").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end")).drop("island", "__stretch")
    runs = stored(runs, "runs")
    open_ = (F.pmod("start", F.lit(stretch)) == 0) | (F.pmod(F.col("end") + 1, F.lit(stretch)) == 0)
    w = Window.partitionBy("video_id").orderBy("start")
    group = F.sum(F.when(F.col("start") == F.lag("end").over(w) + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = runs.filter(open_).withColumn("__run", group).groupBy("video_id", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")
    return runs.filter(~open_).unionByName(joined).filter(F.col("end") - F.col("start") + 1 >= min_frames)
