"""Windows over the frames of a video. All but the window picks share one partitioning by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROLLING_FRAMES = 11


def by_video() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("frame_index")


def delta(x: str | Column) -> Column:
    """Difference to the previous frame, 0 at the first."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(c - F.lag(c).over(by_video()), F.lit(0.0))


def motion(x: str, y: str) -> Column:
    """Distance to the previous frame's point; 0 at the first and where a point is missing."""
    dx, dy = F.col(x) - F.lag(x).over(by_video()), F.col(y) - F.lag(y).over(by_video())
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def trailing_mean(x: str, frames: int = ROLLING_FRAMES) -> Column:
    return F.avg(x).over(by_video().rowsBetween(1 - frames, 0))


def trailing_std(x: str, frames: int = ROLLING_FRAMES) -> Column:
    return F.stddev_pop(x).over(by_video().rowsBetween(1 - frames, 0))


def with_temporal(frames: DataFrame, area: str = "threshold_area", intensity: str = "mean_intensity", total: str = "total_intensity", x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """frames with changes to the frame before and trailing statistics; the names are those of the feature sets."""
    return frames.withColumns(
        {
            "delta_area": delta(area),
            "delta_mean_intensity": delta(intensity),
            "delta_total_intensity": delta(total),
            "centroid_motion": motion(x, y),
            "rolling_area_mean": trailing_mean(area),
            "rolling_area_std": trailing_std(area),
            "rolling_intensity_mean": trailing_mean(intensity),
            "rolling_intensity_std": trailing_std(intensity),
        }
    )


def full_windows(frames: DataFrame, value: Column, length: int, mean: bool) -> DataFrame:
    """(video_id, start, frame_index, statistic): mean or sum of value over each `length` rows in a row, full ones only."""
    place = F.row_number().over(by_video()) - 1
    ahead = by_video().rowsBetween(0, length - 1)
    stat = F.avg(value).over(ahead) if mean else F.sum(value).over(ahead)
    out = frames.select("video_id", "frame_index", place.alias("start"), stat.alias("statistic"), F.count(F.lit(1)).over(ahead).alias("n"))
    return out.filter(F.col("n") == length).drop("n")


def best_window(windows: DataFrame, length: int, inclusive: bool = False) -> DataFrame:
    """(video_id, start, end, statistic): each video's window of the largest statistic, the first of equals.

    end is past the window, or its last row if inclusive.
    """
    order = F.struct(F.col("statistic"), -F.col("start"))
    best = windows.filter("statistic IS NOT NULL").groupBy("video_id").agg(F.max(order).alias("m"))
    start = -F.col("m.col2")
    return best.select("video_id", start.alias("start"), (start + length - (1 if inclusive else 0)).alias("end"), F.col("m.statistic").alias("statistic"))


def gap_segments(frames: DataFrame, gap: int = 1) -> DataFrame:
    """frames with segment: it grows where more than `gap` frames lie between neighbours."""
    new = (F.col("frame_index") - F.lag("frame_index").over(by_video()) > gap).cast("int")
    return frames.withColumn("segment", F.coalesce(F.sum(F.coalesce(new, F.lit(0))).over(by_video().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def runs(segmented: DataFrame, label: str) -> DataFrame:
    """(video_id, segment, run, label, start, end, length): maximal runs of a label within a segment."""
    w = Window.partitionBy("video_id", "segment").orderBy("frame_index")
    change = (F.col(label) != F.lag(label).over(w)).cast("int")
    run = F.sum(F.coalesce(change, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        segmented.withColumn("run", run)
        .groupBy("video_id", "segment", "run")
        .agg(F.first(label).alias("label"), F.min("frame_index").alias("start"), F.max("frame_index").alias("end"), F.count("*").alias("length"))
    )


def switches(label: str, within_segments: bool) -> Column:
    """1 where the label differs from the row before, within segments or over all rows of the video."""
    w = Window.partitionBy("video_id", "segment").orderBy("frame_index") if within_segments else by_video()
    return F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(0))


def high_entries(label: str) -> Column:
    """1 where the label becomes 2, over all rows of the video."""
    return F.coalesce(((F.col(label) == 2) & (F.lag(label).over(by_video()) != 2)).cast("int"), F.lit(0))


def rising_edges(flag: str | Column, order: str = "frame_index", key: str = "video_id") -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return (c & ~F.lag(c, 1, False).over(Window.partitionBy(key).orderBy(order))).cast("int")


def path_segments(frames: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """(video_id, frame_index, x0, y0, x1, y1, value): lines between neighbours."""
    out = frames.select("video_id", "frame_index", F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(by_video()).alias("x1"), F.lead(y).over(by_video()).alias("y1"), F.col(value).alias("value"))
    return out.filter("x1 IS NOT NULL")
