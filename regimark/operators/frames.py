"""Frame tables: feature sets, splits, filters, summaries."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The features of each set, the features and weights of the thermal score.
BASIC = ["threshold_area", "mean_intensity"]
APPEARANCE = [*BASIC, "std_intensity", "total_intensity", "effective_area", "p99", "p999", "saturation_fraction", "bright_fraction_128", "bright_fraction_200"]
SHAPE = ["bbox_width", "bbox_height", "bbox_fill", "major_sigma", "minor_sigma", "eccentricity", "abs_tail_skewness", "outer_intensity_fraction"]
CHANGE = ["delta_area", "delta_mean_intensity", "delta_total_intensity"]
ROLLING = ["rolling_area_mean", "rolling_area_std", "rolling_intensity_mean", "rolling_intensity_std"]
FEATURE_SETS = {
    "basic": BASIC,
    "appearance": APPEARANCE,
    "physical": [*APPEARANCE, *SHAPE, "centroid_motion"],
    "physical_temporal": [*APPEARANCE, *SHAPE, *CHANGE, "centroid_motion", *ROLLING],
}
THERMAL_WEIGHTS = {"threshold_area": 1.0, "mean_intensity": 1.0, "bright_fraction_200": 0.7, "outer_intensity_fraction": 0.3}
TRAIN_VIDEOS, VALIDATION_VIDEOS, FOLDS, SPLIT_SEED = 33, 11, 5, 42

KEYS = ["video_id", "frame_index"]


def with_features(frames: DataFrame, feature_set: str) -> DataFrame:
    return frames.select(*KEYS, *FEATURE_SETS[feature_set])


def first_frames(frames: DataFrame, limit: int = 500) -> DataFrame:
    """The first `limit` frames of each video: the feature is the cap itself."""
    return frames.filter(F.col("frame_index") < limit)


def first_rows(frames: DataFrame, limit: int = 10_000) -> DataFrame:
    """The first `limit` rows by video and frame, as a bounded training table asks for."""
    return frames.orderBy(*KEYS).limit(limit)


def active(frames: DataFrame, flag: str = "active_candidate") -> DataFrame:
    return frames.filter(F.col(flag) == 1)


def active_positions(frames: DataFrame, score: str = "p_high", flag: str = "active") -> DataFrame:
    """(video_id, place, frame_index, score): active frames with a score, numbered from 0 in a video's order."""
    kept = active(frames, flag).filter(F.col(score).isNotNull()).select("video_id", F.col("frame_index").alias("__at"), score)
    return positional(kept, ["__at"]).select("video_id", F.col("frame_index").cast("long").alias("place"), F.col("__at").alias("frame_index"), score)


def is_active(max_pixel: Column, area: Column, total: Column) -> Column:
    return ((max_pixel >= 20) & (area >= 5) & (total >= 100)).cast("int")


def video_partitions(spark: SparkSession, videos: list[str]) -> DataFrame:
    """(video_id, video_index, split, fold) of a seeded shuffle of a fixed list of videos."""
    order = sorted(videos)
    index = {v: i for i, v in enumerate(order)}
    random.Random(SPLIT_SEED).shuffle(order)
    split = lambda k: "train" if k < TRAIN_VIDEOS else "validation" if k < TRAIN_VIDEOS + VALIDATION_VIDEOS else "test"
    return spark.createDataFrame([(v, index[v], split(k), k % FOLDS) for k, v in enumerate(order)], "video_id string, video_index int, split string, fold int")


def with_split(frames: DataFrame, partitions: DataFrame) -> DataFrame:
    """frames with the split and fold of their video; Spark broadcasts the table where it is small."""
    return frames.join(partitions.select("video_id", "split", "fold"), "video_id")


def holdout(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and validation frames to fit on, test frames."""
    return frames.filter(F.col("split").isin("train", "validation")), frames.filter(F.col("split") == "test")


def cross_validation(frames: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return frames.filter(F.col("fold") != fold), frames.filter(F.col("fold") == fold)


def valid_predictions(frames: DataFrame, power: str = "power", label: str = "label", score: str = "p_high") -> DataFrame:
    """Active frames with a label, a finite power and a finite score; numbers are finite or NULL since ingest."""
    return frames.filter((F.col("active") == 1) & (F.col(label) >= 0) & F.col(power).isNotNull() & F.col(score).isNotNull())


def video_summary(frames: DataFrame, value: str) -> DataFrame:
    """Per video: frames, active frames and their share, least and largest value."""
    return frames.groupBy("video_id").agg(
        F.count("*").alias("frames"),
        F.sum("active").cast("long").alias("active_frames"),
        F.avg(F.col("active").cast("double")).alias("active_fraction"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def dataset_summary(summary: DataFrame) -> DataFrame:
    """One row over video_summary: videos, frames, and least, median and largest active share."""
    return summary.agg(
        F.count("*").alias("videos"),
        F.sum("frames").cast("long").alias("frames"),
        F.sum("active_frames").cast("long").alias("active_frames"),
        F.min("active_fraction").alias("min_fraction"),
        F.percentile("active_fraction", 0.5).alias("median_fraction"),
        F.max("active_fraction").alias("max_fraction"),
    )


def positional(rows: DataFrame, order: list[str], key: str = "video_id") -> DataFrame:
    """rows with frame_index: their place in order within their key."""
    from pyspark.sql import Window

    return rows.withColumn("frame_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def zipped(left: DataFrame, right: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of left and right at the same place; raises if some key's counts differ."""
    counts = left.groupBy(key).count().withColumnRenamed("count", "a").join(right.groupBy(key).count().withColumnRenamed("count", "b"), key, "full")
    bad = counts.filter(~F.col("a").eqNullSafe(F.col("b"))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][key]}: {bad[0]['a']} rows meet {bad[0]['b']}")
    return left.join(right, [key, "frame_index"])


def unique_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left with the one row of right of their key; keys that right has more than once don't match."""
    once = right.groupBy(*KEYS).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in KEYS]).filter("__n = 1").drop("__n")
    return left.join(once, KEYS)


def scattered(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """All frames with their prediction, NULL where there is none."""
    return frames.join(predictions, KEYS, "left")


def float_rounded(x: Column) -> Column:
    """x as stored in single precision."""
    return x.cast("float").cast("double")


def experiment_tasks(spark: SparkSession) -> DataFrame:
    """The holdout product of feature sets, models and seeds, and the cross-validation product of folds and seeds."""
    sets = spark.createDataFrame([(s,) for s in FEATURE_SETS], "feature_set string")
    models = spark.createDataFrame([(m,) for m in ("kmeans", "gmm", "anchored_gmm")], "model string")
    seeds = spark.createDataFrame([(s,) for s in (42, 123, 2026)], "seed int")
    folds = spark.range(FOLDS).select(F.col("id").cast("int").alias("fold"))
    hold = sets.crossJoin(models).crossJoin(seeds).select(F.lit("holdout").alias("protocol"), F.lit(None).cast("int").alias("fold"), "feature_set", "model", "seed")
    cv = folds.crossJoin(seeds).select(F.lit("cv").alias("protocol"), "fold", F.lit("physical_temporal").alias("feature_set"), F.lit("anchored_gmm").alias("model"), "seed")
    every = hold.unionByName(cv)
    return every.withColumn("task_id", F.concat_ws("__", "protocol", "feature_set", "model", F.concat(F.lit("fold"), "fold"), F.concat(F.lit("seed"), "seed")))
