"""Latency of decoding and inference: timed runs as rows, and the tables made of them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import first_argmax
from ..sources import avi
from . import frames as D
from . import models as M
from .images import LEVELS, MIN_THRESHOLD

REPETITIONS = 20


def timed(spark: SparkSession, name: str, items: int, run: Callable[[], object], repetitions: int = REPETITIONS) -> DataFrame:
    """(name, items, seconds): a row a repetition, after one run that isn't counted."""
    run()
    rows = []
    for _ in range(repetitions):
        began = time.perf_counter()
        run()
        rows.append((name, items, time.perf_counter() - began))
    return spark.createDataFrame(rows, "name string, items long, seconds double")


def consumed(df: DataFrame) -> Callable[[], object]:
    """A run of df that computes every row and keeps none."""
    return lambda: df.write.format("noop").mode("overwrite").save()


def latency_table(samples: DataFrame) -> DataFrame:
    """Per name: items, repetitions, median and p95 of the run in ms and of a frame in us, frames a second."""
    g = samples.groupBy("name").agg(F.max("items").alias("items"), F.count("*").alias("repetitions"), F.percentile("seconds", [0.5, 0.95]).alias("q"))
    median, p95, n = F.element_at("q", 1), F.element_at("q", 2), F.greatest("items", F.lit(1))
    return g.select(
        "name",
        "items",
        "repetitions",
        (1e3 * median).alias("median_total_ms"),
        (1e3 * p95).alias("p95_total_ms"),
        (1e6 * median / n).alias("median_us_per_frame"),
        (1e6 * p95 / n).alias("p95_us_per_frame"),
        (F.col("items") / F.greatest(median, F.lit(1e-12))).alias("median_fps"),
    )


def minimal_features(videos: DataFrame, width: int, height: int, limit: int = 500) -> DataFrame:
    """(video_id, frame_index, threshold_area, mean_intensity) of the first `limit` frames of each video."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            area, mean = [], []
            for content in pdf["pixels"]:
                hist = np.bincount(np.frombuffer(content, np.uint8), minlength=LEVELS).astype(float)
                levels = np.arange(LEVELS)
                under, mass = hist.cumsum(), (hist * levels).cumsum()
                weight = under * (under[-1] - under)
                spread = np.divide((mass[-1] * under - mass * under[-1]) ** 2, weight, out=np.zeros(LEVELS), where=weight > 0)
                area.append(int(hist[max(MIN_THRESHOLD, int(spread.argmax())) :].sum()))
                mean.append(mass[-1] / under[-1])
            yield pdf[["video_id", "frame_index"]].assign(threshold_area=area, mean_intensity=mean)

    decoded = D.first_frames(avi.decode_frames(videos, width, height), limit)
    return decoded.select("video_id", "frame_index", "pixels").mapInPandas(run, "video_id string, frame_index int, threshold_area long, mean_intensity double")


def decode_agreement(minimal: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: frames, how many the cache has once, and the mean absolute errors of both features against it."""
    known = cached.select(*D.KEYS, F.col("threshold_area").cast("double").alias("cached_area"), F.col("mean_intensity").alias("cached_intensity"))
    both = D.unique_matches(minimal, known)
    errors = both.agg(F.count("*").alias("matched"), F.avg(F.abs(F.col("threshold_area") - F.col("cached_area"))).alias("area_mae"), F.avg(F.abs(F.col("mean_intensity") - F.col("cached_intensity"))).alias("intensity_mae"))
    return minimal.agg(F.count("*").alias("frames")).crossJoin(errors)


def edge_models(train: DataFrame, features: list[str], limit: int = 10_000, seeds: int = 5) -> tuple[M.Scaler, M.Mixture, object]:
    """Scaler, mixture and the logistic model that repeats its labels, all from the first `limit` rows of train."""
    rows = D.first_rows(train, limit).persist()
    scaler = M.fit_scaler(rows, features)
    z = [f"z_{c}" for c in features]
    scaled = rows.withColumns(scaler.columns())
    mixture = M.gmm(scaled, z, starts=seeds)
    logistic = M.distil(scaled.withColumn("state", first_argmax(mixture.posterior(z))), z, "state")
    rows.unpersist()
    return scaler, mixture, logistic


def edge_benchmark(rows: DataFrame, features: list[str], scaler: M.Scaler, mixture: M.Mixture, logistic, repetitions: int = REPETITIONS) -> DataFrame:
    """(name, items, seconds) of scaling with the mixture, the mixture alone and the logistic model over stored rows."""
    spark = rows.sparkSession
    z = [f"z_{c}" for c in features]
    rows = rows.select(*features).persist()
    scaled = rows.withColumns(scaler.columns()).select(*z).persist()
    n = scaled.count()
    jobs = {
        "gmm_scaling_plus_inference": rows.withColumns(scaler.columns()).select(first_argmax(mixture.posterior(z)).alias("state")),
        "gmm_inference": scaled.select(first_argmax(mixture.posterior(z)).alias("state")),
        "logistic_inference": M.distil_predict(logistic, scaled, z).select("prediction"),
    }
    out = None
    for name, job in jobs.items():
        one = timed(spark, name, n, consumed(job), repetitions)
        out = one if out is None else out.unionByName(one)
    rows.unpersist()
    scaled.unpersist()
    return out
