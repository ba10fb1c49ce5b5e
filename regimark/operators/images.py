"""Image features of frames: a relational path over histograms and moments, and a fast path over arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divided

LEVELS = 256
MIN_THRESHOLD = 8
#: Frames whose features a task holds at once.
BATCH = 256


def histogram(pixels: DataFrame, key: str = "frame_id") -> DataFrame:
    """(key, level, n) of pixel rows (key, x, y, level)."""
    return pixels.groupBy(key, "level").agg(F.count("*").alias("n"))


def histogram_features(hist: DataFrame, key: str = "frame_id") -> DataFrame:
    """Per frame: pixels, least and largest level, mean, deviation, total, p95, p99, p999 (discrete), entropy in
    bits, fractions of bright levels, Otsu and segmentation thresholds and the area from the latter on."""
    w = Window.partitionBy(key).orderBy("level")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    h = hist.withColumns({"wt": F.sum("n").over(upto), "st": F.sum(F.col("n") * F.col("level")).over(upto), "total": F.sum("n").over(whole), "mass": F.sum(F.col("n") * F.col("level")).over(whole)})
    below = F.col("wt") * (F.col("total") - F.col("wt"))
    gap = F.col("mass").cast("double") * F.col("wt") - F.col("st").cast("double") * F.col("total")
    h = h.withColumn("between", F.when(below == 0, 0.0).otherwise(gap * gap / F.greatest(below, F.lit(1))))
    p = F.col("n") / F.col("total")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.max("total")
    q = lambda x: F.min(F.when(F.col("wt") >= x * F.col("total"), F.col("level")))
    mean = F.max("mass") / F.max("total")
    out = h.groupBy(key).agg(
        F.max("total").alias("pixels"),
        F.min("level").alias("pixel_min"),
        F.max("level").alias("pixel_max"),
        mean.alias("mean_intensity"),
        F.sqrt(F.greatest(F.sum(F.col("n") * F.col("level") * F.col("level")) / F.max("total") - mean * mean, F.lit(0.0))).alias("std_intensity"),
        F.max("mass").alias("total_intensity"),
        q(0.95).alias("p95"),
        q(0.99).alias("p99"),
        q(0.999).alias("p999"),
        F.sum(-p * F.log2(p)).alias("entropy"),
        share(F.col("level") > 0).alias("nonzero_fraction"),
        share(F.col("level") == 255).alias("saturation_fraction"),
        share(F.col("level") >= 64).alias("bright_fraction_64"),
        share(F.col("level") >= 128).alias("bright_fraction_128"),
        share(F.col("level") >= 200).alias("bright_fraction_200"),
        (-F.max(F.struct("between", -F.col("level"))).getField("col2")).alias("otsu_threshold"),
        F.sort_array(F.collect_list(F.struct("level", "n"))).alias("__h"),
    )
    threshold = F.greatest("otsu_threshold", F.lit(MIN_THRESHOLD))
    area = F.aggregate(F.filter("__h", lambda x: x.level >= threshold), F.lit(0).cast("long"), lambda a, x: a + x.n)
    out = out.withColumns({"segmentation_threshold": threshold, "threshold_area": area, "effective_area": divided(F.col("total_intensity"), F.col("pixel_max"))})
    return out.withColumn("threshold_area_fraction", F.col("threshold_area") / F.col("pixels")).drop("__h")


def mask_box(pixels: DataFrame, thresholds: DataFrame, key: str = "frame_id") -> DataFrame:
    """Per frame the box, fill and centroid of pixels from the segmentation threshold on; 0 and NULL if none."""
    inside = pixels.join(thresholds.select(key, "segmentation_threshold"), key)
    hit = F.col("level") >= F.col("segmentation_threshold")
    x, y = F.when(hit, F.col("x")), F.when(hit, F.col("y"))
    out = inside.groupBy(key).agg(
        F.count(x).alias("area"),
        F.coalesce(F.max(x) - F.min(x) + 1, F.lit(0)).alias("bbox_width"),
        F.coalesce(F.max(y) - F.min(y) + 1, F.lit(0)).alias("bbox_height"),
        F.avg(x).alias("threshold_centroid_x"),
        F.avg(y).alias("threshold_centroid_y"),
    )
    return out.withColumn("bbox_fill", divided(F.col("area"), F.col("bbox_width") * F.col("bbox_height"))).drop("area")


def moments(pixels: DataFrame, key: str = "frame_id") -> DataFrame:
    """Per frame the weighted centroid, the deviations along the principal axes, eccentricity, orientation and
    skewness along the major axis (its direction has positive x, or y where x is 0) and the weight outside of
    the ellipse of three deviations, at least one pixel wide. A blank frame has no centroid, and zeros."""
    w = F.col("level").cast("double")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = pixels.groupBy(key).agg(F.sum(w).alias("m"), F.sum(w * x).alias("mx"), F.sum(w * y).alias("my"), F.sum(w * x * x).alias("mxx"), F.sum(w * y * y).alias("myy"), F.sum(w * x * y).alias("mxy"))
    blank = s.filter("m = 0").select(key)
    s = s.filter("m > 0").withColumns({"centroid_x": F.col("mx") / F.col("m"), "centroid_y": F.col("my") / F.col("m")})
    cx, cy = F.col("centroid_x"), F.col("centroid_y")
    s = s.withColumns({"a": F.col("mxx") / F.col("m") - cx * cx, "b": F.col("mxy") / F.col("m") - cx * cy, "c": F.col("myy") / F.col("m") - cy * cy})
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) * ((F.col("a") - F.col("c")) / 2) + F.col("b") * F.col("b"))
    angle = F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2
    s = s.withColumns({"major_sigma": F.sqrt(F.greatest(half + root, F.lit(0.0))), "minor_sigma": F.sqrt(F.greatest(half - root, F.lit(0.0))), "angle": angle})
    s = s.withColumn("eccentricity", F.when(F.col("major_sigma") > 0, F.sqrt(F.greatest(1 - F.col("minor_sigma") / F.greatest(F.col("major_sigma"), F.lit(1e-300)), F.lit(0.0)))).otherwise(0.0))
    axes = s.select(key, "m", "centroid_x", "centroid_y", "major_sigma", "minor_sigma", "eccentricity", "angle")
    along = (x - cx) * F.cos("angle") + (y - cy) * F.sin("angle")
    across = -(x - cx) * F.sin("angle") + (y - cy) * F.cos("angle")
    far = lambda v, sigma: (v / F.greatest(3 * F.col(sigma), F.lit(1.0))) * (v / F.greatest(3 * F.col(sigma), F.lit(1.0)))
    third = pixels.join(axes, key).groupBy(key).agg(
        F.first("centroid_x").alias("centroid_x"),
        F.first("centroid_y").alias("centroid_y"),
        F.first("major_sigma").alias("major_sigma"),
        F.first("minor_sigma").alias("minor_sigma"),
        F.first("eccentricity").alias("eccentricity"),
        F.degrees(F.first("angle")).alias("orientation_deg"),
        (F.sum(w * along * along * along) / F.first("m")).alias("m3"),
        (F.sum(F.when(far(along, "major_sigma") + far(across, "minor_sigma") > 1, w).otherwise(0.0)) / F.first("m")).alias("outer_intensity_fraction"),
    )
    cube = F.col("major_sigma") * F.col("major_sigma") * F.col("major_sigma")
    skew = F.when(F.col("major_sigma") > 1e-9, F.col("m3") / F.greatest(cube, F.lit(1e-300))).otherwise(0.0)
    lit = third.withColumn("tail_skewness", skew).withColumn("abs_tail_skewness", F.abs("tail_skewness")).drop("m3")
    nothing = {c: F.lit(None if c.startswith("centroid") else 0.0).cast("double") for c in lit.columns if c != key}
    return lit.unionByName(blank.withColumns(nothing))


def frame_features(image: np.ndarray) -> dict[str, float]:
    """All image features of one frame by array operations."""
    flat = image.ravel()
    n, hist = flat.size, np.bincount(flat, minlength=LEVELS)
    cum, levels = np.cumsum(hist), np.arange(LEVELS)
    mass = float(hist @ levels)
    p = hist[hist > 0] / n
    st = np.cumsum(hist * levels).astype(float)
    below = cum.astype(float) * (n - cum)
    between = np.where(below > 0, (mass * cum - st * n) ** 2 / np.maximum(below, 1), 0.0)
    otsu = int(between.argmax())
    threshold = max(MIN_THRESHOLD, otsu)
    ys, xs = np.nonzero(image >= threshold)
    area = len(xs)
    width, height = (int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if area else (0, 0)
    out = {
        "pixel_min": int(flat.min()), "pixel_max": int(flat.max()), "mean_intensity": mass / n, "std_intensity": float(flat.std()), "total_intensity": int(mass),
        **{k: int(np.searchsorted(cum, q * n)) for k, q in (("p95", 0.95), ("p99", 0.99), ("p999", 0.999))},
        "entropy": float(-(p * np.log2(p)).sum()), "otsu_threshold": otsu, "segmentation_threshold": threshold, "threshold_area": area, "threshold_area_fraction": area / n,
        "bbox_width": width, "bbox_height": height, "bbox_fill": area / (width * height) if area else 0.0,
        "threshold_centroid_x": float(xs.mean()) if area else None, "threshold_centroid_y": float(ys.mean()) if area else None,
        "nonzero_fraction": 1 - hist[0] / n, "saturation_fraction": hist[255] / n, **{f"bright_fraction_{k}": hist[k:].sum() / n for k in (64, 128, 200)},
        "effective_area": mass / flat.max() if flat.max() else 0.0,
    }
    out["active_candidate"] = int(out["pixel_max"] >= 20 and area >= 5 and mass >= 100)
    return out | _moments(image)


def _moments(image: np.ndarray) -> dict[str, float]:
    names = ("centroid_x", "centroid_y", "major_sigma", "minor_sigma", "eccentricity", "orientation_deg", "tail_skewness", "abs_tail_skewness", "outer_intensity_fraction")
    w = image.astype(float)
    m = w.sum()
    if not m:
        return dict.fromkeys(names[:2]) | dict.fromkeys(names[2:], 0.0)
    y, x = np.mgrid[: image.shape[0], : image.shape[1]]
    cx, cy = (w * x).sum() / m, (w * y).sum() / m
    dx, dy = x - cx, y - cy
    a, b, c = (w * dx * dx).sum() / m, (w * dx * dy).sum() / m, (w * dy * dy).sum() / m
    root = np.hypot((a - c) / 2, b)
    major, minor = np.sqrt(max((a + c) / 2 + root, 0)), np.sqrt(max((a + c) / 2 - root, 0))
    angle = np.arctan2(2 * b, a - c) / 2
    along, across = dx * np.cos(angle) + dy * np.sin(angle), dy * np.cos(angle) - dx * np.sin(angle)
    skew = (w * along**3).sum() / m / major**3 if major > 1e-9 else 0.0
    outer = w[(along / max(3 * major, 1)) ** 2 + (across / max(3 * minor, 1)) ** 2 > 1].sum() / m
    ecc = np.sqrt(max(0.0, 1 - minor / major)) if major > 0 else 0.0
    return dict(zip(names, map(float, (cx, cy, major, minor, ecc, np.degrees(angle), skew, abs(skew), outer)), strict=True))


INTEGER_FEATURES = {"pixel_min", "pixel_max", "total_intensity", "p95", "p99", "p999", "otsu_threshold", "segmentation_threshold", "threshold_area", "bbox_width", "bbox_height", "active_candidate"}


def extract_features(frames: DataFrame, width: int, height: int) -> DataFrame:
    """(video_id, frame_index, features...) of decoded frames, BATCH of them at a time."""
    names = list(frame_features(np.zeros((height, width), np.uint8)))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                few = pdf.iloc[at : at + BATCH]
                made = [frame_features(np.frombuffer(p, np.uint8).reshape(height, width)) for p in few["pixels"]]
                yield pd.concat([few[["video_id", "frame_index"]].reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    kinds = ", ".join(f"{k} {'long' if k in INTEGER_FEATURES else 'double'}" for k in names)
    out = frames.select("video_id", "frame_index", "pixels").mapInPandas(run, f"video_id string, frame_index int, {kinds}")
    return out.withColumns({"physical_time_s": F.col("frame_index") / 20000.0, "physical_time_ms": F.col("frame_index") / 20.0})
