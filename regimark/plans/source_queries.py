"""Queries of binary sources over rows made for them, and of time windows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import images as I
from ..sources import avi, tables
from ..streaming import frames as ST
from .registry import query
from .views import PIXELS, table

WIDTH = HEIGHT = 8


def _video_bytes():
    """A column: each vector as a video of one frame, built as bytes from its values."""
    @F.pandas_udf("binary")
    def made(v: pd.Series) -> pd.Series:
        out = []
        for e in v:
            image = np.minimum(255, np.floor(np.abs(np.asarray(e, float)) * 255)).astype(np.uint8).reshape(HEIGHT, WIDTH)
            body = np.repeat(image[::-1, :, None], 3, axis=2).tobytes()
            chunk = b"00db" + struct.pack("<I", len(body)) + body
            movi = b"LIST" + struct.pack("<I", 4 + len(chunk)) + b"movi" + chunk
            out.append(b"RIFF" + struct.pack("<I", 4 + len(movi)) + b"AVI " + movi)
        return pd.Series(out)

    return made


def _video_files(vectors):
    """(name, content): 64 vectors in a row as a video; frames lie in nested record lists of eight, and every fifth
    vector has other planes beside the first."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for key, e in pdf.sort_values("vec_id")[["vec_id", "embedding"]].itertuples(index=False):
            image = np.minimum(255, np.floor(np.abs(np.asarray(e, float)) * 255)).astype(np.uint8).reshape(HEIGHT, WIDTH)[::-1]
            other = image ^ 1 if key % 5 == 0 else image
            frames.append(chunk(b"00db", np.stack([image, image, other], axis=2).tobytes()) + chunk(b"ix00", b"abc"))
        groups = [chunk(b"LIST", b"rec " + b"".join(frames[k : k + 8])) for k in range(0, len(frames), 8)]
        content = chunk(b"RIFF", b"AVI " + chunk(b"JUNK", b"x") + chunk(b"LIST", b"movi" + b"".join(groups)))
        return pd.DataFrame({"name": [f"v{int(pdf['vec_id'].iloc[0]) // 64}.avi"], "content": [content]})

    return vectors.groupBy(F.floor(F.col("vec_id") / 64)).applyInPandas(made, "name string, content binary")


def _frames(spark, sf):
    videos = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), _video_bytes()("embedding").alias("content"))
    return avi.decode_frames(videos, WIDTH, HEIGHT)


PIXEL_SUMS = "list_sum(list_transform(embedding, lambda e: least(255, CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS BIGINT))))"


@query("s1_s4_video_frames", f"SELECT CAST(vec_id AS VARCHAR) AS video_id, 0 AS frame_index, CAST({PIXEL_SUMS} AS BIGINT) AS total, 0 AS unequal FROM embeddings")
def video_frames(spark, sf):
    f = I.extract_features(_frames(spark, sf), WIDTH, HEIGHT).select("video_id", "frame_index", F.col("total_intensity").alias("total"))
    return f.join(_frames(spark, sf).select("video_id", "frame_index", "unequal"), ["video_id", "frame_index"])


def _features_sql() -> str:
    """All features by counts of levels, boxes of masks, and moments along axes."""
    mean = lambda x: f"sum(level * {x}) / any_value(mass)"
    fractions = ", ".join(f"coalesce(sum(n) FILTER (level >= {k}), 0) / max(total) AS bright_fraction_{k}" for k in (64, 128, 200))
    rounded = [
        "mean_intensity", "std_intensity", "entropy", "threshold_area_fraction", "bbox_fill", "threshold_centroid_x", "threshold_centroid_y", "nonzero_fraction", "saturation_fraction", "bright_fraction_64",
        "bright_fraction_128", "bright_fraction_200", "effective_area", "centroid_x", "centroid_y", "major_sigma", "minor_sigma", "eccentricity", "orientation_deg", "tail_skewness", "abs_tail_skewness", "outer_intensity_fraction",
    ]
    return f"""WITH {PIXELS}, h AS (SELECT frame_id, level, count(*) AS n FROM pixels GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER w AS wt, sum(n * level) OVER w AS st, sum(n) OVER f AS total, sum(n * level) OVER f AS mass FROM h WINDOW w AS (PARTITION BY frame_id ORDER BY level), f AS (PARTITION BY frame_id)),
o AS (SELECT *, CASE WHEN wt = total THEN 0.0 ELSE pow(CAST(mass AS DOUBLE) * wt - CAST(st AS DOUBLE) * total, 2) / (wt * (total - wt)) END AS between_ FROM c),
t AS (SELECT frame_id, arg_min(level, struct_pack(a := -between_, b := level)) AS otsu, CAST(any_value(mass) AS DOUBLE) AS mass FROM o GROUP BY 1),
levels AS (SELECT frame_id, min(level) AS pixel_min, max(level) AS pixel_max, max(o.mass) / max(total) AS mean_intensity, sqrt(greatest(sum(CAST(n * level * level AS DOUBLE)) / max(total) - pow(max(o.mass) / max(total), 2), 0)) AS std_intensity, max(o.mass) AS total_intensity,
  min(level) FILTER (wt >= 0.95 * total) AS p95, min(level) FILTER (wt >= 0.99 * total) AS p99, min(level) FILTER (wt >= 0.999 * total) AS p999, sum(-(n / total) * log2(n / total)) AS entropy, any_value(otsu) AS otsu_threshold, greatest(any_value(otsu), 8) AS segmentation_threshold,
  coalesce(sum(n) FILTER (level >= greatest(otsu, 8)), 0) AS threshold_area, coalesce(sum(n) FILTER (level >= greatest(otsu, 8)), 0) / max(total) AS threshold_area_fraction, 1 - coalesce(sum(n) FILTER (level = 0), 0) / max(total) AS nonzero_fraction,
  coalesce(sum(n) FILTER (level = 255), 0) / max(total) AS saturation_fraction, {fractions}, coalesce(max(o.mass) / nullif(max(level), 0), 0) AS effective_area FROM o JOIN t USING (frame_id) GROUP BY frame_id),
box AS (SELECT frame_id, max(x) - min(x) + 1 AS bbox_width, max(y) - min(y) + 1 AS bbox_height, count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS bbox_fill, avg(x) AS threshold_centroid_x, avg(y) AS threshold_centroid_y FROM pixels JOIN t USING (frame_id) WHERE level >= greatest(otsu, 8) GROUP BY 1),
centre AS (SELECT frame_id, {mean("x")} AS cx, {mean("y")} AS cy FROM pixels JOIN t USING (frame_id) WHERE mass > 0 GROUP BY 1),
second AS (SELECT frame_id, any_value(cx) AS cx, any_value(cy) AS cy, {mean("(x - cx) * (x - cx)")} AS a, {mean("(x - cx) * (y - cy)")} AS b, {mean("(y - cy) * (y - cy)")} AS c FROM pixels JOIN t USING (frame_id) JOIN centre USING (frame_id) GROUP BY 1),
axes AS (SELECT *, sqrt(greatest((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 0)) AS major, sqrt(greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0)) AS minor, atan2(2 * b, a - c) / 2 AS angle FROM second),
turned AS (SELECT frame_id, level, mass, cx, cy, major, minor, angle, (x - cx) * cos(angle) + (y - cy) * sin(angle) AS along, (y - cy) * cos(angle) - (x - cx) * sin(angle) AS across FROM pixels JOIN t USING (frame_id) JOIN axes USING (frame_id)),
shape AS (SELECT frame_id, any_value(cx) AS centroid_x, any_value(cy) AS centroid_y, any_value(major) AS major_sigma, any_value(minor) AS minor_sigma, CASE WHEN any_value(major) > 0 THEN sqrt(greatest(0, 1 - any_value(minor) / any_value(major))) ELSE 0 END AS eccentricity, degrees(any_value(angle)) AS orientation_deg,
  CASE WHEN any_value(major) > 1e-9 THEN {mean("pow(along, 3)")} / pow(any_value(major), 3) ELSE 0 END AS tail_skewness, coalesce(sum(level) FILTER (pow(along / greatest(3 * major, 1), 2) + pow(across / greatest(3 * minor, 1), 2) > 1), 0) / any_value(mass) AS outer_intensity_fraction FROM turned GROUP BY 1),
every AS (SELECT * EXCLUDE (bbox_width, bbox_height, bbox_fill, major_sigma, minor_sigma, eccentricity, orientation_deg, tail_skewness, outer_intensity_fraction), coalesce(bbox_width, 0) AS bbox_width, coalesce(bbox_height, 0) AS bbox_height, coalesce(bbox_fill, 0) AS bbox_fill, coalesce(major_sigma, 0) AS major_sigma, coalesce(minor_sigma, 0) AS minor_sigma,
  coalesce(eccentricity, 0) AS eccentricity, coalesce(orientation_deg, 0) AS orientation_deg, coalesce(tail_skewness, 0) AS tail_skewness, coalesce(abs(tail_skewness), 0) AS abs_tail_skewness, coalesce(outer_intensity_fraction, 0) AS outer_intensity_fraction FROM levels LEFT JOIN box USING (frame_id) LEFT JOIN shape USING (frame_id))
SELECT CAST(frame_id AS VARCHAR) AS video_id, 0 AS frame_index, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("pixel_min", "pixel_max", "total_intensity", "p95", "p99", "p999", "otsu_threshold", "segmentation_threshold", "threshold_area", "bbox_width", "bbox_height"))},
CAST(pixel_max >= 20 AND threshold_area >= 5 AND total_intensity >= 100 AS BIGINT) AS active_candidate, {", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in rounded)}, 0.0::DOUBLE AS physical_time_s, 0.0::DOUBLE AS physical_time_ms FROM every"""


@query("p2_fast_image_features", _features_sql())
def fast_image_features(spark, sf):
    f = I.extract_features(_frames(spark, sf), WIDTH, HEIGHT)
    return f.select(*[S.rounded(F.col(c), 5).alias(c) if kind == "double" else c for c, kind in f.dtypes])


@query("s5_selected_frames", "SELECT CAST(vec_id AS VARCHAR) AS video_id, 0 AS frame_index FROM embeddings WHERE label = 1")
def selected_frames(spark, sf):
    wanted = table(spark, sf, "embeddings").filter("label = 1").select(F.col("vec_id").cast("string").alias("video_id"), F.lit(0).alias("frame_index"))
    return avi.selected_frames(_frames(spark, sf), wanted).select("video_id", "frame_index")


@query("s14_csv_profile", "WITH l AS (SELECT o_orderpriority AS member, o_orderkey AS row, concat_ws(',', o_orderkey, o_orderstatus, o_totalprice) AS value FROM orders) SELECT member, count(*) AS rows, true AS has_header, 3 AS columns FROM l GROUP BY 1")
def csv_profile(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("member"), F.col("o_orderkey").alias("row"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("string")).alias("value"))
    return tables.profile_csv(o)


@query("p13_file_classes", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'analysis_results' WHEN 1 THEN 'encoder_feedback' WHEN 2 THEN 'command' ELSE 'other_csv' END AS kind FROM part")
def file_classes(spark, sf):
    """A file name of one of four forms for each part."""
    k, number = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("DAQ_RHF_P"), number)).when(k == 1, F.concat(F.lit("data/DAQ_P"), number, F.lit("_x"))).when(k == 2, F.concat(F.lit("RHF_P"), number)).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", S.file_class(F.concat(name, F.lit(".csv"))).alias("kind"))


@query("s19_tolerant_fields", "SELECT p_partkey, try_cast(p_size AS DOUBLE) AS size, try_cast(p_type AS DOUBLE) AS kind FROM part")
def tolerant_fields(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").try_cast("double").alias("size"), F.col("p_type").try_cast("double").alias("kind"))


@query("x_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    w = ST.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "1 hour")
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", S.rounded(F.col("total"), 4).alias("total"))


@query("x_sessions", "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1")
def session_counts(spark, sf):
    s = ST.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
