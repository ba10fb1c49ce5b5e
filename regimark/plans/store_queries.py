"""Queries that write files of each kind to the shared folder and read them again, and latency tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import benchmarks as B
from ..operators import evaluation as EV
from ..operators import events as E
from ..operators import frames as D
from ..operators import images as I
from ..operators import stats as ST
from ..operators import windows as W
from ..sources import arrays, avi, ranges, store, tables
from ..streaming import frames as STREAM
from .registry import query
from .source_queries import HEIGHT, WIDTH, _frames, _video_bytes, _video_files
from .stat_queries import CONFUSION, METHODS, RATES, _rounded, alarm_methods
from .views import frames, table, with_frames

R = S.rounded


@query("s10_s11_feature_files", "SELECT CAST(user_id % 8 AS VARCHAR) AS part, count(*) AS n, count(value) FILTER (event_id % 7 <> 0) AS finite, round(sum(value) FILTER (event_id % 7 <> 0), 4) AS total FROM events GROUP BY 1")
def feature_files(spark, sf):
    """Events as one CSV folder a group, every seventh value infinite, read back over all files."""
    path = store.new_path(spark, "features")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("inf")).otherwise(F.col("value").cast("string")).alias("value"), (F.col("user_id") % 8).alias("part"))
    e.repartition("part").write.partitionBy("part").option("header", True).csv(path)
    f = tables.read_features(spark, path, ["event_id", "value"]).withColumn("part", F.regexp_extract("source_file", r"part=(\d+)/", 1))
    return f.groupBy("part").agg(F.count("*").alias("n"), F.count("value").alias("finite"), R(F.sum("value"), 4).alias("total"))


def _archives(spark, sf):
    """A ZIP file a nation: measured rows of its suppliers, and notes that odd nations have damaged."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        nation, raw = int(pdf["s_nationkey"].iloc[0]), io.BytesIO()
        rows = [",".join(map(str, [int(k), b, *range(9)])) for k, b in pdf.sort_values("s_suppkey")[["s_suppkey", "s_acctbal"]].itertuples(index=False)]
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr(f"DAQ_RHF_P{nation}.csv", "\n".join(["﻿" + ",".join("abcdefghijk"), *rows, "1,2,3", ""]), zipfile.ZIP_DEFLATED)
            z.writestr("notes.csv", "checked text")
        content = raw.getvalue()
        if nation % 2:
            content = content.replace(b"checked text", b"damaged text", 1)
        return pd.DataFrame({"name": [f"{nation}.ZIP"], "content": [content]})

    path = store.new_path(spark, "zips")
    ranges.write_files(s.groupBy("s_nationkey").applyInPandas(made, "name string, content binary"), path)
    return tables.list_archives(spark, path)


def _named(df):
    """The archive's name in place of its path."""
    return df.withColumn("path", F.regexp_extract("path", r"([^/]+)\.ZIP$", 1))


@query("s12_archive_rows", "SELECT CAST(s_nationkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS frame_index, CAST(s_suppkey AS DOUBLE) AS x_mm, s_acctbal AS y_mm, 7.0::DOUBLE AS spatter_area FROM supplier")
def archive_rows(spark, sf):
    m = _named(tables.measured_rows(tables.archive_numbers(_archives(spark, sf), r"DAQ_RHF_P\d+")))
    return m.select("path", F.col("frame_index").cast("long").alias("frame_index"), "x_mm", "y_mm", "spatter_area")


@query("s13_archive_whole_rows", "SELECT CAST(s_nationkey AS VARCHAR) AS path, count(*) + 1 AS rows, 3 AS width, CAST(sum(s_suppkey) + 1 AS DOUBLE) AS total FROM supplier GROUP BY 1")
def archive_whole_rows(spark, sf):
    n = _named(tables.archive_numbers(_archives(spark, sf), r"DAQ_RHF_P\d+", None))
    return n.groupBy("path").agg(F.count("*").alias("rows"), F.max(F.size("numbers")).alias("width"), R(F.sum(F.get("numbers", F.lit(0))), 4).alias("total"))


@query("s15_archive_members", "SELECT CAST(k AS VARCHAR) AS path, unnest(['DAQ_RHF_P' || k || '.csv', 'notes.csv']) AS member, unnest([true, k % 2 = 0]) AS crc_ok, unnest(['analysis_results', 'other_csv']) AS kind FROM (SELECT DISTINCT s_nationkey AS k FROM supplier)")
def archive_members(spark, sf):
    return _named(tables.archive_members(_archives(spark, sf))).select("path", "member", "crc_ok", "kind")


@query("s16_archive_lookup", "SELECT n_name || '.ZIP' AS name, length(n_name) + 1 AS bytes FROM nation WHERE n_nationkey % 2 = 0")
def archive_lookup(spark, sf):
    """Folders named like archives, every second one, found below the root whatever their case."""
    path = store.new_path(spark, "archives")
    n = table(spark, sf, "nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".ZIP").otherwise(".txt")).alias("name"), F.col("n_name").alias("value"))
    n.repartition("name").write.partitionBy("name").text(path)
    a = tables.read_archives(spark, path, "%.zip/%")
    return a.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("name"), F.length("content").cast("long").alias("bytes"))


@query("s17_k4_prediction_arrays", with_frames("SELECT video_id, frame_index, CAST(label AS TINYINT) AS label, CAST(p_high AS FLOAT)::DOUBLE AS p_high FROM frames WHERE active = 1"))
def prediction_arrays(spark, sf):
    """Predictions as NPZ files with an array a column, probabilities with two axes; a reader takes the arrays it names."""
    spark.dataSource.register(arrays.ArrayFiles)
    path = store.new_path(spark, "predictions")
    f = D.active(frames(spark, sf), "active")
    f = f.select("video_id", "frame_index", F.col("label").cast("tinyint").alias("label"), F.array(*[F.col(c).cast("float") for c in ("p_low", "p_nominal", "p_high")]).alias("probabilities"))
    f.write.format("array_files").mode("append").option("path", path).option("rowsPerFile", 5000).option("compression", "deflate").save()
    back = spark.read.format("array_files").option("path", path).option("columns", "video_id,frame_index,label,probabilities").load()
    return back.select("video_id", "frame_index", "label", F.get("probabilities", F.lit(2)).cast("double").alias("p_high"))


@query("s17_array_rows", "SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment, c_acctbal < 0 AS owes FROM customer" )
def array_rows(spark, sf):
    """Customers as plain NPZ files, read by ranges of rows that are smaller than a file."""
    spark.dataSource.register(arrays.ArrayFiles)
    path = store.new_path(spark, "customers")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", (F.col("c_acctbal") < 0).alias("owes"))
    c.write.format("array_files").mode("append").option("path", path).save()
    back = spark.read.format("array_files").option("path", path).option("rowsPerPartition", 400).load()
    return back.withColumn("c_acctbal", R(F.col("c_acctbal"), 2))


@query("s1_s4_video_files", "WITH v AS (SELECT vec_id // 64 AS video, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS frame_index, CAST(list_sum(list_transform(embedding, lambda e: least(255, CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS BIGINT)))) AS BIGINT) AS total, vec_id % 5 = 0 AS odd FROM embeddings) SELECT 'v' || video AS video_id, CAST(frame_index AS INTEGER) AS frame_index, total, CASE WHEN odd THEN 64 ELSE 0 END AS unequal FROM v WHERE frame_index % 3 <> 1")
def video_files(spark, sf):
    """Videos of up to 64 frames in the shared folder, some with unequal planes; two frames of three are read, by stretches of bytes that are smaller than a file."""
    path = store.new_path(spark, "videos")
    ranges.write_files(_video_files(table(spark, sf, "embeddings")), path)
    index = avi.frame_index(avi.list_videos(spark, path)).filter("frame_index % 3 <> 1")
    got = avi.read_frames(index, WIDTH, HEIGHT, stretch=2000)
    hexed = F.hex("pixels")
    values = F.transform(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1)), lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    return got.select("video_id", "frame_index", F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "unequal")


@query("s18_k2_json_records", "SELECT n_nationkey AS key, n_name AS name FROM nation")
def json_records(spark, sf):
    """A JSON file a nation beside a broken one, read back."""
    path = store.new_path(spark, "records")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("file"))
    n.repartition("file").write.partitionBy("file").json(path)
    spark.range(1).select(F.lit('{"key": ').alias("value")).write.text(f"{path}/file=-1")
    return tables.read_records(spark, path).select(F.col("key").cast("int").alias("key"), "name")


@query("s19_reports", "SELECT p_partkey, try_cast(p_size AS DOUBLE) AS size, try_cast(p_type AS DOUBLE) AS kind, CAST(NULL AS VARCHAR) AS absent FROM part")
def reports(spark, sf):
    """A report with a field that is no number and without a named column, beside one that doesn't exist."""
    path = store.new_path(spark, "report")
    store.write_csv(table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("size"), F.col("p_type").alias("kind")), path)
    schema = "p_partkey bigint, size double, kind double, absent string"
    return tables.read_report(spark, path, schema).unionByName(tables.read_report(spark, path + "-none", schema))


@query("s6_plane_audit", "SELECT CAST(vec_id AS VARCHAR) AS video_id, list_sum(list_transform(embedding, lambda e: least(255, CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS BIGINT))))::BIGINT AS grey_sum, 0 AS unequal, 0.0::DOUBLE AS unequal_fraction FROM embeddings")
def plane_audit(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), _video_bytes()("embedding").alias("content"))
    hexed = F.hex("grey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1)), lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    return avi.audit_frames(v, WIDTH, HEIGHT).select("video_id", F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x).alias("grey_sum"), "unequal", "unequal_fraction")


@query("k1_feature_files_by_video", with_frames("SELECT video_id, count(*) AS frames, round(count(*) / 20000.0, 9) AS duration_s, CAST(sum(active) AS BIGINT) AS active_frames, round(sum(active) / count(*), 6) AS active_fraction, round(sum(intensity + CASE WHEN video_id % 2 = 0 THEN 1 ELSE 0 END), 4) AS total FROM frames GROUP BY 1"))
def feature_files_by_video(spark, sf):
    """Features by video, those of even videos written again with other values, and the summary beside them."""
    path = store.new_path(spark, "by-video")
    f = frames(spark, sf).select("video_id", "frame_index", "intensity", "active")
    store.write_features(f, path)
    store.write_features(f.filter("video_id % 2 = 0").withColumn("intensity", F.col("intensity") + 1), path)
    back = spark.read.schema(f.schema).parquet(path)
    totals = back.groupBy("video_id").agg(R(F.sum("intensity"), 4).alias("total"))
    return store.feature_summary(back, S.FRAME_RATE, "active").join(totals, "video_id").withColumns({"active_fraction": R(F.col("active_fraction")), "duration_s": R(F.col("duration_s"), 9)})


@query("k5_markdown", "SELECT unnest(['# Nations', '', '| key | name |', '|---|---|']) AS line, unnest([0, 1, 2, 3]) AS place UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || ' |', 3 + row_number() OVER (ORDER BY n_nationkey) FROM nation")
def markdown(spark, sf):
    text = store.markdown(table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).orderBy("key"), "Nations")
    return spark.createDataFrame([(line, k) for k, line in enumerate(text.splitlines())], "line string, place long")


@query("k6_grey_images", "SELECT CAST(vec_id AS VARCHAR) AS video_id, '50350A3820380A3235350A' || list_aggregate(list_transform(embedding, lambda e: printf('%02X', least(255, CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS INTEGER)))), 'string_agg', '') AS image FROM embeddings")
def grey_images(spark, sf):
    @F.pandas_udf("binary")
    def image(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: store.pgm_bytes(bytes(p), WIDTH, HEIGHT))

    return _frames(spark, sf).select("video_id", F.hex(image("pixels")).alias("image"))


def _image_features(spark, sf):
    """Features of the images of a label as frames of one video, in order of ids."""
    e = D.positional(table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image"), "vec_id", F.col("label").alias("video")), ["vec_id"], "video")
    f = I.extract_features(_frames(spark, sf), WIDTH, HEIGHT).drop("frame_index").withColumnRenamed("video_id", "image")
    return f.join(e.select("image", F.col("video").cast("long").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index")), "image").drop("image")


TEMPORAL = ["mean_intensity", "saturation_fraction", "bright_fraction_128", "delta_mean_intensity", "delta_total_intensity", "centroid_motion", "rolling_intensity_mean", "rolling_intensity_std"]
TEMPORAL_SQL = f"""WITH i AS (SELECT vec_id, CAST(label AS BIGINT) AS video_id, list_transform(embedding, lambda e: least(255, CAST(floor(abs(CAST(e AS DOUBLE)) * 255) AS BIGINT))) AS v FROM embeddings),
f AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 AS frame_index, CAST(list_sum(v) AS DOUBLE) AS total, list_sum(v) / 64.0 AS mean_intensity,
  len(list_filter(v, lambda x: x = 255)) / 64.0 AS saturation_fraction, len(list_filter(v, lambda x: x >= 128)) / 64.0 AS bright_fraction_128,
  list_sum(list_transform(v, lambda x, k: x * ((k - 1) % 8))) / nullif(list_sum(v), 0) AS cx, list_sum(list_transform(v, lambda x, k: x * ((k - 1) // 8))) / nullif(list_sum(v), 0) AS cy FROM i)
SELECT video_id, frame_index, round(mean_intensity, 6) AS mean_intensity, round(saturation_fraction, 6) AS saturation_fraction, round(bright_fraction_128, 6) AS bright_fraction_128,
  round(coalesce(mean_intensity - lag(mean_intensity) OVER w, 0), 6) AS delta_mean_intensity, round(coalesce(total - lag(total) OVER w, 0), 6) AS delta_total_intensity,
  round(coalesce(sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2)), 0), 6) AS centroid_motion, round(avg(mean_intensity) OVER t, 6) AS rolling_intensity_mean, round(coalesce(stddev_pop(mean_intensity) OVER t, 0), 6) AS rolling_intensity_std
FROM f WINDOW w AS (PARTITION BY video_id ORDER BY frame_index), t AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"""


@query("p1_temporal_features_of_images", TEMPORAL_SQL)
def temporal_features_of_images(spark, sf):
    f = D.with_features(W.with_temporal(_image_features(spark, sf)), "physical_temporal")
    return _rounded(f.select("video_id", "frame_index", *TEMPORAL), ("video_id", "frame_index"))


@query("x_stream_of_temporal_features", TEMPORAL_SQL)
def stream_of_temporal_features(spark, sf):
    """The same from a stream over the features' file, run until all of it is read."""
    source, sink, notes = (store.new_path(spark, f"stream-{k}") for k in ("in", "out", "state"))
    f = _image_features(spark, sf)
    f.write.parquet(source)
    run = STREAM.stream_temporal(spark.readStream.schema(f.schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", notes).trigger(availableNow=True).start(sink)
    run.awaitTermination()
    out = spark.read.parquet(sink).join(spark.read.parquet(source).select("video_id", "frame_index", "mean_intensity", "saturation_fraction", "bright_fraction_128"), ["video_id", "frame_index"])
    return _rounded(out.select("video_id", "frame_index", *TEMPORAL), ("video_id", "frame_index"))


@query("m26_v10_latency_table", "SELECT event_type AS name, count(*) AS repetitions, round(1000 * quantile_cont(value, 0.5), 4) AS median_total_ms, round(1000 * quantile_cont(value, 0.95), 4) AS p95_total_ms, round(1e6 * quantile_cont(value, 0.5) / 100, 4) AS median_us_per_frame, round(1e6 * quantile_cont(value, 0.95) / 100, 4) AS p95_us_per_frame, round(100 / quantile_cont(value, 0.5), 4) AS median_fps FROM events GROUP BY 1")
def latency_table(spark, sf):
    """Values of events as seconds of runs over 100 frames."""
    runs = table(spark, sf, "events").select(F.col("event_type").alias("name"), F.lit(100).cast("long").alias("items"), F.col("value").alias("seconds"))
    return _rounded(B.latency_table(runs).drop("items"), ("name", "repetitions"), 4)


@query("m27_decode_agreement", "SELECT count(*) AS frames, count(*) FILTER (vec_id % 5 <> 0) AS matched, round(avg(vec_id % 3) FILTER (vec_id % 5 <> 0), 6) AS area_mae, round(avg((vec_id % 2) / 4.0) FILTER (vec_id % 5 <> 0), 6) AS intensity_mae FROM embeddings")
def decode_agreement(spark, sf):
    """Two features from raw video against a cache that lacks every fifth frame and is off by known amounts."""
    videos = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), _video_bytes()("embedding").alias("content"))
    k = F.col("video_id").cast("long")
    cached = I.extract_features(_frames(spark, sf), WIDTH, HEIGHT).filter(k % 5 != 0).select("video_id", "frame_index", (F.col("threshold_area") + k % 3).alias("threshold_area"), (F.col("mean_intensity") + (k % 2) / 4).alias("mean_intensity"))
    return _rounded(B.decode_agreement(B.minimal_features(videos, WIDTH, HEIGHT), cached), ("frames", "matched"))


@query("m28_edge_benchmark")
def edge_benchmark(spark, sf):
    """Latency of states by mixture and by the logistic model that repeats them; times differ by run."""
    f, names = D.active(frames(spark, sf), "active"), ["intensity", "power"]
    return B.latency_table(B.edge_benchmark(f, names, *B.edge_models(f, names), repetitions=5))


@query("t10_first_frames", with_frames("SELECT video_id, count(*) AS frames FROM frames WHERE frame_index < 10 GROUP BY 1"))
def first_frames(spark, sf):
    return D.first_frames(frames(spark, sf), 10).groupBy("video_id").agg(F.count("*").alias("frames"))


@query("t10_first_rows", with_frames("SELECT video_id, frame_index FROM frames ORDER BY 1, 2 LIMIT 300"))
def first_rows(spark, sf):
    return D.first_rows(frames(spark, sf).select("video_id", "frame_index"), 300)


@query("v9_precision_recall_points", with_frames(", c AS (SELECT definition, method, " + CONFUSION + " FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS definition, '{m}' AS method, {w} AS t, {x} AS p FROM frames WHERE active = 1" for d, w in (("top", "power >= 90"), ("level", "power >= 75")) for m, x in METHODS.items()) + f") GROUP BY 1, 2), r AS (SELECT *, {RATES} FROM c) SELECT definition, CAST(regexp_extract(method, '([0-9.]+)$', 1) AS DOUBLE) AS threshold, precision, recall, f1, false_positive_rate FROM r WHERE method LIKE 'probability%' ORDER BY 1, 2"))
def precision_recall_points(spark, sf):
    return EV.precision_recall_points(alarm_methods(spark, sf))


@query("v14_pipeline_tables", """WITH m AS (SELECT l_returnflag AS model, l_linestatus AS protocol, l_linenumber AS seed, avg(l_quantity) AS silhouette, avg(l_tax) AS confidence FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT model, protocol, avg(silhouette) AS silhouette, avg(confidence) AS confidence FROM m GROUP BY 1, 2)
SELECT 'model' AS axis, model AS label, unnest(['silhouette_mean', 'confidence_mean']) AS metric, unnest([round(silhouette, 6), round(confidence, 6)]) AS value FROM s WHERE protocol = 'F'
UNION ALL SELECT 'protocol', protocol, unnest(['silhouette_mean', 'confidence_mean']), unnest([round(silhouette, 6), round(confidence, 6)]) FROM s WHERE model = 'A'""")
def pipeline_tables(spark, sf):
    """Bars by model within a protocol and by protocol within a model, of a summary over seeds."""
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("protocol"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_quantity").alias("silhouette"), F.avg("l_tax").alias("confidence"))
    s = ST.summary_by(m, ["model", "protocol"], ["silhouette", "confidence"])
    metrics = ["silhouette_mean", "confidence_mean"]
    both = EV.bars(s, "model", {"protocol": "F"}, metrics).unionByName(EV.bars(s, "protocol", {"model": "A"}, metrics))
    return _rounded(both, ("axis", "label", "metric"))


@query("j5_j7_intervals_in_stretches", with_frames(""", t AS (SELECT video_id, frame_index - row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS g, frame_index FROM frames WHERE power >= 50), te AS (SELECT video_id, min(frame_index) AS s, max(frame_index) AS e FROM t GROUP BY video_id, g HAVING count(*) >= 2),
p AS (SELECT video_id, frame_index - row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS g, frame_index FROM frames WHERE intensity >= 40), pe AS (SELECT video_id, min(frame_index) AS s, max(frame_index) AS e FROM p GROUP BY video_id, g HAVING count(*) >= 2)
SELECT te.video_id, te.s AS true_start, te.e AS true_end, pe.s AS predicted_start, pe.e AS predicted_end FROM te JOIN pe ON te.video_id = pe.video_id AND te.s <= pe.e AND pe.s <= te.e"""))
def intervals_in_stretches(spark, sf):
    """All overlaps of two kinds of events, with stretches so short that events span several."""
    f = frames(spark, sf)
    return E.matches(E.events(f, F.col("power") >= 50), E.events(f, F.col("intensity") >= 40), 3)


@query("w_motion_and_seconds", with_frames("SELECT video_id, frame_index, round(coalesce(sqrt(pow(intensity - lag(intensity) OVER w, 2) + pow(power - lag(power) OVER w, 2)), 0), 6) AS motion, round(frame_index / 20000.0, 9) AS seconds FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)"))
def motion(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_index", R(W.motion("intensity", "power")).alias("motion"), R(S.frame_seconds(F.col("frame_index")), 9).alias("seconds"))
    return f


@query("p8_active_positions", with_frames("SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS place, frame_index, p_high FROM frames WHERE active = 1"))
def active_positions(spark, sf):
    return D.active_positions(frames(spark, sf))
