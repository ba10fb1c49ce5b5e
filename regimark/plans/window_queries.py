"""Queries of scans, filters, joins and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import events as E
from ..operators import frames as D
from ..operators import spread as SP
from ..operators import temporal as TM
from ..operators import windows as W
from ..sources import store
from .registry import query
from .views import frames, table, with_decoded, with_frames, with_segments

R = S.rounded
DOWN = "PARTITION BY video_id ORDER BY frame_index"


@query("p3_finite_values", "SELECT count(*) AS n, count(try_cast(p_size AS DOUBLE)) AS sizes, count(try_cast(p_brand AS DOUBLE)) AS brands FROM part")
def finite_values(spark, sf):
    p = table(spark, sf, "part")
    return p.agg(F.count("*").alias("n"), F.count(S.finite(F.col("p_size"))).alias("sizes"), F.count(S.finite(F.col("p_brand"))).alias("brands"))


@query("p4_active_frames", with_frames("SELECT video_id, frame_index, round(intensity, 6) AS intensity FROM frames WHERE active = 1"))
def active_frames(spark, sf):
    return D.active(frames(spark, sf), "active").select("video_id", "frame_index", R(F.col("intensity")).alias("intensity"))


SPLIT = "CASE WHEN video_id % 10 < 6 THEN 'train' WHEN video_id % 10 < 8 THEN 'validation' ELSE 'test' END"


def _partitions(spark, sf):
    v = table(spark, sf, "events").select(F.col("user_id").alias("video_id")).distinct()
    k = F.col("video_id") % 10
    return v.select("video_id", F.when(k < 6, "train").when(k < 8, "validation").otherwise("test").alias("split"), (F.col("video_id") % 5).alias("fold"))


@query("j1_split_join", with_frames(f"SELECT {SPLIT} AS split, video_id % 5 AS fold, count(*) AS frames, CAST(sum(active) AS BIGINT) AS active FROM frames GROUP BY 1, 2"))
def split_join(spark, sf):
    f = D.with_split(frames(spark, sf), _partitions(spark, sf))
    return f.groupBy("split", "fold").agg(F.count("*").alias("frames"), F.sum("active").cast("long").alias("active"))


@query("p5_holdout_counts", with_frames(f"SELECT 'fit' AS side, count(*) AS n FROM frames WHERE {SPLIT} <> 'test' UNION ALL SELECT 'test', count(*) FROM frames WHERE {SPLIT} = 'test'"))
def holdout_counts(spark, sf):
    fit, test = D.holdout(D.with_split(frames(spark, sf), _partitions(spark, sf)))
    side = lambda d, n: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side(fit, "fit").unionByName(side(test, "test"))


@query("p6_cross_validation_counts", with_frames("SELECT k.k AS fold, count(*) FILTER (video_id % 5 <> k.k) AS train, count(*) FILTER (video_id % 5 = k.k) AS test FROM frames, (SELECT unnest(range(5)) AS k) k GROUP BY 1"))
def cv_counts(spark, sf):
    f = D.with_split(frames(spark, sf), _partitions(spark, sf))
    one = lambda k: [d.agg(F.count("*").alias(n)) for d, n in zip(D.cross_validation(f, k), ("train", "test"), strict=True)]
    rows = [a.crossJoin(b).select(F.lit(k).cast("long").alias("fold"), "train", "test") for k in range(D.FOLDS) for a, b in [one(k)]]
    return store.union_ragged(*rows)


@query("p7_valid_predictions", with_frames("SELECT video_id, count(*) AS n FROM frames WHERE active = 1 AND label >= 0 AND power IS NOT NULL AND p_high IS NOT NULL GROUP BY 1"))
def valid_predictions(spark, sf):
    return D.valid_predictions(frames(spark, sf)).groupBy("video_id").agg(F.count("*").alias("n"))


@query("p12_unit_conversion", "SELECT l_orderkey, l_linenumber, round(l_quantity / 0.000064, 3) AS pixels FROM lineitem")
def unit_conversion(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R(S.mm2_to_pixels(F.col("l_quantity")), 3).alias("pixels"))


@query("p14_label_names", with_frames("SELECT CASE label WHEN 0 THEN 'low' WHEN 1 THEN 'nominal' ELSE 'high' END AS regime, count(*) AS n FROM frames GROUP BY 1"))
def label_names(spark, sf):
    return frames(spark, sf).groupBy(S.named(F.col("label").cast("int"), S.REGIMES).alias("regime")).agg(F.count("*").alias("n"))


@query("a1_video_summary", with_frames("SELECT video_id, count(*) AS frames, CAST(sum(active) AS BIGINT) AS active_frames, round(avg(active), 6) AS active_fraction, round(min(intensity), 6) AS min_value, round(max(intensity), 6) AS max_value FROM frames GROUP BY 1"))
def video_summary(spark, sf):
    s = D.video_summary(frames(spark, sf), "intensity")
    return s.select("video_id", "frames", "active_frames", *[R(F.col(c)).alias(c) for c in ("active_fraction", "min_value", "max_value")])


@query("a2_dataset_summary", with_frames(", v AS (SELECT video_id, count(*) AS n, sum(active) AS a, avg(active) AS f FROM frames GROUP BY 1) SELECT count(*) AS videos, CAST(sum(n) AS BIGINT) AS frames, CAST(sum(a) AS BIGINT) AS active_frames, round(min(f), 6) AS min_fraction, round(quantile_cont(f, 0.5), 6) AS median_fraction, round(max(f), 6) AS max_fraction FROM v"))
def dataset_summary(spark, sf):
    s = D.dataset_summary(D.video_summary(frames(spark, sf), "intensity"))
    return s.select("videos", "frames", "active_frames", *[R(F.col(c)).alias(c) for c in ("min_fraction", "median_fraction", "max_fraction")])


@query("w1_w3_temporal_features", with_frames(f"""SELECT video_id, frame_index, round(coalesce(intensity - lag(intensity) OVER w, 0), 6) + 0.0 AS delta, round(coalesce(sqrt(pow(intensity - lag(intensity) OVER w, 2) + pow(power - lag(power) OVER w, 2)), 0), 6) AS motion,
round(avg(intensity) OVER t, 6) AS rolling_mean, round(stddev_pop(intensity) OVER t, 5) + 0.0 AS rolling_std FROM frames WINDOW w AS ({DOWN}), t AS ({DOWN} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"""))
def temporal_features(spark, sf):
    f = frames(spark, sf).withColumns({"delta": W.delta("intensity"), "motion": W.motion("intensity", "power"), "rm": W.trailing_mean("intensity"), "rs": W.trailing_std("intensity")})
    return f.select("video_id", "frame_index", R(F.col("delta")).alias("delta"), R(F.col("motion")).alias("motion"), R(F.col("rm")).alias("rolling_mean"), R(F.col("rs"), 5).alias("rolling_std"))


@query("w4_full_windows", with_frames(f", s AS (SELECT video_id, row_number() OVER ({DOWN}) - 1 AS start, avg(power) OVER a AS m, count(*) OVER a AS n FROM frames WHERE active = 1 WINDOW a AS ({DOWN} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT video_id, start, round(m, 6) AS statistic FROM s WHERE n = 20"))
def full_windows(spark, sf):
    w = W.full_windows(D.active(frames(spark, sf), "active"), F.col("power"), 20, True)
    return w.select("video_id", F.col("start").cast("long").alias("start"), R(F.col("statistic")).alias("statistic"))


def _best_sql(stat: str, end: int) -> str:
    return f""", s AS (SELECT *, {stat} AS v FROM d), k AS (SELECT video_id, row_number() OVER ({DOWN}) - 1 AS start, sum(v) OVER a AS m, count(*) OVER a AS n FROM s WINDOW a AS ({DOWN} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m DESC, start) AS place FROM k WHERE n = 20) SELECT video_id, start, start + {end} AS "end", round(m, 6) AS statistic FROM r WHERE place = 1"""


CHANGE = f"CASE WHEN label <> lag(label) OVER ({DOWN}) THEN 1.0 ELSE 0.0 END + {{}} * CASE WHEN label = 2 AND lag(label) OVER ({DOWN}) <> 2 THEN 1.0 ELSE 0.0 END"


def _best_transitions(spark, sf, weight, inclusive):
    a = D.active(frames(spark, sf), "active").withColumn("v", W.switches("label", False) + weight * W.high_entries("label"))
    b = W.best_window(W.full_windows(a, F.col("v"), 20, False), 20, inclusive)
    return b.select("video_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), R(F.col("statistic")).alias("statistic"))


@query("w5_best_transition_window", with_frames(", d AS (SELECT * FROM frames WHERE active = 1)" + _best_sql(CHANGE.format("3.0"), 20)))
def best_transition_window(spark, sf):
    return _best_transitions(spark, sf, 3.0, False)


@query("w6_best_transition_window_inclusive", with_frames(", d AS (SELECT * FROM frames WHERE active = 1)" + _best_sql(CHANGE.format("2.5"), 19)))
def best_transition_window_inclusive(spark, sf):
    return _best_transitions(spark, sf, 2.5, True)


@query("w7_gap_segments", with_segments("SELECT video_id, segment, min(frame_index) AS start, max(frame_index) AS \"end\", count(*) AS n FROM seg GROUP BY 1, 2"))
def gap_segments(spark, sf):
    g = W.gap_segments(D.active(frames(spark, sf), "active"))
    return g.groupBy("video_id", "segment").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end"), F.count("*").alias("n"))


RUNS = """c AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY video_id, segment ORDER BY frame_index) THEN 1 ELSE 0 END AS change FROM seg),
u AS (SELECT *, CAST(sum(change) OVER (PARTITION BY video_id, segment ORDER BY frame_index) AS BIGINT) AS run FROM c),
runs AS (SELECT video_id, segment, run, min(label) AS label, min(frame_index) AS start, max(frame_index) AS "end", count(*) AS length FROM u GROUP BY 1, 2, 3)"""


@query("w8_label_runs", with_segments(f", {RUNS} SELECT * FROM runs"))
def label_runs(spark, sf):
    return W.runs(W.gap_segments(D.active(frames(spark, sf), "active")), "label")


@query("w9_switches", with_segments(f", {RUNS} SELECT video_id, CAST(sum(change) AS BIGINT) AS switches FROM u GROUP BY 1"))
def segment_switches(spark, sf):
    s = W.gap_segments(D.active(frames(spark, sf), "active")).withColumn("s", W.switches("label", True))
    return s.groupBy("video_id").agg(F.sum("s").cast("long").alias("switches"))


@query("w11_rising_edges", with_frames(f", e AS (SELECT video_id, CASE WHEN power >= 90 AND NOT coalesce(lag(power >= 90) OVER ({DOWN}), false) THEN 1 ELSE 0 END AS r FROM frames) SELECT video_id, CAST(sum(r) AS BIGINT) AS rising FROM e GROUP BY 1"))
def rising_edges(spark, sf):
    f = frames(spark, sf).withColumn("r", W.rising_edges(F.col("power") >= 90))
    return f.groupBy("video_id").agg(F.sum("r").cast("long").alias("rising"))


@query("w12_transitions_over_gaps", with_frames(f", t AS (SELECT video_id, CASE WHEN label <> lag(label) OVER ({DOWN}) THEN 1 ELSE 0 END AS c, CASE WHEN label = 2 AND lag(label) OVER ({DOWN}) <> 2 THEN 1 ELSE 0 END AS h FROM frames WHERE active = 1) SELECT video_id, CAST(sum(c) AS BIGINT) AS transitions, CAST(sum(h) AS BIGINT) AS high_entries FROM t GROUP BY 1"))
def transitions_over_gaps(spark, sf):
    f = D.active(frames(spark, sf), "active").withColumns({"c": W.switches("label", False), "h": W.high_entries("label")})
    return f.groupBy("video_id").agg(F.sum("c").cast("long").alias("transitions"), F.sum("h").cast("long").alias("high_entries"))


def _event_sql(name: str, flag: str, source: str = "frames") -> str:
    return f"{name}_i AS (SELECT video_id, frame_index, frame_index - row_number() OVER ({DOWN}) AS island FROM {source} WHERE {flag}), {name} AS (SELECT video_id, min(frame_index) AS start, max(frame_index) AS \"end\" FROM {name}_i GROUP BY video_id, island HAVING count(*) >= 2)"


TRUE, PRED = _event_sql("t", "active = 1 AND power >= 75"), _event_sql("p", "active = 1 AND intensity >= 60")


def _alarm(spark, sf):
    f = D.active(frames(spark, sf), "active")
    return E.events(f, F.col("power") >= 75), E.events(f, F.col("intensity") >= 60)


@query("w10_events", with_frames(f", {PRED} SELECT * FROM p"))
def alarm_events(spark, sf):
    return _alarm(spark, sf)[1]


OVERLAP = "t.video_id = p.video_id AND t.start <= p.\"end\" AND p.start <= t.\"end\""


@query("j5_event_overlaps", with_frames(f", {TRUE}, {PRED} SELECT t.video_id, t.start AS true_start, t.\"end\" AS true_end, p.start AS predicted_start, p.\"end\" AS predicted_end FROM t JOIN p ON {OVERLAP}"))
def event_overlaps(spark, sf):
    return E.matches(*_alarm(spark, sf))


@query("j6_detected_events", with_frames(f", {TRUE}, {PRED} SELECT * FROM t WHERE EXISTS (SELECT 1 FROM p WHERE {OVERLAP})"))
def detected_events(spark, sf):
    return E.detected(*_alarm(spark, sf))


@query("j7_false_alarms", with_frames(f", {TRUE}, {PRED} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE {OVERLAP})"))
def false_alarm_events(spark, sf):
    return E.false_alarms(*_alarm(spark, sf))


@query("a16_event_metrics", with_frames(f""", {TRUE}, {PRED}, d AS (SELECT t.video_id, t.start, greatest(min(p.start) - t.start, 0) AS delay FROM t JOIN p ON {OVERLAP} GROUP BY 1, 2)
SELECT (SELECT count(*) FROM t) AS true_events, (SELECT count(*) FROM p) AS predicted_events, (SELECT count(*) FROM d) AS detected_events, (SELECT round(avg(delay), 6) FROM d) AS mean_delay_frames,
(SELECT count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE {OVERLAP})) AS false_alarm_events, round((SELECT count(*) FROM d) / (SELECT greatest(count(*), 1) FROM t), 6) AS event_recall,
round((SELECT count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE {OVERLAP})) / 55.0, 6) AS false_alarms_per_part"""))
def event_metrics(spark, sf):
    m = E.event_metrics(*_alarm(spark, sf), 55)
    return m.select(*[R(F.col(c)).alias(c) if c in ("mean_delay_frames", "event_recall", "false_alarms_per_part") else c for c in m.columns])


@query("j8_seed_pairs", "SELECT a.s AS seed_a, b.s AS seed_b, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS s FROM lineitem) a JOIN (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS s FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2")
def seed_pairs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("s"))
    a, b = li.alias("a"), li.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.s") < F.col("b.s")))
    return pairs.groupBy(F.col("a.s").alias("seed_a"), F.col("b.s").alias("seed_b")).agg(F.count("*").alias("n"))


@query("j2_positional_zip", with_frames(f", o AS (SELECT o_custkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_index, o_totalprice FROM orders) SELECT frames.video_id, frames.frame_index, round(o_totalprice, 2) AS price FROM frames JOIN o USING (video_id, frame_index)"))
def positional_zip(spark, sf):
    o = D.positional(table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), "o_orderdate", "o_orderkey", "o_totalprice"), ["o_orderdate", "o_orderkey"])
    return frames(spark, sf).join(o, ["video_id", "frame_index"]).select("video_id", "frame_index", R(F.col("o_totalprice"), 2).alias("price"))


@query("j13_scatter_predictions", with_frames(", a AS (SELECT video_id, frame_index, label FROM frames WHERE active = 1) SELECT f.video_id, f.frame_index, a.label AS predicted FROM frames f LEFT JOIN a USING (video_id, frame_index)"))
def scatter_predictions(spark, sf):
    f = frames(spark, sf)
    return D.scattered(f.select("video_id", "frame_index"), D.active(f, "active").select("video_id", "frame_index", F.col("label").alias("predicted")))


@query("u5_missing_keys", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_keys(spark, sf):
    return store.missing_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("u2_ragged_union", "SELECT 'customer' AS kind, c_acctbal AS customer_balance, NULL::DOUBLE AS supplier_balance FROM customer UNION ALL SELECT 'supplier', NULL, s_acctbal FROM supplier")
def ragged_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("customer_balance"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("supplier_balance"))
    return store.union_ragged(c, s)


@query("m10_viterbi_labels", with_decoded("SELECT * FROM decoded"))
def viterbi_labels(spark, sf):
    return TM.decode(D.active(frames(spark, sf), "active"))


@query("m12_sequence_metrics", with_segments(f""", {RUNS} SELECT (SELECT CAST(sum(change) AS BIGINT) FROM u) AS switches, round(1000.0 * (SELECT sum(change) FROM u) / ((SELECT count(*) FROM u) - (SELECT count(*) FROM (SELECT DISTINCT video_id, segment FROM u))), 6) AS switches_per_1000,
round(sum(CASE WHEN length <= 2 THEN length ELSE 0 END) / sum(length), 6) AS short_run_frame_fraction, round(quantile_cont(length, 0.5), 6) AS median_run_length, round(avg(length), 6) AS mean_run_length FROM runs"""))
def sequence_metrics(spark, sf):
    m = TM.sequence_metrics(D.active(frames(spark, sf), "active"), "label")
    return m.select("switches", *[R(F.col(c).cast("double")).alias(c) for c in m.columns[1:]])


@query("v11_path_segments", with_frames(f", s AS (SELECT video_id, frame_index, intensity AS x0, power AS y0, lead(intensity) OVER ({DOWN}) AS x1, lead(power) OVER ({DOWN}) AS y1 FROM frames) SELECT video_id, frame_index, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM s WHERE x1 IS NOT NULL"))
def path_segments(spark, sf):
    s = W.path_segments(frames(spark, sf), "intensity", "power", "p_high")
    return s.select("video_id", "frame_index", R(F.col("x0")).alias("x0"), "y0", R(F.col("x1")).alias("x1"), "y1")


def _one_video(spark, sf):
    """All events as frames of one video, by their ids."""
    e = table(spark, sf, "events")
    return e.select(F.lit(1).cast("long").alias("video_id"), F.col("event_id").alias("frame_index"), F.col("value").alias("intensity"), F.get_json_object("props", "$.k").cast("double").alias("power"))


ONE_VIDEO = "frames AS (SELECT 1::BIGINT AS video_id, event_id AS frame_index, value AS intensity, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS power FROM events)"
SHORT_STRETCH = 512


@query("w1_w3_one_long_video", f"""WITH {ONE_VIDEO} SELECT video_id, frame_index, round(coalesce(intensity - lag(intensity) OVER w, 0), 6) + 0.0 AS delta_area, round(coalesce(sqrt(pow(intensity - lag(intensity) OVER w, 2) + pow(power - lag(power) OVER w, 2)), 0), 6) AS centroid_motion,
round(avg(intensity) OVER t, 6) AS rolling_area_mean, round(stddev_pop(power) OVER t, 5) + 0.0 AS rolling_intensity_std FROM frames WINDOW w AS ({DOWN}), t AS ({DOWN} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)""")
def temporal_features_of_a_long_video(spark, sf):
    f = SP.temporal_features(_one_video(spark, sf), "intensity", "power", "power", "intensity", "power", stretch=SHORT_STRETCH)
    return f.select("video_id", "frame_index", *[R(F.col(c)).alias(c) for c in ("delta_area", "centroid_motion", "rolling_area_mean")], R(F.col("rolling_intensity_std"), 5).alias("rolling_intensity_std"))


@query("w7_segments_of_a_long_video", f"WITH {ONE_VIDEO}, g AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER ({DOWN}) > 1 THEN 1 ELSE 0 END AS gap FROM frames WHERE power < 90), s AS (SELECT *, CAST(sum(gap) OVER ({DOWN}) AS BIGINT) AS segment FROM g) SELECT video_id, segment, min(frame_index) AS start, count(*) AS n FROM s GROUP BY 1, 2")
def segments_of_a_long_video(spark, sf):
    g = SP.gap_segments(_one_video(spark, sf).filter("power < 90"), stretch=SHORT_STRETCH)
    return g.groupBy("video_id", "segment").agg(F.min("frame_index").alias("start"), F.count("*").alias("n"))


@query("w10_events_of_a_long_video", f"WITH {ONE_VIDEO}, {_event_sql('p', 'power < 75')} SELECT * FROM p")
def events_of_a_long_video(spark, sf):
    return SP.events(_one_video(spark, sf), F.col("power") < 75, stretch=SHORT_STRETCH)
