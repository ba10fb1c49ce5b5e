"""Queries of statistics, images, models and reports."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clusters as C
from ..operators import evaluation as EV
from ..operators import events as E
from ..operators import frames as D
from ..operators import images as I
from ..operators import models as M
from ..operators import reports as RP
from ..operators import stats as ST
from ..operators import temporal as TM
from ..operators import windows as W
from ..sources.store import stored
from .registry import query
from .views import PIXELS, frames, pixels, table, with_decoded, with_frames

R = S.rounded


def _rounded(df, keep=(), digits=6):
    return df.select(*[c if c in keep else R(F.col(c).cast("double"), digits).alias(c) for c in df.columns])


@query("a4_a5_scaler_parameters", with_frames("SELECT round(coalesce(quantile_cont(intensity, 0.5), 0), 6) AS median_intensity, round(avg(intensity), 6) AS mean_intensity, round(stddev_pop(intensity), 6) AS std_intensity, round(coalesce(quantile_cont(power, 0.5), 0), 6) AS median_power, round(avg(power), 6) AS mean_power, round(stddev_pop(power), 6) AS std_power FROM frames"))
def scaler_parameters(spark, sf):
    s = M.fit_scaler(frames(spark, sf), ["intensity", "power"])
    values = {f"{k}_{c}": v[c] for c in s.features for k, v in (("median", s.median), ("mean", s.mean), ("std", s.std))}
    return spark.range(1).select(*[R(F.lit(float(v))).alias(k) for k, v in values.items()])


@query("a6_quantiles", with_frames("SELECT round(quantile_cont(power, 0.9), 6) AS q90, round(quantile_cont(intensity, 0.5), 6) AS q50, count(*) FILTER (power >= 90) AS high FROM frames"))
def quantiles(spark, sf):
    f = frames(spark, sf)
    q = ST.quantiles(f, [("power", 0.9), ("intensity", 0.5)])
    return f.agg(*[R(F.lit(v).cast("double")).alias(n) for v, n in zip(q, ("q90", "q50"), strict=True)], F.count_if(F.col("power") >= 90).alias("high"))


@query("p11_top_power_recall", with_frames(", q AS (SELECT quantile_cont(power, 0.9) AS q FROM frames WHERE active = 1) SELECT count(*) AS frames, round(avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM frames, q WHERE active = 1 AND power >= q"))
def top_power_recall(spark, sf):
    f = D.active(frames(spark, sf), "active")
    q = ST.quantiles(f, [("power", 0.9)])[0] or 0.0
    return f.filter(F.col("power") >= q).agg(F.count("*").alias("frames"), R(F.avg((F.col("label") == 2).cast("double"))).alias("recall"))


@query("a8_regime_profile", with_frames(", r AS (SELECT unnest([0, 1, 2]) AS regime) SELECT r.regime, count(f.label) AS frames, round(avg(f.power), 6) AS power_mean, round(stddev_pop(f.power), 6) AS power_std, round(avg(f.intensity), 6) AS intensity_mean FROM r LEFT JOIN (SELECT * FROM frames WHERE active = 1) f ON f.label = r.regime GROUP BY 1"))
def regime_profile(spark, sf):
    regimes = spark.range(3).select(F.col("id").cast("int").alias("regime"))
    f = D.active(frames(spark, sf), "active").groupBy("label").agg(F.count("*").alias("n"), F.avg("power").alias("pm"), F.stddev_pop("power").alias("ps"), F.avg("intensity").alias("im"))
    j = regimes.join(f, F.col("regime") == F.col("label"), "left")
    return j.select("regime", F.coalesce("n", F.lit(0)).alias("frames"), R(F.col("pm")).alias("power_mean"), R(F.col("ps")).alias("power_std"), R(F.col("im")).alias("intensity_mean"))


PARTS = ", v AS (SELECT video_id, count(*) AS n, avg(power) FILTER (label = 0) AS low, avg(power) FILTER (label = 1) AS nominal, avg(power) FILTER (label = 2) AS high FROM frames WHERE active = 1 GROUP BY 1 HAVING count(*) >= 20)"


def _parts(spark, sf):
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col("power")))
    f = D.active(frames(spark, sf), "active").groupBy("video_id").agg(F.count("*").alias("n"), mean(0).alias("low"), mean(1).alias("nominal"), mean(2).alias("high"))
    return f.filter("n >= 20").withColumn("monotone", F.coalesce((F.col("low") < F.col("nominal")) & (F.col("nominal") < F.col("high")), F.lit(False)))


@query("a9_part_means", with_frames(PARTS + " SELECT video_id, n, round(low, 6) AS low, round(nominal, 6) AS nominal, round(high, 6) AS high, coalesce(low < nominal AND nominal < high, false) AS monotone FROM v"))
def part_means(spark, sf):
    return _rounded(_parts(spark, sf), ("video_id", "n", "monotone"))


@query("a24_part_gap", with_frames(PARTS + " SELECT count(*) AS parts, round(avg(high - low), 6) AS mean_gap, count(*) FILTER (high > low) AS positive FROM v WHERE high IS NOT NULL AND low IS NOT NULL"))
def part_gap(spark, sf):
    p = _parts(spark, sf).filter("high IS NOT NULL AND low IS NOT NULL")
    return p.agg(F.count("*").alias("parts"), R(F.avg(F.col("high") - F.col("low"))).alias("mean_gap"), F.count_if(F.col("high") > F.col("low")).alias("positive"))


SUMMARY = ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std" for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query("a12_grouped_mean_std", f"SELECT l_returnflag, l_linestatus, count(*) AS runs, {SUMMARY} FROM lineitem GROUP BY 1, 2")
def grouped_mean_std(spark, sf):
    s = ST.summary_by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])
    return _rounded(s, ("l_returnflag", "l_linestatus", "runs"), 4)


CONFUSION = "count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn"
RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_positive_rate"


@query("a14_confusion_metrics", with_frames(f", c AS (SELECT {CONFUSION} FROM (SELECT power >= 75 AS t, intensity >= 60 AS p FROM frames WHERE active = 1)) SELECT tp, fp, fn, tn, {RATES} FROM c"))
def confusion_metrics(spark, sf):
    m = E.confusion(D.active(frames(spark, sf), "active"), F.col("power") >= 75, F.col("intensity") >= 60)
    return _rounded(m, ("tp", "fp", "fn", "tn"))


METHODS = {f"probability_{t:.2f}": f"p_high >= {t}" for t in (0.30, 0.50, 0.70, 0.90)} | {"raw_high_state": "label = 2"}


def _alarm_sql() -> str:
    """Each method as a table of its own, ranks for AUROC, islands for events."""
    fixed = [0.30, 0.50, 0.70, 0.90]
    over = "PARTITION BY definition, method, video_id ORDER BY frame_index"
    events = lambda name, flag: f"{name}_i AS (SELECT *, frame_index - row_number() OVER ({over}) AS island FROM p WHERE {flag}), {name} AS (SELECT definition, method, video_id, min(frame_index) AS start, max(frame_index) AS \"end\" FROM {name}_i GROUP BY 1, 2, 3, island HAVING count(*) >= 2)"
    flagged = " UNION ALL ".join(
        [f"SELECT *, 'probability_{x:.2f}' AS method, {x}::DOUBLE AS threshold, p_high >= {x}::DOUBLE AS p FROM t" for x in fixed]
        + ["SELECT t.*, 'probability_best_f1', best, p_high >= best FROM t JOIN best USING (definition)", "SELECT *, 'raw_high_state', NULL, label = 2 FROM t", "SELECT *, 'temporal_high_state', NULL, temporal_label = 2 FROM t"]
    )
    return f""", v AS (SELECT act.*, d.temporal_label FROM act JOIN decoded d USING (video_id, frame_index)),
q AS (SELECT quantile_cont(power, 0.9) AS cut FROM v),
t AS (SELECT 'top' AS definition, video_id, frame_index, label, temporal_label, p_high, power >= cut AS t FROM v, q UNION ALL SELECT 'level', video_id, frame_index, label, temporal_label, p_high, power >= 75 FROM v),
grid AS (SELECT CAST(round(0.05 + k * 0.01, 6) AS DOUBLE) AS threshold FROM (SELECT unnest(range(91)) AS k)),
tried AS (SELECT definition, threshold, 2 * count(*) FILTER (t AND p_high >= threshold) / nullif(count(*) FILTER (t) + count(*) FILTER (p_high >= threshold), 0) AS f1 FROM t, grid GROUP BY 1, 2),
best AS (SELECT definition, threshold AS best FROM tried QUALIFY row_number() OVER (PARTITION BY definition ORDER BY round(coalesce(f1, 0), 12) DESC, threshold) = 1),
p AS ({flagged}),
c AS (SELECT definition, method, threshold, {CONFUSION} FROM p GROUP BY 1, 2, 3),
ranked AS (SELECT definition, t, rank() OVER (PARTITION BY definition ORDER BY p_high) + (count(*) OVER (PARTITION BY definition, p_high) - 1) / 2.0 AS r FROM t),
areas AS (SELECT definition, (sum(r) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0) / (CAST(count(*) FILTER (t) AS DOUBLE) * count(*) FILTER (NOT t)) AS auroc FROM ranked GROUP BY 1),
steps AS (SELECT definition, p_high, count(*) AS n, count(*) FILTER (t) AS pos FROM t GROUP BY 1, 2),
sums AS (SELECT definition, pos, sum(pos) OVER w / sum(n) OVER w AS precision, sum(pos) OVER (PARTITION BY definition) AS positives FROM steps WINDOW w AS (PARTITION BY definition ORDER BY p_high DESC)),
curves AS (SELECT definition, sum(precision * pos / positives) AS auprc FROM sums GROUP BY 1),
{events("te", "t")}, {events("pe", "p")},
m AS (SELECT te.definition, te.method, te.video_id, te.start, pe.start AS p_start FROM te JOIN pe ON te.definition = pe.definition AND te.method = pe.method AND te.video_id = pe.video_id AND te.start <= pe."end" AND pe.start <= te."end"),
delays AS (SELECT definition, method, count(*) AS detected, avg(delay) AS delay FROM (SELECT definition, method, video_id, start, greatest(min(p_start) - start, 0) AS delay FROM m GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
alarms AS (SELECT definition, method, count(*) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE m.definition = pe.definition AND m.method = pe.method AND m.video_id = pe.video_id AND m.p_start = pe.start)) AS n, count(*) AS all_events FROM pe GROUP BY 1, 2),
truths AS (SELECT definition, method, count(*) AS n FROM te GROUP BY 1, 2),
parts AS (SELECT count(DISTINCT video_id) AS n FROM v)
SELECT c.definition, c.method, round(threshold, 6) AS threshold, round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_power_frame_fraction, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(best, 6) AS best_f1_threshold,
tp, fp, fn, tn, {RATES}, round((tp + fp) / (tp + fp + fn + tn), 6) AS positive_fraction, coalesce(truths.n, 0) AS true_events, coalesce(all_events, 0) AS predicted_events, coalesce(detected, 0) AS detected_true_events,
round(coalesce(detected / truths.n, 0), 6) AS event_recall, coalesce(alarms.n, 0) AS false_alarm_events, round(coalesce(alarms.n, 0) / parts.n, 6) AS false_alarm_events_per_part, round(delay, 6) AS mean_detection_delay_frames, round(delay / 20.0, 6) AS mean_detection_delay_ms
FROM c JOIN areas USING (definition) JOIN curves USING (definition) JOIN best USING (definition) CROSS JOIN parts LEFT JOIN delays USING (definition, method) LEFT JOIN alarms USING (definition, method) LEFT JOIN truths USING (definition, method)"""


COUNTS = ("definition", "method", "tp", "fp", "fn", "tn", "true_events", "predicted_events", "detected_true_events", "false_alarm_events")


@query("m22_p10_alarm_evaluation", with_decoded(_alarm_sql()))
def alarm_evaluation(spark, sf):
    """Two definitions of an alarm, the highest tenth of power by its quantile and a level, and seven methods."""
    f = D.active(frames(spark, sf), "active")
    run = stored(f.join(TM.decode(f), ["video_id", "frame_index"]), "run")
    cut = ST.quantiles(run, [("power", 0.9)])[0]
    definitions = {"top": F.col("power") >= F.lit(cut), "level": F.col("power") >= 75}
    return _rounded(EV.alarm_evaluation(run, definitions), COUNTS)


@query("m22_alarm_methods", with_frames(", c AS (SELECT definition, method, " + CONFUSION + " FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS definition, '{m}' AS method, {w} AS t, {x} AS p FROM frames WHERE active = 1" for d, w in (("top", "power >= 90"), ("level", "power >= 75")) for m, x in METHODS.items()) + f") GROUP BY 1, 2) SELECT definition, method, tp, fp, fn, tn, {RATES} FROM c"))
def alarm_methods(spark, sf):
    f = D.active(frames(spark, sf), "active")
    truths = F.array(*[F.struct(F.lit(d).alias("definition"), F.expr(w).alias("t")) for d, w in (("top", "power >= 90"), ("level", "power >= 75"))])
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.expr(x).alias("p")) for m, x in METHODS.items()])
    rows = f.select(F.explode(truths).alias("d"), methods.alias("m")).select("d", F.explode("m").alias("m")).select("d.definition", "d.t", "m.method", "m.p")
    return _rounded(E.confusion(rows, F.col("t"), F.col("p"), ("definition", "method")), ("definition", "method", "tp", "fp", "fn", "tn"))


@query("t7_best_f1_threshold", with_frames(", g AS (SELECT round(0.05 + k * 0.01, 6) AS threshold FROM (SELECT unnest(range(91)) AS k)), c AS (SELECT threshold, count(*) FILTER (power >= 75 AND p_high >= threshold) AS tp, count(*) FILTER (power < 75 AND p_high >= threshold) AS fp, count(*) FILTER (power >= 75 AND p_high < threshold) AS fn FROM frames, g WHERE active = 1 GROUP BY 1), f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c) SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 6) AS f1 FROM f ORDER BY round(f1, 12) DESC, threshold LIMIT 1"))
def best_f1_threshold(spark, sf):
    rows = D.active(frames(spark, sf), "active").select((F.col("power") >= 75).alias("t"), "p_high")
    return _rounded(E.best_f1(E.threshold_metrics(rows, "t", "p_high")), ("threshold", "tp", "fp", "fn"))


@query("m17_pearson", with_frames("SELECT video_id, round(CASE WHEN stddev_pop(intensity) > 1e-12 AND stddev_pop(power) > 1e-12 AND count(*) >= 3 THEN covar_pop(intensity, power) / (stddev_pop(intensity) * stddev_pop(power)) END, 6) AS pearson FROM frames GROUP BY 1"))
def pearson(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(R(ST.pearson(F.col("intensity"), F.col("power"))).alias("pearson"))


def _rank(c, part=""):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {c}" if part else f"PARTITION BY {c}"
    return f"rank() OVER ({p}ORDER BY {c}) + (count(*) OVER ({q}) - 1) / 2.0"


PEARSON = "round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS spearman"


@query("m18_spearman", with_frames(f", r AS (SELECT {_rank('p_high')} AS rx, {_rank('power')} AS ry FROM frames WHERE active = 1) SELECT count(*) AS n, {PEARSON} FROM r"))
def spearman(spark, sf):
    return _rounded(ST.spearman(D.active(frames(spark, sf), "active"), "p_high", "power"), ("n",))


@query("m18_spearman_by_part", with_frames(f", r AS (SELECT video_id, {_rank('intensity', 'video_id')} AS rx, {_rank('power', 'video_id')} AS ry FROM frames WHERE active = 1) SELECT video_id, count(*) AS n, {PEARSON} FROM r GROUP BY 1"))
def spearman_by_part(spark, sf):
    return _rounded(ST.spearman_within(D.active(frames(spark, sf), "active"), "intensity", "power", ["video_id"]), ("video_id", "n"))


@query("w13_average_rank", f"SELECT o_orderkey, {_rank('o_totalprice')} AS rank FROM orders")
def average_rank(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ST.average_rank(o, "o_totalprice", "rank").select("o_orderkey", "rank")


GROUPS = ", s AS (SELECT p_high AS score, count(*) FILTER (power >= 75) AS pos, count(*) AS n FROM frames WHERE active = 1 GROUP BY 1), g AS (SELECT score, pos, n - pos AS neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS ca FROM s)"


def _groups(spark, sf):
    return ST.score_groups(D.active(frames(spark, sf), "active").withColumn("t", F.col("power") >= 75), "t", "p_high")


@query("m20_auroc", with_frames(GROUPS + " SELECT round(sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auroc FROM g"))
def auroc(spark, sf):
    return _rounded(ST.auroc(_groups(spark, sf)))


@query("m21_average_precision", with_frames(GROUPS + " SELECT round(sum(pos * (cp / ca)) / sum(pos), 6) AS auprc FROM g"))
def average_precision(spark, sf):
    return _rounded(ST.average_precision(_groups(spark, sf)))


@query("m9_adjusted_rand", with_frames(", c AS (SELECT video_id % 5 AS g, label AS a, CAST(power >= 50 AS INTEGER) AS b, count(*) AS n FROM frames GROUP BY 1, 2, 3), x AS (SELECT g, sum(n) AS t, sum(n * (n - 1) / 2.0) AS sab FROM c GROUP BY 1), a AS (SELECT g, sum(n * (n - 1) / 2.0) AS sa FROM (SELECT g, a, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), b AS (SELECT g, sum(n * (n - 1) / 2.0) AS sb FROM (SELECT g, b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1) SELECT g, CAST(t AS BIGINT) AS n, round((sab - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)), 6) + 0.0 AS ari FROM x JOIN a USING (g) JOIN b USING (g)"))
def adjusted_rand(spark, sf):
    f = frames(spark, sf).select((F.col("video_id") % 5).alias("g"), F.col("label").alias("a"), (F.col("power") >= 50).cast("int").alias("b"))
    return _rounded(ST.adjusted_rand(f, "a", "b", ["g"]), ("g", "n"))


@query("m23_alignment", with_frames(f", r AS (SELECT intensity, power, {_rank('intensity')} AS rx, {_rank('power')} AS ry FROM frames) SELECT count(*) AS n, round(covar_pop(intensity, power) / (stddev_pop(intensity) * stddev_pop(power)), 6) AS pearson, {PEARSON}, round(avg(abs(intensity - power)), 6) AS mean_absolute_error FROM r"))
def alignment(spark, sf):
    f = frames(spark, sf)
    m = f.agg(R(ST.pearson(F.col("intensity"), F.col("power"))).alias("pearson"), R(F.avg(F.abs(F.col("intensity") - F.col("power")))).alias("mean_absolute_error"))
    return _rounded(ST.spearman(f, "intensity", "power"), ("n",)).crossJoin(m)


@query("a19_group_spread", "SELECT l_shipmode AS g, n, lo, med, hi, rep FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, round(min(l_quantity), 6) AS lo, round(quantile_cont(l_quantity, 0.5), 6) AS med, round(max(l_quantity), 6) AS hi, min(l_orderkey) AS rep FROM lineitem GROUP BY 1)")
def group_spread(spark, sf):
    li = table(spark, sf, "lineitem")
    spread = li.groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"), R(F.min("l_quantity")).alias("lo"), R(F.max("l_quantity")).alias("hi"), F.min("l_orderkey").alias("rep"))
    med = ST.quantiles_by(li.withColumnRenamed("l_returnflag", "g"), ["g"], "l_quantity", {"med": 0.5})
    return spread.join(med, "g").select("g", "n", "lo", R(F.col("med")).alias("med"), "hi", "rep")


@query("a20_trigger_counters", with_frames(", u AS (SELECT video_id, frame_index, 'power' AS signal, power AS v FROM frames UNION ALL SELECT video_id, frame_index, 'active', active FROM frames UNION ALL SELECT video_id, frame_index, 'label', label FROM frames), k AS (SELECT signal, v = 2 AS two, v <> 0 AS other, lag(v = 2) OVER w AS ptwo, lag(v <> 0) OVER w AS psome FROM u WINDOW w AS (PARTITION BY signal, video_id ORDER BY frame_index)) SELECT signal, count(*) FILTER (two) AS equal_2, count(*) FILTER (other) AS nonzero, count(*) FILTER (two AND NOT coalesce(ptwo, false)) AS rising_2, count(*) FILTER (other AND NOT coalesce(psome, false)) AS rising_nonzero FROM k GROUP BY 1"))
def trigger_counters(spark, sf):
    f = frames(spark, sf)
    signals = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("v")) for c in ("power", "active", "label")])
    u = f.select("video_id", "frame_index", F.explode(signals).alias("s")).select(F.concat_ws(":", "s.signal", "video_id").alias("key"), "s.signal", "frame_index", "s.v")
    u = u.withColumns({"r2": W.rising_edges(F.col("v") == 2, key="key"), "r": W.rising_edges(F.col("v") != 0, key="key")})
    return u.groupBy("signal").agg(F.count_if(F.col("v") == 2).alias("equal_2"), F.count_if(F.col("v") != 0).alias("nonzero"), F.sum("r2").cast("long").alias("rising_2"), F.sum("r").cast("long").alias("rising_nonzero"))


@query("t3_best_trigger", with_frames(", c AS (SELECT power, count(*) AS n FROM frames GROUP BY 1) SELECT power, n FROM c ORDER BY abs(n - 100), power LIMIT 1"))
def best_trigger(spark, sf):
    c = frames(spark, sf).groupBy("power").agg(F.count("*").alias("n"))
    return c.orderBy(F.abs(F.col("n") - 100), "power").limit(1)


@query("a21_most_common_values", with_frames("SELECT power, count(*) AS n FROM frames GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def most_common_values(spark, sf):
    return frames(spark, sf).groupBy("power").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "power").limit(5)


@query("a17_a18_distinct_and_all", "SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, count(DISTINCT o_orderpriority) AS priorities, bool_and(o_totalprice > 0) AS all_positive FROM orders")
def distinct_and_all(spark, sf):
    return table(spark, sf, "orders").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"), F.countDistinct("o_orderpriority").alias("priorities"), F.every(F.col("o_totalprice") > 0).alias("all_positive"))


HIST = f"WITH {PIXELS}, h AS (SELECT frame_id, level, count(*) AS n FROM pixels GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY level) AS wt, sum(n * level) OVER (PARTITION BY frame_id ORDER BY level) AS st, sum(n) OVER (PARTITION BY frame_id) AS total, sum(n * level) OVER (PARTITION BY frame_id) AS mass FROM h), o AS (SELECT *, CASE WHEN wt = total THEN 0.0 ELSE pow(CAST(mass AS DOUBLE) * wt - CAST(st AS DOUBLE) * total, 2) / (wt * (total - wt)) END AS between_ FROM c), t AS (SELECT frame_id, arg_min(level, struct_pack(a := -between_, b := level)) AS otsu FROM o GROUP BY 1)"


@query("a22_histogram_features", HIST + """ SELECT frame_id, CAST(max(total) AS BIGINT) AS pixels, min(level) AS pixel_min, max(level) AS pixel_max, round(max(mass) / max(total), 6) AS mean_intensity, CAST(max(mass) AS BIGINT) AS total_intensity,
min(level) FILTER (wt >= 0.95 * total) AS p95, min(level) FILTER (wt >= 0.99 * total) AS p99, round(sum(-(n / total) * log2(n / total)), 6) AS entropy, any_value(otsu) AS otsu_threshold, greatest(any_value(otsu), 8) AS segmentation_threshold,
CAST(coalesce(sum(n) FILTER (level >= greatest(otsu, 8)), 0) AS BIGINT) AS threshold_area, round(coalesce(sum(n) FILTER (level >= 64), 0) / max(total), 6) AS bright_fraction_64, round(coalesce(max(mass) / nullif(max(level), 0), 0), 6) AS effective_area FROM o JOIN t USING (frame_id) GROUP BY frame_id""")
def histogram_features(spark, sf):
    f = I.histogram_features(I.histogram(pixels(spark, sf)))
    ints = ("frame_id", "pixels", "pixel_min", "pixel_max", "total_intensity", "p95", "p99", "otsu_threshold", "segmentation_threshold", "threshold_area")
    return _rounded(f.select(*ints, "mean_intensity", "entropy", "bright_fraction_64", "effective_area"), ints)


@query("p2_mask_box", HIST + ", m AS (SELECT frame_id, x, y FROM pixels JOIN t USING (frame_id) WHERE level >= greatest(otsu, 8)), b AS (SELECT frame_id, count(*) AS n, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY 1) SELECT t.frame_id, coalesce(w, 0) AS bbox_width, coalesce(h, 0) AS bbox_height, round(coalesce(n / (w * h), 0), 6) AS bbox_fill, round(cx, 6) AS threshold_centroid_x, round(cy, 6) AS threshold_centroid_y FROM t LEFT JOIN b USING (frame_id)")
def mask_box(spark, sf):
    p = pixels(spark, sf)
    return _rounded(I.mask_box(p, I.histogram_features(I.histogram(p))), ("frame_id", "bbox_width", "bbox_height"))


@query("a23_weighted_moments", f"WITH {PIXELS}, s AS (SELECT frame_id, sum(level) AS m, sum(level * x) AS mx, sum(level * y) AS my, sum(level * x * x) AS mxx, sum(level * y * y) AS myy, sum(level * x * y) AS mxy FROM pixels GROUP BY 1), c AS (SELECT frame_id, mx / m AS cx, my / m AS cy, mxx / m - pow(mx / m, 2) AS a, mxy / m - (mx / m) * (my / m) AS b, myy / m - pow(my / m, 2) AS c FROM s WHERE m > 0) SELECT frame_id, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(sqrt(greatest((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 0)), 6) AS major_sigma, round(sqrt(greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0)), 6) AS minor_sigma FROM c")
def weighted_moments(spark, sf):
    return _rounded(I.moments(pixels(spark, sf)).select("frame_id", "centroid_x", "centroid_y", "major_sigma", "minor_sigma"), ("frame_id",))


@query("m3_thermal_score", with_frames(", k AS (SELECT avg(intensity) AS mi, stddev_pop(intensity) AS si, avg(power) AS mp, stddev_pop(power) AS sp FROM frames WHERE active = 1) SELECT video_id, frame_index, round((intensity - mi) / si + 0.7 * (power - mp) / sp, 5) + 0.0 AS score FROM frames, k WHERE active = 1"))
def thermal_score(spark, sf):
    f = D.active(frames(spark, sf), "active")
    s = M.fit_scaler(f, ["intensity", "power"])
    return f.select("video_id", "frame_index", R(M.thermal_score({"intensity": 1.0, "power": 0.7}, s), 5).alias("score"))


@query("t2_component_order", with_frames(", m AS (SELECT c.c AS component, avg(f.intensity) AS s FROM (SELECT unnest([0, 1, 2, 3]) AS c) c LEFT JOIN frames f ON f.label = c.c GROUP BY 1) SELECT component, row_number() OVER (ORDER BY s NULLS LAST, component) - 1 AS place FROM m"))
def component_order(spark, sf):
    means = frames(spark, sf).groupBy("label").agg(F.avg("intensity").alias("s"))
    c = spark.range(4).select(F.col("id").cast("int").alias("component")).join(means, F.col("component") == F.col("label"), "left")
    return M.ranked_groups(c, "s", "component").select("component", F.col("place").cast("long").alias("place"))


def _standard(spark, sf):
    """Active frames, stored once for all passes of a fit, with scaled features and their sum."""
    f = stored(D.active(frames(spark, sf), "active"), "training")
    s = M.fit_scaler(f, ["intensity", "power"])
    return f.withColumns(s.columns()).withColumn("score", F.col("z_intensity") + F.col("z_power")), ["z_intensity", "z_power"]


#: Where the fits begin whose steps SQL repeats: centres over intensity and power, both in hundredths, and variances.
GIVEN = [[0.2, 0.1], [0.5, 0.5], [0.9, 1.0]]
GIVEN_VARIANCES = [[0.05, 0.1], [0.02, 0.2], [0.1, 0.05]]
STEPS = 4
POINTS = ", pts AS (SELECT intensity / 100 AS x, power / 100 AS y FROM frames WHERE active = 1)"


def _points_of(spark, sf):
    f = D.active(frames(spark, sf), "active").select((F.col("intensity") / 100).alias("x"), (F.col("power") / 100).alias("y"), F.lit(-1).alias("__fold"))
    return stored(f, "points")


def _lloyd_sql() -> str:
    far = lambda k: f"pow(x - m{k}x, 2) + pow(y - m{k}y, 2)"
    label = f"CASE WHEN {far(0)} <= {far(1)} AND {far(0)} <= {far(2)} THEN 0 WHEN {far(1)} <= {far(2)} THEN 1 ELSE 2 END"
    start = ", ".join(f"{v}::DOUBLE AS m{k}{c}" for k, m in enumerate(GIVEN) for c, v in zip("xy", m, strict=True))
    step = lambda i: f"a{i} AS (SELECT pts.*, c{i}.*, {label} AS label FROM pts, c{i}), c{i + 1} AS (SELECT " + ", ".join(f"coalesce(avg({c}) FILTER (label = {k}), any_value(m{k}{c})) AS m{k}{c}" for k in range(3) for c in "xy") + f" FROM a{i})"
    return POINTS + f", c0 AS (SELECT {start}), " + ", ".join(map(step, range(STEPS))) + " " + " UNION ALL ".join(f"SELECT {k} AS component, round(m{k}x, 6) AS x, round(m{k}y, 6) AS y FROM c{STEPS}" for k in range(3))


@query("m5_steps_from_given_centres", with_frames(_lloyd_sql()))
def steps_from_given_centres(spark, sf):
    """Four steps of k-means from given centres."""
    centres = M.kmeans_fits(_points_of(spark, sf), ["x", "y"], [M.Job()], STEPS, tol=-1.0, begin=[np.array(GIVEN)])[0][0]
    return _rounded(spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(centres)], "component int, x double, y double"), ("component",))


def _em_sql() -> str:
    """Responsibilities by the densities' logarithms, as differences to the largest."""
    log = lambda k: f"ln(greatest(w{k}, 1e-300)) - 0.5 * (ln(2 * pi() * v{k}x) + ln(2 * pi() * v{k}y)) - pow(x - m{k}x, 2) / (2 * v{k}x) - pow(y - m{k}y, 2) / (2 * v{k}y)"
    start = ", ".join([f"{1 / 3}::DOUBLE AS w{k}" for k in range(3)] + [f"{v}::DOUBLE AS {n}{k}{c}" for n, table in (("m", GIVEN), ("v", GIVEN_VARIANCES)) for k, m in enumerate(table) for c, v in zip("xy", m, strict=True)])
    mean = lambda k, e: f"sum(r{k} * {e}) / greatest(sum(r{k}), 1e-10)"
    made = ", ".join(x for k in range(3) for x in (f"greatest(sum(r{k}), 1e-10) / count(*) AS w{k}", *(f"{mean(k, c)} AS m{k}{c}, greatest({mean(k, f'{c} * {c}')} - pow({mean(k, c)}, 2), 0) + 1e-5 AS v{k}{c}" for c in "xy")))
    step = lambda i: f"l{i} AS (SELECT x, y, {', '.join(f'{log(k)} AS l{k}' for k in range(3))} FROM pts, c{i}), e{i} AS (SELECT x, y, {', '.join(f'exp(l{k} - greatest(l0, l1, l2)) AS e{k}' for k in range(3))} FROM l{i}), r{i} AS (SELECT x, y, {', '.join(f'e{k} / (e0 + e1 + e2) AS r{k}' for k in range(3))} FROM e{i}), c{i + 1} AS (SELECT {made} FROM r{i})"
    return POINTS + f", c0 AS (SELECT {start}), " + ", ".join(map(step, range(STEPS))) + " " + " UNION ALL ".join(f"SELECT {k} AS component, round(w{k}, 6) AS weight, round(m{k}x, 6) AS x, round(m{k}y, 6) AS y, round(v{k}x, 6) AS vx, round(v{k}y, 6) AS vy FROM c{STEPS}" for k in range(3))


@query("m6_steps_from_a_given_mixture", with_frames(_em_sql()))
def steps_from_a_given_mixture(spark, sf):
    """Four steps of expectation maximisation from a given mixture."""
    start = M.Mixture(np.full(3, 1 / 3), np.array(GIVEN), np.array(GIVEN_VARIANCES))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # four steps don't converge
        m = M.mixture_fits(_points_of(spark, sf), ["x", "y"], [M.Job()], [start], STEPS, tol=-1.0)[0][0]
    rows = [(k, float(m.weights[k]), *map(float, m.means[k]), *map(float, m.variances[k])) for k in range(3)]
    return _rounded(spark.createDataFrame(rows, "component int, weight double, x double, y double, vx double, vy double"), ("component",))


@query("m5_kmeans_states")
def kmeans_states(spark, sf):
    f, z = _standard(spark, sf)
    p = M.kmeans_posterior(f, z, M.kmeans(f, z))
    labelled = f.withColumn("raw", S.first_argmax(p))
    p, label = M.reordered(p, M.component_order(labelled, "raw", "score"))
    return labelled.withColumn("state", label).groupBy("state").agg(F.count("*").alias("frames"), F.avg("score").alias("mean_score"))


@query("m6_mixture_states")
def mixture_states(spark, sf):
    f, z = _standard(spark, sf)
    p = M.gmm(f, z).posterior(z)
    labelled = f.withColumn("raw", S.first_argmax(p))
    p, label = M.reordered(p, M.component_order(labelled, "raw", "score"))
    return labelled.withColumn("state", label).groupBy("state").agg(F.count("*").alias("frames"), F.avg("score").alias("mean_score"))


@query("m7_anchored_mixture_states")
def anchored_mixture_states(spark, sf):
    f, z = _standard(spark, sf)
    m, _ = M.fit_mixture(f, z, M.anchored_start(f, z, "score"))
    p, label = M.reordered(m.posterior(z), M.component_order(f.withColumn("raw", S.first_argmax(m.posterior(z))), "raw", "score"))
    return f.withColumn("state", label).groupBy("state").agg(F.count("*").alias("frames"), F.avg("score").alias("mean_score"))


FOLD = "CAST(video_id % 5 AS INTEGER)"


def _folded(spark, sf):
    return stored(D.active(frames(spark, sf), "active").select("video_id", "frame_index", "intensity", "power", (F.col("video_id") % 5).cast("int").alias("fold")), "folds")


@query("m15_out_of_fold_states")
def out_of_fold_states(spark, sf):
    oof = M.out_of_fold(_folded(spark, sf), ["intensity", "power"], "fold", ["video_id", "frame_index", "fold", "power"])
    return oof.groupBy("model", "seed", "fold", "label").agg(F.count("*").alias("frames"), F.avg("power").alias("mean_power"), F.avg("p_high").alias("mean_p_high"))


def _all_runs(spark, sf):
    """Out-of-fold rows of every model and seed, with their temporal labels."""
    oof = M.out_of_fold(_folded(spark, sf), ["intensity", "power"], "fold", ["video_id", "frame_index", "power"])
    # A run's videos are videos of their own for the decoder.
    return stored(TM.decode(oof, by=("model", "seed"), keep=("power", "p_high", "label")), "runs")


@query("m15_out_of_fold_evaluation")
def out_of_fold_evaluation(spark, sf):
    """The measures of all runs, each model and seed, with intervals."""
    return EV.evaluate_runs(_all_runs(spark, sf), ["model", "seed"])


@query("m15_out_of_fold_summary")
def out_of_fold_summary(spark, sf):
    """Their means and deviations over seeds, by model."""
    runs = stored(EV.evaluate_runs(_all_runs(spark, sf), ["model", "seed"], intervals=False), "evaluations")
    return EV.runs_summary(runs, ["model"])


@query("m16_fold_scalers", with_frames(f", a AS (SELECT *, {FOLD} AS fold FROM frames WHERE active = 1), k AS (SELECT unnest(range(5)) AS fold) SELECT CAST(k.fold AS INTEGER) AS fold, " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}" for c in ("intensity", "power")) + " FROM k JOIN a ON a.fold <> k.fold GROUP BY 1"))
def fold_scalers(spark, sf):
    names = ["intensity", "power"]
    rows = [(k, *[round(float(v[c]), 6) for c in names for v in (s.median, s.mean, s.std)]) for k, s in enumerate(M.fold_scalers(_folded(spark, sf), names, "fold"))]
    return spark.createDataFrame(rows, "fold int, " + ", ".join(f"{v}_{c} double" for c in names for v in ("median", "mean", "std")))


_CORR = lambda x, y: f"CASE WHEN count(*) >= 3 AND stddev_pop({x}) >= 1e-12 AND stddev_pop({y}) >= 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
_RUN_RANKS = ", ".join(f"{_rank(c)} AS g_{n}, {_rank(c, 'video_id')} AS v_{n}" for c, n in (("p_high", "p"), ("label", "l"), ("temporal_label", "t"), ("power", "w")))
_SWITCHED = lambda c: f"CASE WHEN {c} <> lag({c}) OVER (PARTITION BY video_id, segment ORDER BY frame_index) THEN 1 ELSE 0 END"
RUN_SQL = with_decoded(f""", e AS (SELECT a.*, d.segment, d.temporal_label FROM act a JOIN decoded d ON a.video_id = d.video_id AND a.frame_index = d.frame_index),
r AS (SELECT *, {_RUN_RANKS}, {_SWITCHED('label')} AS sl, {_SWITCHED('temporal_label')} AS st FROM e), q AS (SELECT quantile_cont(power, 0.9) AS cut FROM e),
f AS (SELECT count(*) AS active_frames, avg(CAST(label = 2 AS INTEGER)) FILTER (power >= cut) AS top_10pct_power_high_regime_recall_raw, avg(CAST(temporal_label = 2 AS INTEGER)) FILTER (power >= cut) AS top_10pct_power_high_regime_recall_temporal,
  {_CORR('g_p', 'g_w')} AS p_high_power_spearman_frame, {_CORR('g_l', 'g_w')} AS raw_label_power_spearman_frame, {_CORR('g_t', 'g_w')} AS temporal_label_power_spearman_frame,
  1000.0 * sum(sl) / (count(*) - count(DISTINCT (video_id, segment))) AS raw_switches_per_1000, 1000.0 * sum(st) / (count(*) - count(DISTINCT (video_id, segment))) AS temporal_switches_per_1000 FROM r, q),
v AS (SELECT video_id, {_CORR('v_p', 'v_w')} AS cp, {_CORR('v_t', 'v_w')} AS ct, avg(power) FILTER (temporal_label = 0) AS low, avg(power) FILTER (temporal_label = 1) AS nominal, avg(power) FILTER (temporal_label = 2) AS high FROM r GROUP BY 1 HAVING count(*) >= 20),
m AS (SELECT avg(cp) AS part_mean_p_high_power_spearman, avg(ct) AS part_mean_temporal_power_spearman, avg(high - low) AS part_mean_high_low_power_difference, count(*) FILTER (low < nominal AND nominal < high) AS monotonic_parts, count(low < nominal AND nominal < high) AS eligible_monotonic_parts FROM v)
SELECT active_frames, monotonic_parts, eligible_monotonic_parts, {", ".join(f"round({c}, 6) AS {c}" for c in ("top_10pct_power_high_regime_recall_raw", "top_10pct_power_high_regime_recall_temporal", "p_high_power_spearman_frame", "raw_label_power_spearman_frame", "temporal_label_power_spearman_frame", "raw_switches_per_1000", "temporal_switches_per_1000", "part_mean_p_high_power_spearman", "part_mean_temporal_power_spearman", "part_mean_high_low_power_difference"))},
  round(monotonic_parts / nullif(eligible_monotonic_parts, 0), 6) AS monotonic_part_fraction, round((raw_switches_per_1000 - temporal_switches_per_1000) / nullif(raw_switches_per_1000, 0), 6) AS switch_reduction_fraction FROM f, m""")


@query("m24_run_evaluation", RUN_SQL)
def run_evaluation(spark, sf):
    f = D.active(frames(spark, sf), "active")
    run = stored(f.join(TM.decode(f), ["video_id", "frame_index"]), "run")
    return _rounded(EV.evaluate_run(run, intervals=False), ("active_frames", "monotonic_parts", "eligible_monotonic_parts"))


@query("m13_cluster_quality")
def cluster_quality(spark, sf):
    f, z = _standard(spark, sf)
    s = C.silhouette(C.sampled(f, ["video_id", "frame_index"]), z, "label", "video_id")
    q = C.scatter(f, z, "label")
    return s.select("silhouette", *[F.lit(v).cast("double").alias(k) for k, v in q.items()])


@query("m13_scatter_indices", with_frames(""", k AS (SELECT avg(intensity) AS mi, stddev_pop(intensity) AS si, avg(power) AS mp, stddev_pop(power) AS sp FROM frames WHERE active = 1),
z AS (SELECT label, (intensity - mi) / si AS x, (power - mp) / sp AS y FROM frames, k WHERE active = 1), c AS (SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y FROM z GROUP BY 1),
d AS (SELECT label, c.n, c.x, c.y, avg(sqrt(pow(z.x - c.x, 2) + pow(z.y - c.y, 2))) AS s, sum(pow(z.x - c.x, 2) + pow(z.y - c.y, 2)) AS w FROM z JOIN c USING (label) GROUP BY 1, 2, 3, 4),
p AS (SELECT i.label, max((i.s + j.s) / sqrt(pow(i.x - j.x, 2) + pow(i.y - j.y, 2))) AS r FROM d i JOIN d j ON i.label <> j.label GROUP BY 1)
SELECT round((SELECT avg(r) FROM p), 4) AS davies_bouldin, round(sum(n * (x * x + y * y)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 4) AS calinski_harabasz FROM d"""))
def scatter_indices(spark, sf):
    f, z = _standard(spark, sf)
    return spark.range(1).select(*[R(F.lit(v).cast("double"), 4).alias(k) for k, v in C.scatter(f, z, "label").items()])


@query("m13_confidence", with_frames("SELECT round(avg(greatest(p_low, p_nominal, p_high)), 6) AS confidence_mean, round(avg(CAST(greatest(p_low, p_nominal, p_high) >= 0.8 AS INTEGER)), 6) AS confident_fraction_080, round(avg(CAST(greatest(p_low, p_nominal, p_high) >= 0.95 AS INTEGER)), 6) AS confident_fraction_095 FROM frames"))
def confidence(spark, sf):
    return _rounded(C.confidence(frames(spark, sf), ["p_low", "p_nominal", "p_high"]))


@query("m13_thermal_order", with_frames("SELECT round(avg(CAST(label = 0 AS INTEGER)), 6) AS cluster_0_fraction, round(avg(CAST(label = 1 AS INTEGER)), 6) AS cluster_1_fraction, round(avg(CAST(label = 2 AS INTEGER)), 6) AS cluster_2_fraction, round(avg(intensity) FILTER (label = 0), 6) AS thermal_mean_under, round(avg(intensity) FILTER (label = 1), 6) AS thermal_mean_nominal, round(avg(intensity) FILTER (label = 2), 6) AS thermal_mean_over, coalesce(avg(intensity) FILTER (label = 0) < avg(intensity) FILTER (label = 1) AND avg(intensity) FILTER (label = 1) < avg(intensity) FILTER (label = 2), false) AS thermal_monotonic, round((avg(intensity) FILTER (label = 2) - avg(intensity) FILTER (label = 0)) / stddev_pop(intensity), 6) AS extreme_separation_std FROM frames"))
def thermal_order(spark, sf):
    return _rounded(C.thermal_order(frames(spark, sf), "label", "intensity"), ("thermal_monotonic",))


@query("m14_distillation")
def distillation(spark, sf):
    f, z = _standard(spark, sf)
    model = M.distil(f, z, "label")
    return M.class_metrics(M.distil_predict(model, f, z), "label", "prediction")


@query("m19_bootstrap")
def bootstrap(spark, sf):
    gaps = _parts(spark, sf).select((F.col("video_id") % 5).alias("g"), (F.col("high") - F.col("low")).alias("gap"))
    return ST.bootstrap_interval(gaps, "g", "gap")


@query("j10_experiment_tasks", with_frames(""", f AS (SELECT video_id % 10 AS k, video_id % 5 AS fold, count(*) AS n FROM frames GROUP BY 1, 2),
s AS (SELECT unnest([42, 123, 2026]) AS seed), m AS (SELECT unnest(['kmeans', 'gmm', 'anchored_gmm']) AS model), x AS (SELECT unnest(['basic', 'physical', 'temporal', 'physical_temporal']) AS feature_set),
t AS (SELECT 'holdout' AS protocol, NULL AS fold, feature_set, model, seed FROM x, m, s UNION ALL SELECT 'cv', k, 'physical_temporal', 'anchored_gmm', seed FROM (SELECT unnest(range(5)) AS k), s)
SELECT protocol, CAST(t.fold AS INTEGER) AS fold, count(DISTINCT (feature_set, model, seed)) AS tasks, CAST(sum(n) AS BIGINT) AS tested_frames FROM t JOIN f ON CASE WHEN protocol = 'cv' THEN f.fold = t.fold ELSE k >= 8 END GROUP BY 1, 2"""))
def experiment_tasks(spark, sf):
    """Tasks with the frames that each one tests: those of its fold, or of the held-out split."""
    k = F.col("video_id") % 10
    f = frames(spark, sf).groupBy(F.when(k >= 8, "test").otherwise("fit").alias("split"), (F.col("video_id") % 5).alias("of")).agg(F.count("*").alias("n"))
    met = F.when(F.col("protocol") == "cv", F.col("of") == F.col("fold")).otherwise(F.col("split") == "test")
    return D.experiment_tasks(spark).join(f, met).groupBy("protocol", "fold").agg(F.countDistinct("task_id").alias("tasks"), F.sum("n").cast("long").alias("tested_frames"))


@query("m25_case_records", with_frames(f", a AS (SELECT *, CASE WHEN label <> lag(label) OVER ({'PARTITION BY video_id ORDER BY frame_index'}) THEN 1 ELSE 0 END AS c FROM frames WHERE active = 1) SELECT video_id, count(*) AS frames, CAST(sum(c) AS BIGINT) AS transitions, round(avg(CAST((power >= 75) <> (label = 2) AS INTEGER)), 6) AS disagreement_fraction, round(covar_pop(p_high, power) / nullif(stddev_pop(p_high) * stddev_pop(power), 0), 6) AS score_power_correlation FROM a GROUP BY 1"))
def case_records(spark, sf):
    return _rounded(_cases(spark, sf), ("video_id", "frames", "transitions"))


def _cases(spark, sf):
    f = D.active(frames(spark, sf), "active").withColumn("c", W.switches("label", False))
    return f.groupBy("video_id").agg(
        F.count("*").alias("frames"),
        F.sum("c").cast("long").alias("transitions"),
        F.avg(((F.col("power") >= 75) != (F.col("label") == 2)).cast("double")).alias("disagreement_fraction"),
        ST.pearson(F.col("p_high"), F.col("power")).alias("score_power_correlation"),
    )


@query("t5_upper_median", with_frames(", c AS (SELECT video_id, round(covar_pop(p_high, power) / nullif(stddev_pop(p_high) * stddev_pop(power), 0), 9) AS r FROM frames WHERE active = 1 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY r, video_id) AS place, count(*) OVER () AS n FROM c WHERE r IS NOT NULL) SELECT video_id, round(r, 6) AS correlation FROM o WHERE place = n // 2 + 1"))
def upper_median(spark, sf):
    from ..operators.reports import upper_median as pick

    c = _cases(spark, sf).select("video_id", F.round("score_power_correlation", 9).alias("r")).filter("r IS NOT NULL")
    return pick(c, "r", "video_id").select("video_id", R(F.col("r")).alias("correlation"))


@query("t4_greedy_cases", with_frames(""", a AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY video_id ORDER BY frame_index) THEN 1 ELSE 0 END AS c FROM frames WHERE active = 1), r AS (SELECT video_id, avg(power) AS p, round(avg(CAST((power >= 75) <> (label = 2) AS INTEGER)), 9) AS d, sum(c) AS t FROM a GROUP BY 1),
c1 AS (SELECT video_id FROM r ORDER BY round(p, 9) DESC, video_id LIMIT 1), c2 AS (SELECT video_id FROM r WHERE video_id NOT IN (FROM c1) ORDER BY d DESC, video_id LIMIT 1), c3 AS (SELECT video_id FROM r WHERE video_id NOT IN (FROM c1) AND video_id NOT IN (FROM c2) ORDER BY t DESC, video_id LIMIT 1)
SELECT 'high_power' AS kind, video_id FROM c1 UNION ALL SELECT 'temporal_correction', video_id FROM c2 UNION ALL SELECT 'transition', video_id FROM c3"""))
def greedy_cases(spark, sf):
    from ..operators.reports import greedy_picks

    mean_power = D.active(frames(spark, sf), "active").groupBy("video_id").agg(F.round(F.avg("power"), 9).alias("mean_power"))
    r = _cases(spark, sf).withColumn("disagreement_fraction", F.round("disagreement_fraction", 9)).join(mean_power, "video_id")
    return greedy_picks(r, [("high_power", "mean_power"), ("temporal_correction", "disagreement_fraction"), ("transition", "transitions")], "video_id")


@query("t6_snapshots", with_frames(", a AS (SELECT *, greatest(p_low, p_nominal, p_high) AS conf, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS place, count(*) OVER (PARTITION BY video_id) AS n FROM frames WHERE active = 1), m AS (SELECT video_id, min(frame_index) FILTER (place = n // 2) AS middle FROM a GROUP BY 1), b AS (SELECT video_id, label, frame_index, row_number() OVER (PARTITION BY video_id, label ORDER BY conf DESC, frame_index) AS k FROM a) SELECT m.video_id, coalesce(max(frame_index) FILTER (label = 0), any_value(middle)) AS low, coalesce(max(frame_index) FILTER (label = 1), any_value(middle)) AS nominal, coalesce(max(frame_index) FILTER (label = 2), any_value(middle)) AS high FROM m LEFT JOIN b ON b.video_id = m.video_id AND k = 1 GROUP BY 1"))
def snapshots(spark, sf):
    from ..operators.reports import snapshot_frames

    return snapshot_frames(D.active(frames(spark, sf), "active"), ["p_low", "p_nominal", "p_high"])


@query("v1_pivot", "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1")
def pivot(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return _rounded(p, ("l_returnflag",))


@query("v3_unpivot", "SELECT l_returnflag, unnest(['quantity', 'discount']) AS metric, unnest([round(avg(l_quantity), 6), round(avg(l_discount), 6)]) AS value FROM lineitem GROUP BY 1")
def unpivot(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return _rounded(a.unpivot(["l_returnflag"], ["quantity", "discount"], "metric", "value"), ("l_returnflag", "metric"))


@query("p15_v5_min_max", "WITH a AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, round((m - (SELECT min(m) FROM a)) / greatest((SELECT max(m) FROM a) - (SELECT min(m) FROM a), 1e-12), 6) AS share FROM a")
def min_max(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("m"))
    k = a.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return a.crossJoin(F.broadcast(k)).select("l_returnflag", "l_linestatus", R(S.min_max(F.col("m"), F.col("lo"), F.col("hi"))).alias("share"))


@query("v8_hexagonal_density", with_frames(""", b AS (SELECT min(p_high) AS x0, max(p_high) AS x1, min(power) AS y0, max(power) AS y1 FROM frames WHERE active = 1),
u AS (SELECT (p_high - x0) / greatest(x1 - x0, 1e-12) * 65 AS u, (power - y0) / greatest(y1 - y0, 1e-12) * 37 AS v FROM frames, b WHERE active = 1),
h AS (SELECT CASE WHEN pow(u - round(u), 2) + 3 * pow(v - round(v), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) THEN [round(u), round(v)] ELSE [floor(u) + 0.5, floor(v) + 0.5] END AS h FROM u)
SELECT h[1] AS hex_x, h[2] AS hex_y, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM h GROUP BY 1, 2"""))
def hexagonal_density(spark, sf):
    from ..operators.reports import hexagons

    return _rounded(hexagons(D.active(frames(spark, sf), "active"), "p_high", "power", 65), ("hex_x", "hex_y", "n"))


@query("v9_thresholds_of_methods", with_frames(", m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) FILTER ({x}) AS alarms FROM frames WHERE active = 1" for m, x in METHODS.items()) + ") SELECT method, try_cast(nullif(regexp_extract(method, '([0-9.]+)$', 1), '') AS DOUBLE) AS threshold, alarms FROM m"))
def thresholds_of_methods(spark, sf):
    """Methods of the alarm table that were tried over all frames, with the threshold in their name and their alarms."""
    m = alarm_methods(spark, sf).filter("definition = 'top'")
    return m.select("method", S.method_threshold(F.col("method")).alias("threshold"), (F.col("tp") + F.col("fp")).alias("alarms"))


CASE = "a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS place FROM frames WHERE active = 1), cw AS (SELECT video_id, place AS start, sum(power) OVER w AS m, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), cr AS (SELECT video_id, start FROM cw WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY m DESC, start) = 1), inside AS (SELECT a.*, cr.start FROM a JOIN cr ON a.video_id = cr.video_id AND place BETWEEN cr.start AND cr.start + 19)"


def _case_frames(spark, sf):
    """The frames of each video's case: its 20 active frames in a row of the most power."""
    a = D.active(frames(spark, sf), "active")
    best = W.best_window(W.full_windows(a, F.col("power"), 20, False), 20, True).select("video_id", "start", "end")
    placed = a.withColumn("at", F.row_number().over(W.by_video()) - 1)
    return placed.join(best, "video_id").filter(F.col("at").between(F.col("start"), F.col("end")))


@query("v12_timeline", with_frames("SELECT video_id, round(avg(power), 6) AS mean_power, max(power) AS max_power, round(avg(p_high), 6) AS mean_p_high, round(avg(CAST((power >= 75) <> (label = 2) AS INTEGER)), 6) AS corrected_fraction FROM frames WHERE active = 1 AND frame_index < 40 GROUP BY 1"))
def timeline(spark, sf):
    f = D.active(frames(spark, sf), "active").filter("frame_index < 40")
    return _timeline(f)


@query("v12_case_timeline", with_frames(f", {CASE} SELECT video_id, round(avg(power), 6) AS mean_power, max(power) AS max_power, round(avg(p_high), 6) AS mean_p_high, round(avg(CAST((power >= 75) <> (label = 2) AS INTEGER)), 6) AS corrected_fraction FROM inside GROUP BY 1"))
def case_timeline(spark, sf):
    """The timeline over each video's case window."""
    return _timeline(_case_frames(spark, sf))


@query("v15_cases_with_snapshots", with_frames(f""", {CASE}, conf AS (SELECT *, greatest(p_low, p_nominal, p_high) AS c FROM inside),
picked AS (SELECT video_id, {", ".join(f"arg_min(frame_index, (-c, frame_index)) FILTER (label = {k}) AS s{k}" for k in range(3))}, max(frame_index) FILTER (place = start + 10) AS middle FROM conf GROUP BY 1)
SELECT video_id, round(min(frame_index) / 20.0, 6) AS start_ms, round(max(frame_index) / 20.0, 6) AS end_ms, round(avg(CAST((power >= 75) <> (label = 2) AS INTEGER)), 6) AS disagreement_fraction,
any_value(coalesce(s0, middle)) AS low, any_value(coalesce(s1, middle)) AS nominal, any_value(coalesce(s2, middle)) AS high FROM conf JOIN picked USING (video_id) GROUP BY 1"""))
def cases_with_snapshots(spark, sf):
    """Each case's window, how often state and measured power disagree in it, and the frame that shows each regime."""
    f = stored(_case_frames(spark, sf), "cases")
    lo, hi = F.min("frame_index") / 20.0, F.max("frame_index") / 20.0
    own = f.groupBy("video_id").agg(R(lo).alias("start_ms"), R(hi).alias("end_ms"), R(F.avg(((F.col("power") >= 75) != (F.col("label") == 2)).cast("double"))).alias("disagreement_fraction"))
    return own.join(RP.snapshot_frames(f, ["p_low", "p_nominal", "p_high"]), "video_id")


def _timeline(f):
    return f.groupBy("video_id").agg(R(F.avg("power")).alias("mean_power"), F.max("power").alias("max_power"), R(F.avg("p_high")).alias("mean_p_high"), R(F.avg(((F.col("power") >= 75) != (F.col("label") == 2)).cast("double"))).alias("corrected_fraction"))


@query("v13_box_groups", with_frames("SELECT label, round(quantile_cont(power, 0.25), 6) AS q25, round(quantile_cont(power, 0.5), 6) AS q50, round(quantile_cont(power, 0.75), 6) AS q75 FROM frames GROUP BY 1"))
def box_groups(spark, sf):
    q = ST.quantiles_by(frames(spark, sf), ["label"], "power", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return _rounded(q, ("label",))


@query("t8_ranked_groups", with_frames("SELECT video_id, round(avg(intensity), 6) AS mean FROM frames GROUP BY 1 ORDER BY 2 DESC, 1"))
def ranked_groups(spark, sf):
    return frames(spark, sf).groupBy("video_id").agg(R(F.avg("intensity")).alias("mean")).orderBy(F.desc("mean"), "video_id")


@query("t9_seeded_sample")
def seeded_sample(spark, sf):
    return C.sampled(frames(spark, sf).select("video_id", "frame_index"), ["video_id", "frame_index"])


