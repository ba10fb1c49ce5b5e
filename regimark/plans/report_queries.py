"""Queries of run summaries, lookups and tables behind plots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as D
from ..operators import stats as ST
from ..operators import windows as W
from ..sources import store
from .registry import query
from .stat_queries import PARTS, _parts, _rounded
from .views import frames, table, with_frames

R = S.rounded


@query("j3_number_lookup", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) GROUP BY 1")
def number_lookup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("long").alias("number"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, F.col("number") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("j4_unique_matches", with_frames(", o AS (SELECT o_custkey AS video_id, CAST(o_orderkey % 20 AS BIGINT) AS frame_index, min(o_totalprice) AS price FROM orders GROUP BY 1, 2 HAVING count(*) = 1) SELECT video_id, frame_index, round(price, 2) AS price FROM frames JOIN o USING (video_id, frame_index)"))
def unique_matches(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") % 20).alias("frame_index"), F.col("o_totalprice").alias("price"))
    return D.unique_matches(frames(spark, sf).select("video_id", "frame_index"), o).select("video_id", "frame_index", R(F.col("price"), 2).alias("price"))


@query("a7_discrete_quantiles", with_frames("SELECT video_id, quantile_disc(power, 0.95) AS p95, quantile_disc(power, 0.5) AS p50 FROM frames GROUP BY 1"))
def discrete_quantiles(spark, sf):
    n = frames(spark, sf).groupBy("video_id", "power").agg(F.count("*").alias("n"))
    w = Window.partitionBy("video_id").orderBy("power")
    share = F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("video_id"))
    c = n.withColumn("share", share)
    return c.groupBy("video_id").agg(ST.discrete_quantile(F.col("share"), F.col("power"), 0.95).alias("p95"), ST.discrete_quantile(F.col("share"), F.col("power"), 0.5).alias("p50"))


@query("w14_cumulative_counts", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS upto FROM d")
def cumulative_counts(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return ST.cumulative(d, "day", {"n": "upto"}).select(F.col("day").cast("string").alias("day"), "upto")


def _runs(spark, sf):
    """A metric row for each third of the videos and each label, as runs of seeds would give."""
    f = D.active(frames(spark, sf), "active")
    return f.groupBy((F.col("video_id") % 3).alias("seed"), F.col("label").alias("regime")).agg(F.avg("power").alias("power"), F.avg("p_high").alias("score"))


RUN = ", r AS (SELECT video_id % 3 AS seed, label AS regime, avg(power) AS power, avg(p_high) AS score FROM frames WHERE active = 1 GROUP BY 1, 2)"
MEANS = "count(*) AS runs, round(avg(power), 6) AS power_mean, round(stddev_pop(power), 6) AS power_std, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std"


@query("a10_run_summary", with_frames(RUN + f" SELECT 'all' AS model, {MEANS} FROM r"))
def run_summary(spark, sf):
    return _rounded(ST.summary_by(_runs(spark, sf).withColumn("model", F.lit("all")), ["model"], ["power", "score"]), ("model", "runs"))


@query("a11_regime_summary", with_frames(RUN + f" SELECT regime, {MEANS} FROM r GROUP BY 1"))
def regime_summary(spark, sf):
    return _rounded(ST.summary_by(_runs(spark, sf), ["regime"], ["power", "score"]), ("regime", "runs"))


def _seed_labels(spark, sf):
    f = frames(spark, sf).select("video_id", "frame_index", (F.col("video_id") % 2).alias("fold"), *[F.when(F.col("power") >= t, 1).otherwise(0).alias(f"s{k}") for k, t in enumerate((30, 50, 70))])
    return f.unpivot(["video_id", "frame_index", "fold"], ["s0", "s1", "s2"], "seed", "state")


@query("a13_seed_stability", with_frames(""", s AS (SELECT video_id, frame_index, video_id % 2 AS fold, unnest(['s0', 's1', 's2']) AS seed, unnest([CAST(power >= 30 AS INTEGER), CAST(power >= 50 AS INTEGER), CAST(power >= 70 AS INTEGER)]) AS state FROM frames),
c AS (SELECT a.fold, a.seed AS x, b.seed AS y, a.state AS i, b.state AS j, count(*) AS n FROM s a JOIN s b USING (video_id, frame_index) WHERE a.seed < b.seed GROUP BY ALL),
t AS (SELECT fold, x, y, sum(n) AS t, sum(n * (n - 1) / 2.0) AS sab FROM c GROUP BY 1, 2, 3), p AS (SELECT fold, x, y, sum(m * (m - 1) / 2.0) AS sa FROM (SELECT fold, x, y, i, sum(n) AS m FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), q AS (SELECT fold, x, y, sum(m * (m - 1) / 2.0) AS sb FROM (SELECT fold, x, y, j, sum(n) AS m FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT fold, count(*) AS pairs, round(avg((sab - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0))), 6) AS mean_ari FROM t JOIN p USING (fold, x, y) JOIN q USING (fold, x, y) GROUP BY 1"""))
def seed_stability(spark, sf):
    s = _seed_labels(spark, sf)
    a, b = s.toDF("video_id", "frame_index", "fold", "x", "i"), s.toDF("video_id_b", "frame_index_b", "fold_b", "y", "j")
    pairs = a.join(b, (F.col("video_id") == F.col("video_id_b")) & (F.col("frame_index") == F.col("frame_index_b")) & (F.col("x") < F.col("y")))
    ari = ST.adjusted_rand(pairs.select("fold", "x", "y", "i", "j"), "i", "j", ["fold", "x", "y"])
    return ari.groupBy("fold").agg(F.count("*").alias("pairs"), R(F.avg("ari")).alias("mean_ari"))


@query("u1_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'low' AS kind FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 'high' FROM lineitem WHERE l_quantity > 40) GROUP BY 1")
def union_all(spark, sf):
    q = table(spark, sf, "lineitem").select("l_quantity")
    return q.filter("l_quantity < 10").select(F.lit("low").alias("kind")).unionByName(q.filter("l_quantity > 40").select(F.lit("high").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("u3_power_of_chosen", with_frames("SELECT count(*) AS n, round(quantile_cont(power, 0.02), 6) AS low, round(quantile_cont(power, 0.98), 6) AS high FROM frames WHERE video_id IN (3, 5, 7)"))
def power_of_chosen(spark, sf):
    f = frames(spark, sf).filter(F.col("video_id").isin(3, 5, 7))
    q = ST.quantiles(f, [("power", 0.02), ("power", 0.98)])
    return f.agg(F.count("*").alias("n"), *[R(F.lit(v).cast("double")).alias(n) for v, n in zip(q, ("low", "high"), strict=True)])


@query("v4_scorecard", with_frames(PARTS + ", k AS (SELECT 100.0 * avg(CAST(coalesce(low < nominal AND nominal < high, false) AS INTEGER)) AS m, 100.0 * avg(CAST(high > low AS INTEGER)) AS g FROM v) SELECT unnest(['monotone', 'positive_gap']) AS metric, unnest([round(m, 6), round(g, 6)]) AS percent FROM k"))
def scorecard(spark, sf):
    p = _parts(spark, sf).agg((100 * F.avg(F.col("monotone").cast("double"))).alias("monotone"), (100 * F.avg((F.col("high") > F.col("low")).cast("double"))).alias("positive_gap"))
    return p.unpivot([], ["monotone", "positive_gap"], "metric", "percent").select("metric", R(F.col("percent")).alias("percent"))


@query("v6_ordered_matrix", "SELECT l_linestatus, l_returnflag, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS place, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2, 3 ORDER BY 1, 3")
def ordered_matrix(spark, sf):
    place = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    a = table(spark, sf, "lineitem").groupBy("l_linestatus", "l_returnflag", place.alias("place")).agg(R(F.avg("l_discount")).alias("value"))
    return a.orderBy("l_linestatus", "place")


@query("v7_sorted_gaps", with_frames(PARTS + " SELECT video_id, round(high - low, 6) AS gap FROM v WHERE high IS NOT NULL AND low IS NOT NULL ORDER BY 2, 1"))
def sorted_gaps(spark, sf):
    return _parts(spark, sf).filter("high IS NOT NULL AND low IS NOT NULL").select("video_id", R(F.col("high") - F.col("low")).alias("gap")).orderBy("gap", "video_id")


@query("v15_case_windows", with_frames(", a AS (SELECT video_id, frame_index, power, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS start FROM frames WHERE active = 1), k AS (SELECT video_id, start, frame_index, sum(power) OVER w AS m, count(*) OVER w AS n, max(frame_index) OVER w AS last FROM a WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY m DESC, start) AS p FROM k WHERE n = 20) SELECT video_id, round(frame_index / 20.0, 6) AS start_ms, round(last / 20.0, 6) AS end_ms, round((last - frame_index) / 20.0, 6) AS duration_ms FROM r WHERE p = 1"))
def case_windows(spark, sf):
    a = D.active(frames(spark, sf), "active")
    best = W.best_window(W.full_windows(a, F.col("power"), 20, False), 20, True)
    placed = a.select("video_id", "frame_index", (F.row_number().over(W.by_video()) - 1).alias("at"))
    inside = best.join(placed, "video_id").filter(F.col("at").between(F.col("start"), F.col("end")))
    ms = lambda c: R(c / 20.0)
    lo, hi = F.min("frame_index"), F.max("frame_index")
    return inside.groupBy("video_id").agg(ms(lo).alias("start_ms"), ms(hi).alias("end_ms"), ms(hi - lo).alias("duration_ms"))


@query("k8_resume", "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def resume(spark, sf):
    todo = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return store.missing_keys(todo, done, ["key"])
