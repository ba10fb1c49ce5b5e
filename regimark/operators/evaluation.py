"""Evaluation of a run: how its probabilities and states agree with the measured power, by frames and by parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import FRAME_RATE, divided, method_threshold
from ..sources.store import stored
from . import events as E
from . import stats as ST

#: Frames that a part needs to count.
PART_FRAMES = 20
#: What is correlated with power, and the labels among it, with their names in measures.
SCORES = {"p_high": "p_high", "label": "raw_label", "temporal_label": "temporal_label"}
LABELS = {"label": "raw", "temporal_label": "temporal"}
# Thresholds of the score that alarms are tried at.
ALARM_THRESHOLDS = (0.30, 0.50, 0.70, 0.90)
BEST = "probability_best_f1"


def part_table(frames: DataFrame) -> DataFrame:
    """A row a part of PART_FRAMES frames or more: correlations with power, mean power by temporal state, monotone.

    frames: video_id, frame_index, power, p_high, label, temporal_label, all numbers.
    """
    found = _parts(frames.withColumn("__run", F.lit(0)))
    return found.filter(F.col("frame_count") >= PART_FRAMES).drop("__run", "linked", *[f"{n}_switches" for n in LABELS.values()])


def _parts(frames: DataFrame, more: tuple[Column, ...] = ()) -> DataFrame:
    """The same of all parts of each __run, with frames that go on with the one before them, changes of labels at these,
    and more aggregates. All is counted in one shuffle of the frames by their part.
    """
    keys = ["video_id", "__run"]
    ranked, correlations = ST.ranks_within(frames, {f"{n}_power_spearman": c for c, n in SCORES.items()}, "power", keys)
    w = Window.partitionBy(*keys).orderBy("frame_index")
    gone_on = F.lag(F.lit(1)).over(w).isNotNull() & F.coalesce(F.col("frame_index") - F.lag("frame_index").over(w) <= 1, F.lit(True))
    ranked = ranked.withColumns({"__linked": gone_on} | {f"__{n}": F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False)) for c, n in LABELS.items()})
    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("frame_count"), *[F.avg(F.when(F.col("temporal_label") == k, F.col("power"))).alias(f"{name}_power_mean") for k, name in enumerate(("low", "nominal", "high"))],
        *[c.alias(n) for n, c in correlations.items()], F.count_if("__linked").alias("linked"), *[F.count_if(F.col("__linked") & F.col(f"__{n}")).alias(f"{n}_switches") for n in LABELS.values()], *more,
    )
    rises = (F.col("low_power_mean") < F.col("nominal_power_mean")) & (F.col("nominal_power_mean") < F.col("high_power_mean"))
    return out.withColumn("monotonic_power", rises)


def evaluate_run(frames: DataFrame, intervals: bool = True) -> DataFrame:
    """One row of a run's measures over frames as part_table takes them.

    Frame correlations are over all frames, part means over parts with the measure; a part counts for monotony if
    all three states occur in it. Switches are within segments. Intervals are bootstrap ones over parts.
    """
    one = frames.sparkSession.range(1).select(F.lit(0).alias("__run"))  # no frames are a row too
    found = one.join(_evaluated(frames.withColumn("__run", F.lit(0)), intervals), "__run", "left").drop("__run")
    return found.fillna(0, ["active_frames", "monotonic_parts", "eligible_monotonic_parts"])


def evaluate_runs(frames: DataFrame, by: list[str], intervals: bool = True) -> DataFrame:
    """evaluate_run of every run in frames, told by the columns `by`, in passes that all runs share.

    Runs get numbers on the driver; there are as many as models and seeds that were fitted.
    """
    found = frames.select(*by).distinct().orderBy(*by).collect()
    if not found:
        raise ValueError("there is no run")
    runs = frames.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(found)], StructType([StructField("__run", IntegerType()), *[StructField(c, frames.schema[c].dataType) for c in by]]))
    numbered = frames.join(F.broadcast(ST.told(runs, by)), ST.same_keys(by)).drop(*by, *[f"__k{i}" for i in range(len(by))])
    out = _evaluated(numbered, intervals)
    return runs.join(out, "__run").orderBy("__run").select(*by, *[c for c in out.columns if c != "__run"])


def _evaluated(frames: DataFrame, intervals: bool) -> DataFrame:
    """A row a __run."""
    measures = {"part_mean_p_high_power_spearman": "p_high_power_spearman", "part_mean_temporal_power_spearman": "temporal_label_power_spearman", "part_mean_high_low_power_difference": "gap"}
    finite = F.when(F.abs(F.col("power").cast("double")) <= ST.MOST, F.col("power").cast("double"))
    cut = ST.quantiles_by(frames.withColumn("__power", finite), ["__run"], "__power", {"__cut": 0.9})
    scores = frames.select("__run", "power", F.posexplode(F.array(*[F.col(c).cast("double") for c in SCORES])).alias("__score", "__value"))
    rho = ST.spearman(scores, "__value", "power", ("__run", "__score"))
    rho = rho.groupBy("__run").agg(*[F.max(F.when(F.col("__score") == i, F.col("spearman"))).alias(f"{n}_power_spearman_frame") for i, n in enumerate(SCORES.values())])

    high = F.col("power") >= F.col("__cut")
    tops = {f"{s}_{n}": F.count_if(high & k) for c, n in LABELS.items() for s, k in (("__top", F.col(c).isNotNull()), ("__hit", F.col(c) == 2))}
    parts = _parts(frames.join(F.broadcast(cut), "__run"), tuple(c.alias(n) for n, c in tops.items()))
    parts = stored(parts.withColumn("gap", F.col("high_power_mean") - F.col("low_power_mean")), "parts")
    large = lambda c: F.when(F.col("frame_count") >= PART_FRAMES, F.col(c))
    monotone = F.count_if(large("monotonic_power")), F.count(large("monotonic_power"))
    out = parts.groupBy("__run").agg(
        F.sum("frame_count").alias("active_frames"), *[F.try_divide(F.sum(f"__hit_{n}"), F.sum(f"__top_{n}")).alias(f"top_10pct_power_high_regime_recall_{n}") for n in LABELS.values()],
        *[F.avg(large(c)).alias(n) for n, c in measures.items()], monotone[0].alias("monotonic_parts"), monotone[1].alias("eligible_monotonic_parts"), F.try_divide(*monotone).alias("monotonic_part_fraction"),
        *[(1000.0 * F.sum(f"{n}_switches") / F.greatest(F.sum("linked"), F.lit(1))).alias(f"{n}_switches_per_1000") for n in LABELS.values()],
    ).join(F.broadcast(rho), "__run", "left")
    bounds = []
    if intervals:
        each = F.posexplode(F.array(*[F.col(c) for c in measures.values()])).alias("__measure", "__value")
        series = parts.filter(F.col("frame_count") >= PART_FRAMES).select("__run", F.lit(0).alias("__all"), each).filter("__value IS NOT NULL")
        ends = ST.bootstrap_interval(series, "__all", "__value", by=("__run", "__measure"))
        bounds = [(f"{n}_ci_{c}", F.max(F.when(F.col("__measure") == i, F.col(c)))) for i, n in enumerate(measures) for c in ("low", "high")]
        out = out.join(F.broadcast(ends.groupBy("__run").agg(*[c.alias(n) for n, c in bounds])), "__run", "left")
    raw, temporal = (F.col(f"{n}_switches_per_1000") for n in LABELS.values())
    return out.select(
        "__run", "active_frames", *[f"top_10pct_power_high_regime_recall_{n}" for n in LABELS.values()], *[f"{n}_power_spearman_frame" for n in SCORES.values()], *measures,
        "monotonic_parts", "eligible_monotonic_parts", "monotonic_part_fraction", *[n for n, _ in bounds], raw, temporal, F.try_divide(raw - temporal, raw).alias("switch_reduction_fraction"),
    )


def runs_summary(runs: DataFrame, by: list[str], seed: str = "seed") -> DataFrame:
    """(by, runs, mean and deviation of each measure) over seeds: population deviations of finite measures."""
    return ST.summary_by(runs, by, [c for c in runs.columns if c not in (*by, seed)])


def alarm_evaluation(frames: DataFrame, definitions: dict[str, Column], score: str = "p_high") -> DataFrame:
    """A row for each definition of an alarm and each of seven methods to raise it.

    Methods: the score at fixed thresholds and at the one of the best F1, the highest state by label and by
    temporal_label. Columns: threshold (NULL for states), share of true frames, AUROC and AUPRC of the score (NULL for
    one class), the best threshold, counts and rates of frames, and events: recall, false alarms, delays. Frames are
    counted once by all their flags, and only these few counts are told apart by method.
    frames: video_id, frame_index, label, temporal_label, the score, and what definitions read.
    """
    truths = {d: f"__true_{k}" for k, d in enumerate(definitions)}
    held = stored(frames.select("video_id", "frame_index", score, "label", "temporal_label", *[F.coalesce(c, F.lit(False)).alias(truths[d]) for d, c in definitions.items()]), "alarms")
    parts = held.select("video_id").distinct().count()
    best = {d: E.best_f1(E.threshold_metrics(held, t, score)).first() for d, t in truths.items()}
    best = {d: r["threshold"] if r else 0.5 for d, r in best.items()}

    fixed = {f"probability_{t:.2f}": t for t in ALARM_THRESHOLDS}
    flags = {m: F.col(score) >= t for m, t in fixed.items()} | {f"{BEST}:{d}": F.col(score) >= t for d, t in best.items()}
    flags |= {"raw_high_state": F.col("label") == 2, "temporal_high_state": F.col("temporal_label") == 2}
    column = {m: f"__flag_{k}" for k, m in enumerate(flags)}
    marked = held.select("video_id", "frame_index", *truths.values(), *[F.coalesce(c, F.lit(False)).alias(column[m]) for m, c in flags.items()])
    methods = [(d, m, f"{BEST}:{d}" if m == BEST else m, best[d] if m == BEST else fixed.get(m)) for d in definitions for m in (*fixed, BEST, "raw_high_state", "temporal_high_state")]

    cells = marked.groupBy(*truths.values(), *column.values()).agg(F.count("*").alias("n"))  # thresholds nest: few
    told = [F.struct(F.lit(d).alias("definition"), F.lit(m).alias("method"), F.lit(t).cast("double").alias("threshold"), F.col(truths[d]).alias("t"), F.col(column[f]).alias("p")) for d, m, f, t in methods]
    told = cells.select("n", F.inline(F.array(*told)))
    by = ["definition", "method"]
    counts = E.confusion(told, F.col("t"), F.col("p"), ("definition", "method", "threshold"), F.col("n"))

    names = {t: f"true:{d}" for d, t in truths.items()} | {c: m for m, c in column.items()}
    hits = marked.select("video_id", "frame_index", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in names.items()]))).alias("series"))
    runs = stored(E.events(hits, F.lit(True), keys=("series", "video_id")), "alarm-runs")
    spark = frames.sparkSession
    of = lambda pairs: runs.join(F.broadcast(spark.createDataFrame(pairs, "series string, definition string, method string")), "series")
    true, predicted = of([(f"true:{d}", d, m) for d, m, _, _ in methods]), of([(f, d, m) for d, m, f, _ in methods])
    found = E.event_metrics_by(true, predicted, by, parts, 1000.0 / FRAME_RATE)

    scores = []
    for d, t in truths.items():
        groups = ST.score_groups(held, t, score)
        both = ST.auroc(groups).crossJoin(ST.average_precision(groups)).select(F.lit(d).alias("definition"), "auroc", F.when(F.col("auroc").isNotNull(), F.col("auprc")).alias("auprc"), F.lit(best[d]).alias("best_f1_threshold"))
        scores.append(both)
    out = counts.join(found, by, "left").join(F.broadcast(reduce(DataFrame.unionByName, scores)), "definition")  # a row a definition
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    zero = ("true_events", "predicted_events", "detected_true_events", "event_recall", "false_alarm_events", "false_alarm_events_per_part")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"positive_power_frame_fraction": divided(F.col("tp") + F.col("fn"), total), "positive_fraction": divided(F.col("tp") + F.col("fp"), total)})
    return out.select(
        *by, "threshold", "positive_power_frame_fraction", "auroc", "auprc", "best_f1_threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "specificity", "false_positive_rate",
        "positive_fraction", *zero, "mean_detection_delay_frames", "mean_detection_delay_ms",
    )


def precision_recall_points(metrics: DataFrame) -> DataFrame:
    """(definition, threshold, precision, recall, f1, false_positive_rate) of methods with a threshold in their name, in order."""
    points = metrics.withColumn("threshold", method_threshold(F.col("method"))).filter("threshold IS NOT NULL")
    return points.select("definition", "threshold", "precision", "recall", "f1", "false_positive_rate").orderBy("definition", "threshold")


def bars(summary: DataFrame, axis: str, fixed: dict[str, str], metrics: list[str]) -> DataFrame:
    """(axis, label, metric, value): a chart's bars along one column of a summary, the others held at given values."""
    for column, value in fixed.items():
        summary = summary.filter(F.col(column) == value)
    return summary.unpivot([axis], metrics, "metric", "value").select(F.lit(axis).alias("axis"), F.col(axis).alias("label"), "metric", "value")
