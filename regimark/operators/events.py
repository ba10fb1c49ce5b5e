"""Events: maximal runs of flagged frames, their overlaps, and alarm metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divided

MIN_EVENT_FRAMES = 2


def events(frames: DataFrame, flag: Column, min_frames: int = MIN_EVENT_FRAMES, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(keys, start, end): maximal runs of flagged frames in a row, both ends included, of min_frames or more."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    island = F.col("frame_index") - F.row_number().over(w)
    runs = frames.filter(flag).withColumn("island", island).groupBy(*keys, "island").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end"))
    return runs.filter(F.col("end") - F.col("start") + 1 >= min_frames).drop("island")


def _bucketed(intervals: DataFrame, width: int) -> DataFrame:
    """A row for each stretch of `width` frames that an interval touches."""
    stretch = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    return intervals.select("video_id", "start", "end", F.explode(stretch).alias("stretch"))


def matches(true: DataFrame, predicted: DataFrame, width: int = 1024) -> DataFrame:
    """All overlapping pairs: (video_id, true_start, true_end, predicted_start, predicted_end).

    Intervals meet only within a stretch of width frames of their video, and a pair counts in the stretch where
    the later of the two starts, so a long video is no single group and no pair is given twice.
    """
    t, p = _bucketed(true, width).alias("t"), _bucketed(predicted, width).alias("p")
    same = (F.col("t.video_id") == F.col("p.video_id")) & (F.col("t.stretch") == F.col("p.stretch"))
    later = F.greatest("t.start", "p.start")
    pair = same & (F.col("t.start") <= F.col("p.end")) & (F.col("p.start") <= F.col("t.end")) & (F.floor(later / width) == F.col("t.stretch"))
    return t.join(p, pair).select(F.col("t.video_id"), F.col("t.start").alias("true_start"), F.col("t.end").alias("true_end"), F.col("p.start").alias("predicted_start"), F.col("p.end").alias("predicted_end"))


def _touched(of: DataFrame, by: DataFrame, how: str) -> DataFrame:
    """Rows of `of` that overlap (left_semi) or don't overlap (left_anti) some interval of `by`."""
    found = matches(of, by).select(F.col("video_id").alias("__v"), F.col("true_start").alias("__s"), F.col("true_end").alias("__e"))
    return of.join(found, (F.col("video_id") == F.col("__v")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), how)


def detected(true: DataFrame, predicted: DataFrame) -> DataFrame:
    return _touched(true, predicted, "left_semi")


def false_alarms(true: DataFrame, predicted: DataFrame) -> DataFrame:
    return _touched(predicted, true, "left_anti")


def event_metrics(true: DataFrame, predicted: DataFrame, parts: int) -> DataFrame:
    """One row: true, predicted, detected and false alarm events, recall, false alarms a part, mean delay of the
    first overlapping prediction after the true start."""
    delays = matches(true, predicted).groupBy("video_id", "true_start").agg(F.greatest(F.min("predicted_start") - F.col("true_start"), F.lit(0)).alias("delay"))
    one = (
        true.agg(F.count("*").alias("true_events"))
        .crossJoin(predicted.agg(F.count("*").alias("predicted_events")))
        .crossJoin(delays.agg(F.count("*").alias("detected_events"), F.avg("delay").alias("mean_delay_frames")))
        .crossJoin(false_alarms(true, predicted).agg(F.count("*").alias("false_alarm_events")))
    )
    return one.withColumns({"event_recall": divided(F.col("detected_events"), F.col("true_events")), "false_alarms_per_part": F.col("false_alarm_events") / F.lit(float(parts))})


def event_metrics_by(true: DataFrame, predicted: DataFrame, by: list[str], parts: int, frame_ms: float) -> DataFrame:
    """event_metrics of each group, with the delay in milliseconds too; groups of either side are there. Without a
    detected event the delay is NULL."""
    key = F.struct(*by, "video_id").alias("video_id")
    t, p = (x.select(key, "start", "end") for x in (true, predicted))
    pairs = matches(t, p)
    of = [F.col(f"video_id.{c}").alias(c) for c in by]
    delays = pairs.groupBy("video_id", "true_start").agg(F.greatest(F.min("predicted_start") - F.col("true_start"), F.lit(0)).alias("delay"))
    met = pairs.select("video_id", "predicted_start").distinct()
    tables = [
        true.groupBy(*by).agg(F.count("*").alias("true_events")), predicted.groupBy(*by).agg(F.count("*").alias("predicted_events")),
        delays.groupBy(*of).agg(F.count("*").alias("detected_true_events"), F.avg("delay").alias("mean_detection_delay_frames")), met.groupBy(*of).agg(F.count("*").alias("met")),
    ]
    out = reduce(lambda a, b: a.join(b, by, "full"), tables)
    count = {c: F.coalesce(c, F.lit(0)) for c in ("true_events", "predicted_events", "detected_true_events")}
    alarms = count["predicted_events"] - F.coalesce("met", F.lit(0))
    return out.select(
        *by, *[v.alias(c) for c, v in count.items()], divided(count["detected_true_events"], count["true_events"]).alias("event_recall"), alarms.alias("false_alarm_events"),
        (alarms / F.lit(float(max(parts, 1)))).alias("false_alarm_events_per_part"), "mean_detection_delay_frames", (F.col("mean_detection_delay_frames") * frame_ms).alias("mean_detection_delay_ms"),
    )


def confusion(rows: DataFrame, truth: Column, prediction: Column, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Counts and rates of a binary prediction; a rate with nothing below is 0. weight: frames that a row stands for."""
    n = F.lit(1).cast("long") if weight is None else weight
    count = lambda t, p: F.sum(F.when((truth == t) & (prediction == p), n).otherwise(0).cast("long")).alias
    c = rows.groupBy(*by).agg(count(True, True)("tp"), count(False, True)("fp"), count(True, False)("fn"), count(False, False)("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "precision": divided(tp, tp + fp),
            "recall": divided(tp, tp + fn),
            "f1": divided(2 * tp, 2 * tp + fp + fn),
            "specificity": divided(tn, tn + fp),
            "false_positive_rate": divided(fp, fp + tn),
        }
    )


def threshold_metrics(rows: DataFrame, truth: str, score: str, low: float = 0.05, high: float = 0.95, steps: int = 91) -> DataFrame:
    """confusion at each of `steps` thresholds. Rows are counted once by the number of thresholds they reach, so
    no row is repeated for each threshold."""
    spark = rows.sparkSession
    grid = spark.range(steps).select(F.col("id").cast("int").alias("step"), F.round(F.lit(low) + F.col("id") * ((high - low) / (steps - 1)), 6).alias("threshold"))
    reached = F.least(F.greatest(F.floor((F.col(score) - low) * ((steps - 1) / (high - low)) + 1e-9) + 1, F.lit(0)), F.lit(steps))
    counts = rows.groupBy(reached.cast("int").alias("reached")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))
    met = F.col("reached") > F.col("step")
    wide = grid.join(F.broadcast(counts), F.lit(True), "cross").groupBy("step", "threshold")
    table = wide.agg(
        F.sum(F.when(met, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(met, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(~met, F.col("pos")).otherwise(0)).alias("fn"),
    )
    return table.withColumn("f1", divided(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).drop("step")


def best_f1(table: DataFrame) -> DataFrame:
    """The first threshold of the largest F1."""
    return table.orderBy(F.desc(F.round("f1", 12)), "threshold").limit(1)

