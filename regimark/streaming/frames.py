"""Streams of frames: carried features, alarm events and time windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLLING = 11


def stream_features(frames: DataFrame, value: str = "intensity") -> DataFrame:
    """(video_id, frame_index, delta, rolling_mean, rolling_std) of a stream whose frames arrive in order within a video.

    State per video: the last frames of a window. What it gives equals the batch windows.
    """
    import pandas as pd

    def run(key, batches: Iterator[pd.DataFrame], state):
        held = list(state.get[0]) if state.exists else []
        rows = []
        for index, x in pd.concat(list(batches)).sort_values("frame_index")[["frame_index", value]].itertuples(index=False):
            delta = x - held[-1] if held else 0.0
            held = [*held, x][-ROLLING:]
            mean = sum(held) / len(held)
            rows.append((key[0], index, delta, mean, (sum((h - mean) ** 2 for h in held) / len(held)) ** 0.5))
        state.update((held,))
        yield pd.DataFrame(rows, columns=["video_id", "frame_index", "delta", "rolling_mean", "rolling_std"])

    kind = frames.schema["video_id"].dataType.simpleString()
    return frames.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, frame_index long, delta double, rolling_mean double, rolling_std double", "held array<double>", "append", "NoTimeout")


def stream_temporal(frames: DataFrame) -> DataFrame:
    """(video_id, frame_index, changes and trailing statistics) of a stream of image features whose frames arrive in
    order within a video; what it gives equals windows.with_temporal.

    State per video: areas and mean intensities of a window, and total intensity and centroid of the last frame.
    """
    import numpy as np
    import pandas as pd

    inputs = ["threshold_area", "mean_intensity", "total_intensity", "centroid_x", "centroid_y"]
    names = ["delta_area", "delta_mean_intensity", "delta_total_intensity", "centroid_motion", "rolling_area_mean", "rolling_area_std", "rolling_intensity_mean", "rolling_intensity_std"]

    def run(key, batches: Iterator[pd.DataFrame], state):
        areas, means, last = map(list, state.get) if state.exists else ([], [], [])
        rows = []
        for index, area, mean, *point in pd.concat(list(batches)).sort_values("frame_index")[["frame_index", *inputs]].astype(float).itertuples(index=False):
            motion = float(np.hypot(point[1] - last[1], point[2] - last[2])) if last else 0.0
            changes = [area - areas[-1], mean - means[-1], point[0] - last[0], motion if np.isfinite(motion) else 0.0] if last else [0.0] * 4
            areas, means, last = [*areas, area][-ROLLING:], [*means, mean][-ROLLING:], point
            rows.append((key[0], int(index), *changes, np.mean(areas), np.std(areas), np.mean(means), np.std(means)))
        state.update((areas, means, last))
        yield pd.DataFrame(rows, columns=["video_id", "frame_index", *names])

    kind = frames.schema["video_id"].dataType.simpleString()
    kept = frames.select("video_id", "frame_index", *[F.col(c).cast("double").alias(c) for c in inputs])
    out = f"video_id {kind}, frame_index long, " + ", ".join(f"{n} double" for n in names)
    return kept.groupBy("video_id").applyInPandasWithState(run, out, "areas array<double>, means array<double>, last array<double>", "append", "NoTimeout")


def stream_events(frames: DataFrame, flag: str, min_frames: int = 2, quiet_ms: int | None = None) -> DataFrame:
    """(video_id, start, end) of runs of flagged frames, each given once it is closed by another frame.

    With quiet_ms the last run of a video that sent nothing for so long is given too, and its state ends.
    """
    import pandas as pd

    columns = ["video_id", "start", "end"]

    def run(key, batches: Iterator[pd.DataFrame], state):
        start, last = state.get if state.exists else (-1, -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], start, last)] if start >= 0 and last - start + 1 >= min_frames else [], columns=columns)
            return
        rows = []
        for index, hit in pd.concat(list(batches)).sort_values("frame_index")[["frame_index", flag]].itertuples(index=False):
            if start >= 0 and (not hit or index != last + 1):
                if last - start + 1 >= min_frames:
                    rows.append((key[0], start, last))
                start = -1
            if hit:
                start, last = (index if start < 0 else start), index
        state.update((int(start), int(last)))
        if quiet_ms:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(rows, columns=columns)

    kind = frames.schema["video_id"].dataType.simpleString()
    timeout = "ProcessingTimeTimeout" if quiet_ms else "NoTimeout"
    return frames.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, start long, end long", "start long, last long", "append", timeout)


def windowed_counts(events: DataFrame, time: str, key: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window of event time; rows later than the watermark are left out. Works on batches too."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
