"""Stateful operators on event time: frames in order, alarm events, labels with a fixed lag.

Rows of a key wait until the watermark has passed them, so that they are taken in order of time whatever batch they
came in; rows behind the watermark are late and left out, as everywhere in Spark. A key that has been quiet for
long enough gives what it holds, and nothing of it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.temporal import START, STATES, STEP, fixed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that videos are dealt to: calls to the state store cost far more than rows, so a group's videos share them.
GROUPS = 1024
#: Stands for a missing number of a frame; such a row has no place in an order and is left out.
NO_FRAME = -(1 << 63)


class InOrder(StatefulProcessor):
    """Base: subclasses take the frames of a video one by one. A key is a group of videos. State: the group's rows that
    wait, and for each of its videos what take() keeps between rows."""

    #: Type of a video's id.
    kind = "long"

    #: Columns of a row beside time and frame, and the schema of what is kept.
    values: list[tuple[str, str]] = []
    kept = ""
    out: list[str] = []

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        video = f"known boolean, video {self.kind}"
        self.waiting = handle.getListState("waiting", ", ".join([f"time long, frame long, {video}", *[f"{c} {t}" for c, t in self.values]]))
        self.state = handle.getListState("kept", f"{video}, time long, {self.kept}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = []
        for pdf in rows:
            self.waiting.appendList(list(pdf[["time", "frame", "known", "video", *[c for c, _ in self.values]]].itertuples(index=False, name=None)))
            times += [int(pdf["time"].min()), int(pdf["time"].max())]
        for time in {min(times), max(times)} if times else ():
            self.handle.registerTimer(time)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rest = [r for r in waiting if r[0] > now]
        ready = sorted((r for r in waiting if r[0] <= now and r[1] != NO_FRAME), key=lambda r: (r[0], r[1], *r[4:]))
        held = {tuple(r)[:2]: (r[2], tuple(r)[3:]) for r in self.state.get()} if self.state.exists() else {}
        given: list[tuple] = []

        def give(video: tuple, rows: list[tuple]) -> None:
            given.extend((video[1] if video[0] else None, *r) for r in rows)

        for time, frame, known, video, *values in ready:
            rows: list[tuple] = []
            held[known, video] = (time, self.take(held.get((known, video), (None, None))[1], frame, values, rows))
            give((known, video), rows)
        later = {r[2:4] for r in rest}
        for video in [v for v, (last, _) in held.items() if v not in later and last + self.quiet_ms <= now]:
            rows = []
            self.end(held.pop(video)[1], rows)
            give(video, rows)
        for state, found in ((self.waiting, rest), (self.state, [(*v, last, *kept) for v, (last, kept) in held.items()])):
            if found:
                state.put(found)
            elif state.exists():
                state.clear()
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest))
        elif held:
            self.handle.registerTimer(min(last for last, _ in held.values()) + self.quiet_ms)
        yield pd.DataFrame(given, columns=["video_id", *self.out])

    def take(self, kept: tuple | None, frame: int, values: list, rows: list[tuple]) -> tuple:
        """What is kept after a frame; rows to give go to `rows`."""
        raise NotImplementedError

    def end(self, kept: tuple, rows: list[tuple]) -> None:
        """Gives what is kept once nothing more comes."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class EventMachine(InOrder):
    """Runs of flagged frames; a run is open from `start` to `last`, or start is -1."""

    values = [("hit", "boolean")]
    kept = "start long, last long"
    out = ["start", "end"]

    def __init__(self, quiet_ms: int, min_frames: int):
        super().__init__(quiet_ms)
        self.min_frames = min_frames

    def take(self, kept, frame, values, rows):
        start, last = kept or (-1, -1)
        hit = bool(values[0])
        if start >= 0 and (not hit or frame > last + 1):
            self.end((start, last), rows)
            start = -1
        if hit:
            start, last = (frame if start < 0 else start), frame
        return start, last

    def end(self, kept, rows):
        if kept[0] >= 0 and kept[1] - kept[0] + 1 >= self.min_frames:
            rows.append(kept)


class LagDecoder(InOrder):
    """Viterbi sums of the last frame, and a ring of the last frames with their back pointers, without labels yet."""

    values = [("p0", "double"), ("p1", "double"), ("p2", "double")]
    kept = "segment long, sums array<long>, frames array<long>, back binary"
    out = ["frame_index", "segment", "temporal_label"]

    def __init__(self, quiet_ms: int, lag: int):
        super().__init__(quiet_ms)
        self.lag = lag

    def take(self, kept, frame, values, rows):
        emit = fixed(values)
        segment, sums, frames, back = kept or (-1, [], [], b"")
        if not len(frames) or frame > frames[-1] + 1:
            if len(frames):
                self.end(kept, rows)
            return segment + 1, (START + emit).tolist(), [frame], bytes(STATES)
        paths = np.asarray(sums, np.int64)[:, None] + STEP
        best = paths.max(axis=0) + emit
        frames = [*frames, frame]
        back = bytes(back) + paths.argmax(axis=0).astype(np.uint8).tobytes()
        if len(frames) > self.lag:  # the oldest frame's label by what is best now
            rows.append((frames[0], segment, self._labels(int(best.argmax()), back)[0]))
            frames, back = frames[1:], back[STATES:]
        return segment, (best - best.max()).tolist(), frames, back

    def end(self, kept, rows):
        segment, sums, frames, back = kept
        rows.extend((f, segment, label) for f, label in zip(frames, self._labels(int(np.argmax(sums)), bytes(back)), strict=True))

    @staticmethod
    def _labels(state: int, back: bytes) -> list[int]:
        labels = [state]
        for at in range(len(back) - STATES, 0, -STATES):
            state = back[at + state]
            labels.append(state)
        return labels[::-1]


def _run(frames: DataFrame, machine: InOrder, time: str, late: str, values: dict[str, Column | str], schema: str) -> DataFrame:
    spark: SparkSession = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only store with timers and lists
    machine.kind = frames.schema["video_id"].dataType.simpleString()
    columns = [F.expr(v).alias(c) if isinstance(v, str) else v.alias(c) for c, v in values.items()]
    marked = frames.withWatermark(time, late)
    nothing = F.lit("" if machine.kind == "string" else 0).cast(machine.kind)  # pandas would turn columns with NULL to floats
    rows = marked.select(  # the key video_id is the number of a group of ids; rows without an id are a group
        F.when(F.col("video_id").isNotNull(), F.pmod(F.xxhash64("video_id"), F.lit(GROUPS))).alias("video_id"), F.col("video_id").isNotNull().alias("known"), F.coalesce("video_id", nothing).alias("video"),
        time, F.unix_millis(time).alias("time"), F.coalesce(F.col("frame_index").cast("long"), F.lit(NO_FRAME)).alias("frame"), *columns,
    )
    return rows.groupBy("video_id").transformWithStateInPandas(machine, f"video_id {machine.kind}, {schema}", "append", "EventTime")


def event_stream(frames: DataFrame, flag: Column, time: str, late: str, min_frames: int = 2, quiet_ms: int = 60_000) -> DataFrame:
    """(video_id, start, end) of runs of flagged frames in a row, as events.events finds them in a table.

    Frames may come in any order within the watermark's delay. A run is given once a frame behind it has passed the
    watermark, or its video has been quiet for quiet_ms of event time; no state is left then. A NULL flag is no hit.
    Of repeated frames each one is taken.
    """
    return _run(frames, EventMachine(quiet_ms, min_frames), time, late, {"hit": F.coalesce(flag, F.lit(False))}, "start long, end long")


def label_stream(frames: DataFrame, time: str, late: str, lag: int, quiet_ms: int = 60_000, p: tuple[str, str, str] = ("p_low", "p_nominal", "p_high")) -> DataFrame:
    """(video_id, frame_index, segment, temporal_label): Viterbi labels that are given `lag` frames later, by what is
    the best path then. With a lag as long as the segments, labels are those of temporal.decode.

    State of a video: three sums, and frame numbers and back pointers of `lag` frames.
    """
    if lag < 1:
        raise ValueError("a lag has a frame at least")
    return _run(frames, LagDecoder(quiet_ms, lag), time, late, {f"p{k}": F.col(c).cast("double") for k, c in enumerate(p)}, "frame_index long, segment long, temporal_label int")
