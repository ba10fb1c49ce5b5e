"""Stateful streams on event time: order, late rows, restarts, what is left of the state; and the sink against replays."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimark.operators import temporal
from regimark.streaming import sinks, state

START = datetime.datetime(2024, 1, 1)
SCHEMA = "video_id string, frame_index long, ts timestamp, hit boolean, p_low double, p_nominal double, p_high double"
END = (None, 0, datetime.datetime(2100, 1, 1), False, 0.0, 0.0, 0.0)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def some_frames(seed):
    """Three videos with gaps, and per frame its second: a frame a second."""
    rng, rows = np.random.default_rng(seed), []
    for video in ("a", "b", "c"):
        numbers = np.delete(np.arange(90), rng.integers(1, 89, 6))
        p = rng.dirichlet([0.4] * 3, len(numbers))
        rows += [(video, int(k), at(float(k)), bool(rng.random() < 0.6), *map(float, q)) for k, q in zip(numbers, p, strict=True)]
    return rows


def fed(spark, tmp_path, make, parts, name="q"):
    """What a stream gives whose parts come one after another, each to a new run over the same checkpoint."""
    source, sink, notes = (str(tmp_path / f"{name}-{k}") for k in ("in", "out", "notes"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    stream = make(spark.readStream.schema(SCHEMA).parquet(source))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        sinks.start_once(stream, sink, notes).awaitTermination()
    return sinks.read_written(spark, sink, stream.schema).collect(), notes


def runs(rows, least=2):
    out = []
    for video in {r[0] for r in rows}:
        hits = sorted(r[1] for r in rows if r[0] == video and r[3])
        for k in hits:
            if out and out[-1][0] == video and out[-1][2] == k - 1:
                out[-1][2] = k
            else:
                out.append([video, k, k])
    return sorted(tuple(r) for r in out if r[2] - r[1] + 1 >= least)


def test_events_in_any_order_over_restarts(spark, tmp_path):
    rows = some_frames(1)
    rng = np.random.default_rng(2)
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 15))  # up to 15 seconds out of order
    parts = [mixed[:80], mixed[80:90], mixed[90:200], mixed[200:], [END]]
    got, notes = fed(spark, tmp_path, lambda s: state.event_stream(s, F.col("hit"), "ts", "20 seconds"), parts)
    assert sorted((r["video_id"], r["start"], r["end"]) for r in got) == runs(rows)
    for name in ("waiting", "kept"):
        left = spark.read.format("statestore").option("stateVarName", name).load(f"{notes}")
        assert left.filter("key.video_id IS NOT NULL").count() == 0  # only the row that ends the stream may be there


def test_late_rows_are_left_out_and_quiet_videos_end(spark, tmp_path):
    row = lambda v, k, second, hit=True: (v, k, at(second), hit, 0.0, 0.0, 0.0)
    parts = [
        [row("a", 0, 0), row("a", 1, 1), row("b", 0, 100, False)],
        [row("a", 2, 2), row("b", 1, 200, False)],  # a's row is far behind the watermark by now
        [row("a", 9, 300), row("a", 8, 299), row("a", 7, 298, None), row("b", 2, 400, False)],
        [END],
    ]
    got, _ = fed(spark, tmp_path, lambda s: state.event_stream(s, F.col("hit"), "ts", "5 seconds", quiet_ms=10_000), parts)
    assert sorted((r["video_id"], r["start"], r["end"]) for r in got) == [("a", 0, 1), ("a", 8, 9)]


@pytest.mark.parametrize("lag", [1, 6, 1000])
def test_labels_with_a_lag(spark, tmp_path, lag):
    rows = some_frames(3)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    got, _ = fed(spark, tmp_path, lambda s: state.label_stream(s, "ts", "1 second", lag), [ordered[:100], ordered[100:], [END]], f"lag{lag}")
    got = {(r["video_id"], r["frame_index"]): (r["segment"], r["temporal_label"]) for r in got if r["video_id"]}
    want = {}
    for video in ("a", "b", "c"):
        own = [r for r in rows if r[0] == video]
        cuts = [0, *[k for k in range(1, len(own)) if own[k][1] > own[k - 1][1] + 1], len(own)]
        for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            p = np.array([r[4:] for r in own[a:b]])
            for k in range(a, b):  # the best path once `lag` more frames of the segment are there
                want[video, own[k][1]] = (s, int(temporal.viterbi(p[: k - a + 1 + lag])[k - a]))
    assert got == want


def test_a_killed_run_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    source, sink, notes = (str(tmp_path / k) for k in ("in", "out", "notes"))
    rows = [(f"v{k}", k, at(k), True, 0.0, 0.0, 0.0) for k in range(60)]
    for k in range(6):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    real, calls = sinks.batch_writer(sink), [0]

    def killed(batch, number):
        calls[0] += 1
        if calls[0] in (2, 4):  # dies after the rows, before the manifest; or after both, before the stream knows
            batch.write.mode("overwrite").parquet(f"{sink}/data/batch={number}")
            if calls[0] == 4:
                real(batch, number)
            raise RuntimeError("killed")
        real(batch, number)

    monkeypatch.setattr(sinks, "batch_writer", lambda path: killed)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            sinks.start_once(stream, sink, notes).awaitTermination()
    assert len(sinks.written(spark, sink)) < 6
    sinks.start_once(stream, sink, notes).awaitTermination()
    got = sorted(r["frame_index"] for r in sinks.read_written(spark, sink, SCHEMA).collect())
    assert got == list(range(60)) and len(sinks.written(spark, sink)) == 6


def test_nothing_written_is_empty(spark, tmp_path):
    assert sinks.read_written(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_videos_share_groups_of_state():
    from regimark.streaming.state import NO_FRAME, EventMachine

    class State:
        def __init__(self):
            self.rows, self.calls = [], 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def appendList(self, rows):
            self.rows, self.calls = self.rows + rows, self.calls + 1

        def put(self, rows):
            self.rows, self.calls = rows, self.calls + 1

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.states = {}

        def getListState(self, name, schema):
            return self.states.setdefault(name, State())

        def registerTimer(self, time):
            pass

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, machine = Handle(), EventMachine(1000, 2)
    machine.init(handle)
    rows = pd.DataFrame([(10 * k, k if v else NO_FRAME, v > 0, v, True) for v in range(50) for k in range(4)], columns=["time", "frame", "known", "video", "hit"])
    list(machine.handleInputRows((0,), iter([rows]), None))
    assert [len(b) for b in machine.handleExpiredTimer((0,), Clock(15), None)] == [0]  # two frames of each are taken
    got = pd.concat(machine.handleExpiredTimer((0,), Clock(5000), None))
    assert sorted(got.itertuples(index=False, name=None)) == [(v, 0, 3) for v in range(1, 50)]
    assert not any(s.rows for s in handle.states.values()) and sum(s.calls for s in handle.states.values()) == 3
