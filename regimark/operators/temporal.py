"""Temporal smoothing: Viterbi decoding of videos of any length in blocks of frames, and sequence metrics.

Log probabilities are whole multiples of 2^-40, so sums don't depend on their order: blocks may be composed as max-plus
matrices, and labels are those of decoding a segment from its first frame to its last. Ties go to the lowest state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.store import stored
from .windows import gap_segments, runs, switches

# The chain's transitions and start.
TRANSITION = [[0.985, 0.014, 0.001], [0.007, 0.986, 0.007], [0.001, 0.014, 0.985]]
INITIAL = [0.20, 0.60, 0.20]
FLOOR = 1e-12
SHORT_RUN = 2
STATES = 3
#: Frames of a block: what one task decodes by itself. Its row takes some 0.5 MB.
BLOCK = 16_384


def fixed(p) -> np.ndarray:
    """Log probabilities in units of 2^-40."""
    return np.rint(np.log(np.fmax(np.asarray(p, float), FLOOR)) * (1 << 40)).astype(np.int64)


STEP, START = fixed(TRANSITION), fixed(INITIAL)


def viterbi(p: np.ndarray) -> np.ndarray:
    """Most likely states of a segment; emissions are its posteriors. Ties go to the lowest state."""
    if not len(p):
        return np.zeros(0, np.int8)
    emit = fixed(p)
    back = np.zeros(emit.shape, np.int8)
    best = START + emit[0]
    for i in range(1, len(emit)):
        paths = best[:, None] + STEP
        back[i] = paths.argmax(axis=0)
        best = paths.max(axis=0) + emit[i]
    out = np.empty(len(emit), np.int8)
    out[-1] = best.argmax()
    for i in range(len(emit) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def forward(emit: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best sums at the end of each run, and back pointers of all rows, for runs of emit that begin at `starts`.

    first[run, row, state] has the sums at a run's first frame: one row for a run with a known beginning, three, one
    for each state before it, for a max-plus matrix. Runs go a step at a time together, the longest first.
    """
    lengths = np.diff(np.append(starts, len(emit)))
    longest = np.argsort(-lengths, kind="stable")
    begins, lengths = starts[longest], lengths[longest]
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []  # runs of t rows or more
    best, back = first[longest], np.zeros(emit.shape, np.int8)
    for t, n in enumerate(going[1:], 1):
        paths = best[:n, :, :, None] + STEP
        best[:n] = paths.max(axis=2) + emit[begins[:n] + t][:, None, :]
        if best.shape[1] == 1:
            back[begins[:n] + t] = paths[:, 0].argmax(axis=1)
    out = np.empty_like(best)
    out[longest] = best
    return out, back


def backward(back: np.ndarray, starts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """States of all rows, from those at the ends of the runs; last[run, k] gives k of them for each run."""
    lengths = np.diff(np.append(starts, len(back)))
    longest = np.argsort(-lengths, kind="stable")
    begins, lengths = starts[longest], lengths[longest]
    going = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    out = np.zeros((len(back), last.shape[1]), np.int8)
    out[begins + lengths - 1] = last[longest]
    for t in range(len(going) - 1, 0, -1):
        rows = begins[: going[t]] + t
        out[rows - 1] = np.take_along_axis(back[rows], out[rows].astype(np.int64), axis=1)
    return out


def _flat(batch: pa.RecordBatch, c: str) -> np.ndarray:
    return batch.column(c).flatten().to_numpy(zero_copy_only=False)


def _parts(batch: pa.RecordBatch, p: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of a batch: emissions of all frames, begins of blocks (and the end), begins of runs, and the first and
    the last run of each block."""
    frame = _flat(batch, "frame_index")
    at = np.concatenate([[0], np.cumsum(batch.column("frame_index").value_lengths().to_numpy(zero_copy_only=False))])
    cut = np.ones(len(frame), bool)
    cut[1:] = np.diff(frame) > 1
    cut[at[:-1]] = True
    starts = np.flatnonzero(cut)
    first = np.searchsorted(starts, at[:-1])
    emit = np.stack([fixed(_flat(batch, c)) for c in p], axis=1)
    return emit, at, starts, first, np.append(first[1:], len(starts)) - 1


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list a row of an array."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width), pa.int32()), pa.array(values.ravel()))


def _rows_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows from starts to ends, and where each such run then begins."""
    begin = np.concatenate([[0], np.cumsum(ends - starts)])
    return np.arange(begin[-1]) + np.repeat(starts - begin[:-1], ends - starts), begin[:-1]


def _summarised(batches: Iterator[pa.RecordBatch], p: list[str]) -> Iterator[pa.RecordBatch]:
    """What the scan over blocks needs: first and last frame, number of runs, the first run as a matrix from the
    states before it, and the sums at the end of the last run if that begins here."""
    for batch in batches:
        if batch.num_rows:
            emit, at, starts, first, last = _parts(batch, p)
            frame, ends = _flat(batch, "frame_index"), np.append(starts[1:], len(emit))
            rows, own = _rows_of(starts[last], ends[last])
            fresh, _ = forward(emit[rows], own, (START + emit[starts[last]])[:, None, :])
            rows, own = _rows_of(starts[first], ends[first])
            matrix, _ = forward(emit[rows], own, STEP + emit[starts[first]][:, None, :])
            kind = batch.schema.field("frame_index").type.value_type
            made = {
                "first_frame": pa.array(frame[at[:-1]], kind), "last_frame": pa.array(frame[at[1:] - 1], kind), "runs": pa.array(last - first + 1, pa.int64()),
                "matrix": _lists(matrix.reshape(-1, STATES * STATES)), "fresh": _lists(fresh[:, 0]),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])


def _records(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]):
    """(a video's keys, values of columns) of rows one after the other."""
    for batch in batches:
        yield from zip(zip(*[batch.column(c).to_pylist() for c in keys], strict=True), *[batch.column(c).to_pylist() for c in columns], strict=True)


def _gathered(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in iter(lambda: list(islice(rows, 10_000)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _entered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """Blocks of a video in order: the sums at the frame before a block that goes on with it (else NULL), the number of
    its first segment, and whether it goes on with a block or one with it; blocks for which all this is no are left out.
    Sums are taken relative to the largest, so they stay small."""
    held, begins, segment = None, None, 0  # the block before, its sums at its begin, its first segment
    for row in chain(_records(batches, keys, ["block", "first_frame", "last_frame", "runs", "matrix", "fresh"]), [None]):
        same = held is not None and row is not None and row[0] == held[0]
        linked = same and row[2] - held[3] <= 1
        if held is not None and (begins is not None or segment or linked):
            yield *held[0], held[1], begins, segment, begins is not None or linked
        if linked:
            sums = (np.asarray(begins)[:, None] + np.asarray(held[5]).reshape(STATES, STATES)).max(axis=0) if begins is not None and held[4] == 1 else np.asarray(held[6])
        segment = segment + held[4] - linked if same else 0
        held, begins = row, (sums - sums.max()).tolist() if linked else None


def _pointers(batch: pa.RecordBatch, p: list[str]) -> tuple:
    """Of the blocks of a batch: begins of blocks and of runs, their first and last runs, back pointers, the best last
    state of each run, and the state before a block for each one at its begin."""
    emit, at, starts, first, last = _parts(batch, p)
    begin, before = START + emit[starts], np.zeros((batch.num_rows, STATES), np.int8)
    enter = batch.column("enter")
    if len(on := np.flatnonzero(enter.is_valid().to_numpy(zero_copy_only=False))):
        paths = enter.drop_null().flatten().to_numpy().reshape(-1, STATES)[:, :, None] + STEP
        before[on], begin[first[on]] = paths.argmax(axis=1), paths.max(axis=1) + emit[starts[first[on]]]
    best, back = forward(emit, starts, begin[:, None, :])
    return at, starts, first, last, back, best[:, 0].argmax(axis=1).astype(np.int8), before


def _pointed(batches: Iterator[pa.RecordBatch], keys: list[str], p: list[str]) -> Iterator[pa.RecordBatch]:
    """The state before a block for each state at its end, its best last state."""
    for batch in batches:
        if batch.num_rows:
            _, starts, first, last, back, own, before = _pointers(batch, p)
            ends = np.repeat(own[:, None], STATES, axis=1)
            ends[last] = np.arange(STATES)  # the last run may go on in the next block
            states = backward(back, starts, ends)
            entry = np.take_along_axis(before, states[starts[first]].astype(np.int64), axis=1)
            names = [*keys, "block", "first_frame", "last_frame"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], _lists(entry.astype(np.int32)), pa.array(own[last], pa.int32())], [*names, "entry", "best"])


def _left(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """Blocks of a video, the last one first: the state at a block's last frame where it isn't the best one."""
    video, begin, state = None, None, 0
    for own, block, first_frame, last_frame, entry, best in _records(batches, keys, ["block", "first_frame", "last_frame", "entry", "best"]):
        state = state if own == video and begin - last_frame <= 1 else best
        if state != best:
            yield *own, block, state
        video, begin, state = own, first_frame, entry[state]


def _labelled(batches: Iterator[pa.RecordBatch], keys: list[str], p: list[str], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at, starts, first, last, back, own, _ = _pointers(batch, p)
            state = batch.column("last_state").to_numpy(zero_copy_only=False)
            own[last] = np.where(np.isnan(state), own[last], state) if state.dtype.kind == "f" else state
            label = backward(back, starts, own[:, None])[:, 0]
            block = np.repeat(np.arange(batch.num_rows), np.diff(at))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(label)))) - first[block]
            segment = batch.column("segment").to_numpy()[block] + run
            made = [batch.column(c).take(pa.array(block)) for c in keys] + [batch.column("frame_index").flatten(), pa.array(segment, pa.int64()), pa.array(label, pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *[batch.column(c).flatten() for c in keep]], [*keys, "frame_index", "segment", "temporal_label", *keep])


def decode(frames: DataFrame, p: tuple[str, str, str] = ("p_low", "p_nominal", "p_high"), by: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(video_id, by, frame_index, segment, temporal_label, keep) of frames; a segment ends where an index is left out.

    by: what else tells videos apart, such as the run that the posteriors are from. A video is cut into blocks of BLOCK
    frame numbers that tasks share. A block's first run of frames is a max-plus matrix from the states before it to
    those at its end; a scan over these, one small row a block, gives each block the sums that it begins with. With them
    blocks that go on with others find a map from the state at their end to the one before them; a scan from the last
    block on gives the states at the ends, and blocks their labels. So no task holds a video, and of videos within a
    block nothing but the block is shuffled. Repeated frames of an index follow one another.
    """
    names, keys, keep = list(p), ["video_id", *by], list(keep)
    kind = {c: frames.schema[c].dataType.simpleString() for c in (*keys, "frame_index", *keep)}
    block = F.floor(F.col("frame_index") / BLOCK).alias("block")
    own = {f"p{i}": F.col(c).cast("double") for i, c in enumerate(names)} | {f"k{i}": F.col(c) for i, c in enumerate(keep)}  # a column may be both
    rows = F.sort_array(F.collect_list(F.struct("frame_index", *[c.alias(n) for n, c in own.items()])))
    packed = frames.groupBy(*keys, block).agg(rows.alias("r")).select(*keys, "block", *[F.col(f"r.{c}").alias(c if c == "frame_index" else f"__{c}") for c in ("frame_index", *own)])
    p_, keep_ = [f"__p{i}" for i in range(len(names))], [f"__k{i}" for i in range(len(keep))]
    key = ", ".join([*[f"`{c}` {kind[c]}" for c in keys], "block long"])
    ends = f"first_frame {kind['frame_index']}, last_frame {kind['frame_index']}"
    held = ", ".join([key, f"frame_index array<{kind['frame_index']}>", *[f"{c} array<double>" for c in p_], *[f"{c} array<{kind[k]}>" for c, k in zip(keep_, keep, strict=True)]])
    blocks = stored(packed.mapInArrow(lambda b: _summarised(b, p_), f"{held}, {ends}, runs long, matrix array<long>, fresh array<long>"), "blocks")

    def scanned(table, columns, order, scan, made):
        dealt = table.select(*keys, "block", "first_frame", "last_frame", *columns).repartition(*keys).sortWithinPartitions(*keys, order)
        schema = StructType.fromDDL(f"{key}, {made}")
        arrow = to_arrow_schema(schema)
        return stored(dealt.mapInArrow(lambda b: _gathered(scan(b, keys), arrow), schema), "scan")

    def joined(table, scan, how):
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]
        found = [c for c in scan.columns if c not in (*keys, "block")]
        return table.alias("t").join(scan.alias("s"), reduce(lambda a, b: a & b, same) & (F.col("t.block") == F.col("s.block")), how).select("t.*", *[f"s.{c}" for c in found])

    # Few rows: only blocks that a video goes on from or into have one. Where they are many, the joins are shuffled.
    entered = scanned(blocks, ["runs", "matrix", "fresh"], F.col("block").asc(), _entered, "enter array<long>, segment long, chained boolean")
    bare = blocks.drop("runs", "matrix", "fresh")
    chained = joined(bare.drop(*keep_), entered.filter("chained").drop("chained"), "inner")
    pointed = stored(chained.mapInArrow(lambda b: _pointed(b, keys, p_), f"{key}, {ends}, entry array<int>, best int"), "pointers")
    left = scanned(pointed, ["entry", "best"], F.col("block").desc(), _left, "last_state int")
    known = joined(joined(bare.drop("first_frame", "last_frame"), entered.drop("chained"), "left"), left, "left").withColumn("segment", F.coalesce("segment", F.lit(0)))
    made = ", ".join([*[f"`{c}` {kind[c]}" for c in keys], f"frame_index {kind['frame_index']}, segment long, temporal_label long", *[f"{c} {kind[k]}" for c, k in zip(keep_, keep, strict=True)]])
    out = known.mapInArrow(lambda b: _labelled(b, keys, p_, keep_), made)
    return out.withColumnsRenamed(dict(zip(keep_, keep, strict=True)))


def sequence_metrics(frames: DataFrame, label: str) -> DataFrame:
    """One row: switches within segments, per 1000 possible ones, share of frames in short runs, run lengths."""
    seg = gap_segments(frames)
    r = runs(seg, label)
    s = seg.select("video_id", "segment", switches(label, True).alias("s")).agg(F.sum("s").cast("long").alias("switches"), (F.count("*") - F.countDistinct("video_id", "segment")).alias("possible"))
    m = r.agg(
        (F.sum(F.when(F.col("length") <= SHORT_RUN, F.col("length")).otherwise(0)) / F.greatest(F.sum("length"), F.lit(1))).alias("short_run_frame_fraction"),
        F.percentile("length", 0.5).alias("median_run_length"),
        F.avg("length").alias("mean_run_length"),
    )
    return s.crossJoin(m).select("switches", (1000.0 * F.col("switches") / F.greatest("possible", F.lit(1))).alias("switches_per_1000"), "short_run_frame_fraction", "median_run_length", "mean_run_length")
