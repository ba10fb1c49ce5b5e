"""Importance resampling towards a target: hashed runs of words are counted, weighed and drawn without replacement.

Scores are a sum of gains by an array of buckets, and noise that follows from the id, so that the highest scores are a
draw by weight. Eligible rows become sorted runs, one a partition. An exact cut by counts of scores leaves the runs'
upper parts; these are dealt by ranges, merged by a tournament tree in each range, and the draw ends at its exact count.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, checked_broadcast, released, stored

BUCKETS = 10_000
LONGEST_RUN = 3
#: Rows of a range that are merged in one task, about.
RANGE_ROWS = 200_000
#: Bins of a pass of the cut: each narrows the range of scores by this factor.
BINS = 4096
#: Words up to this length are hashed a byte at a time all together, longer ones by themselves.
SHORT_WORD = 48


def _byte_table() -> np.ndarray:
    """Steps of CRC-32 by one byte, reflected polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> np.uint32(1) ^ np.uint32(0xEDB88320), steps >> np.uint32(1))
    return steps


STEPS = _byte_table()


def _shift_tables(longest: int) -> np.ndarray:
    """[n, k, byte]: what byte k of a CRC becomes after n bytes of zeros; CRCs are linear, so the four add up by xor."""
    out = np.empty((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, longest + 1):
        out[n] = STEPS[out[n - 1] & 255] ^ out[n - 1] >> np.uint32(8)
    return out


SHIFTS = _shift_tables(SHORT_WORD)
BLANK = np.uint32(zlib.crc32(b" "))
# Bytes of words; A-Z are taken as a-z, and all bytes of characters beyond ASCII belong to words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32, length in bytes, number of the text) of every word of the texts, in order."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    raw = FOLD[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], IN_WORD[raw]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    lengths = ends - begins
    borders = np.cumsum([len(t or b"") + 1 for t in texts])
    order = np.argsort(-lengths, kind="stable")
    first, size = begins[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long_words = int(np.searchsorted(-size, -SHORT_WORD, side="left"))
    for i in range(int(size[long_words]) if long_words < len(size) else 0):
        n = int(np.searchsorted(-size, -i, side="left"))  # words of more than i bytes
        some = crc[long_words:n]
        crc[long_words:n] = STEPS[(some ^ raw[first[long_words:n] + i]) & 255] ^ some >> np.uint32(8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(long_words):
        crc[k] = zlib.crc32(raw[first[k] : first[k] + size[k]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out, lengths, np.searchsorted(borders, begins, side="right")


def _appended(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings joined, from those of the first and the second and the length of the second."""
    out = np.empty(len(crc), np.uint32)
    short = length <= SHORT_WORD
    c, n = crc[short], length[short]
    out[short] = SHIFTS[n, 0, c & 255] ^ SHIFTS[n, 1, c >> 8 & 255] ^ SHIFTS[n, 2, c >> 16 & 255] ^ SHIFTS[n, 3, c >> 24]
    for k in np.flatnonzero(~short):
        out[k] = _through_zeros(int(crc[k]), int(length[k]))
    return out ^ after


def _through_zeros(crc: int, n: int) -> int:
    """A CRC after n bytes of zeros."""
    c = np.uint32(crc)
    for _ in range(n // SHORT_WORD):
        c = SHIFTS[SHORT_WORD, 0, c & 255] ^ SHIFTS[SHORT_WORD, 1, c >> 8 & 255] ^ SHIFTS[SHORT_WORD, 2, c >> 16 & 255] ^ SHIFTS[SHORT_WORD, 3, c >> 24]
    n %= SHORT_WORD
    return int(SHIFTS[n, 0, c & 255] ^ SHIFTS[n, 1, c >> 8 & 255] ^ SHIFTS[n, 2, c >> 16 & 255] ^ SHIFTS[n, 3, c >> 24])


def features(texts: list[bytes | None], buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of the text) of every run of up to `longest` words, and the number of words of each text."""
    crc, length, text = word_hashes(texts)
    of, found, run = [text], [crc % np.uint32(buckets)], crc
    for k in range(1, longest):
        # run[i] is the hash of words i to i + k - 1; the next word and a blank go behind it.
        run = _appended(_appended(run[:-1], BLANK, np.ones(max(len(run) - 1, 0), np.int64)), crc[k:], length[k:])
        same = text[: len(text) - k] == text[k:]
        of.append(text[k:][same])
        found.append(run[same] % np.uint32(buckets))
    return np.concatenate(found), np.concatenate(of), np.bincount(text, minlength=len(texts))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. Each task sums its own before they are shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for texts in _texts(batches):
            total += np.bincount(features(texts, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])
        released()

    sums = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def _texts(batches: Iterator, most: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """The first column in lists of about `most` bytes; a text is never cut."""
    for batch in batches:
        held, size = [], 0
        for t in batch.column(0):
            held.append(t.as_py())
            size += len(held[-1] or b"")
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares of each bucket, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for t, s in zip(target, source, strict=True)], np.int64)


def noise(key: str, seed: int) -> int:
    """Thousandths of a standard Gumbel variate that follows from the key."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class Node(NamedTuple):
    """The head of a run: least key first."""

    key: tuple
    run: int
    at: int


def tournament(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, position) of the keys of sorted runs, least first, by a tree of losers over the runs.

    Each step replays the path from one leaf to the root: log2 of the number of runs in comparisons.
    """
    end = Node((math.inf,), -1, -1)
    head = lambda k, at: Node(runs[k][at], k, at) if at < len(runs[k]) else end
    size = 1 << max(len(runs) - 1, 0).bit_length()
    winners = [end] * size + [head(k, 0) if k < len(runs) else end for k in range(size)]
    losers = [end] * size
    for k in range(size - 1, 0, -1):
        a, b = winners[2 * k], winners[2 * k + 1]
        winners[k], losers[k] = (a, b) if a <= b else (b, a)
    best = winners[1]
    while best.run >= 0:
        yield best.run, best.at
        k, best = size + best.run, head(best.run, best.at + 1)
        while k > 1:
            k >>= 1
            if losers[k] < best:
                losers[k], best = best, losers[k]


def score_cut(rows: DataFrame, column: str, draw: int) -> int | None:
    """The largest score that at least `draw` rows reach; None if there are fewer rows.

    Counts in bins narrow the range of scores until it is one score: a few passes, BINS rows each on the driver.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if draw > n or draw < 1:
        return None
    over = 0  # rows above high
    while low < high:
        width = (high - low) // BINS + 1
        binned = rows.filter(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - low) / width).cast("long").alias("bin")).count()
        for b, count in sorted(binned.collect(), reverse=True):
            if over + count >= draw:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            over += count
    return low


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Every document with id_col, n_features, weight, score and, for those that are drawn, rank (all but the id long).

    `percent` of the documents with at least `least_words` words are drawn, rounded down: those of the highest
    scores, ties to the smaller id, NULL last, repeated rows of an id one after another. A null or empty text has
    no features and weight 0. A NULL id has the noise of the empty text. Words of any length and texts without a
    target are whole. Empty tables give no rows, an empty target weighs all buckets by their own counts alone.
    Other columns of docs don't matter. What reaches the driver: one row a bucket, one row a bin, one row a range.
    """
    id_type = docs.schema[id_col].dataType
    table = gains(bucket_counts(target, text_col, buckets), bucket_counts(docs, text_col, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        weights = shared.value

        def work(cols):
            found, of, words = features(cols["text"], buckets)
            n = len(words)
            sums = np.zeros(n, np.int64)
            np.add.at(sums, of, weights[found])
            keys = ["" if k is None else k.decode() for k in cols["key"]]
            return {"id": cols["id"], "n_features": np.bincount(of, minlength=n).tolist(), "weight": sums.tolist(), "score": [w + noise(k, seed) for w, k in zip(sums.tolist(), keys, strict=True)], "eligible": (words >= least_words).tolist()}

        return work

    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("n_features long, weight long, score long, eligible boolean")])
    scored = arrow_rows(docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")), make, schema, 1 << 20)
    # A run a partition: its number and a row's place in it are the two halves of the row's number.
    runs = stored(scored.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.col("id").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id()), "runs")
    eligible = runs.filter("eligible")
    draw = percent * eligible.count() // 100
    cut = score_cut(eligible, "score", draw)
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if cut is None:
        return runs.select(*out, F.lit(None).cast("long").alias("rank"))
    reached = F.col("eligible") & (F.col("score") >= cut)
    ranked = _merged(runs.filter(reached), draw)
    return runs.filter(~reached).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*out, "rank"))


def _merged(rows: DataFrame, draw: int) -> DataFrame:
    """rows, the upper ends of runs, with their rank in the draw; NULL beyond it."""
    kept = ["id", "n_features", "weight", "score"]
    parts = max(1, -(-draw // RANGE_ROWS))
    # The row's number is the last key, so that repeated rows don't fill one range.
    dealt = rows.repartitionByRange(parts, F.desc("score"), F.col("id").asc_nulls_last(), "row").sortWithinPartitions("row")

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        whole = pa.Table.from_batches(list(batches))
        if whole.num_rows:
            order = _merged_order(whole["score"].to_pylist(), whole["id"].to_pylist(), whole["row"].to_numpy(), draw)
            place = pa.array([*range(1, min(draw, len(order)) + 1), *[None] * (len(order) - draw)], pa.int64())
            yield from whole.take(pa.array(order)).drop_columns(["row"]).append_column("place", place).to_batches(10_000)

    schema = T.StructType([*[rows.schema[c] for c in kept], *T.StructType.fromDDL("part int, place long")])
    merged = stored(dealt.select(*kept, F.spark_partition_id().alias("part"), "row").mapInArrow(merge, schema), "merged")
    counts = dict(merged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    before, sums = [], 0
    for part in sorted(counts):
        before.append((part, sums))
        sums += counts[part]
    offsets = checked_broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"), 12)
    rank = F.col("place") + F.col("before")
    return merged.join(offsets, "part").select(*kept, F.when(rank <= draw, rank).alias("rank"))


def _merged_order(score: list[int], ids: list, row: np.ndarray, draw: int) -> list[int]:
    """Places of a range's rows, which lie run by run, in the order of the draw; the tree stops after `draw` rows, the
    others follow as they lie."""
    keys = [(-s, i is None, "" if i is None else i, r) for s, i, r in zip(score, ids, row.tolist(), strict=True)]
    starts = np.flatnonzero(np.diff(row >> 33, prepend=-1)).tolist()
    ends = [*starts[1:], len(keys)]
    order = [starts[run] + at for run, at in islice(tournament([keys[a:b] for a, b in zip(starts, ends, strict=True)]), draw)]
    if len(order) < len(keys):
        drawn = set(order)
        order += [k for k in range(len(keys)) if k not in drawn]
    return order
