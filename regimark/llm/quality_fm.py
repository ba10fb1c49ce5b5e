"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: its distinct words hashed into fixed slots, bins of structure statistics and
bins of the metadata that numeric columns give. The score is w0 + sum(w x) + 1/2 sum_f((sum v x)^2 - sum(v^2 x^2)), linear in the entries.
Fitting takes a bounded sample of labelled rows; vectors are made on the executors, the fit runs on the driver
and the model, of fixed size, is broadcast.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_append, arrow_rows
from .quality_rules import BLANK, DIGIT, MARK, OTHER, SKIP, STOP, SYMBOL, UPPER, CLASS_OF

#: Slots of hashed words; statistics follow.
WORD_SLOTS = 1 << 15
BINS = 12
STATISTICS = 12
#: Metadata columns that a vector may have.
METADATA = 4
SLOTS = WORD_SLOTS + (STATISTICS + METADATA) * BINS
RANK = 6
#: Labelled rows of each class that a fit may take.
SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.7
#: Share of the whole vector's square that words have.
WORD_SHARE = 1.0


def _bin(x: float, scale: float) -> int:
    """x from 0 on, on a log scale, as one of BINS."""
    return min(BINS - 1, int(math.log2(1 + x * scale)))


def vector(text: bytes, metadata: tuple = ()) -> tuple[list[int], list[float]]:
    """Slots and values of a text and of up to METADATA numbers; the empty text has its bins only, and a number that is
    missing or no number has none."""
    words = text.split()
    n = len(words)
    classes = text.translate(CLASS_OF)
    chars = max(1, len(text) - classes.count(SKIP))
    count = classes.count
    lines = text.split(b"\n")
    distinct = set(words)
    upper_words = sum(map(bytes.isupper, words))
    alpha_words = sum(map(bytes.isalpha, words))
    share = lambda a, b: a / b if b else 0.0
    values = (
        (share(count(UPPER), chars), 2000), (share(count(DIGIT), chars), 2000), (share(count(SYMBOL), chars), 2000), (share(count(STOP), chars), 2000),
        (share(count(MARK), chars), 2000), (share(count(OTHER), chars), 2000), (share(count(BLANK), chars), 2000), (share(upper_words, n), 2000),
        (share(n - len(distinct), n), 2000), (share(len(lines) - len(set(lines)), len(lines)), 2000), (share(alpha_words, n), 2000), (chars, 0.02),
    )
    slots = [WORD_SLOTS + k * BINS + _bin(x, scale) for k, (x, scale) in enumerate(values)]
    slots += [WORD_SLOTS + (STATISTICS + k) * BINS + _bin(abs(x), 0.02) for k, x in enumerate(metadata) if x is not None and math.isfinite(x)]
    weights = [1 / math.sqrt(STATISTICS)] * len(slots)
    if distinct:
        hashed = {zlib.crc32(w) % WORD_SLOTS for w in distinct}
        slots += hashed
        weights += [math.sqrt(WORD_SHARE / len(hashed))] * len(hashed)
    return slots, weights


@dataclass
class Machine:
    """bias, linear weights w[SLOTS] and factors v[SLOTS, RANK]."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, slots: list[int], values: list[float]) -> float:
        x = np.asarray(values)
        vx = self.v[slots] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.w[slots] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, slots: list[int], values: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(slots, values)))))


def fit(rows: list[tuple[list[int], list[float], int]], epochs: int = 12, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over mini-batches; both classes weigh alike. No rows: every score is 1/2."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SLOTS), rng.normal(0, 0.02, (SLOTS, RANK)) if rows else np.zeros((SLOTS, RANK)))
    labels = np.array([r[2] for r in rows], float)
    if not rows or len(set(labels)) < 2:
        m.bias = 0.0 if not rows else 2.0 if labels[0] else -2.0
        return m
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    gw, gv, gb = np.full(SLOTS, 1e-6), np.full((SLOTS, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            sizes = [len(rows[i][0]) for i in batch]
            slots = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = m.v[slots] * x[:, None]
            s = np.add.reduceat(vx, starts)
            margin = m.bias + np.add.reduceat(m.w[slots] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[batch]) * weight[batch]
            e = np.repeat(error, sizes) * x
            places, inverse = np.unique(slots, return_inverse=True)
            dw = np.bincount(inverse, e) + decay * m.w[places]
            dv_rows = e[:, None] * (np.repeat(s, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(inverse, dv_rows[:, f]) for f in range(RANK)], 1) + decay * m.v[places]
            gw[places] += dw * dw
            gv[places] += dv * dv
            gb += error.sum() ** 2
            m.w[places] -= rate * dw / np.sqrt(gw[places])
            m.v[places] -= 0.3 * rate * dv / np.sqrt(gv[places])
            m.bias -= rate * error.sum() / math.sqrt(gb)
    return m


def held_out(id_col: str):
    """True where crc32 of the id as text leaves 2 when divided by 4; null ids are held out, as no label is theirs."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS, metadata: tuple[str, ...] = ()
) -> Machine:
    """A machine fitted on up to per_class labelled rows of each class that aren't held out, the first by a hash
    of their ids. Null labels, labels of no document and repeated labels of an id don't count; of rows that repeat
    an id the least text does. metadata: up to METADATA numeric columns."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)").filter(~held_out("__id"))
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"))
    order = [F.xxhash64("__id"), F.col("__id")]
    sample = known.filter("__label = 0").orderBy(*order).limit(per_class).unionAll(known.filter("__label = 1").orderBy(*order).limit(per_class))
    # At most 2 * per_class rows: bounded by the parameter.
    own = docs.select(F.col(id_col).alias("__own"), F.struct(F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]).alias("row"))
    chosen = own.join(F.broadcast(sample), F.col("__own") == F.col("__id")).groupBy("__id").agg(F.min("row").alias("row"), F.min("__label").alias("label"))
    names = [f"m{k}" for k in range(len(metadata))]

    def make():
        def work(cols):
            made = [vector(t or b"", m) for t, *m in zip(cols["text"], *[cols[n] for n in names], strict=True)]
            return {"id": cols["id"], "label": cols["label"], "slots": [a for a, _ in made], "values": [b for _, b in made]}

        return work

    flat = chosen.select(F.col("__id").alias("id"), "label", "row.*")
    made = arrow_rows(flat, make, f"id {known.schema['__id'].dataType.simpleString()}, label int, slots array<int>, values array<double>")
    kept = [(np.array(r["slots"]), np.array(r["values"]), r["label"]) for r in sorted(made.collect())]
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}  # two rows at most
    machine = fit(kept)
    if counts.get(0) and counts.get(1):  # the fit weighs both classes alike; scores follow their true shares
        machine.bias += math.log(counts[1] / counts[0])
    return machine


def append_quality(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD, metadata: tuple[str, ...] = ()) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Null and empty texts are scored by their bins. Nothing but the text and the metadata columns that the machine
    was fitted with enters a score. Rows are scored one by
    one; null and repeated ids stay, as do other columns, but for ones named score or predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value

        def work(cols):
            scores = [m.score(*vector(t or b"", given)) for t, *given in zip(cols[text_col], *[cols[c] for c in names], strict=True)]
            return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    names = [f"__m{k}" for k in range(len(metadata))]
    given = docs.withColumns({n: F.col(c).cast("double") for n, c in zip(names, metadata, strict=True)})
    return arrow_append(given, [text_col, *names], make, "score double, predicted int").drop(*names)


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, metadata: tuple[str, ...] = ()) -> DataFrame:
    """id_col, score, predicted of every row, as append_quality makes them."""
    return append_quality(docs.select(id_col, text_col, *metadata), machine, text_col, threshold, metadata).select(id_col, "score", "predicted")
