"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

Chunks end where the gear hash of the last 16 bytes is below a bound, so after an insertion they soon end at
the same places again. Digests of chunks are counted by document with map-side aggregation; a chunk that a
smaller document has too, or an earlier place of the same text, is a repeat. Runs of repeated chunks go if they
are long enough to be a passage and not a stock phrase.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_append, arrow_rows, heavy_join, own_names, stored
from .line_dedup import text_key

WINDOW = 16
#: One place in so many may be a boundary.
SPACING = 22
MIN_CHUNK = 8
MAX_CHUNK = 512
#: Bytes from which on a run of repeated chunks goes.
MIN_RUN = 96
#: Bytes up to which repeated chunks are broadcast; they grow with the corpus, so beyond small ones they are joined.
BROADCAST = 4 << 20
GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(text: bytes) -> np.ndarray:
    """Ends of bytes after which a chunk may end. Doubling: a hash of 2 k bytes is that of k bytes, shifted by k,
    and that of the next k."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    width = 1
    while width < WINDOW:
        if len(h) <= width:
            return np.zeros(0, np.int64)
        h = (h[:-width] << np.uint16(width)) + h[width:]
        width *= 2
    return np.flatnonzero(h < (1 << 16) // SPACING) + WINDOW


def chunk_ends(text: bytes) -> list[int]:
    """Ends of the chunks: possible ones with no other in the MIN_CHUNK bytes before, so that each depends on the
    bytes just before it alone, and one at MAX_CHUNK bytes where there is none."""
    places = boundaries(text) if len(text) > WINDOW else np.zeros(0, np.int64)
    ends, at = [], 0
    for b in places[np.diff(places, prepend=-MIN_CHUNK) >= MIN_CHUNK].tolist():
        while b - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        at = b
        ends.append(at)
    while len(text) - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < len(text):
        ends.append(len(text))
    return ends


def chunk_digests(text: bytes, ends: list[int]) -> list[tuple[int, int]]:
    out, at = [], 0
    for end in ends:
        d = xxhash.xxh3_128_intdigest(text[at:end])
        out.append(((d >> 64) - (1 << 63), (d & 0xFFFFFFFF) - (1 << 31)))
        at = end
    return out


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, key): each different chunk of each row."""

    def make():
        def work(cols):
            out = {"h1": [], "h2": [], "id": [], "key": []}
            for doc, key, text in zip(cols["id"], cols["key"], cols["text"], strict=True):
                own = set(chunk_digests(text, chunk_ends(text))) if text else ()
                out["h1"] += [a for a, _ in own]
                out["h2"] += [b for _, b in own]
                out["id"] += [doc] * len(own)
                out["key"] += [key] * len(own)
            return out

        return work

    rows = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return arrow_rows(rows, make, f"h1 long, h2 int, id {docs.schema[id_col].dataType.simpleString()}, key long")


@own_names("__of", "__key", "__drops")
def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """docs with repeated passages gone from text_col, which becomes binary; adds n_bytes, n_chunks, n_removed,
    n_spans (long).

    A chunk is a repeat if a row of a smaller id has it or the same text has it before. Runs of repeats go if
    they have at least min_run bytes or are a whole text, so the first copy of a passage stays. Null and empty texts have no
    chunks. Rows that repeat an id are one document and no repeats of each other; rows with null ids lose
    what any other row has, and nothing repeats them. Other columns stay; clashing names are replaced. What
    is left may be no valid UTF-8.
    """
    chunks = _chunks(docs, id_col, text_col)
    shared = stored(
        chunks.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls"), F.count("*").alias("n")).filter("first < last OR first IS NOT NULL AND nulls > 0").select("h1", "h2", "first", "n"),
        "shared-chunks",
    )
    hits = heavy_join(chunks, shared, ["h1", "h2"], "n", "id", BROADCAST).filter(~F.col("id").eqNullSafe(F.col("first")))
    drops = stored(hits.groupBy(F.col("id").alias("__of"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("h1", "h2")).alias("__drops")), "chunk-drops")
    weight = drops.agg(F.coalesce(F.sum(F.size("__drops") * 32 + 128), F.lit(0))).first()[0]
    names = ("n_bytes", "n_chunks", "n_removed", "n_spans")
    base = docs.drop(*names)
    joined = base.join(F.broadcast(drops) if weight <= BROADCAST else drops, base[id_col].eqNullSafe(F.col("__of")) & (text_key(id_col, text_col) == F.col("__key")), "left").drop("__of", "__key")

    def make():
        def work(cols):
            out = {k: [] for k in (text_col, *names)}
            for text, drops in zip(cols[text_col], cols["__drops"], strict=True):
                text = text or b""
                ends = chunk_ends(text)
                gone = {(d["h1"], d["h2"]) for d in drops or ()}
                runs: list[list[int]] = []
                at = 0
                for end, digest in zip(ends, chunk_digests(text, ends), strict=True):
                    if digest in gone:
                        if runs and runs[-1][1] == at:
                            runs[-1][1] = end
                        else:
                            runs.append([at, end])
                    gone.add(digest)  # from here on it is an earlier place of the same text
                    at = end
                runs = [r for r in runs if r[1] - r[0] >= min_run or r == [0, len(text)]]
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                for k, v in zip(out, (b"".join(kept), len(text), len(ends), sum(b - a for a, b in runs), len(runs)), strict=True):
                    out[k].append(v)
            return out

        return work

    return arrow_append(joined, [text_col, "__drops"], make, f"`{text_col}` binary, n_bytes long, n_chunks long, n_removed long, n_spans long").drop("__drops")
