"""Line dedup: lines that many documents hold stay in one of them.

Lines are normalised and hashed where the texts lie; only hashes of long lines are shuffled. Distinct documents
are counted per hash in two levels (by hash and document, then by hash), so a line that a third of all rows
hold is spread over tasks. The lines to drop go back to their documents as hashes, and each text is put
together again by position.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_rows, heavy_join, own_names, stored


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def line_hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def text_key(id_col: str, text_col: str):
    """Tells texts without an id apart, which are no document together; 0 where there is an id."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, key, h1, h2): each distinct long line of each row."""

    def make():
        def work(cols):
            ids, own, h1, h2 = [], [], [], []
            for doc, key, text in zip(cols["__id"], cols["__key"], cols["__text"], strict=True):
                keys = {k for line in (text or b"").split(b"\n") if is_long(k := line_key(line), min_chars)}
                for a, b in map(line_hash, keys):
                    ids.append(doc)
                    own.append(key)
                    h1.append(a)
                    h2.append(b)
            return {"__id": ids, "__key": own, "__h1": h1, "__h2": h2}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), text_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    return arrow_rows(rows, make, f"__id {kind}, __key long, __h1 long, __h2 long")


@own_names("__of", "__key", "__drops", "__id", "__text")
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines gone from text_col; adds n_lines and n_dropped, both long.

    A key of at least min_chars code points found in at least min_docs documents loses all its lines except
    in the largest id that holds it. Rows that repeat an id are one document. A null id is no document: it
    isn't counted and keeps no such line. A null or empty text is one empty line, and becomes the empty
    text. Other columns stay as they are; clashing names (n_lines, n_dropped) are overwritten.
    """
    lines = long_lines(docs, id_col, text_col, min_chars)
    hot = stored(
        lines.groupBy("__h1", "__h2").agg(F.countDistinct("__id").alias("n"), F.max("__id").alias("__keeper")).filter(F.col("n") >= min_docs),
        "hot-lines",
    )
    hits = heavy_join(lines, hot, ["__h1", "__h2"], "n", "__id").filter(~F.col("__id").eqNullSafe(F.col("__keeper")))
    drops = stored(hits.groupBy(F.col("__id").alias("__of"), "__key").agg(F.collect_set(F.struct("__h1", "__h2")).alias("__drops")), "line-drops")
    weight = drops.agg(F.coalesce(F.sum(F.size("__drops") * 32 + 128), F.lit(0))).first()[0]
    small = F.broadcast(drops) if weight <= BROADCAST_BYTES else drops
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*keep).join(small, docs[id_col].eqNullSafe(F.col("__of")) & (text_key(id_col, text_col) == F.col("__key")), "left")
    return _reassembled(joined, keep, text_col, docs)


def _reassembled(joined: DataFrame, keep: list[str], text_col: str, docs: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            drops = batch.column(batch.schema.get_field_index("__drops")).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts, drops, strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {(d["__h1"], d["__h2"]) for d in drop}
                    shortest = [line for line in lines if not (len(k := line_key(line)) and line_hash(k) in gone)]
                    n_dropped.append(len(lines) - len(shortest))
                    lines = shortest
                else:
                    n_dropped.append(0)
                kept.append(b"\n".join(lines))
            cols = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*keep, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.select(*keep, "__drops").mapInArrow(run, f"{schema}, n_lines long, n_dropped long")


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
