"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier goes.

Where strings can be equal is found first, then suffix arrays decide. Each 100-byte window has an anchor, the
least hashed 16-gram in it, so equal windows have equal anchors at the same offset; windows in a row with one
anchor are a segment. Segments of anchors found more than once are brought together by anchor, cut into blocks
of bounded size and sorted: suffixes smaller than their successors directly, all others induced from them by
bucket scans. Neighbours in that order with a common prefix of 100 bytes are equal windows; all but the first
by document and start are repeats.

Whole copies are set aside by digest before, and segments that occur as they are several times are sorted
once. Where anchors are too many for a broadcast, places meet by a join first, and bytes are cut out of texts where
an anchor is found again. So that no more than HOT segments meet in a sort, those of more frequent anchors are cut by how far windows start
before the anchor, and parts meet by the bytes that all their windows share; where more than HOT parts share even
these, by whole windows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_append, arrow_rows, checked_broadcast, heavy_join, own_names, stored

LENGTH = 100
GRAM = 16
#: Segments of one anchor that may meet in a task: under 3 MB of text, which is what a sort takes in memory.
HOT = 16384
#: Places of a window before its anchor that a part of a frequent anchor's segments has.
CELL = 12
#: Bytes of spans that may be broadcast.
SPAN_BYTES = 64 << 20
SEGMENT = ("hash", "id", "key", "first", "last", "body")
#: Bytes of segments that are sorted together.
BLOCK_BYTES = 1 << 20
#: Bytes of text that are anchored together; a power of two that positions fit in.
SPAN_BITS = 18
#: Bytes of rows that a call gets.
PIECE = 2 << 20


def _packed(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number; zeros after the end."""
    x = np.concatenate([t, np.zeros(7, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def anchored(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash of its 16-gram) of the anchor of each window of text; text has at most 2^SPAN_BITS bytes."""
    p8 = _packed(text)[: len(text) - 7]
    h = p8[:-8] * np.uint64(0x9E3779B97F4A7C15) + p8[8:]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << SPAN_BITS) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, length - GRAM + 1
    while 2 * width <= wanted:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if wanted > width:
        best = np.minimum(best[: len(best) - (wanted - width)], best[wanted - width :])
    place = (best & low).astype(np.int64)
    return place, h[place]


def segments_of(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each text its segments (first window start, last window start, anchor hash as a signed long)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    most = 1 << SPAN_BITS
    group: list[tuple[int, int, bytes]] = []
    filled = 0

    def flush():
        nonlocal filled
        if not group:
            return
        joined = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
        place, value = anchored(joined, length)
        sizes = np.array([len(part) for _, _, part in group])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(group)), sizes)[: len(place)]
        inside = np.arange(len(place)) + length <= (begins + sizes)[owner]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        own = owner[first]
        shift = begins[own] - np.array([at for _, at, _ in group])[own]
        whose = np.array([t for t, _, _ in group])[own]
        rows = zip(whose.tolist(), (first - shift).tolist(), (last - shift).tolist(), value[first].view(np.int64).tolist(), strict=True)
        for t, a, b, h in rows:
            out[t].append((a, b, h))
        group.clear()
        filled = 0

    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most - length + 1) if len(text) >= length else ():
            part = text[at : at + most]
            if filled + len(part) > most:
                flush()
            group.append((t, at, part))
            filled += len(part)
    flush()
    return out


def suffix_order(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of t, bytes with 0 as the end mark, ordered by at least `depth` bytes of their suffixes.

    Two-stage sorting: suffixes smaller than their successors are sorted by their bytes, eight at a time among
    those still equal; scanning the buckets upwards, each suffix then places the one before it, if that is
    larger, next in the bucket of its first byte.
    """
    n = len(t)
    key = np.concatenate([_packed(t), np.zeros(depth + 8, np.uint64)])
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.append(change, n - 1)  # of runs of one byte
    rises = np.append(t[change] < t[change + 1], True)
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], ends])))
    direct = np.flatnonzero(smaller).astype(np.int32)
    direct = direct[np.argsort(key[direct], kind="stable")]
    tied = np.zeros(len(direct), bool)
    same = key[direct[1:]] == key[direct[:-1]]
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.concatenate([[True], ~same]), dtype=np.int32) if len(direct) else np.zeros(0, np.int64)
    at = np.flatnonzero(tied)
    for d in range(8, depth, 8):
        if not len(at):
            break
        places, groups = direct[at], group[at]
        k = key[places + d]
        order = np.lexsort((k, groups))
        places, groups, k = places[order], groups[order], k[order]
        direct[at] = places
        same = (groups[1:] == groups[:-1]) & (k[1:] == k[:-1])
        fresh = np.cumsum(np.concatenate([[True], ~same]), dtype=np.int32)
        group[at] = fresh
        tied = np.zeros(len(at), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = at[tied]

    starts = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        larger = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32)
        parts, now = [larger], larger
        while len(now):  # runs of c: each round one byte longer
            now = now[now > 0] - 1
            now = now[t[now] == c]
            parts.append(now)
        bucket = np.concatenate([*parts, direct[starts[c] : starts[c + 1]]])
        waiting[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = t[before]
        above = first > c
        before, first = before[above], first[above]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for piece in np.split(before, cuts):
                waiting[int(t[piece[0]])].append(piece)
    return np.concatenate(out)


def equal_neighbours(t: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of order but the first, whether it has a common prefix of `length` bytes with the one before."""
    key = np.concatenate([_packed(t), np.zeros(length + 8, np.uint64)])
    left = np.arange(len(order) - 1)
    for d in [*range(0, length - 7, 8), length - 8]:
        left = left[key[order[left] + d] == key[order[left + 1] + d]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[left] = True
    return out


def repeats(block: list[tuple[object, int, int, int, bytes]], length: int = LENGTH) -> list[tuple[object, int, int, int]]:
    """(id, key, first, last window start) of the windows in segments (id, key, first, last, bytes) that start earlier
    too: in a text of a smaller id, or before in the same text, which id and key stand for."""
    out, rows = [], []
    seen: dict[bytes, tuple] = {}
    for segment in sorted(block, key=lambda x: x[:3]):
        doc, key, first, last, body = segment
        was = seen.setdefault(body, segment)
        if was is segment or (was[0] == doc and was[1] != key):  # texts of one id are no repeats of each other
            rows.append(segment)
        elif was[:3] != (doc, key, first):  # else the same place of a row that is repeated
            out.append((doc, key, first, last))
    t = np.frombuffer(b"".join(x[4] + b"\xff" for x in rows), np.uint8) + np.uint8(1)  # 255 is in no text; its successor is 0
    sizes = np.array([len(x[4]) + 1 for x in rows])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    is_start = np.arange(len(t), dtype=np.int32) + length < (begins + sizes).astype(np.int32)[owner]
    order = suffix_order(t, length)
    order = order[is_start[order]]
    if not len(order):
        return out
    group = np.cumsum(np.concatenate([[False], ~equal_neighbours(t, order, length)]))
    # Places grow with id, text and start. In each group the least id counts, and in each of its texts the first place.
    changes = lambda k: np.concatenate([[False], [x[:k] != y[:k] for x, y in zip(rows, rows[1:], strict=False)]]).cumsum()
    ids, texts = changes(1)[owner[order]], changes(2)[owner[order]]
    by_place = np.lexsort((order, texts, group))
    g, i, x, places = group[by_place], ids[by_place], texts[by_place], order[by_place]
    new_group = np.concatenate([[True], g[1:] != g[:-1]])
    least = i[new_group][np.cumsum(new_group) - 1]
    new_text = new_group | np.concatenate([[True], x[1:] != x[:-1]])
    gone = np.sort(places[(i != least) | ~new_text])
    if len(gone):
        new = np.ones(len(gone), bool)
        new[1:] = (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(gone)) - 1
        for a, b in zip(gone[first].tolist(), gone[last].tolist(), strict=True):
            doc, key, start, _, _ = rows[owner[a]]
            shift = start - int(begins[owner[a]])
            out.append((doc, key, a + shift, b + shift))
    return out


def _segments(texts: DataFrame, kind: str, columns: tuple[str, ...], length: int) -> DataFrame:
    """The columns, of hash, id, key, first, last and body, of each different segment of each text.

    Later places of a segment in the same text have a null hash, no body, and runs of them in one row.
    """

    def make():
        def work(cols):
            raw = [t or b"" for t in cols["text"]]
            out = {k: [] for k in columns}
            for doc, key, text, own in zip(cols["id"], cols["key"], raw, segments_of(raw, length), strict=True):
                seen, again, rows = set(), [], []
                for a, b, h in own:
                    body = text[a : b + length]
                    if body not in seen:
                        seen.add(body)
                        rows.append((h, doc, key, a, b, body))
                    elif again and again[-1][1] == a - 1:
                        again[-1][1] = b
                    else:
                        again.append([a, b])
                if "first" in columns:
                    rows += [(None, doc, key, a, b, None) for a, b in again]
                for at, name in enumerate(SEGMENT):
                    if name in out:
                        out[name] += [r[at] for r in rows]
            return out

        return work

    kinds = dict(zip(SEGMENT, ("long", kind, "long", "int", "int", "binary"), strict=True))
    return arrow_rows(texts, make, ", ".join(f"{c} {kinds[c]}" for c in columns), PIECE)


def _cells(body: bytes, length: int) -> list[tuple[int, int, int]]:
    """A segment cut by how far its windows start before their anchor, CELL places a part: (hash, first, last).

    All windows of a part hold the same length - CELL + 1 bytes, and the hash is of these; so equal windows, which
    have their anchor at the same place, are in parts of one hash.
    """
    last = len(body) - length
    anchor = int(anchored(np.frombuffer(body[:length], np.uint8), length)[0][0])
    out = []
    for c in range((anchor - last) // CELL, anchor // CELL + 1):
        at = anchor - CELL * c
        common = xxhash.xxh3_64_intdigest(body[at : at + length - CELL + 1], c)
        out.append((common - (1 << 63), max(0, at - CELL + 1), min(last, at)))
    return out


def _parts(segments: DataFrame, kind: str, length: int) -> DataFrame:
    """Segments cut into their cells."""

    def make():
        def work(cols):
            out = {k: [] for k in SEGMENT}
            for doc, key, first, body in zip(cols["id"], cols["key"], cols["first"], cols["body"], strict=True):
                for h, x, y in _cells(body, length):
                    for k, v in zip(out, (h, doc, key, first + x, first + y, body[x : y + length]), strict=True):
                        out[k].append(v)
            return out

        return work

    return arrow_rows(segments.select("id", "key", "first", "body"), make, f"hash long, id {kind}, key long, first int, last int, body binary", PIECE)


def _cut_out(texts: DataFrame, hits: DataFrame, kind: str, length: int) -> DataFrame:
    """(hash, id, key, first, last, body, n): the segments at hits(key, hash, first, last, n), cut out of their texts."""
    by_text = hits.groupBy("key").agg(F.collect_list(F.struct("hash", "first", "last", "n")).alias("hits")).withColumnRenamed("key", "of")
    held = texts.join(by_text, F.col("key") == F.col("of")).drop("of")

    def make():
        def work(cols):
            out = {k: [] for k in (*SEGMENT, "n")}
            for doc, key, text, own in zip(cols["id"], cols["key"], cols["text"], cols["hits"], strict=True):
                for hit in own:
                    h, a, b, n = hit["hash"], hit["first"], hit["last"], hit["n"]
                    if b + length <= len(text):  # else of another text with the same key
                        for k, v in zip(out, (h, doc, key, a, b, None if h is None else text[a : b + length], n), strict=True):
                            out[k].append(v)
            return out

        return work

    return arrow_rows(held, make, f"hash long, id {kind}, key long, first int, last int, body binary, n long", PIECE)


def _repeated_segments(texts: DataFrame, kind: str, length: int) -> DataFrame:
    """hash, id, key, first, last, body, n: segments whose anchor is found n > 1 times, and later places in a text.

    Places meet their anchors first, and bytes are cut out of the texts where one is found again. The most frequent
    anchors are broadcast, a number that doesn't grow, so that the join has no hot key.
    """
    anchors = _segments(texts, kind, ("hash",), length).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    often = stored(anchors, "suffix-anchors")
    places = _segments(texts, kind, ("hash", "key", "first", "last"), length)
    met = heavy_join(places.filter("hash IS NOT NULL"), often.withColumn("rows", F.col("n")), ["hash"], "rows", "key", 0)
    again = places.filter("hash IS NULL").withColumn("n", F.lit(0).cast("long"))
    found = _cut_out(texts, met.select("hash", "key", "first", "last", "n").unionAll(again.select("hash", "key", "first", "last", "n")), kind, length)
    return stored(found.select(*SEGMENT, "n"), "suffix-segments")


def _sorted_repeats(segments: DataFrame, kind: str, length: int) -> DataFrame:
    """(id, key, first, last): segments come sorted by hash and are taken in blocks that end between hashes."""
    import pyarrow as pa

    names = ("id", "key", "first", "last", "body")

    def run(batches):
        block, held, last_hash = [], 0, None
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
        for batch in batches:
            for h, *segment in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hash", *names)), strict=True):
                if held >= BLOCK_BYTES and h != last_hash:
                    yield made(repeats(block, length))
                    block, held = [], 0
                block.append(tuple(segment))
                held += len(segment[-1])
                last_hash = h
        if block:
            yield made(repeats(block, length))

    from pyspark.sql import types as T

    from .common import _arrow_schema

    out = T.StructType.fromDDL(f"id {kind}, key long, first int, last int")
    schema = _arrow_schema(out)
    return segments.select("hash", *names).repartition("hash").sortWithinPartitions("hash").mapInArrow(run, out)


def _window_repeats(segments: DataFrame, kind: str, length: int) -> DataFrame:
    """(id, key, first, last) of single windows. A group of equal windows has nothing to sort: its least id and each
    text's first place are found by map-side aggregation, however large it is."""

    def make():
        def work(cols):
            out = {k: [] for k in ("w1", "w2", "id", "key", "at")}
            for doc, key, first, body in zip(cols["id"], cols["key"], cols["first"], cols["body"], strict=True):
                for k in range(len(body) - length + 1):
                    d = xxhash.xxh3_128_digest(body[k : k + length])
                    for name, v in zip(out, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc, key, first + k), strict=True):
                        out[name].append(v)
            return out

        return work

    windows = arrow_rows(segments.select("id", "key", "first", "body"), make, f"w1 long, w2 long, id {kind}, key long, at int")
    # Places of one text: its first is known apart, all later ones are repeats whatever the other texts hold.
    own = stored(windows.groupBy("w1", "w2", "id", "key").agg(F.min("at").alias("at"), F.sort_array(F.collect_set("at")).alias("every")), "suffix-windows")
    later = own.select("id", "key", F.explode(F.slice("every", 2, F.greatest(F.lit(1), F.size("every")))).alias("at"))
    least = own.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    others = own.join(least, ["w1", "w2"]).filter("id <> least").select("id", "key", "at")
    return others.unionAll(later).select("id", "key", F.col("at").alias("first"), F.col("at").alias("last"))


@own_names("__of", "__key", "__spans", "__own")
def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes gone from text_col, which becomes binary; adds n_bytes, n_removed, n_spans (long).

    A byte goes if some string of `length` bytes that covers it also starts earlier in the input: in a row of
    a smaller id, or before it in the same text. Null and empty texts have no bytes. Rows that repeat an id
    are one document: they aren't earlier than each other, and each of their texts loses what smaller ids have
    and its own repeats. Rows with null ids are left as they are but for repeats within them, and nothing is
    earlier for being in them. Other columns stay; clashing names are replaced. What is left may be no valid
    UTF-8.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(id_col, text_col)  # stands for a text of an id; ids are compared beside it where that matters
    texts = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= length)).select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    digests = texts.select("id", "key", F.octet_length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    keepers = digests.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("other")).filter("keeper <> other").select("digest", "keeper")
    copies = stored(digests.join(keepers, "digest").filter("id <> keeper").select("id", "key", "n").distinct(), "suffix-copies")
    gone = checked_broadcast(copies.select(F.col("id").alias("copy"), F.col("key").alias("copy_key")), 128)
    firsts = texts.join(gone, (F.col("id") == F.col("copy")) & (F.col("key") == F.col("copy_key")), "left_anti")

    segments = _repeated_segments(firsts, kind, length)
    parts = [segments.filter("hash IS NULL").select("id", "key", "first", "last"), _sorted_repeats(segments.filter(F.col("hash").isNotNull() & (F.col("n") <= HOT)), kind, length)]
    if segments.filter(F.col("n") > HOT).limit(1).count():
        cells = stored(_parts(segments.filter(F.col("n") > HOT), kind, length), "suffix-cells")
        counted = stored(cells.join(cells.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "hash"), "suffix-counted")
        parts += [_sorted_repeats(counted.filter(F.col("n") <= HOT), kind, length), _window_repeats(counted.filter(F.col("n") > HOT), kind, length)]
    parts.append(copies.select("id", "key", F.lit(0).alias("first"), (F.col("n") - length).cast("int").alias("last")))
    spans = reduce(DataFrame.unionAll, parts).groupBy(F.col("id").alias("__of"), F.col("key").alias("__key")).agg(F.collect_list(F.struct("first", "last")).alias("__spans"))
    spans = stored(spans, "suffix-spans")
    weight = spans.agg(F.coalesce(F.sum(F.size("__spans") * 32 + 128), F.lit(0))).first()[0]
    names = ("n_bytes", "n_removed", "n_spans")
    base = docs.drop(*names)
    joined = base.join(F.broadcast(spans) if weight <= SPAN_BYTES else spans, (base[id_col] == F.col("__of")) & (F.xxhash64(base[id_col], base[text_col]) == F.col("__key")), "left")
    joined = joined.drop("__of", "__key").withColumn("__own", F.col(id_col).isNull())

    def make():
        def work(cols):
            out = {k: [] for k in (text_col, *names)}
            for text, given, alone in zip(cols[text_col], cols["__spans"], cols["__own"], strict=True):
                text = text or b""
                ranges = [(s["first"], s["last"] + length) for s in given or ()]
                if alone and len(text) >= length:
                    block = [(0, 0, a, b, text[a : b + length]) for a, b, _ in segments_of([text], length)[0]]
                    ranges = [(a, b + length) for _, _, a, b in repeats(block, length)]
                runs: list[list[int]] = []
                for a, b in sorted(ranges):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                out[text_col].append(b"".join(kept))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
            return out

        return work

    return arrow_append(joined, [text_col, "__spans", "__own"], make, f"`{text_col}` binary, n_bytes long, n_removed long, n_spans long", PIECE).drop("__spans", "__own")
