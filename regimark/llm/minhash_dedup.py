"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures.

A document's set of word shingles gives a signature of 40 symbols of 16 bits. Signatures that differ in at most
19 symbols agree, by pigeonhole, in some of 10 chunks up to one of its 4 symbols; each chunk is filed four
times, with one symbol left out, so every such pair shares a key. Links are confirmed on whole sets.

Equal sets are one class from the start. In each group of a key all are compared to its smallest id first,
which is linear. Sets of groups that then still hold several components are met by their rarest shingles, of
which all linked sets share one: first with the least altered set of each shingle's group, which is linear again,
then those outside its component with all others, where sizes and places of the shingle allow a link. A pair is
made once, at the first shingle that both hold. So a group of near copies or of texts around one passage is never
expanded into all its pairs, and no link between different sets is lost.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checked_broadcast, heavy_join, stored
from .components import components

SHINGLE = 5
CHUNKS = 10
SYMBOLS_A_CHUNK = 4
SYMBOLS = CHUNKS * SYMBOLS_A_CHUNK
#: The largest number of errors that leaves some chunk at most one: 2 * CHUNKS - 1.
RADIUS = 2 * CHUNKS - 1
LONGS = SYMBOLS // 4
#: Shingles are counted in so many bits' worth of slots.
COUNT_BITS = 20
SIGNATURE = [f"s{k}" for k in range(LONGS)]

_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `shingle` words, A-Z lower-cased; of fewer words the whole;
    of none nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    seed = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(seed, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        mixed = (mixed ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """40 symbols of 16 bits, as 10 long integers."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * FACTORS + OFFSETS
        np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0), out=low)
    symbols = ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype("<u2")
    return symbols.view("<i8")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """For rows of signatures their 40 keys: chunk and place left out in the high bits, then three symbols."""
    symbols = signatures.view("<u2").reshape(len(signatures), CHUNKS, SYMBOLS_A_CHUNK).astype(np.int64)
    out = np.empty((len(signatures), CHUNKS, SYMBOLS_A_CHUNK), np.int64)
    for left_out in range(SYMBOLS_A_CHUNK):
        a, b, c = (k for k in range(SYMBOLS_A_CHUNK) if k != left_out)
        out[:, :, left_out] = symbols[:, :, a] << 32 | symbols[:, :, b] << 16 | symbols[:, :, c]
    out |= (np.arange(CHUNKS)[:, None] * SYMBOLS_A_CHUNK + np.arange(SYMBOLS_A_CHUNK)) << 48
    return out.reshape(len(signatures), -1)


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, s0..s9): set size, digest of the set, signature."""

    def make():
        def work(cols):
            out = {k: [] for k in ("id", "n", "d1", "d2", *SIGNATURE)}
            for doc, text in zip(cols[id_col], cols[text_col], strict=True):
                s = shingle_set(text or b"")
                digest = xxhash.xxh3_128_digest(s.tobytes())
                row = (doc, len(s), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), *signature(s).tolist())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs.select(id_col, text_col), make, f"id {kind}, n long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in SIGNATURE))


def _keys(classes: DataFrame) -> DataFrame:
    """(key, rep) for each of the 40 keys of each class."""

    def make():
        def work(cols):
            signatures = np.array([cols[s] for s in SIGNATURE], np.int64).T.copy()
            keys = keys_of(signatures) if len(signatures) else np.zeros((0, SYMBOLS), np.int64)
            return {"key": keys.ravel().tolist(), "rep": [r for r in cols["rep"] for _ in range(SYMBOLS)]}

        return work

    return arrow_rows(classes.select("rep", *SIGNATURE), make, f"key long, rep {classes.schema['rep'].dataType.simpleString()}")


def _distance(a: _Named, b: _Named):
    """Symbols that differ: each 16-bit lane of a xor is folded to one bit."""
    total = F.lit(0)
    for s in SIGNATURE:
        x = a[s].bitwiseXOR(b[s])
        for k in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _near(a: _Named, b: _Named, percent: int):
    """What every link has: sizes within the ratio, signatures within the radius."""
    return (100 * F.least(a.n, b.n) >= percent * F.greatest(a.n, b.n)) & (_distance(a, b) <= RADIUS)


def _needed(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id is among ids(need)."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(checked_broadcast(ids, 32), F.col("id") == F.col("need"), "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, shingles): each different set of each needed id, made once."""

    def make():
        def work(cols):
            sets = [shingle_set(t or b"").tobytes() for t in cols["text"]]
            return {"id": cols["id"], "d1": [int.from_bytes(xxhash.xxh3_128_digest(s)[:8], "big", signed=True) for s in sets], "shingles": sets}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    made = arrow_rows(_needed(docs, ids, id_col, text_col), make, f"id {kind}, d1 long, shingles binary")
    return stored(made.dropDuplicates(["id", "d1"]), "near-sets")


def _ids_of(pairs: DataFrame) -> DataFrame:
    one = lambda c: pairs.select(F.col(c).alias("need")).distinct()
    return stored(one("a").unionAll(one("b")).distinct(), "near-ids")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough. A hub's set goes to all its pairs; skew joins split those."""
    one, two = sets.select(F.col("id").alias("ida"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("idb"), F.col("shingles").alias("sb"))
    joined = pairs.join(two, pairs.b == two.idb).join(one, pairs.a == one.ida).select("a", "b", "sa", "sb")

    def make():
        def work(cols):
            out = {"a": [], "b": []}
            for a, b, sa, sb in zip(cols["a"], cols["b"], cols["sa"], cols["sb"], strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    kind = pairs.schema["a"].dataType.simpleString()
    return stored(arrow_rows(joined, make, f"a {kind}, b {kind}").distinct(), "near-links")


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, n, token, at): of each set of n shingles the n - ceil(percent n / 100) + 1 that come first in one order,
    with their place in it.

    Two sets that are similar enough share percent of each at least, so they share one of these whatever the
    order is. The order is by frequency among these sets, rare ones first, from a table of 2^20 counts that
    shingles are hashed into; its size is fixed.
    """
    slots = np.uint64((1 << COUNT_BITS) - 1)

    def make_counts():
        def work(cols):
            held = np.frombuffer(b"".join(cols["shingles"]), np.uint64)
            slot, n = np.unique(held & slots, return_counts=True)
            return {"slot": slot.astype(np.int64).tolist(), "n": n.tolist()}

        return work

    counts = arrow_rows(sets.select("shingles"), make_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2^20 rows at most
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def make():
        often = shared.value

        def work(cols):
            out = {"rep": [], "n": [], "token": [], "at": []}
            for doc, raw in zip(cols["id"], cols["shingles"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                first = len(s) - (percent * len(s) + 99) // 100 + 1
                own = s[np.lexsort((s, often[(s & slots).astype(np.int64)]))[:first]] if len(s) else s
                out["token"] += own.view(np.int64).tolist()
                out["at"] += range(len(own))
                out["rep"] += [doc] * len(own)
                out["n"] += [len(s)] * len(own)
            return out

        return work

    return arrow_rows(sets.select("id", "shingles"), make, f"rep {sets.schema['id'].dataType.simpleString()}, n int, token long, at int")


def _reach(n, at, percent: int):
    """Size that a set may have at most to be linked with one of n shingles if what they share begins at its place `at`."""
    return F.floor((n - at) * (100 + percent) / percent + 1e-9) - n


def _step(n):
    """Sizes by steps of 5 %."""
    return F.floor(F.log(n) / F.log(F.lit(1.05))).cast("int")


def _bound(percent: int):
    """What two sets can share, if that begins at their places `at`, must be enough for a link."""
    return (100 + percent) * F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2")) >= percent * (F.col("n") + F.col("n_2"))


def _labelled(met: DataFrame, labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """met(token, at, rep, n) with the label of rep, and the hub of the token and its label as at_2, rep_2, n_2, label_2.
    hubs has the number of a token's sets too, so that frequent tokens are met without a hot key."""
    other = hubs.join(labels.select(F.col("node").alias("rep_2"), F.col("label").alias("label_2")), "rep_2", "left").withColumn("label_2", F.coalesce("label_2", "rep_2"))
    named = labels.select(F.col("node").alias("rep"), "label")
    return heavy_join(met, other, ["token"], "sets", "rep", 0).join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()


def _to_hubs(labelled: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets of other components than the hub of one of their tokens, with that hub; linear in the rows."""
    return _pairs(labelled.filter((F.col("label") != F.col("label_2")) & _bound(percent)))


def _what_is_left(labelled: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different components that may be linked.

    One of two sets of different components is outside the component of their token's hub; only those are met
    with the others, and with those whose size their token's place allows. Of the tokens that two sets share the
    first has the places that say how much they can share at most, and later ones say less.
    """
    rows = stored(labelled.select("token", "at", "rep", "n", "label", F.col("label_2").alias("hub"), _step(F.col("n")).alias("step")), "near-placed")
    outside = rows.filter("label <> hub").withColumn("low", _step(F.ceil(F.col("n") * percent / 100 - 1e-9)))
    outside = outside.withColumn("high", _step(F.greatest(F.lit(1), _reach(F.col("n"), F.col("at"), percent)))).filter("low <= high")
    outside = outside.drop("step", "hub").withColumn("step", F.explode(F.sequence("low", "high"))).drop("low", "high")
    two = rows.select("token", "step", *[F.col(c).alias(f"{c}_2") for c in ("at", "rep", "n", "label", "hub")])
    once = (F.col("label_2") == F.col("hub_2")) | (F.col("rep") < F.col("rep_2"))
    return _pairs(outside.join(two, ["token", "step"]).filter((F.col("label") != F.col("label_2")) & once & _bound(percent)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id, kept of every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; percent is 80 or
    more, for which the radius was chosen (a link of exactly 80 is missed with a chance of 2e-5, of 85 with
    2e-7). component_id is the smallest id that can be reached, kept whether that is the row's own. Null,
    empty and blank texts have no shingles, are linked with nothing and kept. Rows that repeat an id are one
    document with the links of each of them. A row with a null id is given the component of its copies, which
    is null, and the row kept, if all of them have null ids.
    """
    rows = stored(sets_of(docs, id_col, text_col), "near-rows")
    classes = stored(
        rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), *[F.max(s).alias(s) for s in SIGNATURE]), "near-classes"
    )
    linkable = classes.filter("rep IS NOT NULL")
    keys = _keys(linkable)
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("sets")).filter("hub <> last").drop("last")
    multi = stored(heavy_join(keys, stored(hubs, "near-hubs"), ["key"], "sets", "rep", 0), "near-keys")

    signed = linkable.select("rep", "n", *SIGNATURE)
    first = _filtered(multi.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), signed, percent)
    links = _confirmed(first, _sets(docs, _ids_of(first), id_col, text_col), percent)
    labels = components(links)

    # What is left: pairs of a key's group in different components. Groups that hold such pairs may be large, as
    # of texts around one passage; they are split by the members' rarest shingles, of which every link has one.
    placed = multi.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("sets")).filter("low <> high").select("key", "sets")
    reps = heavy_join(placed, stored(mixed, "near-mixed"), ["key"], "sets", "rep", 0).select(F.col("rep").alias("need")).distinct()
    reps = stored(reps, "near-rest")
    sets = _sets(docs, reps, id_col, text_col)
    tokens = stored(_rarest(sets, percent), "near-rarest")
    # The hub of a token is the set with the fewest shingles before it, the least altered one of its group.
    hubs = tokens.groupBy("token").agg(F.min(F.struct("at", "rep", "n")).alias("h"), F.max("rep").alias("most"), F.min("rep").alias("least"), F.count("*").alias("sets")).filter("least < most")
    hubs = stored(hubs.select("token", "sets", F.col("h.at").alias("at_2"), F.col("h.rep").alias("rep_2"), F.col("h.n").alias("n_2")), "near-token-hubs")
    for search in (_to_hubs, _what_is_left):
        pairs = _filtered(search(_labelled(tokens, labels, hubs), percent), signed, percent)
        links = links.unionAll(_confirmed(pairs, sets, percent))
        labels = components(links)

    of_class = classes.join(labels, classes.rep == labels.node, "left").select("d1", "d2", "copies", F.coalesce("label", "rep").alias("component"))
    held = heavy_join(rows.filter("n > 0").select("id", "n", "d1", "d2"), stored(of_class, "near-of-class"), ["d1", "d2"], "copies", "id", 0).select("id", "n", "component")
    whole = held.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


class _Named:
    """Columns by their name and a suffix, for conditions over two sides."""

    def __init__(self, suffix: str):
        self._suffix = suffix

    def __getitem__(self, name: str):
        return F.col(name + self._suffix)

    __getattr__ = __getitem__


def _filtered(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which sizes and signatures allow a link."""
    one, two = signed.toDF(*[f"{c}_1" for c in signed.columns]), signed.toDF(*[f"{c}_2" for c in signed.columns])
    both = pairs.join(one, pairs.a == F.col("rep_1")).join(two, pairs.b == F.col("rep_2"))
    return stored(both.filter(_near(_Named("_1"), _Named("_2"), percent)).select("a", "b").distinct(), "near-pairs")
