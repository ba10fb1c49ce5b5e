"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For each item size, rounded down by less than an eighth, there are windows of that many words over every text,
a seventh of a window apart. A window's SimHash sums the bits of its word pairs, by differences of running sums.
Fingerprints are cut into blocks; two within the radius agree in some block up to radius // blocks bits, so each item is filed under all
such variants of its blocks and every window within the radius is found. Candidates are then compared at every
start near them by the weighted Jaccard similarity of their word shingles. As similar windows can lie between the
fingerprinted ones or beyond the radius, texts also meet the items by their rarest shingles, of which any similar
window holds one, and are compared at every start that covers it; so none is missed. Texts of fewer words than an
item are compared as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_append, stored

BLOCKS = 4
BLOCK_BITS = 16
RADIUS = 15
#: Windows begin so many to a window's length.
WINDOWS_A_SIZE = 7
#: Items of like size share windows, up to one in so many words less than they have.
SIZES_AN_OCTAVE = 8
SHINGLE = 5
SIMILARITY = 0.8
#: Items, and bytes of them, that one index holds; larger benchmarks take several passes over the texts.
ITEMS_PER_PASS = 5_000
BYTES_PER_PASS = 8 << 20
#: Words that are fingerprinted together, so that memory doesn't follow a text's length.
SPAN = 16_000
# Characters that words are compared without.
PUNCTUATION = b".,;:!?\"'()[]{}<>|*#_`~-"


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation."""
    return text.lower().translate(None, PUNCTUATION).split()


def shingles_of(words: list[bytes]) -> Counter:
    """Counted runs of five words; of fewer words the whole."""
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[k]) for k, n in a.items())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def rolling_similarities(words: list[bytes], size: int, wanted: Counter) -> list[float]:
    """weighted_jaccard of wanted and the shingles of each window of `size` words, SHINGLE at least."""
    grams = list(zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    n = size - SHINGLE + 1
    held = Counter(grams[:n])
    common, total = sum(min(k, held[g]) for g, k in wanted.items()), sum(wanted.values()) + n
    out = [common / (total - common)]
    for gone, new in zip(grams, grams[n:], strict=False):
        common -= held[gone] <= wanted[gone]
        held[gone] -= 1
        common += held[new] < wanted[new]
        held[new] += 1
        out.append(common / (total - common))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_bits(hashes: np.ndarray) -> np.ndarray:
    """Row i: for each of the 64 bits, how many of the first i word pairs have it set, modulo 2^16; differences
    hold for windows of fewer words. hashes: of single words."""
    pairs = _mixed(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(pairs.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(pairs) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, out=out[1:], dtype=np.uint16)
    return out


def fingerprints(sums: np.ndarray, size: int, step: int) -> np.ndarray:
    """SimHash of the windows of `size` words, size < 2^16, at each step-th word."""
    n = max(1, size - 1)
    ones = sums[n::step] - sums[: len(sums) - n : step]
    return np.packbits(ones > n // 2, axis=1, bitorder="little").view("<u8").ravel()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """One for each run of SHINGLE words, from the hashes of single words; equal runs have equal ones."""
    n = max(0, len(hashes) - SHINGLE + 1)
    out = hashes[:n]
    for k in range(1, SHINGLE):
        out = _mixed(out * np.uint64(3) + hashes[k : n + k])
    return out


def rarest(wanted: Counter, often: Counter) -> list[tuple]:
    """Shingles of an item that are more than its similar texts may lack, those of few items first."""
    out, held, total = [], 0, sum(wanted.values())
    for k in sorted(wanted, key=lambda k: (often[k], k)):
        if held > (1 - SIMILARITY) * total + 1e-9:
            break
        out.append(k)
        held += wanted[k]
    return out


def window_size(words: int) -> int:
    """Words of the windows for an item: its own number, rounded down by less than an eighth."""
    return words - words % max(1, words // SIZES_AN_OCTAVE)


class BlockIndex:
    """Items of one size by all variants of their blocks that lie within the errors a block may have: for each
    group of up to 64 items and each block a table from the block's value to the set of items, as bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        flips = [0]
        for k in range(1, radius // BLOCKS + 1):
            flips += [sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), k)]
        flips = np.array(flips, np.int64)
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)
        self.group = next((n for n in (8, 16, 32) if len(prints) <= n), 64)
        kind = np.dtype(f"u{self.group // 8}").type  # small tables stay in the processor's cache
        self.tables = np.zeros((-(-len(prints) // self.group), BLOCKS, 1 << BLOCK_BITS), kind)
        for i, own in enumerate(blocks):
            for b in range(BLOCKS):
                self.tables[i // self.group, b, own[b] ^ flips] |= kind(1 << i % self.group)

    def within(self, prints: np.ndarray) -> np.ndarray:
        """All (row of prints, item) whose fingerprints differ in at most radius bits, each once, as row * items + item."""
        found = [np.zeros(0, np.int64)]
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        for g, tables in enumerate(self.tables):
            held = tables[0].take(blocks[:, 0])
            for b in range(1, BLOCKS):
                held |= tables[b].take(blocks[:, b])
            rows = np.flatnonzero(held)
            held, own = held[rows], prints[rows]
            for i in range(self.group * g, min(self.group * (g + 1), len(self.prints))):
                near = (np.bitwise_count(own ^ self.prints[i]) <= self.radius) & ((held >> tables.dtype.type(i % self.group)) & tables.dtype.type(1)).astype(bool)
                found.append(rows[near] * len(self.prints) + i)
        return np.concatenate(found)


class Benchmark:
    """Items by size, with their index and shingles."""

    def __init__(self, items: list[tuple[int, bytes]]):
        by_size: dict[int, list] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                by_size.setdefault(window_size(len(words)), []).append((item, words))
        self.sizes = {}
        for size, own in sorted(by_size.items()):
            sums = [running_bits(word_hashes(w)) for _, w in own]
            prints = np.concatenate([fingerprints(s, len(w), len(w)) if size > 1 else np.zeros(1, np.uint64) for s, (_, w) in zip(sums, own, strict=True)])
            self.sizes[size] = (BlockIndex(prints), [i for i, _ in own], [shingles_of(w) for _, w in own], [len(w) for _, w in own], {w[0]: [i for i, x in own if x == w] for _, w in own if len(w) == 1})
        self.longest = max((n for x in self.sizes.values() for n in x[3]), default=0)
        # Anchors: hashes of each item's rarest shingles, sorted, with their items.
        self.items = [(i, len(w), shingles_of(w)) for own in by_size.values() for i, w in own if len(w) >= SHINGLE]
        often = Counter(k for _, _, wanted in self.items for k in wanted)
        anchors = [(k, j) for j, (_, _, wanted) in enumerate(self.items) for k in rarest(wanted, often)]
        hashes = shingle_hashes(word_hashes([w for k, _ in anchors for w in k]))[::SHINGLE]
        order = np.argsort(hashes, kind="stable")
        self.anchors, self.anchored = hashes[order], np.array([j for _, j in anchors], np.int64)[order]

    def leaks(self, texts: list[list[bytes]]) -> list[dict]:
        """For each text {item: (similarity, first start)} of the items that some window holds."""
        found: list[dict] = [{} for _ in texts]
        if not self.sizes:
            return found
        # Texts side by side, long ones in overlapping parts, so that arrays are large and bounded.
        group: list[tuple[int, int, list[bytes]]] = []
        filled = 0
        for t, words in enumerate(texts):
            for at in range(0, max(1, len(words) - self.longest + 1), SPAN):
                part = words[at : at + SPAN + self.longest + self.longest // 6 + 2]
                group.append((t, at, part))
                filled += len(part)
                if filled >= SPAN:
                    self._search(group, texts, found)
                    group, filled = [], 0
        if group:
            self._search(group, texts, found)
        return found

    def _search(self, group: list[tuple[int, int, list[bytes]]], texts: list[list[bytes]], found: list[dict]) -> None:
        words = [w for _, _, part in group for w in part]
        if len(words) < 2:
            words += [b""] * (2 - len(words))
        lengths = np.array([len(part) for _, _, part in group])
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(group)), lengths)
        hashes = word_hashes(words)
        self._anchored(hashes, owner, begins, group, texts, found)
        sums = running_bits(hashes)
        for size, (index, items, shingles, lengths_of, whole) in self.sizes.items():
            if size <= 1:
                for g, (t, at, part) in enumerate(group):
                    for k, w in enumerate(part):
                        for i in whole.get(w, ()):
                            found[t].setdefault(i, (1.0, at + k))
                continue
            if size > len(words):
                continue
            step = max(1, size // WINDOWS_A_SIZE)
            keys = index.within(fingerprints(sums, size, step))
            starts = keys // len(items) * step
            for start, i in zip(starts, keys % len(items), strict=True):
                first, last = int(owner[start]), int(owner[start + size - 1])
                for g in {first, last}:  # a window over a border stands for the nearest one on either side
                    if lengths[g] >= size:
                        t, at, _ = group[g]
                        inside = min(max(int(start - begins[g]), 0), int(lengths[g]) - size)
                        self._verify(texts[t], inside + at - (lengths_of[i] - size), inside + at, lengths_of[i], step, items[i], shingles[i], found[t])

    def _anchored(self, hashes: np.ndarray, owner: np.ndarray, begins: np.ndarray, group: list, texts: list[list[bytes]], found: list[dict]) -> None:
        """Compares texts with the items of which they hold an anchor, in all windows that hold it."""
        own = shingle_hashes(hashes[: len(owner)])
        first, end = np.searchsorted(self.anchors, own), np.searchsorted(self.anchors, own, side="right")
        met: dict[tuple[int, int], list[int]] = {}
        for start in np.flatnonzero(first < end):
            g = owner[start]
            if g == owner[start + SHINGLE - 1]:  # not over a border
                t, at, _ = group[g]
                for j in self.anchored[first[start] : end[start]]:
                    met.setdefault((t, int(j)), []).append(int(start - begins[g]) + at)
        for (t, j), places in sorted(met.items()):
            item, size, wanted = self.items[j]
            if len(texts[t]) < size:
                similarity = weighted_jaccard(shingles_of(texts[t]), wanted)
                if similarity >= SIMILARITY - 1e-12:
                    found[t][item] = max(found[t].get(item, (0.0, 0)), (similarity, 0))
                continue
            low = high = None
            for place in sorted(places):
                if high is not None and place - size + SHINGLE > high + 1:
                    self._verify(texts[t], low, high, size, 0, item, wanted, found[t])
                    low = None
                low, high = place - size + SHINGLE if low is None else low, place
            self._verify(texts[t], low, high, size, 0, item, wanted, found[t])

    @staticmethod
    def _verify(words: list[bytes], first: int, last: int, size: int, step: int, item: int, wanted: Counter, found: dict) -> None:
        low, high = max(0, first - step), min(len(words) - size, last + step)
        best, at = found.get(item, (0.0, 0))
        if high < low or (best >= 1 and at <= low):
            return
        # Of a set's shingles 2 s / (1 + s) are common; a word that is lacking costs at least one.
        own = {w for k in wanted for w in k}
        if len(own.difference(words[low : high + size])) * (1 + SIMILARITY) > (1 - SIMILARITY) * sum(wanted.values()) + 1e-9:
            return
        near = shingles_of(words[low : high + size])
        # Of the shingles of both, a similarity of s needs 2 s / (1 + s) of the item's own.
        if size >= SHINGLE and sum(min(n, near[k]) for k, n in wanted.items()) * (1 + SIMILARITY) < 2 * SIMILARITY * sum(wanted.values()) - 1e-9:
            return
        if size < SHINGLE:
            similarities = (weighted_jaccard(shingles_of(words[s : s + size]), wanted) for s in range(low, high + 1))
        else:
            similarities = rolling_similarities(words[low : high + size], size, wanted)
        for s, similarity in enumerate(similarities, low):
            if similarity >= SIMILARITY - 1e-12 and (similarity > best or (similarity == best and s < at)):
                best, at = found[item] = (similarity, s)


def flag_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with leaks: array of (item_id, similarity, start) of the benchmark items that the text holds.

    An item counts as held if some window of as many words as it has is similar by 0.8 or more, by counted
    shingles of five words; items of fewer words must occur as they are. A text of fewer words than the item is
    compared as a whole. start is the window's first word.
    Null or empty texts and items hold nothing and are held by nothing. Rows are judged one by one: null or
    repeated ids don't matter, all other columns stay, and a column named leaks is replaced. Item ids may be of
    any type and null; each row of the benchmark is an item. The benchmark is read to the driver in passes of
    about ITEMS_PER_PASS items and BYTES_PER_PASS bytes, one after another.
    """
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).filter("t IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    passes = max(1, -(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = docs.drop("leaks")
    for k in range(passes):
        some = items if passes == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        held = sorted(((r["i"], r["t"].encode()) for r in some.collect()), key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))
        shared = docs.sparkSession.sparkContext.broadcast(held)
        name = "leaks" if passes == 1 else f"__leaks{k}"
        out = arrow_append(out, [text_col], _maker(shared, text_col, name), f"{name} array<struct<item_id: {kind}, similarity: double, start: int>>")
        if passes > 1:
            out = stored(out, "leaks-pass")
            shared.unpersist()
    if passes > 1:
        parts = [f"__leaks{k}" for k in range(passes)]
        out = out.withColumn("leaks", F.concat(*parts)).drop(*parts)
    return out


def _maker(shared, text_col: str, name: str):
    def make():
        items = shared.value
        held = Benchmark([(j, text) for j, (_, text) in enumerate(items)])

        def work(cols):
            found = held.leaks([words_of(t or b"") for t in cols[text_col]])
            return {name: [[{"item_id": items[j][0], "similarity": s, "start": at} for j, (s, at) in sorted(f.items())] for f in found]}

        return work

    return make


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and item it holds: id_col, item_id, similarity, start."""
    flagged = flag_leaks(docs.select(id_col, text_col), benchmark, text_col)
    return flagged.select(id_col, F.explode("leaks").alias("l")).select(id_col, "l.item_id", "l.similarity", "l.start")
