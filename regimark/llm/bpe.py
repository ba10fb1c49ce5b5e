"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding.

Each leaf of the tree holds `rank << 32 | position` of the mergeable pair that starts there, so the root is
the leftmost pair of the lowest rank. A merge changes three leaves: O(log n) each, O(n log n) for a word of
any length. Short words of a batch go through it together, one tree a row of an array; each task keeps a bounded
cache of encoded pieces, as words repeat.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import arrow_rows

# The pattern that splits text before the merges of byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 62
PAD = 0xFFFFF
CACHED_PIECES = 120_000
CACHED_LENGTH = 48


def byte_alphabet() -> dict[str, int]:
    """Printable character -> byte: bytes that print stand for themselves, the others follow from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of single bytes, merges as {left << 20 | right: (rank << 20 | merged)}, bytes of each id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes = {i: as_bytes(t) for t, i in vocab.items()}
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}


def merge_word(ids: list[int], merges: dict[int, int]) -> list[int]:
    """ids after all merges, lowest rank first, leftmost first among equals."""
    n = len(ids) - 1
    if n < 1:
        return ids
    get = merges.get
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    made = [0] * (n + 1)
    for i in range(n):
        found = get(ids[i] << 20 | ids[i + 1])
        if found is not None:
            tree[size + i] = (found >> 20) << 32 | i
            made[i] = found & 0xFFFFF
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == NONE:
        return ids
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    ids = list(ids)
    alive = [True] * (n + 1)

    def put(i: int, value: int) -> None:
        k = size + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    while (root := tree[1]) != NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        ids[i] = made[i]
        alive[j] = False
        k = after[i] = after[j]
        if j < n:
            put(j, NONE)
        if k <= n:
            before[k] = i
            found = get(ids[i] << 20 | ids[k])
            if found is None:
                put(i, NONE)
            else:
                made[i] = found & 0xFFFFF
                put(i, (found >> 20) << 32 | i)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            found = get(ids[h] << 20 | ids[i])
            if found is None:
                put(h, NONE)
            else:
                made[h] = found & 0xFFFFF
                put(h, (found >> 20) << 32 | h)
    return [x for x, there in zip(ids, alive, strict=True) if there]


class PairTable:
    """merges as arrays: found(left, right) for whole columns, by open addressing."""

    def __init__(self, merges: dict[int, int]):
        keys = np.fromiter(merges.keys(), np.int64, len(merges))
        values = np.fromiter(merges.values(), np.int64, len(merges))
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # the last writer of a slot wins it
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.mask = (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id, or -1."""
        shape, keys = left.shape, (left << 20 | right).ravel()
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out.reshape(shape)


def merge_many(words: list[bytes], byte_ids: np.ndarray, pairs: PairTable) -> list[list[int]]:
    """merge_word for many words of like length at once: row w of the arrays is the tree of word w."""
    count, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    longest = int(lengths.max(initial=0))
    there = np.arange(longest + 1) < lengths[:, None]  # the last column is the end of the longest word
    ids = np.full((count, longest + 1), PAD, np.int64)
    ids[there] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    if longest < 2:
        return [row[:1].tolist() for row in ids]
    size = 1 << (longest - 2).bit_length()
    value = lambda found, at: np.where(found < 0, NONE, (found >> 20) << 32 | at)
    made = pairs.found(ids[:, :-1], ids[:, 1:])
    tree = np.full((count, 2 * size), NONE, np.int64)
    tree[:, size : size + longest - 1] = value(made, np.arange(longest))[:, : longest - 1]
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    made &= 0xFFFFF
    after = np.tile(np.arange(1, longest + 2), (count, 1))
    before = np.tile(np.arange(-1, longest), (count, 1))
    alive = there
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        i = tree[rows, 1] & 0xFFFFFFFF
        j = after[rows, i]
        k = np.minimum(after[rows, j], longest)
        ids[rows, i] = made[rows, i]
        ids[rows, j] = PAD
        alive[rows, j] = False
        after[rows, i] = k
        before[rows, k] = i
        h = before[rows, i]
        right = pairs.found(ids[rows, i], ids[rows, k])
        made[rows, i] = right & 0xFFFFF
        left = np.where(h >= 0, pairs.found(ids[rows, h], ids[rows, i]), -1)
        made[rows, h] = np.where(h >= 0, left & 0xFFFFF, made[rows, h])
        # Leaf j goes first and leaf h last but for words without one, where h repeats i.
        leaves = [(np.minimum(j, size - 1) + size, np.where(j < size, NONE, tree[rows, 2 * size - 1]))]
        leaves.append((i + size, value(right, i)))
        leaves.append((np.where(h >= 0, h, i) + size, np.where(h >= 0, value(left, h), value(right, i))))
        for at, new in leaves:
            tree[rows, at] = new
        paths = [at for at, _ in leaves]
        for _ in range(size.bit_length() - 1):
            paths = [at >> 1 for at in paths]
            for at in paths:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        rows = rows[tree[rows, 1] != NONE]
    flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs = PairTable(vocabulary.merges)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int64)
        self.decimals = [str(i) for i in range(max(vocabulary.token_bytes) + 1)]
        self.token_bytes = [vocabulary.token_bytes.get(i, b"") for i in range(len(self.decimals))]
        self.split = regex.compile(SPLIT_PATTERN)
        #: piece between spaces -> ids, their decimals joined by commas, their bytes; with and without a space before it
        self.chunks: dict[str, tuple[list[int], str, bytes]] = {}
        # A space that opens no word: such texts are not cut at their spaces.
        self.odd_space = re.compile(r" (?=[\s\x1c-\x1f]|\Z)")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None

    def pieces(self, text: str) -> list[str]:
        """text cut where a cut changes no id. No word of the pattern holds a space after its first place, so a
        space before a non-space begins a word; special strings stand alone."""
        if self.special is not None and any(s in text for s in self.v.special):
            return [p for part in self.special.split(text) for p in ([part] if part in self.v.special else self.pieces(part) if part else [])]
        if self.odd_space.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]

    def learn(self, wanted: set[str]) -> dict[str, tuple[list[int], str, bytes]]:
        """Encodes pieces; the short ones are kept for later texts."""
        special, findall = self.v.special, self.split.findall
        wanted = list(wanted)
        split = [[p] if p in special else findall(p) for p in wanted]
        words = list(set(chain.from_iterable(split)) - special.keys())
        raw = [w.encode("utf-8") for w in words]
        groups: dict[int, list[int]] = {}
        for at, b in enumerate(raw):
            groups.setdefault((len(b) - 2).bit_length() if len(b) > 1 else 0, []).append(at)
        ids: dict[str, list[int]] = {w: [i] for w, i in special.items()}
        of = self.v.byte_ids
        for bits, places in groups.items():
            for start in range(0, len(places), 20_000):
                some = places[start : start + 20_000]
                if bits > 6:  # a tree for each, as long as they are
                    merged = [merge_word([of[b] for b in raw[at]], self.v.merges) for at in some]
                else:
                    merged = merge_many([raw[at] for at in some], self.byte_ids, self.pairs)
                ids.update(zip([words[at] for at in some], merged, strict=True))
        decimals, token_bytes, made = self.decimals, self.token_bytes, {}
        for p, own in zip(wanted, split, strict=True):
            t = ids[own[0]] if len(own) == 1 else [i for w in own for i in ids[w]]
            made[p] = (t, ",".join([decimals[i] for i in t]), b"".join([token_bytes[i] for i in t]))
        if len(self.chunks) > CACHED_PIECES:
            self.chunks.clear()
        self.chunks |= {p: x for p, x in made.items() if len(p) <= CACHED_LENGTH}
        return made

    def bytes_of(self, ids) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def encode_all(self, texts: list[str]) -> list[list[tuple[list[int], str, bytes]]]:
        """For each text its encoded pieces: ids, decimals, decoded bytes."""
        cut = [self.pieces(t) for t in texts]
        wanted = set().union(*cut)
        known = {p: x for p in wanted if (x := self.chunks.get(p)) is not None}
        known |= self.learn(wanted - known.keys())
        return [[known[p] for p in c] for c in cut]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(x[0] for x in self.encode_all([text])[0]))

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each document's ids and the text decoded from them.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids array<int> and decoded string.
    Strings of special tokens in a text become their ids, as the vocabulary's library does by default. A null
    or empty text has no ids and decodes to the empty text. Rows are independent: null or repeated ids and
    other columns don't matter. The vocabulary is read once on the driver and broadcast; its size is fixed.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        gc.set_threshold(200_000, 50, 100)  # many long-lived tuples and no cycles
        coder = Encoder(shared.value)

        def work(cols):
            out = {id_col: cols[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            kept_ids, kept_text = [], []
            texts = [(raw or b"").decode("utf-8", "replace") for raw in cols[text_col]]
            for pieces in coder.encode_all(texts):
                decoded = b"".join([x[2] for x in pieces]).decode("utf-8", "replace")
                out["n_tokens"].append(sum([len(x[0]) for x in pieces]))
                out["ids_sha256"].append(hashlib.sha256(",".join([x[1] for x in pieces if x[1]]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    kept_ids.append(list(chain.from_iterable([x[0] for x in pieces])))
                    kept_text.append(decoded)
            return out | ({"ids": kept_ids, "decoded": kept_text} if with_ids else {})

        return work

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return arrow_rows(docs.select(id_col, text_col), make, schema, 1 << 20)
