"""Merges of scored pieces (SentencePiece's BPE kind) by a table of prefixes, and decoding.

The best merges of a text end, whatever follows, in one last token for each of its prefixes. So a table is filled
from left to right: an automaton gives the pieces that end at a place, and the one whose predecessor (the last token
of the shorter prefix) is compatible with it is that prefix's last token. Ids are then recovered backwards.
Two tokens are compatible if merging their joined text gives these two again; that is found by undoing merges from
the latest on, or, for tokens whose merges don't come in order of rank, by merging. Texts are cut where no piece
spans, so that words that repeat are encoded once a task.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import re
from itertools import chain, groupby

import ahocorasick
from pyspark.sql import DataFrame

from .common import arrow_rows

SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Spaces with the letters or the other characters behind them; a line break stands alone.
WORD = re.compile(rf"{SPACE}*[^\W\d_²]+|{SPACE}*(?:[^\w{SPACE}\n]|[\d_²])+|{SPACE}+|\n")
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: In the table: the prefix ends with a character that no piece holds.
NO_PIECE = -1
#: Words of a generation; two are kept, so that words which come again stay.
CACHED_WORDS = 100_000
CACHED_LENGTH = 64
CACHED_PAIRS = 1_000_000


def merge_plain(text: str, ranks: dict[str, int]) -> list[tuple[str, tuple | None]]:
    """(token, the two that it was merged from) of text, merging the pair of the least rank first, leftmost first
    among equals. For pieces and pairs of pieces, which are short."""
    tokens: list[tuple[str, tuple | None]] = [(c, None) for c in text]
    while len(tokens) > 1:
        found = [(r, i) for i in range(len(tokens) - 1) if (r := ranks.get(tokens[i][0] + tokens[i + 1][0])) is not None]
        if not found:
            break
        _, i = min(found)
        tokens[i : i + 2] = [(tokens[i][0] + tokens[i + 1][0], (tokens[i], tokens[i + 1]))]
    return tokens


class PieceModel:
    """What encoding needs of a model file: pieces that merges reach, their ranks and last merges, ids of bytes.

    Only models of the BPE kind with identity normalisation, byte fallback, a dummy space in front and no removal of
    spaces are taken; others raise.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        if kind.model_type != 2 or not kind.byte_fallback or kind.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("not a model of merges with bytes, a dummy space and texts taken as they are")
        if any(p.type in (USER, UNUSED) for p in spec.pieces):
            raise ValueError("models with pieces of users or unused ones are not known")
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.byte_ids = [0] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.end_id = self.pieces.index(kind.eos_piece or "</s>")
        scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[s] for p, s in scores.items()}
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.rank = [self.ranks.get(p, -1) for p in self.pieces]
        self.parts: list[tuple[int, int] | None] = [None] * len(self.pieces)
        self.reached, self.in_order = [], [False] * len(self.pieces)
        for p, i in sorted(ids.items(), key=lambda x: len(x[0])):
            tokens = merge_plain(p, self.ranks)
            if len(tokens) > 1:
                continue  # merges of its text end in other tokens, so it never comes up
            self.reached.append(i)
            self.in_order[i] = True
            if tokens[0][1]:
                a, b = (ids[x[0]] for x in tokens[0][1])
                self.parts[i] = a, b
                # A part needs its own text to end in it; it does, as nothing outside has touched it.
                self.in_order[i] = all(self.in_order[x] and (self.parts[x] is None or self.rank[x] < self.rank[i]) for x in (a, b))
        if not {c for p in ids for c in p} <= ids.keys():
            raise ValueError("a character of a piece is no piece")
        #: Whether WORD cuts no piece; else texts stay whole.
        self.cuts = all(WORD.fullmatch(p) for p in ids)


class PieceCoder:
    def __init__(self, model: PieceModel):
        self.m = model
        self.length = [len(p) for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for i in model.reached:
            self.automaton.add_word(model.pieces[i], i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        #: word -> number of its ids, their decimals joined by spaces, its decoded text, ids
        self.words: dict[str, tuple[int, str, str, list[int]]] = {}
        self.old: dict[str, tuple[int, str, str, list[int]]] = {}
        self.decimals = [str(i) for i in range(len(model.pieces))]
        self.shown = [p.replace(SPACE, " ") if k == NORMAL else None for p, k in zip(model.pieces, model.kinds, strict=True)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b ends in a and b."""
        known = self.pairs.get(a << 20 | b)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            ordered = self.m.in_order[a] and self.m.in_order[b]
            known = self.pairs[a << 20 | b] = self._undone(a, b) if ordered else [t for t, _ in merge_plain(self.m.pieces[a] + self.m.pieces[b], self.m.ranks)] == [self.m.pieces[a], self.m.pieces[b]]
        return known

    def _undone(self, a: int, b: int) -> bool:
        """Back in time: at each moment the tokens beside the border must not merge before one of them goes on.

        A merge over the border wins against one in b of the same rank, as it lies to its left, and loses to one in a.
        """
        pieces, ranks, rank, parts = self.m.pieces, self.m.ranks, self.m.rank, self.m.parts
        until = len(pieces)
        while True:
            over = ranks.get(pieces[a] + pieces[b])
            if over is not None and over < until:
                return False
            if parts[b] is None or (parts[a] is not None and rank[a] > rank[b]):
                if parts[a] is None:
                    return True
                until, a = rank[a], parts[a][1]
            else:
                until, b = rank[b] + 1, parts[b][0]

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text whose spaces are escaped."""
        last = [NO_PIECE] * (len(text) + 1)
        length, pairs, compatible = self.length, self.pairs, self.compatible
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                begin = end - length[token]
                if begin:
                    before = last[begin]
                    if before >= 0:
                        fits = pairs.get(before << 20 | token)
                        if not (compatible(before, token) if fits is None else fits):
                            continue
                last[end] = token
        ids, at = [], len(text)
        while at:
            token = last[at]
            if token < 0:
                at -= 1
                ids.extend(self.m.byte_ids[x] for x in reversed(text[at].encode("utf-8")))
            else:
                ids.append(token)
                at -= length[token]
        return ids[::-1]

    def parts(self, text: str) -> list[str]:
        """text with escaped spaces and the dummy one in front, cut where no piece spans."""
        text = SPACE + text.replace(" ", SPACE)
        return WORD.findall(text) if self.m.cuts else [text]

    def encoded(self, text: str) -> list[tuple[int, str, str, list[int]]]:
        """The encoded parts of a text, the dummy space in front included."""
        if not text:
            return []
        out, words = [], self.words
        for w in self.parts(text):
            known = words.get(w)
            if known is None:
                known = self.old.get(w)
                if known is None:
                    ids = self.encode_part(w)
                    known = len(ids), " ".join([self.decimals[i] for i in ids]), self.surface(ids), ids
                if len(w) <= CACHED_LENGTH:
                    if len(words) > CACHED_WORDS:
                        self.old, self.words = words, {}
                        words = self.words
                    words[w] = known
            out.append(known)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text with the end id."""
        return [*chain.from_iterable(x[3] for x in self.encoded(text)), self.m.end_id]

    def surface(self, ids: list[int]) -> str:
        """Text of ids, the dummy space included; runs of bytes that are no UTF-8 give a replacement character a byte."""
        with contextlib.suppress(TypeError):  # a byte, a control id or the unknown one among them
            return "".join([self.shown[i] for i in ids])
        out = []
        for is_bytes, run in groupby(ids, lambda i: self.m.kinds[i] == BYTE):  # other ids, control ones too, end a run
            if is_bytes:
                out.append(_decoded(bytes(int(self.m.pieces[i][3:5], 16) for i in run)))
            else:
                out += ["" if (k := self.m.kinds[i]) == CONTROL else UNKNOWN_SURFACE if k == UNKNOWN else self.m.pieces[i].replace(SPACE, " ") for i in run]
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first space of the first piece is the dummy one and goes."""
        text, kinds = self.surface(ids), self.m.kinds
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        return text[1:] if first is not None and kinds[first] == NORMAL and text.startswith(" ") else text


def _decoded(raw: bytes) -> str:
    """UTF-8 as text, with a replacement character for each byte that belongs to no whole character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return raw[: e.start].decode("utf-8") + "�" + _decoded(raw[e.start + 1 :])


def piece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each document's ids, the end id last, and the text decoded from them.

    Returns id_col, n_tokens (end id included), ids_sha256 (of decimals joined by spaces), decoded_sha256 and, if
    with_ids, ids array<int> and decoded string. A null or empty text has the end id alone and decodes to the empty
    text. Characters that no piece holds become their bytes' ids. Rows are independent: null or repeated ids and
    other columns don't matter. The table of a text without a space to cut at is as long as that text; the time is
    linear in it. The model is read once on the driver and broadcast; its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        gc.set_threshold(200_000, 50, 100)  # many long-lived tuples and no cycles
        coder = PieceCoder(shared.value)
        end = str(coder.m.end_id)

        def work(cols):
            out = {id_col: cols[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            kept_ids, kept_text = [], []
            for raw in cols[text_col]:
                parts = coder.encoded((raw or b"").decode("utf-8", "replace"))
                decoded = "".join([x[2] for x in parts])[1:]
                out["n_tokens"].append(sum([x[0] for x in parts]) + 1)
                out["ids_sha256"].append(hashlib.sha256(" ".join([*[x[1] for x in parts], end]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    kept_ids.append([*chain.from_iterable([x[3] for x in parts]), coder.m.end_id])
                    kept_text.append(decoded)
            return out | ({"ids": kept_ids, "decoded": kept_text} if with_ids else {})

        return work

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return arrow_rows(docs.select(id_col, text_col), make, schema, 1 << 20)
