"""Encoding by scored pieces against the library, and the compatibility of pairs against plain merging."""

import hashlib
import random

import pytest

from regimark.llm import piece_bpe
from regimark.llm.common import default_path

PATH = default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceCoder(piece_bpe.PieceModel(PATH))


def texts(coder, rng):
    letters = " \n\t\x00abzé'srelvd1½²!?ß中\U0001f600▁́ñ<>/s0xA"
    long_pieces = [p for p in coder.m.pieces if len(p) > 3]
    yield from ["", " ", "  a ", "\n", "▁", "a▁b", "<s>x</s><unk>", "<0x0A>", "�", "a" * 900, " " * 700, "ab " * 100, "x" * 3 + "é" * 300]
    for _ in range(500):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
    for _ in range(200):
        yield "".join(rng.choice(" ethanori") for _ in range(150))
    for _ in range(500):
        yield "".join(rng.choice(long_pieces) for _ in range(12))


def test_is_the_library(spark, library, coder):
    rows = [None, *texts(coder, random.Random(1))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in piece_bpe.piece_encode(docs, PATH).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(rows):
        ids = library.encode(t or "", add_eos=True)
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids), t
        assert got[k]["decoded"] == library.decode(ids), t
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_whole_texts_without_cuts(library, coder, monkeypatch):
    monkeypatch.setattr(coder.m, "cuts", False)
    for t in texts(coder, random.Random(2)):
        assert coder.encode(t) == library.encode(t, add_eos=True)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(piece_bpe, "CACHED_PAIRS", 5)
    small = piece_bpe.PieceCoder(piece_bpe.PieceModel(PATH))
    for t in texts(small, random.Random(3)):
        assert small.encode(t) == library.encode(t, add_eos=True)


def test_any_ids_decode_like_the_library(library, coder):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 10))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_undone_merges_are_plain_merging(coder):
    m, rng = coder.m, random.Random(5)
    ordered = [i for i in m.reached if m.in_order[i]]
    for _ in range(3000):
        a, b = rng.choice(ordered), rng.choice(ordered)
        tokens = [t for t, _ in piece_bpe.merge_plain(m.pieces[a] + m.pieces[b], m.ranks)]
        assert coder._undone(a, b) == (tokens == [m.pieces[a], m.pieces[b]]), (m.pieces[a], m.pieces[b])


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (1, "a", "y"), (1, "a", "y")], "doc_id long, text string, n_tokens string")
    assert [r["n_tokens"] for r in piece_bpe.piece_encode(docs, PATH, with_ids=False).collect()] == [2, 2, 2]
    assert piece_bpe.piece_encode(docs.filter("false"), PATH).count() == 0


def test_other_models_raise(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PATH, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        piece_bpe.PieceModel(str(tmp_path / "other.model"))
