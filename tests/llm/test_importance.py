"""Importance resampling against counts, weights and ranks made in one place."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from regimark.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def runs(text):
    w = WORD.findall(lower(text))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def expected(docs, target, percent=5, least=20):
    t, s = Counter(), Counter()
    for x in target:
        t.update(runs(x)[0])
    for _, x in docs:
        s.update(runs(x)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    rows = []
    for k, (i, x) in enumerate(docs):
        found, words = runs(x)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words, k])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def some_docs(rng, n):
    words = ["the", "Of", "ÄRGER", "x9", "naïve", "a" * 60, "b" * 300, "42", "中文", "é", *[f"w{k}" for k in range(80)]]
    blanks = [" ", "\n", ", ", "--", "\x00", "_"]
    docs = [(k, "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 40, 200])))) for k in range(n)]
    docs += [(5, docs[5][1])] * 40 + [(None, docs[7][1])] * 3 + [(n + 1, None), (n + 2, ""), (n + 3, " .. "), (n + 4, "long word " * 30_000)]
    docs += [(n + 10 + k, docs[9][1]) for k in range(50)]
    rng.shuffle(docs)
    return docs


def got(frame):
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("percent, range_rows", [(5, 200_000), (40, 10), (100, 30)])
def test_is_the_plain_draw(spark, monkeypatch, percent, range_rows):
    monkeypatch.setattr(importance, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(importance, "BINS", 16)
    rng = random.Random(percent)
    docs, target = some_docs(rng, 300), ["the w1 w2 w3 of", None, "w4 W5"]
    frame = spark.createDataFrame([(i, x, "clash", 1) for i, x in docs], "doc_id long, text string, score string, row int").repartition(7)
    bench = spark.createDataFrame([(x, k) for k, x in enumerate(target)], "text string, item_id int")
    assert got(importance.resample(frame, bench, percent)) == expected(docs, target, percent)


def test_empty_and_small_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([("a b c",)], "text string")
    assert got(importance.resample(docs, bench)) == []
    few = [(1, "a b"), (2, "w " * 25)]
    assert got(importance.resample(spark.createDataFrame(few, docs.schema), bench)) == expected(few, ["a b c"])
    many = [(k, f"w{k} " * 25) for k in range(30)]
    assert got(importance.resample(spark.createDataFrame(many, docs.schema), bench.limit(0))) == expected(many, [])


def test_ids_of_text(spark):
    docs = [(f"id{k}", "w " * 25) for k in range(200)] + [(None, "w " * 30)]
    frame = importance.resample(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("w",)], "text string"), 50)
    drawn = sorted((r for r in frame.collect() if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 101))
    assert drawn == sorted(drawn, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or ""))


def test_hashes_of_runs():
    rng = random.Random(3)
    for texts in ([], [None], [b""], [b"a"], [rng.randbytes(rng.randint(0, 200)) for _ in range(60)], [b"x" * 1000, b"y" * 48 + b" " + b"z" * 49]):
        found, of, words = importance.features(texts)
        for k, t in enumerate(texts):
            w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or b"").lower())
            assert words[k] == len(w)
            assert sorted(found[of == k].tolist()) == sorted(zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_tournament_is_a_sort():
    rng = random.Random(4)
    for k in (1, 2, 3, 5, 8, 13):
        own = [sorted((rng.randint(0, 30), r, x) for x in range(rng.randint(0, 12))) for r in range(k)]
        assert [own[r][at] for r, at in importance.tournament(own)] == sorted(x for run in own for x in run)
    assert list(importance.tournament([])) == []


def test_cut_is_a_rank(spark):
    rng = np.random.default_rng(5)
    for values in (rng.integers(-(10**12), 10**12, 500), rng.integers(0, 3, 500), np.zeros(500, int)):
        frame = spark.createDataFrame([(int(v),) for v in values], "v long")
        down = np.sort(values)[::-1]
        for draw in (1, 77, 500):
            assert importance.score_cut(frame, "v", draw) == down[draw - 1]
        assert importance.score_cut(frame, "v", 501) is None and importance.score_cut(frame, "v", 0) is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert got(queries.op11_importance_resampling(spark, sf)) == expected(docs, target)
