"""Operators that compare rows: line, chunk, near-duplicate and suffix dedup, and the pipeline."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regimark.llm import cdc_dedup, common, line_dedup, minhash_dedup, suffix_dedup
from regimark.llm.components import components

MANY = [f"{a}{b}{c}" for a in "bcdfghlmnprst" for b in "aeiou" for c in ("", "ng", "st", "lor", "mane")]


def prose(rng, n):
    return " ".join(rng.choice(MANY) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_removed string")


def test_lines(spark):
    rng = random.Random(1)
    line = [prose(rng, 12) for _ in range(6)]
    rows = [(k, "\n".join([prose(rng, 9), rng.choice(line).upper() + " \t", "short", rng.choice(line)])) for k in range(40)]
    rows += [(50, None), (51, ""), (52, line[0] + "\n" + line[0]), (None, line[0])]

    def brute(rows):
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
        held = collections.defaultdict(set)
        for d, t in rows:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40 and d is not None:
                    held[key(x)].add(d)
        gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
        return {d: "\n".join(x for x in (t or "").split("\n") if key(x) not in gone or gone[key(x)] == d) for d, t in rows}

    want = brute(rows)
    got = line_dedup.dedup_lines(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_removed"] == "clash" for r in got)
    assert all(r["n_lines"] - r["n_dropped"] == (len(want[r["doc_id"]].split("\n")) if r["n_dropped"] < r["n_lines"] else 0) for r in got)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_lines_by_shuffled_joins_and_without_ids(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 2)
    for module, name in ((line_dedup, "BROADCAST_BYTES"), (common, "BROADCAST_BYTES")):
        monkeypatch.setattr(module, name, 0)
    monkeypatch.setattr(line_dedup, "heavy_join", lambda *a: common.heavy_join(*a, 0))
    rng = random.Random(19)
    line = [prose(rng, 12) for _ in range(6)]
    rows = [(k, line[k % 6] + "\n" + line[0], 5, 6) for k in range(40)] + [(None, line[0] + "\nown", 5, 6), (None, line[1] + "\nother\n" + line[0], 5, 6), (None, None, 5, 6)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_dropped int")).collect()
    kept = {k: [x for j, x in enumerate(t.split("\n")) if k == max(d for d, u, *_ in rows[:40] if x in u.split("\n"))] for k, t, *_ in rows[:40]}
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] is not None} == {k: "\n".join(v) for k, v in kept.items()}
    assert sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] is None) == [("", 1, 0), ("other", 3, 2), ("own", 2, 1)]


def test_near_duplicates_are_exact(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.randint(4, 120)).split() for _ in range(25)]
    rows = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(MANY)
        rows.append((k, " ".join(w)))
    shared = prose(rng, 40)
    rows += [(200 + k, shared + " " + prose(rng, 25)) for k in range(40)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "One  TWO"), (5, rows[5][1])]
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    for percent in (80, 85):
        parent = {d: d for d in sets}

        def find(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for a, s in sets.items():
            for b, t in sets.items():
                if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        got = minhash_dedup.near_duplicates(docs_of(spark, rows), percent=percent).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (len(s), find(d), d == find(d)) for d, s in sets.items()}


def test_near_duplicates_without_rows_or_ids(spark):
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    got = minhash_dedup.near_duplicates(docs_of(spark, [(None, "a b c"), (None, "a b c"), (4, "a b c")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(None, 4, False), (4, 4, True)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks(spark):
    rng = random.Random(3)
    passage = prose(rng, 80)
    rows = [(k, prose(rng, rng.randint(30, 90))) for k in range(20)]
    rows += [(30, prose(rng, 40) + " " + passage + " " + prose(rng, 40)), (31, prose(rng, 33) + " " + passage + prose(rng, 20)), (32, rows[3][1] * 1), (40, None), (41, ""), (42, "ab" * 4000), (None, passage)]
    got = {r["doc_id"]: r for r in cdc_dedup.dedup_chunks(docs_of(spark, rows)).collect()}
    texts = dict(rows)
    for d, r in got.items():
        raw = (texts[d] or "").encode()
        assert r["n_bytes"] == len(raw) == len(r["text"]) + r["n_removed"]
        if d is not None and d < 31:
            assert r["n_removed"] == 0
    assert got[31]["n_removed"] > 0.6 * len(passage) and got[31]["n_spans"] == 1 and bytes(got[31]["text"]).startswith(texts[31][:100].encode())
    assert got[32]["n_removed"] == got[32]["n_bytes"] and got[None]["n_removed"] > 0 and got[42]["n_removed"] > 4000
    assert cdc_dedup.dedup_chunks(docs_of(spark, [])).count() == 0
    for t in (passage.encode(), b"a" * 3000, b"", b"xyz"):
        ends = cdc_dedup.chunk_ends(t)
        assert (ends[-1] if ends else 0) == len(t) and all(0 < b - a <= cdc_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))


def without_repeated_chunks(rows):
    """{(id, text): (n_chunks, kept)}, byte by byte."""
    gear, window = cdc_dedup.GEAR.tolist(), cdc_dedup.WINDOW

    def chunks(x):
        ends, last, at = [], None, 0
        for end in range(window, len(x) + 1):
            if len(x) <= window:
                break
            h = 0
            for byte in x[end - window : end]:
                h = (h * 2 + gear[byte]) % (1 << 16)
            if h < (1 << 16) // cdc_dedup.SPACING:
                if last is None or end - last >= cdc_dedup.MIN_CHUNK:
                    while end - at > cdc_dedup.MAX_CHUNK:
                        at += cdc_dedup.MAX_CHUNK
                        ends.append(at)
                    at = end
                    ends.append(at)
                last = end
        while len(x) - at > cdc_dedup.MAX_CHUNK:
            at += cdc_dedup.MAX_CHUNK
            ends.append(at)
        if at < len(x):
            ends.append(len(x))
        return [x[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    made = {(d, t): chunks((t or "").encode()) for d, t in rows}
    least = {}
    for (d, _), own in made.items():
        for c in own:
            if d is not None:
                least[c] = min(d, least.get(c, d))
    want = {}
    for (d, t), own in made.items():
        seen, runs, open_run = set(), [], False
        for k, c in enumerate(own):
            repeat = c in seen or (c in least and least[c] != d)
            seen.add(c)
            if repeat and open_run:
                runs[-1].append(k)
            elif repeat:
                runs.append([k])
            open_run = repeat
        gone = {k for r in runs if sum(len(own[k]) for k in r) >= cdc_dedup.MIN_RUN or len(r) == len(own) for k in r}
        want[d, t] = (len(own), b"".join(c for k, c in enumerate(own) if k not in gone))
    return want


@pytest.mark.parametrize("few", [False, True])
def test_chunks_are_exact(spark, few, monkeypatch):
    rng = random.Random(16)
    if few:  # the joins of large tables, with few keys broadcast
        monkeypatch.setattr(cdc_dedup, "BROADCAST", 0)
        monkeypatch.setattr(common, "HEAVY", 5)
    passages = [prose(rng, 50) for _ in range(4)]
    rows = [(k, prose(rng, rng.randint(0, 40)) + rng.choice([*passages, ""]) + prose(rng, rng.randint(0, 40))) for k in range(50)]
    rows += [(60, rows[3][1]), (61, "short copy"), (62, "short copy"), (63, None), (64, ""), (65, "q" * 3000), (66, rows[3][1] + "x"), (67, rows[3][1]), (67, passages[0]), (67, passages[0]), (None, passages[1]), (None, prose(rng, 60)), (None, rows[5][1])]
    want = without_repeated_chunks(rows)
    tagged = spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id long, text string, n_chunks string").withColumn("was", F.col("n_chunks"))
    got = cdc_dedup.dedup_chunks(tagged).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_chunks"], bytes(r["text"])) == want[r["doc_id"], r["was"]], r["doc_id"]


def test_heavy_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 2)
    rng = random.Random(17)
    rows = [(rng.choice([1, 1, 1, 2, rng.randrange(40)]), k, str(k)) for k in range(400)] + [(None, 900, "x")]
    small = [(k, 10 * k, sum(r[0] == k for r in rows)) for k in range(0, 60, 3)] + [(1, None, 300)]
    left, right = spark.createDataFrame(rows, "k long, id long, x string"), spark.createDataFrame(small, "k long, y long, w long")
    for limit in (0, 1 << 20):
        got = common.heavy_join(left, right, ["k"], "w", "id", limit)
        assert sorted((r["k"], r["id"], r["x"], str(r["y"])) for r in got.collect()) == sorted((k, i, x, str(y)) for k, i, x in rows for j, y, _ in small if k == j)


def test_near_duplicates_of_one_large_group(spark):
    rng = random.Random(18)
    base = prose(rng, 120).split()
    rows = []
    for k in range(400):  # most lie too far from each other, some only near through others
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(MANY)
        rows.append((k, " ".join(w)))
    sets = {d: frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = minhash_dedup.near_duplicates(docs_of(spark, rows), percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label and 1 < len(set(label.values())) < 400


def without_repeats(rows):
    """{(id, text): (n_bytes, n_removed, n_spans, kept)} by brute force; texts of one id aren't earlier than each other."""
    want, held = {}, set()
    for d in sorted({d for d, _ in rows if d is not None}) + [None]:
        texts = {t for e, t in rows if e == d}
        for t in texts:
            x = (t or "").encode()
            seen, gone = set() if d is None else set(held), bytearray(len(x))
            for p in range(len(x) - 99):
                if x[p : p + 100] in seen:
                    gone[p : p + 100] = b"\1" * 100
                seen.add(x[p : p + 100])
            want[d, t] = (len(x), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), bytes(b for b, g in zip(x, gone, strict=True) if not g))
        held |= {x[p : p + 100] for x in ((t or "").encode() for t in texts) for p in range(len(x) - 99)}
    return want


@pytest.mark.parametrize("hot,broadcast", [(suffix_dedup.HOT, None), (30, 0), (3, 0), (1, None)])
def test_suffixes_are_exact(spark, hot, broadcast, monkeypatch):
    rng = random.Random(4)
    passages = [prose(rng, 40) for _ in range(4)]
    rows = []
    for k in range(60):
        t = prose(rng, rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            t += " " + rng.choice(passages)[rng.randint(0, 60) :] + prose(rng, rng.randint(0, 12))
        rows.append((k, rows[rng.randrange(k)][1] if k and k % 9 == 0 else t + "é" * (k % 3)))
    rows += [(70, None), (71, ""), (72, "a" * 700), (73, "ab" * 300), (74, passages[0] * 3)]
    # Ids that repeat with other texts, with the same one, and rows without an id.
    rows += [(80, rows[5][1]), (80, prose(rng, 60)), (81, prose(rng, 9) + passages[1]), (81, passages[1] + prose(rng, 9)), (81, passages[1] * 2)]
    rows += [(90, "x" + rows[64][1] + "y"), (91, rows[64][1]), (91, rows[64][1]), (None, passages[2]), (None, passages[2] + prose(rng, 5) + passages[2])]
    want = without_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    if broadcast is not None:
        monkeypatch.setattr(suffix_dedup, "SPAN_BYTES", broadcast)
        monkeypatch.setattr(suffix_dedup, "checked_broadcast", lambda df, *_: df)
    tagged = spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id long, text string, n_spans string").withColumn("was", F.col("n_spans"))
    got = suffix_dedup.dedup_substrings(tagged).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) == want[r["doc_id"], r["was"]], r["doc_id"]


def test_suffixes_without_rows_or_ids(spark):
    assert suffix_dedup.dedup_substrings(docs_of(spark, [])).count() == 0
    t = "x" * 50 + prose(random.Random(5), 60)
    got = suffix_dedup.dedup_substrings(docs_of(spark, [(1, t), (1, t), (None, t)])).collect()
    assert [r["n_removed"] for r in got] == [0, 0, 0]


def test_later_texts_of_an_id_count(spark):
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    got = suffix_dedup.dedup_substrings(docs_of(spark, [(3, a), (5, a), (5, b), (9, prose(rng, 30) + b)])).collect()
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(3, 0), (5, len(a)), (5, 0), (9, len(b))}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, left, sf).cache()
        assert new.columns == docs.columns and new.count() <= left.count()
        left = new
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert out.keys() == texts.keys() and 0 < len(out) < docs.count()
    assert all(out[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items())
    sets = [frozenset(zip(*((t.lower().split())[k:] for k in range(5)), strict=False)) for t in texts.values() if t and len(t.split()) > 5]
    assert not any(a is not b and 5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_columns_named_like_internal_ones(spark):
    text = "a line that is long enough to count as one of them " * 4
    rows = [(k, text, "x", k, "y", 3) for k in range(6)]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    odd = spark.createDataFrame(rows, "doc_id long, text string, __key string, __of int, __DROPS string, __own int")
    for f in (line_dedup.dedup_lines, cdc_dedup.dedup_chunks, suffix_dedup.dedup_substrings):
        got = f(odd)
        assert set(odd.columns) < set(got.columns)
        assert sorted((r["doc_id"], bytes(r["text"], "utf8") if isinstance(r["text"], str) else bytes(r["text"]), r["__key"], r["__of"], r["__own"]) for r in got.collect()) == sorted(
            (r["doc_id"], bytes(r["text"], "utf8") if isinstance(r["text"], str) else bytes(r["text"]), "x", r["doc_id"], 3) for r in f(plain).collect()
        )
        renamed = plain.withColumnRenamed("text", "__key")
        assert f(renamed, "doc_id", "__key").columns[:2] == ["doc_id", "__key"] or "__key" in f(renamed, text_col="__key").columns
