"""The manifest against trees built in one place, on groups of many sizes and with small subtrees and partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from regimark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(leaves):
    """Root, and per leaf its siblings level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append((nodes[run:i], nodes[i + 1 : run + 8]))
            at[k] = i // 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[g] = (own, *tree([leaf_of(r) for r in own]))
    root, above = tree([built[g][1] for g in order])
    out = []
    for k, g in enumerate(order):
        own, sub, paths = built[g]
        for r, p in zip(own, paths, strict=True):
            path = p + above[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            x = leaf_of((*r[:4], text))
            for left, right in path:
                x = h(*left, x, *right)
            out.append((r[0], leaf_of(r), sub, root, h(*(d for left, right in path for d in (*left, *right))), x, x == root))
    return sorted(out, key=repr)


def some_rows(rng, sizes):
    texts = [None, "", "Ärger", "plain", "A Text\nof Lines", "x" * 40_000, "Ünder A-Z"]
    rows, k = [], 0
    for lang, n in sizes:
        for _ in range(n):
            k += rng.randint(1, 3)
            rows.append((k, rng.choice([None, "", "web", "code"]), lang, rng.choice([None, 0, 17]), rng.choice(texts), "clash"))
    rng.shuffle(rows)
    return rows


def got(spark, docs):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, low).otherwise(F.col("text"))
    frame = merkle.manifest(docs, now={"text": changed})
    assert frame.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("height, part_rows", [(5, 200_000), (1, 40), (2, 7)])
def test_is_the_plain_tree(spark, monkeypatch, height, part_rows):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    rng = random.Random(height)
    sizes = [("de", 1), ("en", 650), (None, 9), ("", 8), ("fr", 64), ("é", 65), ("zz", 2), *[(f"g{k}", rng.randint(1, 3)) for k in range(15)]]
    rows = some_rows(rng, sizes)
    rows += [rows[5]] * 30 + [(None, "web", "en", 3, "No Id", "y")] * 3 + [(rows[7][0], "other", rows[7][2], None, "same id", "z")]
    assert got(spark, spark.createDataFrame(rows, SCHEMA)) == expected(rows)


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 8)], [("en", 9)], [(None, 1), ("a", 1)]])
def test_small_tables(spark, sizes):
    rows = some_rows(random.Random(3), sizes)
    assert got(spark, spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_empty_table(spark):
    assert got(spark, spark.createDataFrame([], SCHEMA)) == []


def test_paths_fold_to_the_root(spark):
    rows = some_rows(random.Random(4), [("en", 100), ("de", 20)])
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), with_path=True).collect():
        assert r["verified"] and merkle.fold(r["leaf"], r["path"]) == r["root"] == r["folded_root"]
        assert h(*r["path"]) == r["proof_sha256"]


def test_borders_meet_whatever_the_cuts():
    rng = random.Random(5)
    for n in (1, 7, 8, 9, 63, 64, 65, 700):
        leaves = [h(str(k)) for k in range(n)]
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(4))})
        nodes = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            levels = merkle.local_levels(a, leaves[a:b], n)
            for level, index, x in merkle.ragged(levels):
                assert (level, index) not in nodes
                nodes[level, index] = x
            assert {merkle.local_path(levels, k)[1] for k in range(a, b)} == {(x, y) for x, y, _ in merkle.ragged(levels)}
        size, level = n, 0
        while size > 1:
            for p in range(merkle.up(size)):
                own = [nodes.get((level, k)) for k in range(8 * p, min(8 * p + 8, size))]
                if all(own):
                    nodes[level + 1, p] = h(*own)
            size, level = merkle.up(size), level + 1
        assert nodes[level, 0] == tree(leaves)[0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, sf).collect()), key=repr) == expected(rows)
