"""A manifest of a data set as Merkle trees of eight children a node: one tree a group, one over the groups' roots.

Rows are range-sorted by group and id once. Each partition tells its first and its last group with their counts, the
only ones that others may share; their sums give every leaf its index in its group. Then each partition builds the
aligned subtrees that it holds whole. What is left at its borders, and the tops of subtrees, is shuffled by
coordinate (group, level, index) to finish the upper levels, and paths come back down to where they are needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

ARITY = 8
#: Levels that a partition builds: paths need a subtree of ARITY ** HEIGHT leaves in memory.
HEIGHT = 5
#: Rows of a sorted partition, about: 350 bytes each as Python objects.
PART_ROWS = 200_000


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give; path has the siblings to the left and to the right of each level."""
    for k in range(0, len(path), 2):
        leaf = digest(path[k], leaf, path[k + 1])
    return leaf


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row: each value as its count of UTF-8 bytes, a colon and itself, NULL as a dash."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def up(n: int) -> int:
    """Nodes of the level above n nodes."""
    return -(-n // ARITY)


def local_levels(start: int, leaves: list[str], n: int) -> list[tuple[int, list[str]]]:
    """(first index, digests) of the levels over leaves start, start + 1, ... of a group of n, as far as all children
    of a node are there. The last node of a level may have fewer children."""
    out, size = [(start, leaves)], n
    while size > 1 and len(out) <= HEIGHT:
        a, d = out[-1]
        low, high = up(a), up(a + len(d)) if a + len(d) == size else (a + len(d)) // ARITY
        if low >= high:
            break
        out.append((low, [digest(*d[p * ARITY - a : (p + 1) * ARITY - a]) for p in range(low, high)]))
        size = up(size)
    return out


def ragged(levels: list[tuple[int, list[str]]]) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes without a local parent."""
    for level, (a, d) in enumerate(levels):
        b, c = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for k, x in enumerate(d, a):
            if not b <= k // ARITY < b + len(c):
                yield level, k, x


class Forest:
    """Trees over rows (grp, ord, leaf, ...): sorted rows, the indexes where groups begin in partitions, upper nodes."""

    def __init__(self, rows: DataFrame, parts: int, tag: str):
        keys = [F.col("grp").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("leaf").asc(), F.col("__row").asc()]
        # Equal rows give the same tree in any order; their number parts them, as there may be very many.
        dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__row")
        self.spark: SparkSession = rows.sparkSession
        self.tag = tag
        self.sorted: RDD = dealt.rdd  # its shuffled files serve every pass below
        # Two entries a partition.
        self.begins = self.spark.sparkContext.broadcast(_offsets(self.sorted.mapPartitionsWithIndex(_ends).collect()))
        self._climb()

    def _climb(self) -> None:
        begins = self.begins

        def border(part, rows):
            for gid, n, start, members in _blocks(part, list(rows), begins.value):
                for level, index, found in ragged(local_levels(start, [r["leaf"] for r in members], n)):
                    yield part, gid, n, _height(n), level, index, found

        schema = "part int, gid long, n long, height int, level int, index long, digest string"
        self.border = stored(self.spark.createDataFrame(self.sorted.mapPartitionsWithIndex(border), schema, verifySchema=False), f"{self.tag}-border")
        self.height = self.border.agg(F.max("height")).first()[0] or 0
        nodes = self.border.select("gid", "height", "level", "index", "digest")
        self.parents, self.roots = [], [nodes.filter("level = height AND level = 0")]
        made = nodes.limit(0)
        for level in range(self.height):
            here = nodes.filter(F.col("level") == level).unionByName(made).filter(F.col("height") > level)
            family = here.groupBy("gid", "height", F.floor(F.col("index") / ARITY).alias("index")).agg(F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("children"))
            family = stored(family.withColumn("digest", F.sha2(F.array_join("children.digest", ""), 256)), f"{self.tag}-level")
            self.parents.append(family)
            made = family.select("gid", "height", F.lit(level + 1).alias("level"), "index", "digest")
            self.roots.append(nodes.filter((F.col("level") == level + 1) & (F.col("height") == level + 1)).unionByName(made.filter(F.col("height") == level + 1)))
        self.roots = stored(reduce(DataFrame.unionByName, self.roots).select("gid", "height", "digest"), f"{self.tag}-roots")

    def paths(self, tops: DataFrame) -> DataFrame:
        """(part, gid, level, index, path, subroot) of every border node; tops has the path above each group's root."""
        seeds = stored(self.roots.join(tops, "gid").select("gid", "height", F.col("digest").alias("subroot"), "path"), f"{self.tag}-tops")
        of_level = lambda level: seeds.filter(F.col("height") == level).select("gid", F.lit(level).alias("level"), F.lit(0).cast("long").alias("index"), "path", "subroot")
        above, found = of_level(self.height), []
        found.append(above)
        for level in range(self.height - 1, -1, -1):
            family = self.parents[level].select("gid", "index", F.posexplode("children").alias("k", "child"), "children")
            left, right = (F.array_join(x, "") for x in (F.slice("children.digest", 1, F.col("k")), F.slice("children.digest", F.col("k") + 2, ARITY)))
            below = family.select("gid", "index", F.col("child.index").alias("of"), F.array(left, right).alias("own")).join(above.drop("level"), ["gid", "index"])
            below = below.select("gid", F.lit(level).alias("level"), F.col("of").alias("index"), F.concat("own", "path").alias("path"), "subroot")
            above = stored(below.unionByName(of_level(level)), f"{self.tag}-paths")
            found.append(above)
        return self.border.select("part", "gid", "level", "index").join(reduce(DataFrame.unionByName, found), ["gid", "level", "index"])

    def proved(self, tops: DataFrame, give: Callable, schema: T.StructType) -> DataFrame:
        """give(row, path, subroot) of every row, as a frame."""
        begins, parts = self.begins, self.sorted.getNumPartitions()
        if not parts:  # no rows
            return self.spark.createDataFrame([], schema)
        known = self.paths(tops).repartitionById(parts, F.col("part")).select("gid", "level", "index", "path", "subroot").rdd.glom()

        def prove(part, pairs):
            for rows, own in pairs:
                above = {tuple(x[:3]): tuple(x[3:]) for x in own}
                for gid, n, start, members in _blocks(part, rows, begins.value):
                    levels = local_levels(start, [r["leaf"] for r in members], n)
                    for k, row in enumerate(members, start):
                        path, top = local_path(levels, k)
                        rest, subroot = above[(gid, *top)]
                        yield give(row, path + rest, subroot)

        return self.spark.createDataFrame(self.sorted.glom().zip(known).mapPartitionsWithIndex(prove), schema, verifySchema=False)


def local_path(levels: list[tuple[int, list[str]]], index: int) -> tuple[list[str], tuple[int, int]]:
    """Siblings of a leaf in its local subtree, and (level, index) of the subtree's top."""
    path, level = [], 0
    while level + 1 < len(levels) and levels[level + 1][0] <= index // ARITY < levels[level + 1][0] + len(levels[level + 1][1]):
        a, d = levels[level]
        first = index // ARITY * ARITY
        path += ["".join(d[first - a : index - a]), "".join(d[index + 1 - a : first + ARITY - a])]
        index, level = index // ARITY, level + 1
    return path, (level, index)


def _height(n: int) -> int:
    height = 0
    while n > 1:
        n, height = up(n), height + 1
    return height


def _ends(part: int, rows) -> Iterator[tuple]:
    """(part, rows, its first group, its count, its last group, its count) of a partition that has rows."""
    n, runs = 0, []
    for group, members in groupby(rows, lambda r: r["grp"]):
        count = sum(1 for _ in members)
        n += count
        runs = [*runs[:1], (group, count)]
    if runs:
        yield part, n, *runs[0], *(runs[1] if len(runs) > 1 else (None, 0))


def _offsets(ends: list[tuple]) -> dict[int, list[tuple[int, int, int]]]:
    """part -> (group's id, index of its first row here, rows of the group) of its first and its last group.

    A group's id is the place of its first row, so ids ascend with groups.
    """
    spans: list[list] = []  # group, id, rows so far, [(part, which, index)]
    for part, n, first, first_count, last, last_count in sorted(ends, key=lambda x: x[0]):
        if not spans or spans[-1][0] != first:
            spans.append([first, part << 33, 0, []])
        spans[-1][3].append((part, 0, spans[-1][2]))
        spans[-1][2] += first_count
        if last_count:
            spans.append([last, part << 33 | n - last_count, last_count, [(part, 1, 0)]])
    out: dict[int, list] = {}
    for _, gid, n, places in spans:
        for part, which, index in places:
            out.setdefault(part, [None, None])[which] = (gid, index, n)
    return {part: [x for x in entry if x] for part, entry in out.items()}


def _blocks(part: int, rows: list, begins: dict[int, list[tuple[int, int, int]]]) -> Iterator[tuple[int, int, int, list]]:
    """(group's id, its rows in all, index of the first, rows) of a partition, cut at the borders of subtrees."""
    size, at = ARITY**HEIGHT, 0
    for _, found in groupby(rows, lambda r: r["grp"]):
        members = list(found)
        gid, index, n = (part << 33 | at, 0, len(members))
        if at == 0:
            gid, index, n = begins[part][0]
        elif at + len(members) == len(rows):
            gid, index, n = begins[part][1]
        at += len(members)
        start = 0
        while start < len(members):
            stop = min(len(members), (index + start) // size * size + size - index)
            yield gid, n, index + start, members[start:stop]
            start = stop


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", now: dict[str, Column] | None = None, with_path: bool = False) -> DataFrame:
    """Each row's leaf, its group's root, the root of all, a digest of its siblings, and what they give with the
    row as it is now.

    Returns id_col, leaf, subroot, root, proof_sha256, folded_root, verified (folded_root is root) and, if with_path,
    path array<string>: siblings to the left and to the right of every level, the digests joined. now has columns
    that may have changed since the manifest was made; without it every row is verified. Leaves ascend by id in
    their group, NULL first, rows of one id by their digests; repeated rows are leaves of their own. Groups are ordered by
    their bytes, NULL first. A NULL value is told from an empty one. An empty table gives no rows. Other columns
    don't matter.
    """
    spark = docs.sparkSession
    values = {c: F.col(c) for c in columns}
    leaf = leaf_digest(values)
    changed = leaf_digest(values | now) if now else leaf
    rows = stored(docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("ord"), leaf.alias("leaf"), changed.alias("now")), "leaves")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    forest = Forest(rows, max(usual, -(-rows.count() // PART_ROWS)), "merkle")
    groups = forest.roots.select(F.lit(0).alias("grp"), F.col("gid").alias("ord"), F.col("digest").alias("leaf"))
    top = Forest(groups, max(1, -(-groups.count() // PART_ROWS)), "merkle-top")
    root = top.roots.select("digest").first()
    root = root and root[0]
    above = top.roots.select("gid", F.array().cast("array<string>").alias("path"))
    above = top.proved(above, lambda row, path, _: (row["ord"], path), T.StructType.fromDDL("gid long, path array<string>"))

    def give(row, path, subroot):
        folded = fold(row["now"], path)
        return (row["ord"], row["leaf"], subroot, root, digest(*path), folded, folded == root, *([path] if with_path else []))

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)])
    for f in T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", path array<string>" if with_path else "")):
        schema.add(f)
    return forest.proved(above, give, schema)
