"""Readers of tables: CSV with checked headers, CSV in archives, tolerant reports, JSON records."""

from __future__ import annotations

import contextlib
import csv
import io
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import file_class, finite
from .ranges import RangeFile, list_files, spread, task_count
from .store import stored

# The columns of measured tables, by position.
MEASURED = ["x_mm", "y_mm", "power_w", "speed_mm_s", "area_mm2", "length_mm", "width_mm", "mean_intensity", "spatter_count", "spatter_area"]

#: Bytes of small members that a task reads, about.
MEMBER_BYTES = 64 << 20


def read_features(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Feature CSVs under path with their file's name; raises if a file lacks a required column.

    Headers are the files' first lines, compared on the executors; numbers that aren't finite become NULL.
    """
    heads = spark.read.text(path, recursiveFileLookup=True, wholetext=False).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("row"))
    first = heads.groupBy("file").agg(F.min_by("value", "row").alias("header"))
    lacking = first.select("file", F.array_except(F.array(*map(F.lit, required)), F.transform(F.split("header", ","), lambda c: F.trim(c))).alias("missing")).filter(F.size("missing") > 0)
    found = lacking.limit(1).collect()
    if found:
        raise ValueError(f"{found[0]['file']} lacks {', '.join(found[0]['missing'])}")
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path).withColumn("source_file", F.input_file_name())
    keys = {"video_id", "source_file", "split"}
    return raw.select(*[F.col(c) if c in keys else finite(F.col(c)).alias(c) for c in raw.columns])


def read_archives(spark: SparkSession, path: str, pattern: str = "%.zip") -> DataFrame:
    """ZIP files under path, whatever the case of their names, as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").like(pattern)).select("path", "content")


def _reads(archive: zipfile.ZipFile, member: str) -> bool:
    """Whether a member can be read to its end with the checksum that the archive gives."""
    try:
        with archive.open(member) as f:
            while f.read(1 << 20):
                pass
    except (zipfile.BadZipFile, zlib.error, EOFError):
        return False
    return True


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the ZIP files under path, whatever the case of their names."""
    return list_files(spark, path, ".zip")


def archive_index(archives: DataFrame) -> DataFrame:
    """(path, member, size, stored_size) of the members of ZIP archives: only their central directories are read."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                with RangeFile(path) as data, zipfile.ZipFile(data.handle) as z:
                    rows = [(path, i.filename, i.file_size, i.compress_size) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "stored_size"])

    tasks = task_count(archives.sparkSession, archives.count(), 0)  # directories are small, whatever the archives' bytes
    found = spread(archives.select("path"), tasks, "path").mapInPandas(run, "path string, member string, size long, stored_size long")
    return stored(found, "archive-index")


def _by_member(index: DataFrame) -> DataFrame:
    """An index dealt by members, to a task for each or for each MEMBER_BYTES of those that are small."""
    n, total = index.agg(F.count("*"), F.sum("size")).first()
    return spread(index, min(n, -(-(total or 0) // MEMBER_BYTES) + n // 1000), "path", "member")


def archive_members(archives: DataFrame) -> DataFrame:
    """(path, member, size, crc_ok, kind) of every member of ZIP archives; tasks share an archive by members."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, member, size in pdf[["path", "member", "size"]].itertuples(index=False):
                with RangeFile(path) as data, zipfile.ZipFile(data.handle) as z:
                    yield pd.DataFrame([(path, member, size, _reads(z, member))], columns=["path", "member", "size", "crc_ok"])

    return _by_member(archive_index(archives)).mapInPandas(run, "path string, member string, size long, crc_ok boolean").withColumn("kind", file_class(F.col("member")))


def _numeric_rows(archive: zipfile.ZipFile, member: str, width: int | None) -> Iterator[list[float]]:
    """Rows of a CSV member that have numbers alone, as the member is inflated."""
    with archive.open(member) as raw:
        for fields in csv.reader(io.TextIOWrapper(raw, "utf-8-sig", "replace", newline="")):
            if fields and (width is None or len(fields) >= width):
                with contextlib.suppress(ValueError):
                    yield [float(x) for x in (fields if width is None else fields[:width])]


def archive_numbers(archives: DataFrame, member_regex: str, width: int | None = len(MEASURED)) -> DataFrame:
    """(path, member, row, numbers) of CSV members: rows of numbers only.

    The first `width` fields count; rows with fewer or with other text are dropped and the rest numbered from 0.
    With width None whole rows count, cut to the narrowest of their member, which is found by reading it once
    before. A byte order mark and bytes that are no UTF-8 are tolerated. A task inflates a member as it reads it,
    10,000 rows at a time, so neither an archive nor a member is held.
    """
    columns = ["path", "member", "row", "numbers"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, member in pdf[["path", "member"]].itertuples(index=False):
                with RangeFile(path) as data, zipfile.ZipFile(data.handle) as z:
                    narrow = width if width is not None else min(map(len, _numeric_rows(z, member, None)), default=0)
                    numbers, first = _numeric_rows(z, member, width), 0
                    while rows := list(islice(numbers, 10_000)):
                        yield pd.DataFrame({"path": path, "member": member, "row": range(first, first + len(rows)), "numbers": [r[:narrow] for r in rows]}, columns=columns)
                        first += len(rows)

    wanted = _by_member(archive_index(archives).filter(F.col("member").rlike(member_regex)))
    return wanted.mapInPandas(run, "path string, member string, row int, numbers array<double>")


def measured_rows(numbers: DataFrame) -> DataFrame:
    """archive_numbers by the names of measured columns; what isn't finite is NULL."""
    return numbers.select("path", "member", F.col("row").alias("frame_index"), *[finite(F.get("numbers", F.lit(i))).alias(c) for i, c in enumerate(MEASURED)])


def profile_csv(lines: DataFrame, text: str = "value", group: str = "member") -> DataFrame:
    """For each group of text lines: non-empty rows, whether the first has fields that are no numbers, widest row.

    lines needs a column `row` that orders them.
    """
    fields = F.split(text, ",")
    numeric = F.forall(fields, lambda x: F.trim(x).try_cast("double").isNotNull())
    return lines.filter(F.trim(text) != "").groupBy(group).agg(F.count("*").alias("rows"), (~F.min_by(numeric, "row")).alias("has_header"), F.max(F.size(fields)).alias("columns"))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report CSV by named columns: missing files give no rows, fields that don't parse NULL."""
    want = T.StructType.fromDDL(schema)
    try:
        raw = spark.read.option("header", True).csv(path)
    except Exception as e:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], want)
    return raw.select(*[(F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records, one a file; files that don't parse are left out."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.filter(F.col("_bad").isNull()).drop("_bad") if "_bad" in raw.columns else raw
