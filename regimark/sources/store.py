"""Sinks and intermediate tables: the shared folder, keyed resume, ragged unions, reports."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of feature files, and the column that names them.
KEY_PARTS, PART = 64, "key_part"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="regimark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of the application's part of the shared folder that nothing else has."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def own_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder."""
    return f"{shared_dir(spark)}/regimark/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written to the shared folder and read again, so that lost executors cost no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_ragged(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns; missing ones are NULL, columns in first-seen order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def missing_keys(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys still to do: what a resumed run works on."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def drop_stored(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, and of no other on the same folder; call it when no frame
    over them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_features(df: DataFrame, path: str, key: str = "video_id") -> None:
    """Feature rows as parquet in KEY_PARTS folders, by a hash of their key; a rerun replaces only the keys it has.

    The number of files follows from the bytes, not from the keys. A rerun writes the folders that hold its keys anew,
    with the rows of other keys that lie there; Spark's committer renames finished ones into place. A NULL key is a
    key, and rows may have other columns than those before.
    """
    part = F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)).cast("int")
    spark = df.sparkSession
    new = df.withColumn(PART, part)
    if _holds_files(spark, path):
        new = stored(new, "features")
        touched = [r[0] for r in new.select(PART).distinct().collect()]  # KEY_PARTS rows at most
        known, fresh = spark.read.option("mergeSchema", True).parquet(path), new.select(F.col(key).alias("__key")).distinct()
        kept = known.filter(F.col(PART).isin(touched)).join(fresh, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        new = union_ragged(new, kept)
    new.hint("rebalance", F.col(PART)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def _holds_files(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(folder) and any(s.getPath().getName().startswith(f"{PART}=") for s in system.listStatus(folder))


def feature_summary(df: DataFrame, fps: float, flag: str = "active_candidate") -> DataFrame:
    """(video_id, frames, duration_s, active_frames, active_fraction) of feature rows, to be written beside them."""
    g = df.groupBy("video_id").agg(F.count("*").alias("frames"), F.sum(F.col(flag).cast("long")).alias("active_frames"))
    return g.select("video_id", "frames", (F.col("frames") / fps).alias("duration_s"), "active_frames", (F.col("active_frames") / F.col("frames")).alias("active_fraction"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as a Markdown table; limit is the report's length."""
    cols = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(lines) + "\n"


def pgm_bytes(pixels: bytes, width: int, height: int) -> bytes:
    """A grey image as a binary PGM file."""
    if len(pixels) != width * height:
        raise ValueError("pixels don't fill the image")
    return f"P5\n{width} {height}\n255\n".encode() + pixels


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, NULL fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def json_text(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True)
