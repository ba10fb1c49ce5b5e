"""A sink that takes each batch of a stream once, whatever is replayed, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows in a folder of its number, then an entry in the manifest.

    A batch that is in the manifest is whole, and a replay of it does nothing. One that isn't may have left files
    when its run was killed; its replay replaces them. So a reader of the batches in the manifest sees each once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in written(spark, path):
            return
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        spark.range(1).selectExpr(f"{number}L AS number").write.mode("overwrite").json(f"{path}/manifest/{number}")

    return write


def written(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches in the manifest; an entry counts once its job has ended."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = system.listStatus(folder) if system.exists(folder) else []
    return {int(e.getPath().getName()) for e in entries if system.exists(jvm.org.apache.hadoop.fs.Path(e.getPath(), "_SUCCESS"))}


def read_written(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches in the manifest."""
    paths = [f"{path}/data/batch={k}" for k in sorted(written(spark, path))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def start_once(stream: DataFrame, path: str, notes: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream into batch_writer until all that is there has been read; `notes` is its checkpoint folder."""
    return stream.writeStream.foreachBatch(batch_writer(path)).outputMode(mode).option("checkpointLocation", notes).trigger(availableNow=True).start()
