"""What the corpus operators share: tables in the shared folder, Arrow batches, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side may be broadcast up to this estimate of bytes; above it the join shuffles.
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = 1000
#: Keys of a join that are broadcast for having the most rows.
HEAVY = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="regimark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/regimark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if its counted rows stay under the limit, else as it is.

    small must be cheap to count: a stored table or a literal one.
    """
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def heavy_join(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, spread: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined to small, which has each value of keys (longs or ints) once, by keys; weight is dropped.

    A small side under the limit is broadcast. Else its HEAVY rows of most weight are, a number that doesn't grow;
    of what then is shuffled no key has more than 1 / HEAVY of the weight. Rows that have met theirs already are
    spread by the column `spread`.
    """
    others = [c for c in small.columns if c not in (*keys, weight)]
    if limit and small.count() * 64 <= limit:
        return rows.join(F.broadcast(small.drop(weight)), keys)
    heavy = small.orderBy(F.desc(weight), *keys).limit(HEAVY).select(*keys, F.lit(True).alias("__heavy"), *[F.col(c).alias(f"__{c}") for c in others])
    first = rows.join(F.broadcast(heavy), keys, "left")
    moved = F.when(F.col("__heavy"), F.xxhash64(spread).cast(rows.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))
    first = first.withColumn("__was", F.col(keys[0])).withColumn(keys[0], moved)
    met = first.join(small.drop(weight).withColumn("__light", F.lit(True)), keys, "left").filter("__heavy OR __light")
    return met.select(*[F.col("__was").alias(keys[0]) if c == keys[0] else c for c in rows.columns], *[F.when(F.col("__heavy"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in others])


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, most: int = 2 << 20) -> DataFrame:
    """df through mapInArrow: make() is called once a task and returns a function from columns to columns.

    Strings arrive as UTF-8 bytes, so that byte semantics hold and nothing is decoded needlessly. A call gets
    about `most` bytes of rows.
    """
    out_schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = _arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in _pieces(batch, most):
                cols = {}
                for name, col in zip(piece.schema.names, piece.columns, strict=True):
                    if pa.types.is_string(col.type):
                        col = col.cast(pa.binary())
                    elif pa.types.is_large_string(col.type):
                        col = col.cast(pa.large_binary())
                    cols[name] = col.to_pylist()
                made = work(cols)
                yield pa.RecordBatch.from_arrays(
                    [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=f.type) for f in arrow_schema],
                    schema=arrow_schema,
                )
        released()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, out_schema)


def released() -> None:
    """Gives free memory back at a task's end: Python workers are used again and would keep their peaks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Texts are large: Arrow batches of 1000 rows, where the session has no smaller number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` bytes, so that long texts don't pile up as Python objects."""
    n = max(1, min(batch.num_rows, -(-batch.nbytes // most)))
    step = max(1, -(-batch.num_rows // n))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def own_names(*names: str):
    """Decorator of a function from a frame to a frame: columns that come with one of these names, which the function
    uses itself, have other names meanwhile, also where an argument names them."""

    def wrap(f):
        @functools.wraps(f)
        def named(docs: DataFrame, *args, **kwargs) -> DataFrame:
            other: dict[str, str] = {}
            for c in docs.columns:
                if c.lower() in names:
                    new = f"given{c}"
                    while new in docs.columns:
                        new += "_"
                    other[c] = new
            if not other:
                return f(docs, *args, **kwargs)
            known = lambda a: other.get(a, a) if isinstance(a, str) else a
            out = f(docs.withColumnsRenamed(other), *map(known, args), **{k: known(v) for k, v in kwargs.items()})
            return out.withColumnsRenamed({v: k for k, v in other.items()})

        return named

    return wrap


def ascii_lower(col):
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def default_path(name: str) -> str:
    """Where a public tokenizer's file lies, by the installed helper module."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))


def arrow_append(df: DataFrame, inputs: list[str], make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], added: str, most: int = 2 << 20) -> DataFrame:
    """df with the columns of `added` made from the columns of `inputs`, as arrow_rows does; all other columns
    pass through as they are, and columns of df with an added name are replaced."""
    out = T.StructType.fromDDL(added)
    names = [f.name for f in out]
    keep = [c for c in df.columns if c not in names]
    arrow_out = _arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in _pieces(batch, most):
                at = piece.schema.get_field_index
                cols = {}
                for name in inputs:
                    col = piece.column(at(name))
                    cols[name] = (col.cast(pa.binary()) if pa.types.is_string(col.type) else col).to_pylist()
                made = work(cols)
                new = [pa.array(made[f.name], type=f.type) for f in arrow_out]
                yield pa.RecordBatch.from_arrays([*[piece.column(at(c)) for c in keep], *new], [*keep, *names])
        released()

    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.select(*keep).schema] + list(out.fields))
    return df.select(*keep, *[c for c in inputs if c not in keep]).mapInArrow(run, schema)
