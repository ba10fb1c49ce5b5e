"""NPY and NPZ files as tables: a row an index of the first axis, a column an array.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("array_files").option("path", folder).option("columns", "label,probabilities").load()
    df.write.format("array_files").mode("append").option("path", folder).save()

Only headers are read to plan. Arrays that aren't compressed are read by ranges of rows, so tasks share a large file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from .ranges import CommittedFiles, RangeFile, Written, file_system

ROWS_A_PART = 100_000
LOCAL_HEADER = 30
KINDS = {"b1": T.BooleanType(), "i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType()}
DTYPES = {"boolean": "?", "tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


@dataclass
class Array:
    """An array of a file: the name of its column, its type and shape, and where its values begin; -1 if compressed."""

    name: str
    dtype: np.dtype
    shape: tuple[int, ...]
    begin: int
    member: str | None

    def column(self) -> T.DataType:
        kind = T.StringType() if self.dtype.kind in "US" else KINDS.get(self.dtype.str[1:])
        if kind is None or len(self.shape) > 2:
            raise ValueError(f"{self.name}: arrays of {self.dtype} with {len(self.shape)} axes are no columns")
        return T.ArrayType(kind) if len(self.shape) == 2 else kind


def _header(stream, name: str, begin: int, member: str | None) -> Array:
    """The head of an array at a stream's place. Rows of arrays in Fortran order aren't together in the file."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if not shape or dtype.hasobject or (fortran and len(shape) > 1):
        raise ValueError(f"{name}: arrays without rows, of objects or by columns aren't read")
    return Array(name, dtype, shape, begin + stream.tell() if begin >= 0 else -1, member)


def arrays_of(path: str) -> list[Array]:
    """The arrays of a file, by name: the members of an NPZ file, or the one of an NPY file."""
    with RangeFile(path) as data:
        if path.lower().endswith(".npy"):
            return [_header(data.handle, path.rsplit("/", 1)[-1][:-4], 0, None)]
        found = []
        with zipfile.ZipFile(data.handle) as z:
            for i in z.infolist():
                if i.filename.endswith(".npy"):
                    # The local header repeats the name and has an extra field of its own length.
                    local = data[i.header_offset : i.header_offset + LOCAL_HEADER]
                    begin = i.header_offset + LOCAL_HEADER + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
                    with z.open(i) as stream:
                        found.append(_header(stream, i.filename[:-4], begin if i.compress_type == zipfile.ZIP_STORED else -1, i.filename))
        return found


@dataclass
class Rows(InputPartition):
    """Rows start to stop of the arrays of a file."""

    path: str
    arrays: list[Array]
    start: int
    stop: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.names = options, [f.name for f in schema]
        self.part_rows = int(options.get("rowsPerPartition", ROWS_A_PART))

    def partitions(self) -> list[Rows]:
        out = []
        for path in array_paths(self.options["path"]):
            arrays = {a.name: a for a in arrays_of(path)}
            wanted = [arrays[n] for n in self.names if n in arrays]
            counts = {a.shape[0] for a in wanted}
            if len(wanted) < len(self.names) - (2 if "source_file" in self.names else 0) or len(counts) > 1:
                raise ValueError(f"{path} lacks a column, or its columns differ in length")
            n = max(counts, default=0)
            # What is compressed can't be entered in the middle: such a file is one partition, read as a stream.
            step = self.part_rows if all(a.begin >= 0 for a in wanted) else max(n, 1)
            out += [Rows(path, wanted, k, min(k + step, n)) for k in range(0, n, step)]
        return out

    def read(self, part: Rows) -> Iterator:
        import pyarrow as pa

        with RangeFile(part.path) as data:
            streams = [self._values(data, a, part.start) for a in part.arrays]
            try:
                for start in range(part.start, part.stop, 10_000):
                    n = min(10_000, part.stop - start)
                    made = {a.name: _arrow(a, read(n)) for a, (read, _) in zip(part.arrays, streams, strict=True)}
                    if "source_file" in self.names:
                        made |= {"source_file": pa.array([part.path] * n, pa.string()), "row": pa.array(range(start, start + n), pa.int64())}
                    yield pa.RecordBatch.from_arrays([made[c] for c in self.names], self.names)
            finally:
                for _, close in streams:
                    close()

    def _values(self, data: RangeFile, a: Array, start: int):
        """(a function that gives the bytes of the next n rows, a function that ends it)."""
        row_bytes = a.dtype.itemsize * (a.shape[1] if len(a.shape) == 2 else 1)
        if a.begin >= 0:
            place = [a.begin + start * row_bytes]

            def ranged(n: int) -> bytes:
                place[0] += n * row_bytes
                return data[place[0] - n * row_bytes : place[0]]

            return ranged, lambda: None
        archive = zipfile.ZipFile(RangeFile(data.path).handle)  # one for each stream: they move apart
        stream = archive.open(a.member)
        _header(stream, a.name, -1, a.member)
        return lambda n: stream.read(n * row_bytes), lambda: (stream.close(), archive.close())


def _arrow(a: Array, raw: bytes):
    import pyarrow as pa

    values = np.frombuffer(raw, a.dtype).reshape(-1, *a.shape[1:])
    values = values.astype(a.dtype.newbyteorder("="))
    if a.dtype.kind in "US":
        return pa.array([v.decode("latin-1") if isinstance(v, bytes) else str(v) for v in values.tolist()], pa.string())
    kind = {"u1": np.int16, "u2": np.int32, "u4": np.int64, "f2": np.float32}.get(a.dtype.str[1:])
    values = values.astype(kind) if kind else values
    if values.ndim == 1:
        return pa.array(values)
    offsets = np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def array_paths(path: str) -> list[str]:
    """The array files at or under a path, by name."""
    from pyarrow import fs

    system, name = file_system(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path[: len(path.rstrip("/")) - len(name.rstrip("/"))] if path.rstrip("/").endswith(name.rstrip("/")) else ""
    found = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=False))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".npy", ".npz")))


class ArrayWriter(CommittedFiles, DataSourceWriter):
    """Each task writes files of up to rowsPerFile rows, which is what it holds."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        super().__init__(options)
        self.columns = schema
        self.rows = int(options.get("rowsPerFile", ROWS_A_PART))
        self.compress = options.get("compression", "none") != "none"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        part, held, files = TaskContext.get().partitionId(), [], []
        for r in rows:
            held.append(tuple(r))
            if len(held) == self.rows:
                files.append(self._put(part, len(files), held))
                held = []
        if held:
            files.append(self._put(part, len(files), held))
        return Written(files)

    def _put(self, part: int, number: int, rows: list[tuple]) -> tuple[str, str]:
        columns = {f.name: _numpy(f, [r[k] for r in rows]) for k, f in enumerate(self.columns)}
        out = io.BytesIO()
        (np.savez_compressed if self.compress else np.savez)(out, **columns)
        return self.put(f"part-{part:05d}-{number:05d}.npz", out.getvalue())


def _numpy(field: T.StructField, values: list) -> np.ndarray:
    kind = field.dataType.elementType if isinstance(field.dataType, T.ArrayType) else field.dataType
    if isinstance(kind, T.StringType):
        if None in values:
            raise ValueError(f"{field.name}: an array of text has no NULL")
        return np.array(values, dtype=str)
    dtype = DTYPES.get(kind.simpleString())
    if dtype is None:
        raise ValueError(f"{field.name}: no array has values of {kind.simpleString()}")
    if dtype[0] != "f" and None in values:
        raise ValueError(f"{field.name}: an array of {kind.simpleString()} has no NULL")
    return np.array(values, dtype=dtype)  # NULL of floats is NaN; rows of different lengths raise


class ArrayFiles(DataSource):
    """Source and sink of NPY and NPZ files.

    Options of reading: path of a file or folder; columns, the arrays wanted, by default all of the first file;
    fileColumns=true for source_file and row as well; rowsPerPartition. All files need the columns of the first,
    with as many rows in each; others raise. Unsigned types become the next larger signed ones. Options of writing:
    path, rowsPerFile, compression=deflate. NULL becomes NaN in floats and raises elsewhere.
    """

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> T.StructType:
        paths = array_paths(self.options["path"])
        if not paths:
            raise ValueError(f"no array files under {self.options['path']}")
        arrays = {a.name: a for a in arrays_of(paths[0])}
        names = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else list(arrays)
        if missing := [n for n in names if n not in arrays]:
            raise ValueError(f"{paths[0]} lacks {', '.join(missing)}")
        out = T.StructType([T.StructField(n, arrays[n].column()) for n in names])
        if self.options.get("fileColumns", "false").lower() == "true":
            out = out.add("source_file", "string").add("row", "long")
        return out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ArrayWriter(self.options, schema)
