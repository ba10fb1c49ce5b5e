"""Binary video: RIFF chunks, frames of uncompressed bitmaps, selective decoding."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import RangeFile, list_files, spread, task_count
from .store import stored

#: Bytes of a file that stay together in a task, about.
STRETCH = 64 << 20
#: Frames of a batch that a task gives or works on at once.
BATCH = 256
HEADER = struct.Struct("<4sI")


def riff_chunks(data: bytes | RangeFile, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, end) of the chunks between at and end; bodies are padded to even sizes and cut at end."""
    while at + HEADER.size <= end:
        name, size = HEADER.unpack(data[at : at + HEADER.size])
        body = at + HEADER.size
        yield name, body, min(body + size, end)
        at = body + size + size % 2


def movie_list(data: bytes | RangeFile) -> tuple[int, int]:
    """Start and end of the list of frames; raises if there is none."""
    if data[:4] != b"RIFF":
        raise ValueError("no RIFF file")
    for name, start, end in riff_chunks(data, 12, len(data)):
        if name == b"LIST" and data[start : start + 4] == b"movi":
            return start + 4, end
    raise ValueError("no list of frames")


def frame_chunks(data: bytes | RangeFile, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(offset, size) of frames in file order, also of those in nested record lists."""
    for name, a, b in riff_chunks(data, start, end):
        if name == b"LIST":
            if data[a : a + 4] in (b"rec ", b"movi"):
                yield from frame_chunks(data, a + 4, b)
        elif name[2:] in (b"db", b"dc"):
            yield a, b - a


def frame_planes(data: bytes | RangeFile, offset: int, width: int, height: int) -> np.ndarray:
    """A frame as uint8[height, width, 3], top row first. Stored rows are padded to 4 bytes, bottom row first."""
    stride = (3 * width + 3) // 4 * 4
    body = data[offset : offset + stride * height]
    if len(body) < stride * height:
        raise ValueError("a frame is shorter than its image")
    rows = np.frombuffer(body, np.uint8).reshape(height, stride)[::-1, : 3 * width]
    return rows.reshape(height, width, 3)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, content) of the videos under path; the id is the file's name without its ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(F.lower("path").endswith(".avi")).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("video_id"), "content")


def frame_index(files: DataFrame) -> DataFrame:
    """(video_id, path, frame_index, offset, size) of every frame of the files at `path`, in file order.

    A task walks the headers of a file's chunks, or of several small files'; no image is read. The index is stored, as
    readers plan by its sizes. Tasks are planned by a column `length`, if there is one. A file without a list of
    frames raises.
    """

    def run(batches):
        import pandas as pd

        columns = ["path", "frame_index", "offset", "size"]
        rows = []
        for pdf in batches:
            for path in pdf["path"]:
                with RangeFile(path) as data:
                    for index, (offset, size) in enumerate(frame_chunks(data, *movie_list(data))):
                        rows.append((path, index, offset, size))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
        yield pd.DataFrame(rows, columns=columns)

    size = F.sum("length") if "length" in files.columns else F.lit(0)
    tasks = task_count(files.sparkSession, *files.agg(F.count("*"), size).first())
    found = spread(files.select("path"), tasks, "path").mapInPandas(run, "path string, frame_index int, offset long, size long")
    return stored(found, "frame-index").select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("video_id"), "*")


def read_frames(index: DataFrame, width: int = 120, height: int = 120, stretch: int = STRETCH) -> DataFrame:
    """(video_id, frame_index, pixels, unequal) of the frames of an index, as decode_frames gives them.

    Tasks share a file by stretches of bytes and read the frames' bytes alone, so a filter or a join of the index
    leaves out what isn't wanted before anything is read, and a file may be of any size. A task reads a stretch, or
    several small ones. A frame whose chunk is shorter than its image raises.
    """
    columns = ["video_id", "frame_index", "pixels", "unequal"]
    stored_size = (3 * width + 3) // 4 * 4 * height

    def run(batches):
        import pandas as pd

        path, data = None, None
        for pdf in batches:
            rows = []
            for video, where, number, offset, size in pdf[["video_id", "path", "frame_index", "offset", "size"]].itertuples(index=False):
                if where != path:
                    path, data = where, RangeFile(where)
                if size < stored_size:
                    raise ValueError(f"frame {number} of {video} is shorter than its image")
                planes = frame_planes(data, offset, width, height)
                rows.append((video, number, planes[..., 0].tobytes(), int(((planes[..., 0] != planes[..., 1]) | (planes[..., 0] != planes[..., 2])).sum())))
                if len(rows) == BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    total = index.agg(F.sum("size")).first()[0] or 0
    tasks = task_count(index.sparkSession, -(-total // stretch), total)
    dealt = spread(index, tasks, "path", F.floor(F.col("offset") / stretch)).sortWithinPartitions("path", "offset")
    return dealt.mapInPandas(run, "video_id string, frame_index int, pixels binary, unequal int")


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the videos under path, for frame_index."""
    return list_files(spark, path, ".avi")


def decode_frames(videos: DataFrame, width: int = 120, height: int = 120) -> DataFrame:
    """(video_id, frame_index, pixels, unequal): the first plane of each frame, and how many of its pixels have
    unequal planes. A frame shorter than its image raises."""

    def run(batches):
        import pandas as pd

        rows = []
        for pdf in batches:
            for video, data in zip(pdf["video_id"], pdf["content"], strict=True):
                for index, (offset, _) in enumerate(frame_chunks(data, *movie_list(data))):
                    planes = frame_planes(data, offset, width, height)
                    unequal = int(((planes[..., 0] != planes[..., 1]) | (planes[..., 0] != planes[..., 2])).sum())
                    rows.append((video, index, planes[..., 0].tobytes(), unequal))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["video_id", "frame_index", "pixels", "unequal"])
                        rows = []
        yield pd.DataFrame(rows, columns=["video_id", "frame_index", "pixels", "unequal"])

    return videos.mapInPandas(run, "video_id string, frame_index int, pixels binary, unequal int")


def audit_frames(videos: DataFrame, width: int = 120, height: int = 120) -> DataFrame:
    """(video_id, frame_index, grey, unequal, unequal_fraction): the mean of a pixel's planes, rounded half to even,
    as bytes; how many pixels have unequal planes, and their share. A frame shorter than its image raises."""

    def run(batches):
        import pandas as pd

        columns, rows = ["video_id", "frame_index", "grey", "unequal", "unequal_fraction"], []
        for pdf in batches:
            for video, data in zip(pdf["video_id"], pdf["content"], strict=True):
                for index, (offset, _) in enumerate(frame_chunks(data, *movie_list(data))):
                    planes = frame_planes(data, offset, width, height)
                    grey = np.rint(planes.mean(axis=2)).astype(np.uint8)
                    unequal = int((planes != planes[..., :1]).any(axis=2).sum())
                    rows.append((video, index, grey.tobytes(), unequal, unequal / grey.size))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return videos.mapInPandas(run, "video_id string, frame_index int, grey binary, unequal int, unequal_fraction double")


def selected_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames whose (video_id, frame_index) is wanted; indexes that a video lacks are left out."""
    return frames.join(wanted.select("video_id", "frame_index").distinct(), ["video_id", "frame_index"], "left_semi")
