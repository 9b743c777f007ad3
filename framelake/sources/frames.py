"""Frames of video files, and a file for each row, by Spark's own source and sink protocols.

format("y4m") reads uncompressed YUV4MPEG2 videos. A frame's place follows from the header, so a file is cut into pieces
of FRAMES frames that tasks read apart, and what start, end, stride and filters on video and frame_id leave out is never
read. format("frame_files") writes each row (path, content) as a file below a root: tasks write to a folder of their
attempt, and the driver moves what succeeded into place when all have; an aborted job leaves nothing.

Paths may be local or of any store that Arrow's file systems know by its URI.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FRAMES = 64
HEADER, MARK = b"YUV4MPEG2 ", b"FRAME\n"
#: Bytes of a frame for each luma byte, by what a file's colour space begins with; 420 where it lacks.
PLANES = {"mono": 1.0, "411": 1.5, "420": 1.5, "422": 2.0, "444": 3.0}
_LONGEST = 4096


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass(frozen=True)
class Video:
    """What a file's header says: the sides, where the first frame begins, bytes of a frame with its mark, and frames."""

    path: str
    name: str
    width: int
    height: int
    begin: int
    size: int
    frames: int


def opened(path: str, size: int, head: bytes) -> Video:
    """A file's header read; ValueError if it is no such video, or if its frames have no fixed places."""
    line, end, _ = head.partition(b"\n")
    if not line.startswith(HEADER.strip()) or not end:
        raise ValueError(f"{path} has no YUV4MPEG2 header")
    tags = {t[:1]: t[1:].decode("ascii", "replace") for t in line.split(b" ")[1:] if t}
    width, height, space = int(tags.get(b"W", "0")), int(tags.get(b"H", "0")), tags.get(b"C", "420")
    share = next((v for k, v in PLANES.items() if space.startswith(k)), None)
    if width < 1 or height < 1 or share is None or re.search(r"(p|mono)\d+$", space):  # these have more than 8 bits
        raise ValueError(f"{path}: sides {width} x {height} in {space} aren't read")
    chroma = {1.0: 0, 3.0: 2 * width * height}.get(share)
    if chroma is None:
        across, down = ((width + 3) // 4, height) if space.startswith("411") else ((width + 1) // 2, (height + 1) // 2 if share == 1.5 else height)
        chroma = 2 * across * down
    begin = len(line) + 1
    one = len(MARK) + width * height + chroma
    if size > begin and not head[begin : begin + len(MARK)] == MARK and len(head) >= begin + len(MARK):
        raise ValueError(f"{path}: frames with parameters have no fixed places")
    name = posixpath.basename(path).rsplit(".", 1)[0]
    return Video(path, name, width, height, begin, one, (size - begin) // one)


@dataclass
class _Piece(InputPartition):
    video: Video
    first: int
    last: int
    step: int


class Y4mSource(DataSource):
    """format("y4m"): video, frame_id, h, w and pixels, the luma; options path (a file or folder), start, end, stride, frames."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return "video string, frame_id long, h int, w int, pixels binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return Y4mReader({k.lower(): v for k, v in self.options.items()})


class Y4mReader(DataSourceReader):
    """Pieces of videos; filters on frame_id and video that it can heed are taken out of Spark's hands."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 62))
        self.stride, self.frames = max(1, int(options.get("stride", 1))), max(1, int(options.get("frames", FRAMES)))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("frame_id",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.start = max(self.start, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.end = min(self.end, int(f.value) + (not isinstance(f, LessThan)))
            elif column == ("video",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = located(self.path)
        info = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        out: list[InputPartition] = []
        for file in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".y4m")), key=lambda f: f.path):
            if self.names is not None and posixpath.basename(file.path).rsplit(".", 1)[0] not in self.names:
                continue
            with store.open_input_file(file.path) as source:
                video = opened(file.path, file.size, source.read(min(_LONGEST, file.size)))
            # frames that stride takes count from 0, whatever start is
            first, last = -(-max(0, self.start) // self.stride) * self.stride, min(self.end, video.frames)
            for at in range(first, last, self.frames * self.stride):
                out.append(_Piece(video, at, min(last, at + self.frames * self.stride), self.stride))
        return out or [_Piece(None, 0, 0, 1)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        video = partition.video
        if video is None:
            return
        store, _ = located(self.path)
        names, schema = ["video", "frame_id", "h", "w", "pixels"], [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        with store.open_input_file(video.path) as source:
            for i in range(partition.first, partition.last, partition.step):
                source.seek(video.begin + i * video.size)
                data = source.read(len(MARK) + video.width * video.height)
                if not data.startswith(MARK):
                    raise ValueError(f"{video.path}: frame {i} isn't where the header puts it")
                row = (video.name, i, video.height, video.width, data[len(MARK) :])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema)], names)


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    paths: list[str]


class FrameFiles(DataSource):
    """format("frame_files"): rows (path, content), each written as a file below the option path."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ARG002, FBT001
        return FrameWriter(self.options["path"], overwrite)


class FrameWriter(DataSourceWriter):
    """Two steps: tasks write below _pending/job/attempt, commit() moves the attempts that Spark counts into place."""

    def __init__(self, root: str, overwrite: bool) -> None:  # noqa: FBT001
        self.root, self.overwrite, self.job = root.rstrip("/"), overwrite, uuid.uuid4().hex
        store, root = located(self.root)
        store.create_dir(self._pending(root), recursive=True)

    def _pending(self, root: str) -> str:
        return f"{root}/_pending/{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = located(self.root)
        attempt, paths = f"{self._pending(root)}/{uuid.uuid4().hex}", []
        try:
            self._write(store, attempt, iterator, paths)
        except BaseException:  # a task that fails, or is ended, takes its files along
            if store.get_file_info(attempt).type == fs.FileType.Directory:
                store.delete_dir(attempt)
            raise
        return _Written(attempt, paths)

    def _write(self, store: fs.FileSystem, attempt: str, iterator: Iterator, paths: list[str]) -> None:
        for row in iterator:
            if len(paths) % 64 == 0 and store.get_file_info(posixpath.dirname(attempt)).type != fs.FileType.Directory:
                raise RuntimeError("the job was aborted")
            path = posixpath.normpath(str(row.path))
            if path.startswith(("/", "..")) or path in ("", "."):
                raise ValueError(f"{row.path!r} doesn't lie below the root")
            target = f"{attempt}/{path}"
            store.create_dir(posixpath.dirname(target), recursive=True)
            with store.open_output_stream(target) as out:
                out.write(b"" if row.content is None else bytes(row.content))
            paths.append(path)
        if store.get_file_info(posixpath.dirname(attempt)).type != fs.FileType.Directory:
            raise RuntimeError("the job was aborted")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = located(self.root)
        written = [m for m in messages if m is not None]
        seen: set[str] = set()
        for path in (p for m in written for p in m.paths):
            if path in seen:
                self.abort(messages)
                raise ValueError(f"two rows write {path}")
            seen.add(path)
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for old in store.get_file_info(fs.FileSelector(root)):
                if not old.path.endswith("/_pending"):
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for m in written:
            for path in m.paths:
                store.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                store.move(f"{m.attempt}/{path}", f"{root}/{path}")
        self._forget()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:  # noqa: ARG002
        self._forget()

    def _forget(self) -> None:
        """What is left of this job, and the folder of pending ones if that was the last."""
        store, root = located(self.root)
        if store.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            store.delete_dir(self._pending(root))
        pending = f"{root}/_pending"
        if store.get_file_info(pending).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(pending)):
            store.delete_dir(pending)


def register(spark) -> None:
    """Makes both formats known to a session, and lets Spark hand its filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Y4mSource, FrameFiles):
        spark.dataSource.register(source)


def class_files(frames: DataFrame, suffix: str = "png") -> DataFrame:
    """(path, content) of frames (video, frame_id, h, w, classes): an 8-bit image for each, video/frame_<id>.<suffix>."""
    from framelake.sources.files import encode_gray

    @F.arrow_udf("binary")
    def encode(h: pa.Array, w: pa.Array, data: pa.Array) -> pa.Array:
        import numpy as np

        rows = zip(h.to_pylist(), w.to_pylist(), data.to_pylist())
        return pa.array([None if d is None else encode_gray(np.frombuffer(d, "u1").reshape(a, b)) for a, b, d in rows], pa.binary())

    name = F.concat(F.col("video"), F.lit("/frame_"), F.col("frame_id").cast("string"), F.lit(f".{suffix}"))
    return frames.select(name.alias("path"), encode("h", "w", "classes").alias("content"))
