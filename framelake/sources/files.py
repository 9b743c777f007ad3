"""File sources and sinks of the engine; paths may be in any store that Spark reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framelake.functions import parsing

#: Shares of red, green and blue in the luma.
LUMA = (0.299, 0.587, 0.114)
SEGMENTS = "video string, start_frame long, end_frame long, startpoint long"
PROFILE = "cat string, name string, ts long, dur long, args struct<op_name:string,provider:string,output_size:string>"


def image_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below root whose name fits glob (path, content), to be sorted by path where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "content")


def encode_gray(image: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.hstack((np.zeros((len(image), 1), "u1"), image.astype("u1"))).tobytes()
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def images(spark: SparkSession, root: str, glob: str, mode: str = "gray") -> DataFrame:
    """(path, h, w, pixels, status) of the images below root whose name fits glob, as Spark's image source decodes them.

    mode gray: a byte a pixel, of colours the luma rounded half to even; rgb: three. status is unreadable, with nulls, for
    what is no image.
    """
    read = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    rows = read.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, w, n, data in zip(pdf["h"], pdf["w"], pdf["n"], pdf["data"]):
                a = np.frombuffer(data, "u1").reshape(h, w, n)[:, :, :3][:, :, ::-1] if h > 0 and w > 0 else None  # stored as blue, green, red
                if a is not None and mode == "rgb":
                    a = np.broadcast_to(a, (h, w, 3))
                elif a is not None:
                    a = np.rint(a @ np.array(LUMA)) if a.shape[2] == 3 else a[:, :, 0]
                out.append(None if a is None else a.astype("u1").tobytes())
            sides = {c: pd.array([None if x is None else int(v) for x, v in zip(out, pdf[c])], "Int32") for c in ("h", "w")}
            yield pd.DataFrame({"path": pdf["path"], **sides, "pixels": out, "status": ["unreadable" if x is None else "ok" for x in out]})

    return rows.mapInPandas(run, "path string, h int, w int, pixels binary, status string")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Interval table of lag corrections from CSV."""
    return spark.read.schema(SEGMENTS).option("header", True).csv(path)


def profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile events from a JSON document that is one array."""
    return spark.read.schema(PROFILE).option("multiLine", True).json(path)


def matched_files(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(video, frame_id, pred_path, gt_path, status): each prediction with its truth, missing_gt where there is none."""
    key = lambda df, name: df.select(parsing.path_part(F.col("path"), 2).alias("video"), parsing.frame_id(F.col("path")).alias("frame_id"), F.col("path").alias(name))
    both = key(predictions, "pred_path").join(key(truths, "gt_path"), ["video", "frame_id"], "left")
    return both.withColumn("status", F.when(F.col("gt_path").isNull(), "missing_gt").otherwise("ok"))


def copy_counts(matched: DataFrame, fold: str) -> DataFrame:
    """(fold, copied, missing) of matched_files() rows with a column fold: how many have a truth to be copied."""
    return matched.groupBy(fold).agg(F.count_if(F.col("status") == "ok").alias("copied"), F.count_if(F.col("status") != "ok").alias("missing"))


def write_metrics(metrics: DataFrame, path: str, value: str = "dice") -> None:
    """A metric table as CSV with header, without rows that have no value."""
    metrics.where(F.col(value).isNotNull()).write.mode("overwrite").option("header", True).csv(path)


def write_folds(rows: DataFrame, path: str) -> None:
    """Rows with fold and part, a folder for each."""
    rows.write.mode("overwrite").partitionBy("fold", "part").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as JSON lines."""
    report.write.mode("overwrite").json(path)


class FrameSource(DataSource):
    """format("frames"): frames of videos kept as raw gray bytes; options videos, frames, height, width, start, end.

    A stand-in for a decoder, deterministic: pixel = (video * 31 + frame * 7 + y * 3 + x) mod 256. A partition per video;
    start and end are pruned before any frame is made.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video string, frame_id long, h int, w int, pixels binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _FrameReader({k.lower(): v for k, v in self.options.items()})


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = lambda k, d: int(options.get(k, d))
        self.videos, self.h, self.w = get("videos", 1), get("height", 8), get("width", 8)
        self.start, self.end = get("start", 0), min(get("end", 1 << 60), get("frames", 10))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.videos)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        y, x = np.mgrid[: self.h, : self.w]
        for f in range(self.start, self.end):
            yield f"video{partition.value:02d}", f, self.h, self.w, ((partition.value * 31 + f * 7 + y * 3 + x) % 256).astype("u1").tobytes()
