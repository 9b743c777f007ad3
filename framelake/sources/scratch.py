"""Tables between the steps of a query, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; a local folder only where it is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    _made.append(f"{shared_folder(spark)}/framelake/{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch folders made within; only for results that are written or gone by its end."""
    before = len(_made)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in _made[before:]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        del _made[before:]


def forget(table: DataFrame) -> None:
    """Deletes the scratch folder of a table that materialise() or bucketed() gave, when nothing reads it any more."""
    folders = {m[0] for f in table.inputFiles() if (m := re.match(r".*/framelake/[0-9a-f]{32}(?=/)", f))}
    spark = table.sparkSession
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        name = folder.rsplit("/", 1)[1]
        _made[:] = [f for f in _made if not f.endswith(name)]


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """df written into the shared scratch folder in buckets of key: joins and groups by key don't move its rows again.

    The catalogue's entry is only needed until Spark has read it and is dropped at once; the files stay.
    """
    spark, name = df.sparkSession, f"framelake_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{scratch_dir(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
