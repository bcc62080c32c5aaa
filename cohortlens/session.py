"""Session helper for local runs, and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortlens")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local master, where every task shares this machine's disk, falls back to a
    temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="cohortlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table under the shared folder and read it back.

    Used where one result feeds several jobs (cuts and ranks, fits per fold, boosting
    rounds): each job then scans a columnar table instead of running the whole plan again,
    and a lost executor costs a re-read, not a re-computation. Tables that hold texts are
    smaller with ``zstd``.
    """
    path = f"{stage_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    for paths in _COLLECTORS:
        paths.append(path)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a table that ``stage`` returned, once nothing will read it any more."""
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    if len(folders) != 1 or not (folder := folders.pop()).rpartition("/")[2].startswith("staged-"):
        raise ValueError("not a staged table")
    drop_staged(df.sparkSession, folder)


def drop_staged(spark: SparkSession, folder: str) -> None:
    """Delete one staged table by its path; one that is gone already is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_COLLECTORS: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of all tables staged inside the block, for whoever knows when they are not needed any more."""
    paths: list[str] = []
    _COLLECTORS.append(paths)
    try:
        yield paths
    finally:
        _COLLECTORS[:] = [c for c in _COLLECTORS if c is not paths]
