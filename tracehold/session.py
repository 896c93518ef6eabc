"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracehold")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACEHOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once per application.

    Not needed where the package is installed on the executors or passed with
    ``--py-files``; harmless there.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="tracehold-"), "tracehold"), "zip",
            os.path.dirname(package), os.path.basename(package),
        )
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a fresh
    temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    key = context.applicationId
    if key not in _own_folders:
        _own_folders[key] = tempfile.mkdtemp(prefix="tracehold-")
    return _own_folders[key]


_scope = threading.local()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the thread's ``scratch`` folder."""
    return f"{getattr(_scope, 'path', None) or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_folder(spark: SparkSession, path: str) -> None:
    system, place = _located(spark, path)
    system.delete(place, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, place = _located(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there as a whole or not at all."""
    system, place = _located(spark, path)
    part = place.suffix(".part")
    out = system.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not system.rename(part, place):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file, without a job."""
    system, place = _located(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized by this thread meanwhile are deleted at the end.

    Frames that read them must have been written or collected by then.
    """
    outer = getattr(_scope, "path", None)
    _scope.path = mine = new_folder(spark, "scratch")
    try:
        yield
    finally:
        _scope.path = outer
        delete_folder(spark, mine)


def materialize(frame: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner
    real file sizes for the joins that follow.
    """
    spark = frame.sparkSession
    path = path or new_folder(spark, label)
    frame.write.mode("overwrite").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
