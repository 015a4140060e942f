"""Session helpers: where shared files go, how lineage is cut, how wide a job may run."""

from __future__ import annotations

import io
import math
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir`` or set as the context's checkpoint folder.

    Only a local session that names none (as in tests) gets a temporary one; on
    a cluster that is an error, as executors wouldn't see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="driftloom-")
        context.setCheckpointDir(folder)
        _leave_nothing(spark, folder)
    return context._jsc.sc().getCheckpointDir().get()


def _leave_nothing(spark: SparkSession, folder: str) -> None:
    """Have a folder removed when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder for files that are removed when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/driftloom-{kind}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)
    _leave_nothing(spark, folder)
    return folder


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of ``df``, written once as a table in the shared folder and read from there: columns are pruned, and parts told apart by ``by``."""
    spark = df.sparkSession
    folder = f"{own_folder(spark, 'table')}/rows"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and detached from their lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """Number of tasks a wide stage should have in this session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for ``rows`` rows at ``rows_per_task`` each, at least one."""
    return max(1, math.ceil(rows / rows_per_task))


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per session, wherever they run.

    The archive is written to the shared folder, through Hadoop's file system, so any kind of folder will do.
    """
    context = spark.sparkContext
    if getattr(context, "_driftloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    hadoop = context._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{own_folder(spark, 'package')}/driftloom.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    context._driftloom_shipped = True
