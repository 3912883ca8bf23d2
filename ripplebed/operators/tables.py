"""Tables that cut the lineage: written to the folder which driver and executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``, or the folder that was given to
    ``setCheckpointDir``.  Only where neither is set and all runs in one process
    (in tests) a temporary folder is made, and removed at exit; on a cluster a
    folder of one machine would lose tables, so there that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        told = folder.get() if folder.isDefined() else None
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="ripplebed-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
    return "file://" + _OWN_FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a written file, where the number of rows is known beforehand.
FILE_BYTES = 16 << 20
#: On a local file system, files without a second one of checksums; other stores know neither setting.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_table(df: DataFrame, path: str, rows: int | None = None, width: int = 16) -> DataFrame:
    """Write ``df`` as Parquet and read it back; at most ``rows`` rows of ``width`` bytes go into as few files as they need."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows * width // FILE_BYTES)))
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str, rows: int | None = None, width: int = 16) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs read files that outlive any executor
    instead of computing ``df`` again.
    """
    return write_table(df, new_path(df.sparkSession, name), rows, width)


def file_system(spark: SparkSession, path: str):
    """Spark's file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, at.makeQualified(fs.getUri(), fs.getWorkingDirectory())


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)
