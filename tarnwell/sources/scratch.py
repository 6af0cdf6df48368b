"""Tables that jobs leave for later jobs, in a folder that all nodes see.

They go under ``spark.checkpoint.dir`` and are deleted when the application ends.
Only a session on one machine may do without that setting; it then uses the
machine's temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop's objects."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, files = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no later job reads."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    what later jobs read survives the loss of any executor.  Each task writes one
    file."""
    path = f"{folder or shared_folder(df.sparkSession, name)}/table"
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, which outlives the application; made where there is none
    that was written to its end."""
    end, files = _path(spark, f"{path}/_SUCCESS")
    if not files.exists(end):
        make().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def file_number() -> Column:
    """Of a table from ``stored``: the number of the task that wrote a row's file."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")


def row_number() -> Column:
    """Of a table from ``stored``: a number that is each row's own in every read."""
    return F.shiftleft(file_number(), 40) + F.col("_metadata.row_index")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the parents of the target are made."""
    there, files = _path(spark, target)
    files.mkdirs(there.getParent())
    if not files.rename(_path(spark, source)[0], there):
        raise OSError(f"{source} could not be renamed to {target}")


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file if there is none of that name; false if there is.  The text is
    written aside first, so nobody reads half of it."""
    there, files = _path(spark, path)
    aside = _path(spark, f"{path}.{uuid.uuid4().hex}")[0]
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        jvm = spark.sparkContext._jvm
        if files.getScheme() == "file":  # a hard link is made only where there is no file
            local = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(local(jvm.java.net.URI.create(f"file://{there.toUri().getPath()}")), local(jvm.java.net.URI.create(f"file://{aside.toUri().getPath()}")))
            return True
        return files.rename(aside, there)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        files.delete(aside, False)


def read_text(spark: SparkSession, path: str) -> str:
    there, files = _path(spark, path)
    stream = files.open(there)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
