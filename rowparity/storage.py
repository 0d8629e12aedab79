"""The application's folder on shared storage, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    That setting names storage which driver and executors share.  Only a local
    session, as in tests, may leave it unset: a temporary folder then stands
    in.  The file system deletes the folder when the driver's JVM ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name storage that the driver and the executors share")
        folder = f"{(root or tempfile.mkdtemp(prefix='rowparity-')).rstrip('/')}/rowparity-{app}"
        path, system = _path(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def _path(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def listing(spark: SparkSession, path: str) -> list[list]:
    """[path, bytes, milliseconds] of each file at or below ``path``; a missing one raises."""
    place, system = _path(spark, path)
    found, out = system.listFiles(place, True), []
    while found.hasNext():
        status = found.next()
        out.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return sorted(out)


def children(spark: SparkSession, folder: str, mark: str) -> list[str]:
    """The folders in ``folder`` that have a file ``mark``; none if it doesn't exist."""
    place, system = _path(spark, folder)
    found = [s.getPath().toString() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(p for p in found if system.exists(_path(spark, f"{p}/{mark}")[0]))


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or archive in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage: what follows reads files that survive the loss of
    an executor, and an expensive step runs once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of what is now written
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    own = shared_folder(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(own):
            delete(spark, folder)
