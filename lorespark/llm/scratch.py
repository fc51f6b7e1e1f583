"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.session import ship_package

#: Arrow batches that Spark hands to Python hold so many bytes; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and batches small unless the session asks for smaller ones."""
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = str(spark.conf.get(setting, "64m")).lower()
    if known in ("67108864b", "67108864", "64m", "64mb"):  # Spark's default
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like that one which ``df`` doesn't have."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a folder of our own on one machine (``local`` master, as in tests); on a cluster, where
    executors would not see it, a ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lorespark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours, whatever file system it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may have ended before the interpreter does
        pass


class Workspace:
    """The intermediate tables of one call of an operator.

    :meth:`write` cuts lineage and survives lost executors, as the table lies in the shared folder. :meth:`drop` removes
    tables that nothing to come reads. What a returned DataFrame still reads stays until the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/lorespark-{uuid.uuid4().hex}-{name}"
        atexit.register(_delete_quietly, spark, self.folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def text_version(text: str = "text") -> Column:
    """Sixteen bytes of a text's SHA-256, which tell rows with the same id apart; null for a null text."""
    return F.unhex(F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))
