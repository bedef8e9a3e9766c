"""Session defaults and the one place where intermediate tables are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "tablemill", **extra: str) -> SparkSession:
    """A session in UTC; master and everything else are the launcher's unless given here."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder: on a cluster a
    machine-local path would be lost with its machine, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tablemill-")
    return _local_scratch[app]


def new_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, stem: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts lineage, survives lost executors and, unlike an RDD checkpoint, keeps column
    pruning and size statistics for whatever reads it next.
    """
    spark = df.sparkSession
    path = new_path(spark, stem)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table behind what :func:`materialize` gave, once nothing reads it any more.

    Anything that is not a folder of its own in the shared folder is left alone.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(shared_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(hadoop.Path(shared_dir(spark)))
    folder = hadoop.Path(spark._jvm.java.net.URI.create(files[0])).getParent()
    if folder.getParent().toUri().getPath() == root.toUri().getPath() and re.search(r"-[0-9a-f]{12}$", folder.getName()):
        fs.delete(folder, True)
