"""Session set-up and the durable scratch area shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(app: str = "corpuscope", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator is planned for.

    AQE coalesces small shuffle partitions, splits skewed join partitions and
    picks broadcast joins from measured sizes, so no operator hints a
    broadcast of data that grows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_library(spark)
    return spark


def ship_library(spark: SparkSession) -> None:
    """Give the executors this package, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="corpuscope-code-"), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(top, package)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, a session inside one process takes a folder of its own;
    on a cluster that is an error, since executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="corpuscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one written table or stream; it goes when the driver ends."""
    path = f"{scratch_root(spark)}/corpuscope/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table while the session still lives; afterwards the folder is the cluster's to clear."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of any store that Spark reaches; nothing if there is no such folder."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(context._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where a result feeds several later stages: the files survive the loss
    of any executor and cut the lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
