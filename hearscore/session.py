"""Session settings and stage tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hearscore", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on: adaptive execution
    (which also splits skewed join partitions) and UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that hasn't it
    installed: Arrow UDFs run there."""
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(), "hearscore"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, as the cluster names it.

    Only a local session, which has no other machines, gets a folder of its
    own when the setting is absent.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hearscore-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """New path for one stage table or stream below the shared folder."""
    safe = re.sub(r"\W+", "_", label)
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/hearscore/{app}/{safe}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds more than one branch of a plan (the scoring UDF
    must not run twice) and to cut lineage: the files outlive any executor.
    """
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_stage(df: DataFrame, label: str, buckets: int, column: str) -> DataFrame:
    """The same as a table whose rows lie in ``buckets`` by the hash of
    ``column``: joins on it alone shuffle only the other side.  ``df`` should
    be dealt that way already (``repartition(buckets, column)``), or each task
    writes a file for every bucket."""
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", stage_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def drop_stage(table: DataFrame) -> None:
    """Delete the files of a stage table: after all that reads it is stored."""
    spark = table.sparkSession
    own = f"{shared_dir(spark)}/hearscore/{spark.sparkContext.applicationId}/"
    mark = own.split(":", 1)[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        if mark in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this application: after what was made from
    them is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/hearscore/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
