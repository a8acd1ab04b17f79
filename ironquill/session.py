"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ironquill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings given outside stay in force."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that executors share, removed when the application ends.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``.
    Where that is unset, a local session gets a folder of its own; a cluster
    must name one, and not a machine's own.
    """
    base, local = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.startswith("local")
    if not local and (not base or base.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="ironquill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def keep_result(df: DataFrame) -> DataFrame:
    """Compute once what several queries read: a table in the shared folder, so that a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once, and keep which rows are in which partition and in which order."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that is read in fewer pieces than there are cores.

    A table with enough splits is left as it is: large inputs are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
