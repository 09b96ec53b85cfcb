"""Session settings that the verbs of this library rely on."""

from __future__ import annotations

import os

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Value rules: arithmetic wraps and divides without raising; one session zone; the optimizer re-plans at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "kolumna", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; conf takes precedence (dots written as in Spark)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session that somebody else made (its runtime settings only)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one is set only where none is (local runs)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kolumna-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder: lineage ends there, and what is read again is what was written."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """cut() for plain columns, as compressed Parquet: written once, its size known to the optimizer, its shuffle files gone."""
    spark = df.sparkSession
    path, key = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import this package from where the driver did.

    A cluster has the package installed or shipped with the job; this only adds a search path.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows may hold long texts
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # buffers of the JVM beside its heap
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark
