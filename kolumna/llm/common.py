"""Helpers shared by the text operators: tables in the shared folder, clean column selection, Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolumna.session import on_workers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words in every contract of this package: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one is set only where none is (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kolumna-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kolumna/{name}-{uuid.uuid4().hex}"
    _written(df, path, partition_by)
    return spark.read.schema(df.schema).parquet(path)


def stored_parts(parts: list[DataFrame], name: str) -> DataFrame:
    """The union of parts of one schema as a stored() table, written one after the other: only one has shuffle files."""
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/kolumna/{name}-{uuid.uuid4().hex}"
    for part in parts:
        _written(part, path)
    return spark.read.schema(parts[0].schema).parquet(path)


#: With this setting Spark deletes a query's shuffle files when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def free(df: DataFrame, only: str = "") -> None:
    """Delete the files of a stored() table (those of the folder ``only``) that nothing will read again."""
    spark = df.sparkSession
    paths = {p for f in df.inputFiles() if (p := f.rsplit("/", 1)[0]).endswith(only)}
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then the Python worker, which waits for its next task, gives the memory it freed back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Texts of ASCII only take Spark's fast path; translate() leaves other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def clean_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
