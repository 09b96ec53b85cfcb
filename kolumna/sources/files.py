"""Text, fixed-width, key-value, binary, JSON and column-directory sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type letters of column specifications; a blank skips the column, * keeps text.
LETTERS = {
    "b": "boolean", "g": "string", "x": "smallint", "h": "smallint", "i": "int", "j": "bigint", "e": "float", "f": "double",
    "c": "string", "s": "string", "p": "timestamp", "m": "date", "d": "date", "z": "timestamp", "n": "string", "u": "string", "v": "string", "t": "string", "*": "string",
}


def read_csv(spark: SparkSession, path: str, types: str | None = None, sep: str = ",", header: bool = True, names: Sequence[str] = ()) -> DataFrame:
    """Delimited text: with type letters nothing is inferred (and no second pass is made); without, types are inferred."""
    if types is None:
        return spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    kinds = [LETTERS.get(t.lower(), "string") for t in types]
    if header and not names:
        names = spark.read.csv(path, sep=sep, header=True).columns
    names = list(names) or [f"c{i}" for i in range(len(types))]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    df = spark.read.csv(path, sep=sep, header=header, schema=schema)
    return df.select(*[n for n, t in zip(names, types) if t != " "])


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def read_fixed(spark: SparkSession, path: str, types: str, widths: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Fixed-width records, one per line."""
    out: list[Column] = []
    at = 1
    for t, w, n in zip(types, widths, names):
        if t != " ":
            out.append(F.trim(F.substring("value", at, w)).try_cast(LETTERS[t.lower()]).alias(n))
        at += w
    return spark.read.text(path).select(*out)


def key_values(x: Column | str, pair: str, key: str) -> Column:
    """"k=v;k=v" text as a dictionary."""
    return F.str_to_map(x if isinstance(x, Column) else F.col(x), F.lit(pair), F.lit(key))


def prepare_text(df: DataFrame, sep: str = ",") -> DataFrame:
    """Rows as delimited lines, quoted where needed."""
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": sep}).alias("value"))


def save_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def read0(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read1(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_binary(spark: SparkSession, path: str, types: str, names: Sequence[str]) -> DataFrame:
    """Files of fixed-length little-endian records as columns; a file is one task's work."""
    kinds = {"h": ("<i2", "smallint", pa.int16()), "i": ("<i4", "int", pa.int32()), "j": ("<i8", "bigint", pa.int64()), "e": ("<f4", "float", pa.float32()), "f": ("<f8", "double", pa.float64()), "x": ("u1", "smallint", pa.int16())}
    record = np.dtype([(n, kinds[t][0]) for n, t in zip(names, types)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                data = np.frombuffer(content, record)
                yield pa.RecordBatch.from_arrays([pa.array(data[n].astype(kinds[t][2].to_pandas_dtype())) for n, t in zip(names, types)], names=list(names))

    return read1(spark, path).select("content").mapInArrow(rows, ", ".join(f"`{n}` {kinds[t][1]}" for n, t in zip(names, types)))


def save_splayed(df: DataFrame, path: str) -> None:
    """One directory of column chunks (Parquet is columnar, lazy and typed)."""
    df.write.mode("overwrite").parquet(path)


def get_splayed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_parted(df: DataFrame, path: str, *by: str, sort: Sequence[str] = ()) -> None:
    """Partition directories by columns; rows within a file sorted, so that min/max statistics prune."""
    (df.sortWithinPartitions(*by, *sort) if sort else df).write.mode("overwrite").partitionBy(*by).parquet(path)


def csv_to_splayed(spark: SparkSession, csv: str, path: str, types: str | None = None, rows_per_file: int = 0) -> None:
    writer = read_csv(spark, csv, types).write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def save(df: DataFrame, path: str, kind: str) -> None:
    """By extension: csv, txt (tab), json, xml, parquet."""
    w = df.write.mode("overwrite")
    if kind == "csv":
        w.csv(path, header=True)
    elif kind == "txt":
        w.csv(path, header=True, sep="\t")
    elif kind == "json":
        w.json(path)
    elif kind == "xml":
        w.format("xml").option("rowTag", "row").save(path)
    else:
        w.parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_xml(df: DataFrame) -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": "r"}).alias("value"))
