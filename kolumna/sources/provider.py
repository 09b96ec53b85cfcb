"""A virtual-table provider as a Spark data source: tables of a DuckDB file, read in ranges, with column and filter push."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "SMALLINT": "smallint", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BLOB": "binary", "HUGEINT": "decimal(38,0)"}


class Slice(InputPartition):
    def __init__(self, start: int, length: int):
        self.start, self.length = start, length


#: Filters that the source answers itself, as SQL operators.
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class DuckReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.names = options["path"], options["table"], schema.fieldNames()
        self.condition, self.slices = options.get("where", "true"), int(options.get("slices", "4"))
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of a column with a value, null tests and value lists; gives back the others."""
        for f in filters:
            name = '"' + ".".join(f.attribute) + '"' if hasattr(f, "attribute") else None
            if type(f) in _OPERATORS and isinstance(f.value, (int, float, str, bool)):
                self.condition += f" AND {name} {_OPERATORS[type(f)]} ?"
                self.values.append(f.value)
            elif isinstance(f, IsNotNull):
                self.condition += f" AND {name} IS NOT NULL"
            elif isinstance(f, IsNull):
                self.condition += f" AND {name} IS NULL"
            elif isinstance(f, In) and all(isinstance(v, (int, float, str, bool)) for v in f.value):
                self.condition += f" AND {name} IN ({', '.join('?' * len(f.value))})"
                self.values += f.value
            else:
                yield f

    def partitions(self) -> list[Slice]:
        import duckdb

        with duckdb.connect(self.path, read_only=True) as c:
            n = c.execute(f"SELECT count(*) FROM {self.table}").fetchall()[0][0]
        step = max(1, -(-n // self.slices))
        return [Slice(i, step) for i in range(0, max(n, 1), step)]

    def read(self, partition: Slice) -> Iterator:
        import duckdb

        columns = ", ".join(f'"{c}"' for c in self.names)
        sql = f"SELECT {columns} FROM {self.table} WHERE rowid >= {partition.start} AND rowid < {partition.start + partition.length} AND ({self.condition})"
        with duckdb.connect(self.path, read_only=True) as c:
            yield from map(tuple, c.execute(sql, self.values).fetchall())


class DuckSource(DataSource):
    """format("duck"): options path, table, where (pushed as it stands), slices."""

    @classmethod
    def name(cls) -> str:
        return "duck"

    def schema(self) -> str:
        import duckdb

        with duckdb.connect(self.options["path"], read_only=True) as c:
            rows = c.execute(f"DESCRIBE {self.options['table']}").fetchall()
        return ", ".join(f"`{r[0]}` {_TYPES.get(r[1], 'string')}" for r in rows)

    def reader(self, schema: StructType) -> DuckReader:
        return DuckReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DuckSource)


def count(path: str, table: str) -> int:
    """The number of rows, from the source itself."""
    import duckdb

    with duckdb.connect(path, read_only=True) as c:
        return c.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]


def meta(path: str, table: str) -> list[tuple[str, str]]:
    """(column, its type) as the source names them."""
    import duckdb

    with duckdb.connect(path, read_only=True) as c:
        return [(r[0], r[1]) for r in c.execute(f"DESCRIBE {table}").fetchall()]


def append(df: DataFrame, path: str, table: str) -> None:
    """Add rows to a table of the file (made if it is not there), batch by batch; the file takes one writer."""
    import duckdb

    with duckdb.connect(path) as c:
        first = df.limit(0).toArrow()  # noqa: F841 (read by name below)
        c.execute(f"CREATE TABLE IF NOT EXISTS {table} AS SELECT * FROM first")
        for batch in _batches(df):
            c.register("batch", batch)
            c.execute(f"INSERT INTO {table} SELECT * FROM batch")
            c.unregister("batch")


def _batches(df: DataFrame, size: int = 50_000) -> Iterator:
    import pyarrow as pa

    schema, rows = df.limit(0).toArrow().schema, []
    for r in df.toLocalIterator():
        rows.append(r.asDict())
        if len(rows) == size:
            yield pa.Table.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.Table.from_pylist(rows, schema)
