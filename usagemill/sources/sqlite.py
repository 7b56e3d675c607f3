"""SQLite databases as a Spark data source.

    spark.dataSource.register(SqliteSource)
    spark.read.format("usagemill_sqlite").schema(...).option("path", glob).option("table", name).load()

Each database file is one partition. Columns that a database lacks are null, a
table that it lacks gives no rows, and comparisons with constants are handed to
SQLite.

SQLite reads through a file system, so the path must be one that the driver and
the executors have mounted; any other scheme than file is refused, and so is a
path that isn't there. A file that is no database at all gives no rows. One that
breaks off while it is read is an error: its rows so far would pass for all.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
FILE = "src_file"


class DatabaseFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.table, self.where = schema, options["table"], options.get("where")
        self.path, self.pushed = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else FILE
            if name != FILE and type(f) in _COMPARE and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.pushed.append((name, _COMPARE[type(f)], f.value))
            elif name != FILE and isinstance(f, IsNotNull):
                self.pushed.append((name, "IS NOT", None))
            yield f  # Spark checks again, as SQLite's types are looser

    def partitions(self) -> list[DatabaseFile]:
        scheme, _, rest = self.path.partition("://")
        if rest and scheme != "file":
            raise ValueError(f"SQLite can't read {self.path}: mount it, and give its path there")
        path = self.path.removeprefix("file://")
        if not glob.glob(path) and not os.path.exists(path):
            raise FileNotFoundError(self.path)
        found = [os.path.join(root, n) for root, _, names in os.walk(path) for n in names if n.endswith((".db", ".sqlite"))] if os.path.isdir(path) else glob.glob(path)
        return [DatabaseFile(p) for p in sorted(found)] or [DatabaseFile("")]

    def read(self, partition: DatabaseFile) -> Iterator[tuple]:
        if not partition.path:
            return
        con = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            try:
                there = {r[1] for r in con.execute(f"PRAGMA table_info({quoted(self.table)})")}
            except sqlite3.DatabaseError:
                return  # not a database: like a file that doesn't parse
            if not there:
                return
            names = [f.name for f in self.schema.fields]
            kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
            asked = [quoted(n) if n in there else "?" if n == FILE else "NULL" for n in names]
            values: list = [f"file://{partition.path}"] * asked.count("?")
            tests = [f"({self.where})"] if self.where else []
            for name, op, value in self.pushed:
                if name in there and kinds[name] in ("bigint", "double", "string"):
                    tests.append(f"{quoted(name)} {op} ?")
                    values.append(value)
            sql = f"SELECT {', '.join(asked)} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
            casts = [_CASTS.get(kinds[n], lambda x: x) for n in names]
            for row in con.execute(sql, values):
                yield tuple(None if x is None else c(x) for c, x in zip(casts, row))
        except sqlite3.DatabaseError as e:
            raise RuntimeError(f"{partition.path} broke off while {self.table} was read: {e}") from e
        finally:
            con.close()


def _whole(x: object) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _real(x: object) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


_CASTS = {"bigint": _whole, "double": _real, "string": lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x), "binary": lambda x: x if isinstance(x, bytes) else str(x).encode()}


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usagemill_sqlite"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, schema: str, where: str | None = None) -> DataFrame:
    """table of every database below path; the column src_file names the database."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader with push-down needs it when planned
    reader = spark.read.format(SqliteSource.name()).schema(schema).option("path", path).option("table", table)
    return (reader.option("where", where) if where else reader).load()
