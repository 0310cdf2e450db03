"""Tables as immutable versions: a name leads to a list of written files, and a change makes the next list.

An append adds files; a change of rows replaces only the files that hold one of them. A snapshot is a copy of the dictionaries, so
transactions and savepoints cost nothing per row. Files are Parquet in the data folder, which cuts lineage and outlives executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyforge.errors import InvalidArgument, NotFound
from tallyforge.operators.recursive import shared_folder


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    not_null: bool = False
    primary_key: bool = False
    default: str | None = None
    identity: bool = False
    references: str | None = None


@dataclass(frozen=True)
class Table:
    """``history`` has closed rows of a system-versioned table, with valid_from and valid_to in milliseconds. ``files`` and ``past`` are the
    files of ``data`` and ``history``; a table that was registered, not made here, has none."""

    data: DataFrame
    columns: tuple[Column, ...] = ()
    temporal: bool = False
    history: DataFrame | None = None
    files: tuple[str, ...] = ()
    past: tuple[str, ...] = ()


@dataclass
class Catalog:
    spark: SparkSession
    folder: str
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str]] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)

    def snapshot(self) -> tuple:
        return dict(self.tables), dict(self.views), dict(self.indexes)

    def back_to(self, snapshot: tuple) -> None:
        for name in [*self.tables, *self.views]:
            self.spark.catalog.dropTempView(name)
        self.tables, self.views, self.indexes = (dict(x) for x in snapshot)
        self.publish()

    def publish(self, *names: str) -> None:
        """Make tables, then views, known to Spark under their names."""
        for name in names or self.tables:
            if name in self.tables:
                self.visible(self.tables[name]).createOrReplaceTempView(name)
        for name, text in self.views.items():
            self.spark.sql(text).createOrReplaceTempView(name)

    @staticmethod
    def visible(table: Table) -> DataFrame:
        return table.data.drop("_valid_from") if table.temporal else table.data

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise NotFound(f"no table {name!r}")
        return self.tables[name]

    def put(self, name: str, table: Table) -> None:
        self.tables[name] = table
        self.publish(name)

    def drop(self, name: str) -> None:
        self.get(name)
        del self.tables[name]
        self.indexes = {k: v for k, v in self.indexes.items() if v[0] != name}
        self.spark.catalog.dropTempView(name)

    def written(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as files of a new version of the table ``name``."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.files[path] = name
        return self.over((path,), df)

    def over(self, paths: tuple[str, ...], like: DataFrame) -> DataFrame:
        """The rows of these files, in the columns of ``like``."""
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in like.schema])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def owned(self, name: str) -> Table:
        """The table, with files of its own; one that was registered is written once."""
        table = self.get(name)
        if not table.files and not table.columns:
            data = self.written(name, table.data)
            table = replace(table, data=data, files=tuple(data.inputFiles()))
        return table

    def append(self, name: str, fresh: DataFrame) -> None:
        """Add rows that are ``written``."""
        table = self.owned(name)
        files = (*table.files, *fresh.inputFiles())
        self.put(name, replace(table, data=self.over(files, table.data), files=files))

    def with_past(self, table: Table, name: str, closed: DataFrame) -> Table:
        """The table with more closed rows in its history."""
        past = (*table.past, *self.written(f"{name}_history", closed).inputFiles())
        return replace(table, history=self.over(past, table.history), past=past)

    def new_version(self, name: str, df: DataFrame, **changes) -> None:
        """All rows anew."""
        data = self.written(name, df)
        self.put(name, replace(self.get(name), data=data, files=tuple(data.inputFiles()), **changes))

    def column(self, name: str, column: str) -> str:
        """The stored spelling of a column."""
        for c in self.get(name).data.columns:
            if c.lower() == column.strip('"`[]').lower():
                return c
        raise InvalidArgument(f"no column {column!r} in {name!r}")


def data_folder(spark: SparkSession, folder: str | None) -> str:
    if folder:
        return folder.rstrip("/")
    return f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}"
