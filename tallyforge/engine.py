"""The engine: SQL text in, DataFrames out. Queries go to Spark; statements that Spark has not for plain files are done here."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyforge.catalog import Catalog, Column, Table, data_folder
from tallyforge.errors import InvalidArgument, NotFound, ParseError, Unsupported
from tallyforge.operators import recursive, similarity
from tallyforge.plans import extensions
from tallyforge.plans.scan import cut, find, inside, mask, name_of, split
from tallyforge.sources import files

#: Type names of statements, as Spark has them.
TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "text": "string", "float": "double", "double": "double", "real": "float", "bit": "boolean", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "json": "string", "array": "array<string>", "uuid": "string", "bytea": "binary", "binary": "binary", "varbinary": "binary", "varchar": "string", "nvarchar": "string", "char": "string", "enum": "string", "time": "bigint", "string": "string"}
FOREVER = (1 << 63) - 1


def spark_type(text: str) -> str:
    m = re.match(r"\s*([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?", text)
    if not m:
        raise ParseError(f"type expected: {text!r}")
    kind, size = m[1].lower(), m[2]
    if kind in ("decimal", "numeric"):
        return f"decimal({size or '18,2'})"
    if kind not in TYPES:
        raise ParseError(f"unknown type {m[1]!r}")
    return TYPES[kind]


class Engine:
    """``clock`` gives milliseconds, for system-versioned tables. ``log_path`` is a folder to which committed changes are added, a file each."""

    def __init__(self, spark: SparkSession, data_dir: str | None = None, log_path: str | None = None, clock: Callable[[], int] | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, data_folder(spark, data_dir))
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.procedures: dict[str, tuple[list[str], str]] = {}
        self.table_types: dict[str, tuple[Column, ...]] = {}
        self.context: dict[str, str] = {}
        self.hints: dict[str, str] = {}
        self.schemas: set[str] = set()
        self._arguments = 0
        self.log_path, self._log, self._replaying = log_path, [], False
        self._transaction: tuple | None = None
        self._savepoints: list[tuple[str, tuple, int]] = []

    # ------------------------------------------------------------ entry points

    def load_parquet(self, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
        return self.register(name, files.read_parquet(self.spark, path, columns))

    def load_parquet_for(self, path: str, name: str, sql: str) -> DataFrame:
        """Only the columns that ``sql`` reads."""
        return self.load_parquet(path, name, files.needed_columns(self.spark, path, name, sql))

    def load_csv(self, path: str, name: str, header: bool = True) -> DataFrame:
        return self.register(name, files.read_csv(self.spark, path, header))

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self.catalog.put(name_of(name), Table(df))
        return df

    def query(self, text: str, **params) -> DataFrame:
        """A query that changes nothing; anything else is an error."""
        if not re.match(r"\s*(\(|select\b|with\b|values\b)", mask(text) if text.strip().startswith("--") else text, re.I):
            raise Unsupported("not a query")
        return self._select(text, params)

    def batch(self, text: str) -> list[DataFrame]:
        """Statements parted by semicolons."""
        return [self.sql(s) for s in split(text, ";")]

    def scalar(self, text: str):
        row = self.sql(text).first()
        return row[0] if row else None

    def flush(self) -> None:
        """Write what the log still holds, as one further file of the log's folder."""
        if self.log_path and self._log:
            n = len(self._log_files())
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.log_path}/{n:012d}.json")
            out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
            out.write("".join(json.dumps({"sql": s}) + "\n" for s in self._log).encode())
            out.close()
        self._log = []

    def _log_files(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.log_path)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        return sorted(s.getPath().toString() for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def replay(self) -> int:
        """Run the log's statements again, in a fresh engine."""
        self._replaying = True
        try:
            lines: list[str] = []
            for path in self._log_files():
                lines += [r.value for r in self.spark.read.text(path).toLocalIterator()]
            # A line that was cut off while it was written is no statement; only the last can be.
            lines = [json.loads(x)["sql"] for k, x in enumerate(lines) if k + 1 < len(lines) or x.endswith("}")]
            for s in lines:
                self.sql(s)
        finally:
            self._replaying = False
        return len(lines)

    def sql(self, text: str, **params) -> DataFrame:
        """Run one statement. Changes give one row, ``rows_affected``; others that have no answer give ``status``."""
        text = text.strip().rstrip(";").strip()
        head = " ".join(re.findall(r"[A-Za-z_]+", mask(text))[:4]).upper()
        for words, run in self._statements():
            if head == words or head.startswith(words + " "):
                return run(text)
        return self._select(text, params)

    def _statements(self):
        log = self._logged
        return (
            ("EXPLAIN", self._explain), ("ANALYZE", self._analyze), ("VACUUM", self._vacuum), ("CHECKPOINT", self._checkpoint), ("COPY", self._copy),
            ("BEGIN", self._begin), ("COMMIT", self._commit), ("ROLLBACK TO", self._rollback_to), ("ROLLBACK", self._rollback), ("SAVEPOINT", self._savepoint), ("RELEASE", self._release),
            ("CREATE TABLE", log(self._create_table)), ("DROP TABLE", log(self._drop_table)), ("ALTER TABLE", log(self._alter)), ("CREATE SCHEMA", log(self._create_schema)),
            ("CREATE INDEX", log(self._create_index)), ("CREATE UNIQUE INDEX", log(self._create_index)), ("DROP INDEX", log(self._drop_index)),
            ("CREATE VIEW", log(self._create_view)), ("CREATE OR ALTER VIEW", log(self._create_view)), ("CREATE OR REPLACE VIEW", log(self._create_view)), ("DROP VIEW", log(self._drop_view)),
            ("CREATE PROCEDURE", log(self._procedure)), ("CREATE OR ALTER PROCEDURE", log(self._procedure)), ("CREATE FUNCTION", log(self._function)), ("CREATE OR ALTER FUNCTION", log(self._function)), ("CREATE TYPE", log(self._create_type)),
            ("EXEC", self._exec), ("EXECUTE", self._exec), ("INSERT", log(self._insert)), ("UPDATE", log(self._update)), ("DELETE", log(self._delete)), ("MERGE", log(self._merge)),
        )

    def _logged(self, run):
        def both(text: str) -> DataFrame:
            out = run(text)
            if self.log_path and not self._replaying:
                self._log.append(text)
                if self._transaction is None:
                    self.flush()
            return out

        return both

    def _status(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "status string")

    def _affected(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "rows_affected long")

    # ------------------------------------------------------------ queries

    def _select(self, text: str, params: dict | None = None) -> DataFrame:
        text, found = extensions.strip(self._qualified(text))
        self.hints = found.hints
        quoted = lambda m: "NULL" if (v := self.context.get(m[1])) is None else "'" + v.replace("'", "''") + "'"
        text = re.sub(r"\bSESSION_CONTEXT\s*\(\s*N?'([^']*)'\s*\)", quoted, text, flags=re.I)
        text = self._as_of(text)
        if find(text, "PIVOT"):
            text = self._pivot(text)
        m = re.search(r"\bOPTION\s*\(\s*MAXRECURSION\s+(\d+)\s*\)\s*$", text, re.I)
        if re.match(r"\s*WITH\b", text, re.I) and (m or find(text, "RECURSIVE")):
            return self._recursive(text[: m.start()] if m else text, int(m[1]) if m else recursive.DEFAULT_ROUNDS)
        text = self._json(text)
        df = self.spark.sql(text, params or None)
        if found.similar:
            column, value, most = found.similar
            df = similarity.within_hamming(df, column or df.columns[0], value, most)
        return df

    def _create_schema(self, text: str) -> DataFrame:
        """A schema is a part of its tables' names."""
        m = re.match(r"CREATE\s+SCHEMA\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*$", text, re.I)
        if not m:
            raise ParseError(text)
        self.schemas.add(m[1].lower())
        return self._status("created")

    def _qualified(self, text: str) -> str:
        for schema in self.schemas:
            for m in reversed(list(re.finditer(rf"\b{schema}\s*\.\s*(\w+)", mask(text), re.I))):
                text = f"{text[: m.start()]}{schema}_{m[1].lower()}{text[m.end() :]}"
        return text

    def _json(self, text: str) -> str:
        """JSON_VALUE and JSON_QUERY as expressions."""
        for name, keep in (("JSON_VALUE", "NOT"), ("JSON_QUERY", "")):
            while (m := re.search(rf"\b{name}\s*\(", mask(text), re.I)) is not None:
                args, stop = inside(text, m.start())
                doc, path = split(args)
                kind = f"upper(schema_of_variant(try_variant_get(try_parse_json({doc}), {path}, 'variant')))"
                test = f"({kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%')"
                if keep:
                    test = f"NOT {test} AND {kind} <> 'VOID'"
                text = f"{text[: m.start()]}(CASE WHEN {test} THEN get_json_object({doc}, {path}) END){text[stop:]}"
        return text

    def _as_of(self, text: str) -> str:
        pattern = r"\b([A-Za-z_]\w*)\s+FOR\s+SYSTEM_TIME\s+(AS\s+OF\s+(\d+)|BETWEEN\s+(\d+)\s+AND\s+(\d+)|ALL)"
        for k, m in enumerate(list(re.finditer(pattern, text, re.I))):
            view = f"_as_of_{k}_{m[1].lower()}"
            table = m[1].lower()
            if m[3]:
                df = self.as_of(table, int(m[3]))
            elif m[4]:
                df = self.between(table, int(m[4]), int(m[5]))
            else:
                df = self.versions(table)
            df.createOrReplaceTempView(view)
            text = text.replace(m[0], view, 1)
        return text

    def _pivot(self, text: str) -> str:
        """PIVOT groups by the first other column; values in brackets or quotes."""
        at = find(text, "PIVOT")
        spec, stop = inside(text, at[1])
        m = re.match(r"\s*(\w+)\s*\(\s*([^)]+)\)\s+FOR\s+([\w`\"\[\]]+)\s+IN\s*\((.*)\)\s*$", spec, re.I | re.S)
        source = re.search(r"\bFROM\s+([\w.`\"\[\]]+)\s*(?:AS\s+\w+\s*|\w+\s*)?$", text[: at[0]].rstrip(), re.I)
        if not m or not source:
            return text
        how, column, on, values = m[1].lower(), m[2].strip(), m[3].strip('"`[]'), [v.strip() for v in split(m[4])]
        named = [(v.strip("[]'\"`"), v) for v in values]
        df = self.spark.table(name_of(source[1]))
        used = {column.lower(), on.lower()}
        group = next((c for c in df.columns if c.lower() not in used), None)
        if group is None:
            raise InvalidArgument("PIVOT needs a column to group by")
        kind = df.schema[next(c for c in df.columns if c.lower() == on.lower())].dataType.simpleString()
        literal = lambda v: f"CAST('{v}' AS {kind})"
        cells = ", ".join(f"{how}({column}) FILTER (WHERE `{on}` = {literal(v)}) AS `{v}`" for v, _ in named)
        rest = re.sub(r"^\s*(AS\s+)?(?!WHERE\b|ORDER\b|LIMIT\b|GROUP\b|HAVING\b)[A-Za-z_]\w*", "", text[stop:], flags=re.I)
        head = text[: source.start()]
        return f"{head} FROM (SELECT `{group}`, {cells} FROM {name_of(source[1])} GROUP BY `{group}`) AS _pivoted {rest}"

    def _recursive(self, text: str, rounds: int) -> DataFrame:
        """Standard recursion is Spark's own. A body with UNION (set semantics) runs to its fixed point."""
        m = re.match(r"\s*WITH\s+(?:RECURSIVE\s+)?(\w+)\s*(\([^)]*\))?\s+AS\s*", text, re.I)
        body, stop = inside(text, m.end())
        at = find(body, "UNION")
        is_all = at and re.match(r"\s*ALL\b", body[at[1] :], re.I)
        rest = text[stop:].strip()
        refers = at and re.search(rf"\b{m[1]}\b", mask(body[at[1] :]), re.I)
        if not at or not refers or rest.startswith(","):
            return self.spark.sql(text)
        limit = rounds or recursive.NO_LIMIT
        if is_all:
            native = re.sub(r"^(\s*WITH)\s+(?:RECURSIVE\s+)?(\w+\s*(?:\([^)]*\))?)\s+AS\s*", rf"\1 RECURSIVE \2 MAX RECURSION LEVEL {limit} AS ", text, count=1, flags=re.I)
            return self.spark.sql(native)
        anchor = self.spark.sql(body[: at[0]])
        if m[2]:
            anchor = anchor.toDF(*split(m[2][1:-1]))

        def step(new: DataFrame) -> DataFrame:
            new.createOrReplaceTempView(m[1])
            return self.spark.sql(body[at[1] :])

        out = recursive.fixpoint(anchor, step, rounds)
        out.createOrReplaceTempView(m[1])
        df = self.spark.sql(rest)
        self.spark.catalog.dropTempView(m[1])
        return df

    def _explain(self, text: str) -> DataFrame:
        plan = self._select(text.split(None, 1)[1])
        return self.spark.createDataFrame([(plan._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),)], "plan string")

    def _analyze(self, text: str) -> DataFrame:
        """Runs the query, without keeping its rows, and times it."""
        df = self._select(text.split(None, 1)[1])
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return self.spark.createDataFrame([((time.time() - began) * 1000,)], "execution_time_ms double")

    # ------------------------------------------------------------ tables, views, indexes

    def _column(self, text: str) -> Column | None:
        if re.match(r"\s*(PRIMARY\s+KEY|FOREIGN\s+KEY|CONSTRAINT|UNIQUE|CHECK|PERIOD)\b", text, re.I):
            return None
        m = re.match(r"\s*([\w`\"\[\]]+)\s+(.*)$", text, re.S)
        if not m:
            raise ParseError(f"column expected: {text!r}")
        rest = m[2]
        default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\([^)]*\)|[\w.+-]+(?:\([^)]*\))?)", rest, re.I)
        refers = re.search(r"\bREFERENCES\s+([\w.]+)", rest, re.I)
        has = lambda w: bool(re.search(rf"\b{w}\b", mask(rest), re.I))
        return Column(m[1].strip('"`[]'), spark_type(rest), has(r"NOT\s+NULL") or has(r"PRIMARY\s+KEY"), has(r"PRIMARY\s+KEY"), default[1] if default else None, has("IDENTITY"), refers[1] if refers else None)

    def _create_table(self, text: str) -> DataFrame:
        m = re.match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([\w.`\"\[\]]+)\s*", text, re.I)
        name = name_of(m[2])
        if name in self.catalog.tables:
            if m[1]:
                return self._status("exists")
            raise InvalidArgument(f"table {name!r} exists")
        if re.match(r"AS\b", text[m.end() :], re.I):
            df = self._select(text[m.end() :].split(None, 1)[1])
            self.catalog.tables[name] = Table(df)
            self.catalog.new_version(name, df)
            return self._status("created")
        body, stop = inside(text, m.end())
        columns = tuple(c for c in map(self._column, split(body)) if c)
        keys = re.search(r"PRIMARY\s+KEY\s*\(([^)]*)\)", body, re.I)
        if keys:
            named = {k.strip('"`[] ').lower() for k in keys[1].split(",")}
            columns = tuple(replace(c, primary_key=True, not_null=True) if c.name.lower() in named else c for c in columns)
        temporal = bool(re.search(r"SYSTEM_VERSIONING\s*=\s*ON", text[stop:], re.I))
        schema = ", ".join([f"`{c.name}` {c.type}" for c in columns] + ["`_valid_from` bigint"] * temporal)
        data = self.spark.createDataFrame([], schema)
        history = self.spark.createDataFrame([], schema + ", `_valid_to` bigint") if temporal else None
        self.catalog.put(name, Table(data, columns, temporal, history))
        return self._status("created")

    def _drop_table(self, text: str) -> DataFrame:
        m = re.match(r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?(.+)$", text, re.I)
        name = name_of(m[2])
        if name not in self.catalog.tables and m[1]:
            return self._status("absent")
        self.catalog.drop(name)
        return self._status("dropped")

    def _alter(self, text: str) -> DataFrame:
        m = re.match(r"ALTER\s+TABLE\s+([\w.`\"\[\]]+)\s+(ADD|DROP|ALTER)\s+(?:COLUMN\s+)?(.*)$", text, re.I | re.S)
        if not m:
            raise ParseError(text)
        name, verb, rest = name_of(m[1]), m[2].upper(), m[3]
        table = self.catalog.get(name)
        df, columns = table.data, table.columns
        if verb == "ADD":
            c = self._column(rest)
            df = df.withColumn(c.name, (F.expr(c.default) if c.default else F.lit(None)).cast(c.type))
            columns = (*columns, c)
        elif verb == "DROP":
            gone = self.catalog.column(name, rest.strip())
            if len(df.columns) - table.temporal == 1:
                raise InvalidArgument("the last column cannot be dropped")
            df, columns = df.drop(gone), tuple(c for c in columns if c.name != gone)
        else:
            word, kind = rest.split(None, 1)
            kind = re.sub(r"^TYPE\s+", "", kind, flags=re.I)
            old, new = self.catalog.column(name, word), spark_type(kind)
            df = df.withColumn(old, F.col(old).cast(new))
            columns = tuple(replace(c, type=new) if c.name == old else c for c in columns)
        history = table.history
        if table.temporal:
            history = self.spark.createDataFrame([], df.schema).withColumn("_valid_to", F.lit(0).cast("long")).unionByName(history, allowMissingColumns=True).select(*df.columns, "_valid_to") if verb != "DROP" else history.drop(gone)
        past = ()
        if table.temporal:
            history = self.catalog.written(f"{name}_history", history)
            past = tuple(history.inputFiles())
        self.catalog.new_version(name, df, columns=columns, history=history, past=past)
        return self._status("altered")

    def _create_index(self, text: str) -> DataFrame:
        """A hint for introspection: equality lookups use Parquet statistics."""
        m = re.match(r"CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+([\w.]+)\s*\(\s*([\w`\"]+)", text, re.I)
        if not m:
            raise ParseError(text)
        self.catalog.indexes[m[1].lower()] = name_of(m[2]), self.catalog.column(name_of(m[2]), m[3])
        return self._status("created")

    def _drop_index(self, text: str) -> DataFrame:
        m = re.match(r"DROP\s+INDEX\s+(IF\s+EXISTS\s+)?(\w+)", text, re.I)
        if self.catalog.indexes.pop(m[2].lower(), None) is None and not m[1]:
            raise NotFound(f"no index {m[2]!r}")
        return self._status("dropped")

    def _create_view(self, text: str) -> DataFrame:
        m = re.match(r"CREATE\s+(?:OR\s+(?:ALTER|REPLACE)\s+)?VIEW\s+([\w.`\"\[\]]+)\s+AS\s+(.*)$", text, re.I | re.S)
        if not m:
            raise ParseError(text)
        name = name_of(m[1])
        if name in self.catalog.views and not re.match(r"CREATE\s+OR\b", text, re.I):
            raise InvalidArgument(f"view {name!r} exists")
        self.spark.sql(m[2]).createOrReplaceTempView(name)
        self.catalog.views[name] = m[2]
        return self._status("created")

    def _drop_view(self, text: str) -> DataFrame:
        m = re.match(r"DROP\s+VIEW\s+(IF\s+EXISTS\s+)?(.+)$", text, re.I)
        name = name_of(m[2])
        if self.catalog.views.pop(name, None) is None:
            if m[1]:
                return self._status("absent")
            raise NotFound(f"no view {name!r}")
        self.spark.catalog.dropTempView(name)
        return self._status("dropped")

    # ------------------------------------------------------------ changes of rows

    def _stamped(self, df: DataFrame, table: Table) -> DataFrame:
        return df.withColumn("_valid_from", F.lit(self.clock()).cast("long")) if table.temporal else df

    def _insert(self, text: str) -> DataFrame:
        m = re.match(r"INSERT\s+INTO\s+([\w.`\"\[\]]+)\s*", text, re.I)
        if not m:
            raise ParseError(text)
        name, at = name_of(m[1]), m.end()
        table = self.catalog.get(name)
        stored = [c for c in table.data.columns if c != "_valid_from"]
        listed = stored
        if text[at:].lstrip().startswith("("):
            inner, stop = inside(text, at)
            if not re.match(r"\s*(SELECT|WITH|VALUES)\b", inner, re.I):
                listed, at = [self.catalog.column(name, c) for c in split(inner)], stop
        body = text[at:].strip()
        rows = self.spark.sql(f"SELECT * FROM ({body})" if re.match(r"VALUES\b", body, re.I) else body)
        if len(rows.columns) != len(listed):
            raise InvalidArgument(f"{len(listed)} columns expected, {len(rows.columns)} given")
        rows = rows.toDF(*listed)
        by_name = {c.name: c for c in table.columns}
        full = []
        for c in stored:
            kind = table.data.schema[c].dataType
            default = by_name[c].default if c in by_name else None
            value = F.col(c) if c in listed else F.expr(default) if default else F.lit(None)
            full.append(value.cast(kind).alias(c))
        rows = rows.select(*full)
        identity = [c.name for c in table.columns if c.identity and c.name not in listed]
        if identity:
            rows = self._numbered(name, rows, identity, table).select(*stored)
        # Written once, then counted and checked as they are in the files.
        fresh = self.catalog.written(name, self._stamped(rows, table))
        self._check(name, fresh, table.data)
        self.catalog.append(name, fresh)
        return self._affected(fresh.count())

    def _numbered(self, name: str, rows: DataFrame, identity: list[str], table: Table) -> DataFrame:
        """``rows`` with the next numbers in the columns ``identity``: each task's rows follow those of the tasks before it."""
        staged = self.catalog.written(f"{name}_staged", rows.withColumn("_n", F.monotonically_increasing_id()))
        task = F.expr("shiftright(_n, 33)")
        # One row per task that wrote rows.
        counts = staged.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
        before, offsets = 0, []
        for r in counts:
            offsets.append((r.task, before))
            before += r.n
        placed = staged.withColumn("_task", task).join(F.broadcast(self.spark.createDataFrame(offsets, "_task long, _before long")), "_task")
        for c in identity:
            top = table.data.agg(F.max(c)).first()[0] or 0
            placed = placed.withColumn(c, (F.col("_before") + F.expr("_n & 8589934591") + 1 + top).cast(table.data.schema[c].dataType))
        return placed

    def _check(self, name: str, fresh: DataFrame, old: DataFrame | None) -> None:
        """Constraints that new rows must meet: NOT NULL, PRIMARY KEY (against ``old`` as well), REFERENCES."""
        columns = self.catalog.get(name).columns
        needed = [c.name for c in columns if c.not_null]
        if needed and not fresh.where(" OR ".join(f"`{c}` IS NULL" for c in needed)).isEmpty():
            raise InvalidArgument(f"null in a NOT NULL column of {name!r}")
        key = [c.name for c in columns if c.primary_key]
        if key:
            twice = fresh.groupBy(*key).count().where("count > 1")
            if not twice.isEmpty() or old is not None and not fresh.select(*key).join(old.select(*key), key, "left_semi").isEmpty():
                raise InvalidArgument(f"primary key of {name!r} is not unique")
        for c in columns:
            parent = name_of(c.references.split("(")[0]) if c.references else None
            if parent in self.catalog.tables:
                other = self.catalog.get(parent)
                at = next((p.name for p in other.columns if p.primary_key), other.data.columns[0])
                keys = other.data.select(F.col(at).alias(c.name))
                keys = keys.unionByName(fresh.select(c.name)) if parent == name else keys
                if not fresh.select(c.name).where(F.col(c.name).isNotNull()).join(keys, c.name, "left_anti").isEmpty():
                    raise InvalidArgument(f"{c.name!r} of {name!r} refers to no row of {parent!r}")

    def _change(self, name: str, changed, after) -> int:
        """Rows for which ``changed`` holds become ``after(df)`` (None: they go). Files without such rows stay as they are; old versions of a
        temporal table are kept."""
        table = self.catalog.owned(name)
        if not table.files:
            return 0
        test = F.coalesce(changed, F.lit(False))
        # One row per file that holds a hit.
        found = table.data.where(test).groupBy(F.col("_metadata.file_path").alias("file")).count().collect()
        n = sum(r["count"] for r in found)
        if not n:
            return 0
        short = lambda f: "/".join(f.rsplit("/", 2)[1:])  # noqa: E731  the file systems' spellings of a path differ
        touched = {short(r.file) for r in found}
        old = self.catalog.over(tuple(f for f in table.files if short(f) in touched), table.data)
        now = self.clock()
        new = old.where(~test)
        if after is not None:
            changed_rows = self.catalog.written(name, self._stamped(after(old.where(test)), table).select(*table.data.columns))
            keys = [c for c in table.columns if c.primary_key or c.not_null or c.references]
            if keys:
                untouched = table.data.where(~test)
                self._check(name, changed_rows, untouched)
            files = tuple(changed_rows.inputFiles())
        else:
            files = ()
        files = (*(f for f in table.files if short(f) not in touched), *self.catalog.written(name, new).inputFiles(), *files)
        if table.temporal:
            table = self.catalog.with_past(table, name, old.where(test).withColumn("_valid_to", F.lit(now).cast("long")))
        self.catalog.put(name, replace(table, data=self.catalog.over(files, table.data), files=files))
        return n

    def _update(self, text: str) -> DataFrame:
        m = re.match(r"UPDATE\s+([\w.`\"\[\]]+)\s+SET\s+", text, re.I)
        if not m:
            raise ParseError(text)
        name = name_of(m[1])
        sets, where = cut(text[m.end() :], "WHERE")
        table = self.catalog.get(name)
        values = {}
        for s in split(sets):
            column, value = s.split("=", 1)
            values[self.catalog.column(name, column.strip())] = value
        after = lambda df: df.select(*[F.expr(values[c]).cast(table.data.schema[c].dataType).alias(c) if c in values else F.col(c) for c in df.columns])
        return self._affected(self._change(name, self._where(name, where), after))

    def _delete(self, text: str) -> DataFrame:
        m = re.match(r"DELETE\s+FROM\s+([\w.`\"\[\]]+)\s*", text, re.I)
        if not m:
            raise ParseError(text)
        _, where = cut(text[m.end() - 1 :], "WHERE")
        return self._affected(self._change(name_of(m[1]), self._where(name_of(m[1]), where), None))

    def _where(self, name: str, where: str | None):
        return F.expr(where) if where else F.lit(True)

    def _merge(self, text: str) -> DataFrame:
        m = re.match(r"MERGE\s+(?:INTO\s+)?([\w.]+)(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s+", text, re.I)
        if not m:
            raise ParseError(text)
        name, target = name_of(m[1]), (m[2] or name_of(m[1])).lower()
        rest = text[m.end() :]
        if rest.startswith("("):
            inner, stop = inside(rest)
            source = self.spark.sql(inner if re.match(r"\s*(SELECT|WITH)\b", inner, re.I) else f"SELECT * FROM ({inner})")
        else:
            word = re.match(r"[\w.]+", rest)
            source, stop = self.spark.table(name_of(word[0])), word.end()
        alias = re.match(r"\s*(?:AS\s+)?(?!ON\b)(\w+)?\s*", rest[stop:], re.I)
        source_name, stop = (alias[1] or "source").lower(), stop + alias.end()
        if rest[stop : stop + 1] == "(":
            names, end = inside(rest, stop)
            source, stop = source.toDF(*split(names)), end
        on_at = find(rest, "ON", stop)
        whens = [(w.start(), w.end()) for w in re.finditer(r"\bWHEN\b", mask(rest), re.I) if w.start() > on_at[1]]
        condition = rest[on_at[1] : whens[0][0]]
        table = self.catalog.get(name)
        stored = [c for c in table.data.columns if c != "_valid_from"]
        t = table.data.withColumn("_t", F.monotonically_increasing_id()).alias(target)
        s = source.withColumn("_s", F.monotonically_increasing_id()).alias(source_name)
        both = t.join(s, F.expr(condition), "full")
        if not both.where("_t IS NOT NULL AND _s IS NOT NULL").groupBy("_t").count().where("count > 1").isEmpty():
            raise InvalidArgument("several source rows match one target row")
        rules = []
        for k, (_, end) in enumerate(whens):
            clause = rest[end : whens[k + 1][0] if k + 1 < len(whens) else len(rest)]
            head, action = cut(clause, "THEN")
            kind = "source" if re.match(r"NOT\s+MATCHED\s+BY\s+SOURCE", head, re.I) else "insert" if re.match(r"NOT\s+MATCHED", head, re.I) else "match"
            extra = cut(head, "AND")[1]
            rules.append((kind, extra, action))
        base = {"match": F.expr("_t IS NOT NULL AND _s IS NOT NULL"), "insert": F.expr("_t IS NULL"), "source": F.expr("_s IS NULL")}
        verdict = F.lit(-1)
        for k, (kind, extra, _) in reversed(list(enumerate(rules))):
            verdict = F.when(base[kind] & (F.coalesce(F.expr(extra), F.lit(False)) if extra else F.lit(True)), k).otherwise(verdict)
        # Without column names of their own, the verdict and the new values are settled in one pass.
        types = {c: table.data.schema[c].dataType for c in stored}
        fresh = {c: F.col(f"{target}.{c}") for c in stored}
        gone = [k for k, (_, _, a) in enumerate(rules) if re.match(r"DELETE\b", a, re.I)]
        for k, (kind, _, action) in enumerate(rules):
            if kind == "insert":
                m = re.match(r"INSERT\s*", action, re.I)
                listed = stored
                at = m.end()
                if action[at : at + 1] == "(":
                    names, at = inside(action, at)
                    listed = [self.catalog.column(name, c) for c in split(names)]
                values = split(inside(action, find(action, "VALUES", at)[1])[0])
                if len(values) != len(listed):
                    raise InvalidArgument("as many values as columns expected")
                given = dict(zip(listed, values))
                for c in stored:
                    fresh[c] = F.when(F.col("_verdict") == k, F.expr(given[c]).cast(types[c]) if c in given else F.lit(None).cast(types[c])).otherwise(fresh[c])
            elif k not in gone:
                for piece in split(re.sub(r"^UPDATE\s+SET\s+", "", action, flags=re.I)):
                    column, value = piece.split("=", 1)
                    c = self.catalog.column(name, column.strip().split(".")[-1])
                    fresh[c] = F.when(F.col("_verdict") == k, F.expr(value).cast(types[c])).otherwise(fresh[c])
        settled = both.withColumn("_verdict", verdict)
        out = settled.select(*[fresh[c].alias(c) for c in stored], "_verdict", "_t", *(["_valid_from"] if table.temporal else []))
        out = self.catalog.written(f"{name}_merge", out)
        n = out.where("_verdict >= 0").count()
        new = out.where(F.col("_t").isNotNull() | (F.col("_verdict") >= 0)).where(~F.col("_verdict").isin(gone or [-2]))
        if table.temporal:
            now = F.lit(self.clock()).cast("long")
            changed = out.where("_verdict >= 0 AND _t IS NOT NULL").select("_t")
            table = self.catalog.with_past(table, name, t.join(changed, "_t", "left_semi").drop("_t").withColumn("_valid_to", now))
            new = new.withColumn("_valid_from", F.when(F.col("_verdict") >= 0, now).otherwise(F.col("_valid_from")))
        merged = self.catalog.written(name, new.select(*table.data.columns))
        self._check(name, merged, None)
        self.catalog.put(name, replace(table, data=merged, files=tuple(merged.inputFiles())))
        return self._affected(n)

    # ------------------------------------------------------------ system-versioned tables

    def versions(self, name: str) -> DataFrame:
        """All rows there ever were, with valid_from and valid_to."""
        table = self.catalog.get(name)
        if not table.temporal:
            raise InvalidArgument(f"table {name!r} is not system-versioned")
        now = table.data.withColumn("_valid_to", F.lit(FOREVER).cast("long"))
        return now.unionByName(table.history).withColumnsRenamed({"_valid_from": "valid_from", "_valid_to": "valid_to"})

    def as_of(self, name: str, at: int) -> DataFrame:
        at = min(at, FOREVER - 1)
        return self.versions(name).where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).drop("valid_from", "valid_to")

    def between(self, name: str, low: int, high: int) -> DataFrame:
        """Rows valid at any time from low to high."""
        return self.versions(name).where((F.col("valid_from") <= high) & (F.col("valid_to") > low)).drop("valid_from", "valid_to")

    def version_counts(self, name: str) -> DataFrame:
        """Versions per first column."""
        df = self.versions(name)
        return df.groupBy(df.columns[0]).agg(F.count("*").alias("versions"))

    # ------------------------------------------------------------ transactions

    def _begin(self, text: str) -> DataFrame:
        if self._transaction is not None:
            raise InvalidArgument("a transaction is active")
        self._transaction = (self.catalog.snapshot(), len(self._log))
        return self._status("begun")

    def _need(self) -> None:
        if self._transaction is None:
            raise InvalidArgument("no transaction is active")

    def _commit(self, text: str) -> DataFrame:
        self._need()
        self._transaction, self._savepoints = None, []
        self.flush()
        return self._status("committed")

    def _rollback(self, text: str) -> DataFrame:
        self._need()
        snapshot, n = self._transaction
        self.catalog.back_to(snapshot)
        del self._log[n:]
        self._transaction, self._savepoints = None, []
        return self._status("rolled back")

    def _savepoint(self, text: str) -> DataFrame:
        self._need()
        self._savepoints.append((text.split()[-1].lower(), self.catalog.snapshot(), len(self._log)))
        return self._status("savepoint")

    def _at(self, text: str) -> int:
        name = text.split()[-1].lower()
        for k in range(len(self._savepoints) - 1, -1, -1):
            if self._savepoints[k][0] == name:
                return k
        raise NotFound(f"no savepoint {name!r}")

    def _rollback_to(self, text: str) -> DataFrame:
        self._need()
        k = self._at(text)
        self.catalog.back_to(self._savepoints[k][1])
        del self._log[self._savepoints[k][2] :]
        del self._savepoints[k + 1 :]
        return self._status("rolled back")

    def _release(self, text: str) -> DataFrame:
        self._need()
        del self._savepoints[self._at(text) :]
        return self._status("released")

    # ------------------------------------------------------------ files and upkeep

    def _copy(self, text: str) -> DataFrame:
        m = re.match(r"COPY\s+([\w.`\"\[\]]+)\s+(TO|FROM)\s+'([^']+)'", text, re.I)
        if not m:
            raise ParseError(text)
        name = name_of(m[1])
        table = self.catalog.get(name)
        visible = self.catalog.visible(table)
        if m[2].upper() == "TO":
            return self._affected(files.write_csv(visible, m[3]))
        rows = self._stamped(files.read_csv(self.spark, m[3], True, visible.schema), table)
        fresh = self.catalog.written(name, rows.select(*table.data.columns))
        self._check(name, fresh, table.data)
        self.catalog.append(name, fresh)
        return self._affected(fresh.count())

    def _vacuum(self, text: str) -> DataFrame:
        """Delete the folders of versions that nothing leads to any more; not within a transaction."""
        if self._transaction is not None:
            raise InvalidArgument("a transaction is active")
        used = {f.rsplit("/", 2)[1] for t in self.catalog.tables.values() for df in (t.data, t.history) if df is not None for f in df.inputFiles()}
        n = 0
        for path in list(self.catalog.files):
            if path.rsplit("/", 1)[1] not in used:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
                del self.catalog.files[path]
                n += 1
        return self._affected(n)

    def _checkpoint(self, text: str) -> DataFrame:
        """Rewrite each table into few files."""
        for name, table in list(self.catalog.tables.items()):
            if table.columns:
                self.catalog.new_version(name, table.data.coalesce(max(1, min(table.data.rdd.getNumPartitions(), 8))))
        self.flush()
        return self._status("checkpoint")

    def backup(self, path: str) -> list[str]:
        return files.backup({n: self.catalog.visible(t) for n, t in self.catalog.tables.items()}, path)

    def restore(self, path: str) -> list[str]:
        tables = files.restore(self.spark, path)
        for name, df in tables.items():
            self.catalog.put(name, Table(df))
        return sorted(tables)

    # ------------------------------------------------------------ procedures, functions, types, session

    def _procedure(self, text: str) -> DataFrame:
        m = re.match(r"CREATE\s+(?:OR\s+ALTER\s+)?PROCEDURE\s+([\w.]+)\s*(\(.*?\))?\s*AS\s+(.*)$", text, re.I | re.S)
        if not m:
            raise ParseError(text)
        if name_of(m[1]) in self.procedures and not re.match(r"CREATE\s+OR\b", text, re.I):
            raise InvalidArgument(f"procedure {m[1]!r} exists")
        params = [(p.split()[0], name_of(p.split()[1]) if len(p.split()) > 1 else "") for p in split(m[2][1:-1])] if m[2] else []
        body = re.sub(r"^\s*BEGIN\s+(.*?)\s*END\s*$", r"\1", m[3], flags=re.I | re.S)
        self.procedures[name_of(m[1])] = params, body
        return self._status("created")

    def _exec(self, text: str) -> DataFrame:
        m = re.match(r"EXEC(?:UTE)?\s+([\w.]+)\s*(.*)$", text, re.I | re.S)
        name = name_of(m[1])
        if name not in self.procedures:
            raise NotFound(f"no procedure {name!r}")
        declared, body = self.procedures[name]
        params = [p for p, _ in declared]
        given = split(m[2].strip()[1:-1] if m[2].strip().startswith("(") else m[2])
        if params and len(given) != len(params):
            raise InvalidArgument(f"{len(params)} arguments expected, {len(given)} given")
        given = [self._table_argument(v, self.table_types[kind]) if kind in self.table_types else v for v, (_, kind) in zip(given, declared)] if declared else given
        for k, value in enumerate(given, 1):
            if k <= len(params):
                body = re.sub(rf"@?{re.escape(params[k - 1].lstrip('@'))}\b" if params[k - 1].startswith("@") else rf"@{re.escape(params[k - 1])}\b", lambda _: value, body)
            body = re.sub(rf"@{k}\b", lambda _: value, body)
        return self.batch(body)[-1]

    def _function(self, text: str) -> DataFrame:
        """A scalar SQL function of the session."""
        m = re.match(r"CREATE\s+(?:OR\s+ALTER\s+)?FUNCTION\s+(\w+)\s*\((.*?)\)\s*RETURNS\s+(.+?)\s+AS\s+(.*)$", text, re.I | re.S)
        if not m:
            raise ParseError(text)
        body = re.sub(r"^\s*(?:BEGIN\s+)?RETURN\s+(.*?)(?:\s*;?\s*END)?\s*$", r"\1", m[4], flags=re.I | re.S)
        params = []
        for p in split(m[2]):
            word, kind = p.split(None, 1)
            params.append(f"{word.lstrip('@')} {spark_type(kind)}")
            body = re.sub(rf"@{re.escape(word.lstrip('@'))}\b", word.lstrip("@"), body)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {m[1]}({', '.join(params)}) RETURNS {spark_type(m[3])} RETURN {body}")
        return self._status("created")

    def _table_argument(self, value: str, columns: tuple[Column, ...]) -> str:
        """The name of a table that has the columns of a table type, given by name or as a query in parentheses."""
        source = self.spark.sql(inside(value)[0]) if value.strip().startswith("(") else self.spark.table(name_of(value))
        if len(source.columns) != len(columns):
            raise InvalidArgument(f"a table of {len(columns)} columns expected, {len(source.columns)} given")
        self._arguments += 1
        view = f"_argument_{self._arguments}"
        source.toDF(*[c.name for c in columns]).select(*[F.col(c.name).cast(c.type) for c in columns]).createOrReplaceTempView(view)
        return view

    def cursor(self, text: str, max_rows: int, **params) -> Iterator[list[Row]]:
        """The rows of a query, ``max_rows`` at a time; the driver holds a partition and a page."""
        if max_rows < 1:
            raise InvalidArgument("max_rows must be positive")
        rows = self.sql(text, **params).toLocalIterator()
        while page := list(islice(rows, max_rows)):
            yield page

    def set_context(self, key: str, value: str | None) -> None:
        """A value of the session; None removes it."""
        if value is None:
            self.context.pop(key, None)
        else:
            self.context[key] = value

    def get_context(self, key: str) -> str | None:
        return self.context.get(key)

    def _create_type(self, text: str) -> DataFrame:
        m = re.match(r"CREATE\s+TYPE\s+([\w.]+)\s+AS\s+TABLE\s*", text, re.I)
        if not m:
            raise ParseError(text)
        self.table_types[name_of(m[1])] = tuple(c for c in map(self._column, split(inside(text, m.end())[0])) if c)
        return self._status("created")
