"""SQL dumps as a partitioned batch source: ``spark.read.format("sqldump")``.

Files are cut into byte ranges, and a line belongs to the range that it begins in, so one file of any size is read by many
tasks. The schema names what is wanted: other columns' fields are passed over as they stand, and pushed filters see their own
columns' fields alone, so a row that they reject is never decoded. Lines of other tables are told by their first bytes.

Options: path (a file, a folder, or several with commas), table, columns (all of the dump's, in order; where they are not
given, the table's CREATE statement is looked for, from the first file on), split (bytes a task, 64 MiB).
Without a schema all columns are strings. Reading is by pyarrow, so the path has to be one that executors reach.
A wrong number of columns, an open string or a field that is not of its column's type is an error, never a skipped row.
"""

from __future__ import annotations

import io
import operator
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from chatterscope.sources.dump import tuples, unescaped

BLOCK, ROWS = 4 << 20, 8192
INTEGERS = (ByteType, ShortType, IntegerType, LongType)
COMPARED = {S.EqualTo: operator.eq, S.GreaterThan: operator.gt, S.GreaterThanOrEqual: operator.ge, S.LessThan: operator.lt, S.LessThanOrEqual: operator.le}
_COLUMN = re.compile(r"\s+`([^`]+)` ")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(paths: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of all files in name order; hidden ones and Spark's marks are none."""
    for path in paths.split(","):
        system, at = opened(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        root = path.rstrip("/") if "://" in path else at.rstrip("/")
        for f in sorted(found, key=lambda f: f.path):
            yield root + f.path[len(at.rstrip("/")) :], f.size


def lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end)."""
    system, at = opened(path)
    with io.BufferedReader(system.open_input_file(at), BLOCK) as f:
        if start:
            f.seek(start - 1)
            f.readline()
        while f.tell() < end and (line := f.readline()):
            yield line


def declared(paths: str, table: str) -> list[str]:
    """The columns of the table's CREATE statement."""
    head = f"CREATE TABLE `{table}` (".encode()
    for path, size in files(paths):
        found = None
        for line in lines(path, 0, size):
            if found is None:
                found = [] if line.startswith(head) else None
            elif m := _COLUMN.match(line.decode()):
                found.append(m[1])
            else:
                return found
    raise ValueError(f"the dump has no CREATE statement of {table}: give the columns")


class Range(S.InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class SqlDump(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def _columns(self) -> list[str]:
        given = self.options.get("columns")
        return [c.strip() for c in given.split(",")] if given else declared(self.options["path"], self.options["table"])

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._columns()])

    def reader(self, schema: StructType) -> DumpReader:
        return DumpReader(schema, self.options["path"], self.options["table"], self._columns(), int(self.options.get("split", 64 << 20)))


class DumpReader(S.DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str, columns: list[str], split: int):
        lacking = [c for c in schema.names if c not in columns]
        if lacking:
            raise ValueError(f"blocked: the dump's {table} lacks {', '.join(lacking)}")
        self.schema, self.path, self.table, self.columns, self.split = schema, path, table, columns, split
        self.tests: list[tuple[int, bool, str, object]] = []

    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:
        """Tests of one string or integer column; Spark applies the others."""
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            kind = kinds.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            plain = kind == StringType() or isinstance(kind, INTEGERS)
            said = type(f).__name__
            if not plain or type(f) not in (*COMPARED, S.In, S.IsNull, S.IsNotNull) or (hasattr(f, "value") and f.value is None):
                yield f
                continue
            value = frozenset(v for v in f.value if v is not None) if said == "In" else getattr(f, "value", None)
            self.tests.append((self.columns.index(f.attribute[0]), kind == StringType(), said, value))

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(at + self.split, size)) for p, size in files(self.path) for at in range(0, size, self.split)]

    def _kept(self) -> Callable[[list[tuple[bool, str]]], bool]:
        compared = {k.__name__: v for k, v in COMPARED.items()}

        def kept(fields: list[tuple[bool, str]]) -> bool:
            for at, text, said, value in self.tests:
                v = decoded(*fields[at])
                if said in ("IsNull", "IsNotNull"):
                    if (v is None) != (said == "IsNull"):
                        return False
                    continue
                if v is None:
                    return False
                v = v if text else int(v)
                if not (v in value if said == "In" else compared[said](v, value)):
                    return False
            return True

        return kept

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        wanted, kept, head = [self.columns.index(c) for c in self.schema.names], self._kept(), f"INSERT INTO `{self.table}`".encode()
        arrow, rows = to_arrow_schema(self.schema), []
        for line in lines(part.path, part.start, part.end):
            if line.startswith(head):
                for fields in tuples(line.decode(), len(self.columns)):
                    if kept(fields):
                        rows.append([decoded(*fields[i]) for i in wanted])
                        if len(rows) == ROWS:
                            yield batch(rows, arrow)
                            rows = []
        if rows:
            yield batch(rows, arrow)


def decoded(text: bool, raw: str) -> str | None:
    return unescaped(raw) if text else None if raw.upper() == "NULL" else raw


def batch(rows: list[list[str | None]], schema: pa.Schema) -> pa.RecordBatch:
    """Times without a zone are taken as UTC, as the dump's sessions are."""
    out = []
    for values, field in zip(zip(*rows, strict=True), schema, strict=True):
        column = pa.array(values, pa.string())
        zoned = pa.types.is_timestamp(field.type) and field.type.tz
        out.append(column.cast(pa.timestamp("us")).cast(field.type) if zoned else column.cast(field.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def register(spark: SparkSession) -> None:
    """Spark asks Python sources for filters only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqlDump)
