"""A stream over a stored table in keyset order: ``spark.readStream.format("paged")``.

An offset is the (time, id) of the last row of a page, so rows of one instant are neither lost nor doubled, and it carries
a hash of what the stream reads: a checkpoint goes on only over the source it was made for. A page is the next ``page`` rows in order; it
is cut into ``slices`` by its own (time, id) quantiles, which executors read each by itself, with the bounds pushed to the files' row groups.
So is the search for a page's end, where the footers tell how many rows follow: over files in about the order of the log a page costs what it holds.
After a restart the first batch takes all that is left. Reading is by pyarrow from the folder that driver and
executors share; new rows have to be newer than those that were read, as a log's are. Times or ids that are null are not part of the order and are not read.

Options: path, ts, key, page (100,000), slices (4). The schema has to be given.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType


#: Files may hold times in other units than Spark's.
KINDS = {TimestampType: pa.timestamp("us", tz="UTC"), TimestampNTZType: pa.timestamp("us")}


class Slice(InputPartition):
    def __init__(self, after: tuple[str, int] | None, through: tuple[str, int]):
        self.after, self.through = after, through


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def streamReader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, {k: v for k, v in self.options.items()})


class PagedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}
        self.path, self.ts, self.key = get["path"], get["ts"], get["key"]
        self.page, self.slices = int(get.get("page", 100_000)), int(get.get("slices", 4))
        self.schema, self.columns = schema, schema.names
        said = json.dumps([self.path, self.ts, self.key, schema.json()])
        self.config = hashlib.sha256(said.encode()).hexdigest()
        self.at: tuple[str, int] | None = None
        self.resumed = True

    def _offset(self, place: tuple[str, int] | None) -> dict:
        return {"ts": place[0] if place else None, "id": place[1] if place else None, "config": self.config}

    def _place(self, offset: dict) -> tuple[str, int] | None:
        if offset["config"] != self.config:
            raise ValueError("the source differs from the one this checkpoint was made for: path, time, key and schema have to stay")
        return None if offset["ts"] is None else (offset["ts"], offset["id"])

    def _rows(self) -> ds.Dataset:
        return ds.dataset(self.path.removeprefix("file://"), format="parquet")

    def _bound(self, rows: ds.Dataset, ts: str) -> pa.Scalar:
        return pa.scalar(datetime.fromisoformat(ts), type=rows.schema.field(self.ts).type)

    def _between(self, rows: ds.Dataset, after: tuple[str, int] | None, through: tuple[str, int] | None) -> pc.Expression:
        ts, key = ds.field(self.ts), ds.field(self.key)
        out = ts.is_valid() & key.is_valid()
        if after:
            t = self._bound(rows, after[0])
            out = out & (ts >= t) & ((ts > t) | (key > after[1]))
        if through:
            t = self._bound(rows, through[0])
            out = out & (ts <= t) & ((ts < t) | (key <= through[1]))
        return out

    def _reach(self, rows: ds.Dataset, after: tuple[str, int] | None, most: int) -> datetime | None:
        """A time through which ``most`` rows follow for certain, by what the files' footers tell; None if they don't."""
        start, told, many = datetime.fromisoformat(after[0]) if after else None, [], 0
        for file in rows.get_fragments():
            for group in map(file.metadata.row_group, range(file.metadata.num_row_groups)):
                columns = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns))}
                ts, key = columns.get(self.ts), columns.get(self.key)
                if ts is None or key is None or not (ts.has_min_max and ts.has_null_count and key.has_null_count) or not isinstance(ts.max, datetime):
                    continue
                if start is None or ts.min.replace(tzinfo=None) > start:
                    told.append((ts.max, group.num_rows - ts.null_count - key.null_count))
        for at, n in sorted(told):
            if (many := many + n) >= most:
                return at
        return None

    def _places(self, after: tuple[str, int] | None, through: tuple[str, int] | None, nth: list[int]) -> list[tuple[str, int]]:
        """The rows of these ranks after a place; of a page at most, since batches' smallest are kept while the keys are read."""
        rows = self._rows()
        most, kept = max(nth) + 1, None
        wanted = self._between(rows, after, through)
        if not through and (reach := self._reach(rows, after, most)):
            wanted = wanted & (ds.field(self.ts) <= self._bound(rows, reach.replace(tzinfo=None).isoformat()))
        for batch in rows.to_batches(columns=[self.ts, self.key], filter=wanted):
            if batch.num_rows:
                kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
                if kept.num_rows > 4 * most:
                    kept = kept.take(pc.select_k_unstable(kept, most, sort_keys=[(self.ts, "ascending"), (self.key, "ascending")]))
        if kept is None:
            return []
        kept = kept.sort_by([(self.ts, "ascending"), (self.key, "ascending")])
        found = [(kept.column(self.ts)[i].as_py(), kept.column(self.key)[i].as_py()) for i in (min(n, kept.num_rows - 1) for n in nth)]
        return [(t.replace(tzinfo=None).isoformat(), k) for t, k in found]

    def initialOffset(self) -> dict:
        self.resumed = False
        return self._offset(None)

    def latestOffset(self) -> dict:
        if self.resumed and self.at is None:  # where the checkpoint stands is told only afterwards
            rows = self._rows()
            last = None
            for batch in rows.to_batches(columns=[self.ts, self.key], filter=self._between(rows, None, None)):
                if batch.num_rows:
                    top = pa.Table.from_batches([batch]).sort_by([(self.ts, "descending"), (self.key, "descending")]).slice(0, 1).to_pylist()[0]
                    last = max(last or (top[self.ts], top[self.key]), (top[self.ts], top[self.key]))
            return self._offset((last[0].replace(tzinfo=None).isoformat(), last[1]) if last else None)
        found = self._places(self.at, None, [self.page - 1])
        return self._offset(found[0] if found else self.at)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, through = self._place(start), self._place(end)
        self.at = through
        if through is None or through == after:
            return []
        size = -(-self.page // self.slices)
        cuts = self._places(after, through, [size * (i + 1) - 1 for i in range(self.slices - 1)]) if self.slices > 1 else []
        edges = [after, *sorted({c for c in cuts if c != through}), through]
        return [Slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        rows = self._rows()
        for batch in rows.to_batches(columns=self.columns, filter=self._between(rows, part.after, part.through)):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(KINDS[type(f.dataType)], safe=False) if type(f.dataType) in KINDS else batch.column(f.name) for f in self.schema], self.columns)

    def commit(self, end: dict) -> None:
        """Nothing to do: the offset is in the stream's checkpoint."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
