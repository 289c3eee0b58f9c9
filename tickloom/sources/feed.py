"""A collection with growing ids as a Spark data source, for batch and for streams.

``spark.read.format("id_feed")`` cuts the ids above ``after`` into ranges that tasks fetch in parallel;
``spark.readStream.format("id_feed")`` does the same between its offsets, which are ids, so a query that is
started again goes on behind the last id of its checkpoint. Options:

- ``path``: folder of Parquet files that stands for the collection; files may be added at any time.
- ``key``: the id column, a whole number. Rows without an id cannot be told apart and are left out.
- ``after``: ids up to this one are known already (batch), or not wanted (stream). Default: all are new.
- ``range_rows``: about the rows of one range, the unit of a task (default 50,000).

``IdRanges`` holds all that depends on the collection; another store is read by overriding ``schema``, ``top``, ``ranges`` and ``fetch``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Ids before the first one.
NOTHING = -(1 << 63)


@dataclass
class IdRange(InputPartition):
    """Ids ``low < id <= high``."""

    low: int
    high: int


class IdRanges:
    """Access to a collection by ranges of its ids."""

    def __init__(self, options: dict, schema: StructType | None = None):
        self.path, self.key = options["path"], options["key"]
        self.after = int(options.get("after", NOTHING))
        self.range_rows = int(options.get("range_rows", 50_000))
        self.columns = schema.names if schema is not None else None

    def _table(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet", exclude_invalid_files=False)

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._table().schema)

    def _groups(self, after: int) -> list[tuple[int, int, int]]:
        """First id, last id and rows of every row group that reaches above ``after``, in the order of their last ids."""
        found = []
        for fragment in self._table().get_fragments():
            for group in fragment.row_groups:
                told = (group.statistics or {}).get(self.key) or self._read_bounds(fragment, group.id)
                if told is not None and told["max"] is not None and told["max"] > after:
                    found.append((max(int(told["min"]), after + 1), int(told["max"]), group.num_rows))
        return sorted(found, key=lambda g: g[1])

    def _read_bounds(self, fragment, group: int) -> dict | None:
        # a group of nulls alone, or one without statistics
        values = fragment.subset(row_group_ids=[group]).to_table(columns=[self.key]).column(0)
        return pc.min_max(values).as_py()

    def top(self, after: int) -> int:
        """The last id, or ``after`` if none is above it."""
        return max((g[1] for g in self._groups(after)), default=after)

    def ranges(self, after: int, upto: int | None = None) -> list[IdRange]:
        """Disjoint ranges that hold all ids above ``after`` and up to ``upto``, of about ``range_rows`` rows each."""
        out, low, rows = [], after, 0
        for first, last, n in self._groups(after):
            rows += n
            high = last if upto is None else min(last, upto)
            if rows < self.range_rows or high <= low:
                continue
            begin, pieces = max(low, first - 1), -(-rows // self.range_rows)
            for i in range(1, pieces + 1):
                cut = high if i == pieces else begin + (high - begin) * i // pieces
                if cut > low:
                    out.append(IdRange(low, cut))
                    low = cut
            rows = 0
        end = upto if upto is not None else self.top(after)
        return [*out, IdRange(low, end)] if end > low else out

    def fetch(self, part: IdRange) -> Iterator[pa.RecordBatch]:
        """Batches of the rows of a range; row groups outside it are skipped by their statistics."""
        key = ds.field(self.key)
        yield from self._table().to_batches(columns=self.columns, filter=(key > part.low) & (key <= part.high), batch_size=8192)


class _Reader(DataSourceReader):
    def __init__(self, ranges: IdRanges):
        self.ranges = ranges

    def partitions(self) -> list[IdRange]:
        return self.ranges.ranges(self.ranges.after) or [IdRange(0, 0)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        if partition.low < partition.high:
            yield from self.ranges.fetch(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, ranges: IdRanges):
        self.ranges = ranges
        self.top = ranges.after

    def initialOffset(self) -> dict:
        return {"id": self.ranges.after}

    def latestOffset(self) -> dict:
        # ids never fall, even if the collection cannot be seen whole for a moment
        self.top = self.ranges.top(self.top)
        return {"id": self.top}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return self.ranges.ranges(start["id"], end["id"]) if end["id"] > start["id"] else []

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        yield from self.ranges.fetch(partition)

    def commit(self, end: dict) -> None:
        pass


class IdFeed(DataSource):
    """The data source ``id_feed``."""

    @classmethod
    def name(cls) -> str:
        return "id_feed"

    def schema(self) -> StructType:
        return IdRanges(self.options).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(IdRanges(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(IdRanges(self.options, schema))


def register(spark: SparkSession) -> None:
    """Makes ``id_feed`` known to the session."""
    spark.dataSource.register(IdFeed)
