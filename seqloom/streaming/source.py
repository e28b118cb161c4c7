"""The stored log as a live source with sequence offsets.

``spark.dataSource.register(LogSource)`` then ``spark.readStream.format("seqloom_log").option("path", ...)``. The offset is the last
sequence handed out; a micro-batch is cut into ranges of sequences that tasks read on their own. A range knows the files whose statistics say that they hold some of it,
so a task opens those only, and the bounds are pushed down to their row groups. The driver reads a file's footer once. The rows are those of the log, all columns,
so filters and selections of partitions are the same on the stream as on the table. The path must be one that all executors see.

Sequence is the order of arrival, so a file that comes later holds later sequences. One that comes with sequences already handed out would be missed; it is an error,
or left out with ``late`` set to ``skip``.

Options: ``path`` (file or directory of Parquet parts), ``after`` (exclusive start, 0 for the earliest), ``latest`` (``true`` starts behind the current end), ``range``
(sequences per task; wider where a batch would have more than ``MOST_TASKS`` of them), ``most`` (sequences per micro-batch, no limit by default; the first batch after a
restart has none, because the interface doesn't tell a source where it stands), ``late`` (``fail`` or ``skip``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from seqloom.sources.model import LOG

MOST_TASKS = 10_000

_KINDS = {"bigint": pa.int64(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "map<string,string>": pa.map_(pa.string(), pa.string())}
FIELDS = {name: _KINDS[kind] for name, kind in (part.split(" ") for part in LOG.split(", "))}


class Range(InputPartition):
    """Sequences after ``low`` up to ``high``, and the files that may hold some."""

    def __init__(self, low: int, high: int, files: tuple[str, ...]):
        self.low, self.high, self.files = low, high, files


def _read(part: Range) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds

    at = ds.field("sequence")
    schema = pa.schema(list(FIELDS.items()))
    if not part.files:
        return
    data = ds.dataset(list(part.files))
    here = [name for name in FIELDS if name in data.schema.names]
    for batch in data.to_batches(columns=here, filter=(at > part.low) & (at <= part.high)):
        if batch.num_rows:
            columns = [batch.column(name).cast(kind) if name in here else pa.nulls(batch.num_rows, kind) for name, kind in FIELDS.items()]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class Files:
    """Least and greatest sequence of each file, from its footer, which is read once."""

    def __init__(self, path: str):
        self.path = path
        self.bounds: dict[str, tuple[int, int]] = {}

    def new(self) -> dict[str, tuple[int, int]]:
        """The files that were not there before, which are known from now on; files without rows have no bounds."""
        import pyarrow.dataset as ds

        found = {}
        for fragment in ds.dataset(self.path, format="parquet").get_fragments():
            if fragment.path in self.bounds or fragment.path in found:
                continue
            low, high = None, None
            for group in fragment.row_groups:
                if not group.num_rows:
                    continue
                seen = (group.statistics or {}).get("sequence")
                if seen is None:
                    raise ValueError(f"{fragment.path} has no statistics of sequence")
                low, high = (seen["min"], seen["max"]) if low is None else (min(low, seen["min"]), max(high, seen["max"]))
            if low is not None:
                found[fragment.path] = (low, high)
        self.bounds |= found
        return found

    def end(self) -> int:
        return max((high for _, high in self.bounds.values()), default=0)

    def within(self, low: int, high: int) -> tuple[str, ...]:
        return tuple(sorted(f for f, (a, b) in self.bounds.items() if b > low and a <= high))


class _Common:
    def __init__(self, options: dict):
        self.files = Files(options["path"].removeprefix("file://"))
        self.after = int(options.get("after", 0))
        self.latest = options.get("latest", "false").lower() == "true"
        self.step = int(options.get("range", 1 << 16))
        self.most = int(options.get("most", 0))
        self.late = options.get("late", "fail")
        if self.late not in ("fail", "skip") or self.step < 1 or self.most < 0:
            raise ValueError("an option of the log source has no meaning")

    def ranges(self, low: int, high: int) -> list[Range]:
        step = max(self.step, -(-(high - low) // MOST_TASKS))
        made = (Range(a, min(a + step, high), self.files.within(a, min(a + step, high))) for a in range(low, high, step))
        return [r for r in made if r.files] or [Range(low, low, ())]


class LogStream(_Common, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.handed: int | None = None

    def initialOffset(self) -> dict:
        if self.latest:
            self.files.new()
        self.handed = self.files.end() if self.latest else self.after
        return {"sequence": self.handed}

    def latestOffset(self) -> dict:
        known = bool(self.files.bounds)
        for file, (low, _) in self.files.new().items():
            if known and self.late == "fail" and self.handed is not None and low <= self.handed and self.handed > self.after:
                raise ValueError(f"{file} came with sequences from {low}, but those up to {self.handed} were handed out")
        end = max(self.files.end(), self.after)
        if self.handed is not None:
            end = max(end, self.handed)
            if self.most:
                end = min(end, self.handed + self.most)
            self.handed = end
        return {"sequence": end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.files.new()
        self.handed = max(end["sequence"], self.handed or 0)
        return self.ranges(start["sequence"], end["sequence"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class LogBatch(_Common, DataSourceReader):
    def partitions(self) -> list[Range]:
        self.files.new()
        end = self.files.end()
        return self.ranges(end if self.latest else self.after, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class LogSource(DataSource):
    """Format ``seqloom_log``."""

    @classmethod
    def name(cls) -> str:
        return "seqloom_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> LogBatch:
        return LogBatch(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)
