"""A change log as a streaming source whose offsets are event ids.

The log is a folder of parquet files (event_id, ts, path, change_type) with ids that grow. A query that starts again goes on
behind the last id it has finished, whatever files have come, gone or been rewritten since. Files are
chosen by the ids in their footers, and read by the tasks, one a file and batch. If the log no longer
reaches back to where the query stopped, one row of type ``dropped`` for the root stands for the
lost range; rows of the log itself that tell of lost events or a changed root (LOSSES) count as lost too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from stocktake.operators.incremental import LOSSES

CHANGES = "event_id bigint, ts timestamp_ntz, path string, change_type string, lost boolean"
_ARROW = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("path", pa.string()), ("change_type", pa.string()), ("lost", pa.bool_())])


def _system(folder: str):
    return (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("file:", "/")) else fs.FileSystem.from_uri(folder)


@dataclass
class Piece(InputPartition):
    """Events after ``low`` up to ``high`` of one file; no file: that range of the log is lost."""

    file: str | None
    low: int
    high: int


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.root, self.since = options["path"], options.get("root", "/"), int(options.get("since", 0))
        self.footers: dict[tuple, tuple[int, int]] = {}

    def _files(self) -> list[tuple[str, int, int]]:
        """(file, first id, last id) of each file that has any, from the footers; a footer is read once."""
        system, folder = _system(self.folder)
        found = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type != fs.FileType.File or not info.base_name.endswith(".parquet") or info.base_name.startswith(("_", ".")):
                continue
            key = (info.path, info.size, info.mtime_ns)
            if key not in self.footers:
                with system.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                    at = [meta.row_group(0).column(k).path_in_schema for k in range(meta.num_columns)].index("event_id") if meta.num_row_groups else 0
                    stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                stats = [s for s in stats if s is not None and s.has_min_max]
                self.footers[key] = (min(s.min for s in stats), max(s.max for s in stats)) if stats else (1, 0)
            first, last = self.footers[key]
            if first <= last:
                found.append((info.path, first, last))
        return found

    def initialOffset(self) -> dict:
        return {"event_id": self.since}

    def latestOffset(self) -> dict:
        """The newest id. A batch takes all there is: Spark does not tell a Python reader here where the batch begins, so it cannot be cut to a number of events."""
        return {"event_id": max([self.since, *(last for _, _, last in self._files())])}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high = start["event_id"], end["event_id"]
        if low >= high:
            return []
        files = self._files()
        oldest = min([first for _, first, _ in files], default=high + 1)
        lost = [Piece(None, low, min(oldest - 1, high))] if low > 0 and oldest > low + 1 else []
        return lost + [Piece(file, low, high) for file, first, last in files if last > low and first <= high]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.file is None:
            yield pa.RecordBatch.from_pylist([{"event_id": piece.high, "ts": None, "path": self.root, "change_type": "dropped", "lost": True}], _ARROW)
            return
        system, _ = _system(self.folder)
        with system.open_input_file(piece.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["event_id", "ts", "path", "change_type"]):
                ids = batch.column("event_id")
                part = batch.filter(pc.and_(pc.greater(ids, piece.low), pc.less_equal(ids, piece.high)))
                if part.num_rows:
                    lost = pc.is_in(part.column("change_type"), value_set=pa.array(list(LOSSES)))
                    yield pa.RecordBatch.from_arrays([*(part.column(n).cast(_ARROW.field(n).type) for n in _ARROW.names[:4]), lost], schema=_ARROW)


class ChangeLog(DataSource):
    """Options: path, since (id; 0), root (the path of a lost range's row)."""

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def follow_changes(spark: SparkSession, folder: str, since: int = 0, root: str = "/") -> DataFrame:
    """The change log of a folder as a stream (event_id, ts, path, change_type, lost) from an event id on."""
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format("change_log").option("path", folder).option("since", since).option("root", root).load()
