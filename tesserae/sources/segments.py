"""The journal as a streaming source: a cursor of sequence numbers by project, and entries read by tasks.

A journal is a folder of Parquet files below ``project_id=<n>``; each holds a run of one project's entries, whose
``seq`` is dense from 1. The source itself hands out runs of numbers only: what is there comes from the files'
footers, the cursor is the stream's checkpoint, and a batch admits so many entries of a project. Tasks then read
these runs from their files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tesserae.workers import by_value

by_value(__name__)

#: Entries of a project in a batch.
LEAST, MOST = 1, 512


def _files(path: str) -> list[tuple[int, str]]:
    """(project, file) of every finished segment."""
    import re

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    out = []
    for f in found:
        project = re.search(r"/project_id=(\d+)/[^/_.][^/]*\.parquet$", f.path)
        if f.is_file and project and "/_temporary/" not in f.path:
            out.append((int(project[1]), f.path))
    return sorted(out)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()


def _span(path: str, file: str) -> tuple[int, int]:
    """The first and last ``seq`` of a file, from the statistics in its footer."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(_store(path).open_input_file(file)).metadata
    at = meta.schema.names.index("seq")
    groups = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
    return (min(s.min for s in groups), max(s.max for s in groups)) if groups else (1, 0)


class JournalRuns(DataSource):
    """Runs (project_id, file, after, upto) of entries with after < seq <= upto, as a stream.

    Options: ``path``; ``entries``, how many of a project a batch admits (1 to 512, else cut to that), 256 by default;
    ``project``, to follow one alone. A segment that comes before the one in front of it waits for that.
    """

    @classmethod
    def name(cls) -> str:
        return "journal_runs"

    def schema(self) -> str:
        return "project_id long, file string, after long, upto long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Runs(self.options)


class _Runs(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.entries = min(MOST, max(LEAST, int(options.get("entries", 256))))
        self.only = options.get("project")
        self.spans: dict[str, tuple[int, int]] = {}

    def _segments(self) -> dict[str, list[tuple[int, int, str]]]:
        out: dict[str, list[tuple[int, int, str]]] = {}
        for project, file in _files(self.path):
            if self.only is None or str(project) == str(self.only):
                if file not in self.spans:  # segments are never changed
                    self.spans[file] = _span(self.path, file)
                out.setdefault(str(project), []).append((*self.spans[file], file))
        return out

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end, rows = dict(start), []
        for project, segments in self._segments().items():
            cursor = end.get(project, 0)
            stop = cursor + self.entries
            for first, last, file in sorted(segments):
                if first <= cursor + 1 <= last and cursor < stop:
                    upto = min(last, stop)
                    rows.append((int(project), file, cursor, upto))
                    cursor = upto
            if cursor:
                end[project] = cursor
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for project, segments in self._segments().items():
            cursor, stop = start.get(project, 0), end.get(project, 0)
            for first, last, file in sorted(segments):
                if first <= cursor + 1 <= last and cursor < stop:
                    yield int(project), file, cursor, min(last, stop)
                    cursor = min(last, stop)


def entries(spark: SparkSession, path: str, schema, per_batch: int = 256, project: int | None = None) -> DataFrame:
    """The entries of a journal as a stream of ``schema``, each exactly once over stops and restarts from one checkpoint.

    A batch has at most ``per_batch`` entries of a project, in the order of ``seq`` within a run. Only runs pass the driver. The
    folder must be one that pyarrow can open from the driver and the executors.
    """
    spark.dataSource.register(JournalRuns)
    reader = spark.readStream.format("journal_runs").option("path", path).option("entries", str(per_batch))
    runs = (reader if project is None else reader.option("project", str(project))).load()
    names = [f.name for f in schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for r in b.to_pylist():
                inside = [("seq", ">", r["after"]), ("seq", "<=", r["upto"])]
                t = pq.read_table(r["file"], filesystem=_store(path), filters=inside, partitioning=None).sort_by("seq")
                t = t.append_column("project_id", pa.array([r["project_id"]] * len(t), pa.int64())) if "project_id" not in t.column_names else t
                yield from t.select(names).cast(arrow).to_batches()

    return runs.mapInArrow(fetch, schema)


def write(journal: DataFrame, path: str) -> None:
    """Append entries (project_id, seq, ...) as segments: a run of each project a file, in order."""
    journal.repartition("project_id").sortWithinPartitions("project_id", "seq").write.mode("append").partitionBy("project_id").parquet(path)


def lag(journal: DataFrame, cursors: DataFrame) -> DataFrame:
    """(project_id, behind): how many entries each cursor (project_id, seq) has yet to see; a project without one has all."""
    last = journal.groupBy("project_id").agg(F.max("seq").alias("_last"))
    return last.join(cursors, "project_id", "left").select("project_id", (F.col("_last") - F.coalesce("seq", F.lit(0))).alias("behind"))
