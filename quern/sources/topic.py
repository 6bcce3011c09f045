"""A topic kept as a log of files with partitions and offsets: batch and stream readers and writers.

Every partition of a topic is a sequence of records with offsets from 0. Rows of a write
are put behind what is there, in the order of its tasks, so a key, which always goes to
one partition, keeps the order of the written rows, and no task has to hold a partition.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "topic_log"
SCHEMA = "key string, value string, partition int, offset long"
STORED = pa.schema([("key", pa.string()), ("value", pa.string())])
READ = pa.schema([("key", pa.string()), ("value", pa.string()), ("partition", pa.int32()), ("offset", pa.int64())])
#: Rows of one partition that one task reads at least, if there are as many.
ROWS_A_TASK = 1_000_000


class TopicLog:
    """What is committed of a topic, under a path that driver and executors share.

    The n-th commit is commits/n.json: its files with partition, first offset and end, the
    ends of all partitions, and the last batch of each stream writer. A file counts only
    once a commit names it. One application commits at a time; a second one that takes the
    same number is an error.
    """

    def __init__(self, path: str):
        local = not re.match(r"[A-Za-z][\w+.-]*:/", path)
        self.fs, root = (fs.LocalFileSystem(), path) if local else fs.FileSystem.from_uri(path)
        self.root = root.rstrip("/")
        self._last: int | None = None

    def _name(self, version: int) -> str:
        return f"{self.root}/commits/{version:012d}.json"

    def version(self) -> int:
        """The number of the last commit; 0 without any."""
        if self._last is None:
            found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
            self._last = max((int(f.base_name[:-5]) for f in found if re.fullmatch(r"\d+\.json", f.base_name)), default=0)
        while self.fs.get_file_info(self._name(self._last + 1)).type == fs.FileType.File:
            self._last += 1
        return self._last

    def commit(self, version: int) -> dict:
        if version == 0:
            return {"files": [], "ends": {}, "writers": {}}
        with self.fs.open_input_stream(self._name(version)) as f:
            return json.loads(f.read())

    def ends(self) -> dict[str, int]:
        """The next offset of each partition, by its number as text."""
        return self.commit(self.version())["ends"]

    def append(self, written: Sequence[_Written | None], writer: str | None = None, batch: int | None = None) -> None:
        """Give offsets to the files of a write. A batch that this writer has committed before adds nothing."""
        done = sorted((w for w in written if w is not None), key=lambda w: w.task)
        version = self.version()
        last = self.commit(version)
        if writer is not None and last["writers"].get(writer, -1) >= batch:
            return self.discard(done)
        ends, files = dict(last["ends"]), []
        for w in done:
            for part, name, rows in w.files:
                start = ends.get(str(part), 0)
                ends[str(part)] = start + rows
                files.append([part, start, start + rows, name])
        writers = last["writers"] if writer is None else last["writers"] | {writer: batch}
        if not files and writer is None:
            return
        self.fs.create_dir(f"{self.root}/commits")
        draft = f"{self.root}/commits/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files, "ends": ends, "writers": writers}).encode())
        if self.fs.get_file_info(self._name(version + 1)).type != fs.FileType.NotFound:
            raise RuntimeError(f"commit {version + 1} of {self.root} was taken by another writer")
        self.fs.move(draft, self._name(version + 1))

    def discard(self, written: Sequence[_Written | None]) -> None:
        for w in written:
            for _, name, _ in w.files if w is not None else ():
                self.fs.delete_file(f"{self.root}/data/{name}")

    def pieces(self, start: dict, end: dict, rows_a_task: int) -> list[_Piece]:
        """The files committed after start up to end, in readers of one partition each, from start's offsets on."""
        files = sorted(tuple(f) for v in range(start["version"] + 1, end["version"] + 1) for f in self.commit(v)["files"])
        out: list[_Piece] = []
        rows = 0
        for part, first, stop, name in files:
            low = int(start["ends"].get(str(part), 0))
            if stop <= low:
                continue
            if not out or out[-1].part != part or rows >= rows_a_task:
                out.append(_Piece(part, low, []))
                rows = 0
            out[-1].files.append((first, name))
            rows += stop - max(first, low)
        return out


@dataclass
class _Piece(InputPartition):
    """Some files, as first offset and name, of one partition; rows below low are passed over."""

    part: int
    low: int
    files: list[tuple[int, str]]


@dataclass
class _Written(WriterCommitMessage):
    """The files of one task: partition, name, rows."""

    task: int
    files: list[tuple[int, str, int]]


def _read(path: str, piece: _Piece) -> Iterator[pa.RecordBatch]:
    log = TopicLog(path)
    for at, name in piece.files:
        with log.fs.open_input_file(f"{log.root}/data/{name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(10_000):
                skip = min(max(0, piece.low - at), len(batch))
                kept = batch.slice(skip)
                offsets = pa.array(range(at + skip, at + len(batch)), pa.int64())
                at += len(batch)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([kept["key"], kept["value"], pa.array([piece.part] * len(kept), pa.int32()), offsets], schema=READ)


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> _Written:
    """Writes the rows of a task, a file for each partition of the topic, batch by batch."""
    log = TopicLog(path)
    log.fs.create_dir(f"{log.root}/data")
    writers: dict[int, tuple[str, pq.ParquetWriter]] = {}
    rows: dict[int, int] = {}
    for batch in batches:
        for part in pc.unique(batch["partition"]).to_pylist():
            if part is None or part < 0:
                raise ValueError("a record needs a partition of 0 or more")
            mine = batch.filter(pc.equal(batch["partition"], part))
            if part not in writers:
                name = f"{part}-{uuid.uuid4().hex}.parquet"
                writers[part] = name, pq.ParquetWriter(f"{log.root}/data/{name}", STORED, filesystem=log.fs)
                rows[part] = 0
            writers[part][1].write_batch(pa.RecordBatch.from_arrays([mine["key"].cast(pa.string()), mine["value"].cast(pa.string())], schema=STORED))
            rows[part] += len(mine)
    for _, w in writers.values():
        w.close()
    return _Written(TaskContext.get().partitionId(), [(p, writers[p][0], rows[p]) for p in sorted(rows)])


class _Options:
    """What readers and writers take from the options of a source."""

    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a topic needs a path")
        self.starting = options.get("startingOffsets", "earliest")
        self.rows_a_task = int(options.get("rowsPerTask", ROWS_A_TASK))
        self.name = options.get("writer")

    def log(self) -> TopicLog:
        return TopicLog(self.path)

    def latest(self) -> dict:
        log = self.log()
        version = log.version()
        return {"version": version, "ends": log.commit(version)["ends"]}

    def start(self) -> dict:
        if self.starting == "latest":
            return self.latest()
        return {"version": 0, "ends": {} if self.starting == "earliest" else json.loads(self.starting)}


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self._o = options

    def partitions(self) -> Sequence[InputPartition]:
        return self._o.log().pieces(self._o.start(), self._o.latest(), self._o.rows_a_task) or [_Piece(0, 0, [])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _read(self._o.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the number of a commit and the ends of all partitions at it."""

    def __init__(self, options: _Options):
        self._o = options

    def initialOffset(self) -> dict:
        return self._o.start()

    def latestOffset(self) -> dict:
        return self._o.latest()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self._o.log().pieces(start, end, self._o.rows_a_task)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _read(self._o.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: _Options):
        self._o = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _write(self._o.path, iterator)

    def commit(self, messages) -> None:
        self._o.log().append(messages)

    def abort(self, messages) -> None:
        self._o.log().discard(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: _Options):
        if not options.name:
            raise ValueError("a stream that writes a topic needs the option writer, a name that stays over restarts")
        self._o = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _write(self._o.path, iterator)

    def commit(self, messages, batchId: int) -> None:
        self._o.log().append(messages, self._o.name, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._o.log().discard(messages)


class TopicSource(DataSource):
    """Format topic_log. Options: path; startingOffsets ("earliest", "latest", or JSON of
    first offsets by partition); rowsPerTask; writer (the lasting name of a stream that writes)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a topic can only be appended to")
        return _Writer(_Options(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(_Options(self.options))


def partition_of(key: Column, partitions: int) -> Column:
    """The partition of a key; records without a key are of that of the empty one."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(partitions)).cast("int")


def records(events: DataFrame, key: str, value: str, partitions: int) -> DataFrame:
    """(key, value, partition) to be written to a topic."""
    return events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), partition_of(F.col(key), partitions).alias("partition"))


def publish(events: DataFrame, path: str, key: str, value: str, order: str, partitions: int) -> None:
    """Append events to a topic so that offsets of a partition follow the order column.

    Rows are dealt by ranges of the order, not by key, so one busy key is written by many tasks.
    """
    ranged = events.select(key, value, F.col(order).alias("_order")).repartitionByRange("_order").sortWithinPartitions("_order")
    spark = events.sparkSession
    spark.dataSource.register(TopicSource)
    records(ranged, key, value, partitions).write.format(FORMAT).mode("append").save(path)


def read_topic(spark: SparkSession, path: str, starting: str = "earliest", stream: bool = False) -> DataFrame:
    """(key, value, partition, offset) of a topic, all of it or as a stream."""
    spark.dataSource.register(TopicSource)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).option("startingOffsets", starting).load(path)
