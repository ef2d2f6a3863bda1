"""Result files of frames: staged by the tasks in one pass, published only once every task has succeeded."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framewright.sources.images import path_order, stem

#: What is written: all files of a frame in one row, or the reason why it has none. report is text of its own.
RESULT = "frame string, files array<struct<ending:string,content:binary>>, reason string, report string"
UNREAD = "can't be read or decoded"

#: Frames whose log is written together, and of which a publishing task has about as many.
LOGGED = 1000

_LOG = pa.schema([("frame", pa.string()), ("attempt", pa.string()), ("number", pa.int64()), ("endings", pa.list_(pa.string())), ("reason", pa.string()), ("report", pa.string())])
_LOG_DDL = "frame string, attempt string, number long, endings array<string>, reason string, report string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder.removeprefix("file:")))


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: its folder, and how many frames it has."""

    attempt: str
    frames: int


class FrameFiles(DataSource):
    """Sink of rows like RESULT. Option path: the staging folder, which every executor reaches."""

    @classmethod
    def name(cls) -> str:
        return "framewright_files"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceArrowWriter):
    """A task puts its files and a log of its frames into a folder of its own. Of several attempts at a partition only the one
    that Spark commits is published; a failed one takes its folder with it."""

    def __init__(self, staging: str) -> None:
        self.staging = staging

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        store, root = opened(self.staging)
        attempt, frames, log, held = uuid.uuid4().hex, 0, None, []
        own = f"{root}/{attempt}"
        store.create_dir(own, recursive=True)
        try:
            for batch in batches:
                columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("frame", "files", "reason", "report")}
                for k in range(batch.num_rows):
                    endings = []
                    for file in columns["files"][k] if columns["files"][k].is_valid else ():
                        endings.append(file["ending"].as_py())
                        with store.open_output_stream(f"{own}/{frames}{endings[-1]}") as out:
                            out.write(file["content"].as_buffer())
                    held.append((columns["frame"][k].as_py(), attempt, frames, endings, columns["reason"][k].as_py(), columns["report"][k].as_py()))
                    frames += 1
                    if len(held) == LOGGED:
                        log, held = _logged(log, store, f"{own}/log", held), []
            if held:
                log = _logged(log, store, f"{own}/log", held)
            if log is not None:
                log.close()
        except BaseException:
            store.delete_dir(own)
            raise
        return Staged(attempt, frames)

    def commit(self, messages: list[Staged]) -> None:
        """Name the attempts that count; one line a task."""
        store, root = opened(self.staging)
        with store.open_output_stream(f"{root}/committed") as out:
            out.write("".join(f"{m.attempt}\n" for m in messages if m.frames).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def _logged(log: pq.ParquetWriter | None, store: fs.FileSystem, path: str, rows: list[tuple]) -> pq.ParquetWriter:
    log = log or pq.ParquetWriter(path, _LOG, filesystem=store)
    log.write_table(pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), _LOG, strict=True)], schema=_LOG))
    return log


@dataclass
class Written:
    """How many files a run has published, and how many frames it has rejected."""

    files: int
    rejected: int


def write_frames(results: DataFrame, folder: str, listed: DataFrame | None = None) -> Written:
    """Write the files of rows like RESULT as `{stem}{ending}` into `folder`, a path or URI that every executor reaches.

    `results` is evaluated once. Files stand in a hidden staging folder until every task has succeeded, and are then renamed by tasks; a
    run that fails leaves none. Of frames with equal stems the last in path order that has a file of that ending gives it.
    Below `_report` there is a JSON line for each frame (frame, reason, report): reason tells why a frame has no files. Frames of
    `listed` (path) that `results` lacks are reported as UNREAD. An earlier `_report` is replaced, other files stay.
    """
    spark = results.sparkSession
    spark.dataSource.register(FrameFiles)
    staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    store, root = opened(staging)
    store.create_dir(root, recursive=True)
    try:
        results.select("frame", "files", "reason", "report").write.format("framewright_files").mode("append").save(staging)
        with store.open_input_stream(f"{root}/committed") as held:
            attempts = held.read().decode().split()
        log = _log(spark, store, root, attempts)
        files = _published(log, folder, staging)
        rows = log.select("frame", "reason", "report")
        if listed is not None:
            missing = listed.select(F.col("path").alias("frame")).join(log.select("frame"), "frame", "left_anti")
            rows = rows.unionByName(missing.select("frame", F.lit(UNREAD).alias("reason"), F.lit(None).cast("string").alias("report")))
        seen = Observation()
        rows.observe(seen, F.count_if(F.col("reason").isNotNull()).alias("rejected")).write.mode("overwrite").json(_uri(f"{folder.rstrip('/')}/_report"))
        return Written(files, seen.get["rejected"])
    finally:
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def _log(spark, store: fs.FileSystem, root: str, attempts: list[str]) -> DataFrame:
    """The committed attempts' log, as a table. Each log is read by the task that has its name: one name a writing task."""
    names = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(max(1, len(attempts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                yield from pq.ParquetFile(f"{root}/{attempt}/log", filesystem=store).iter_batches()

    return names.mapInArrow(run, _LOG_DDL)


def _published(log: DataFrame, folder: str, staging: str) -> int:
    """Rename the files that count; how many. A task that runs again finds its files renamed already."""
    spark = log.sparkSession
    files = log.select(stem(F.col("frame")).alias("stem"), "frame", "attempt", "number", F.explode("endings").alias("ending"))
    last = files.groupBy("stem", "ending").agg(F.max_by(F.struct("attempt", "number"), path_order(F.col("frame"))).alias("f"))
    moves = last.select("stem", "ending", "f.attempt", "f.number").repartition(spark.sparkContext.defaultParallelism * 4, "stem")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, source), (_, target) = opened(staging), opened(folder)
        for batch in batches:
            for one in batch.to_pylist():
                old, new = f"{source}/{one['attempt']}/{one['number']}{one['ending']}", f"{target}/{one['stem']}{one['ending']}"
                if store.get_file_info(old).type == fs.FileType.NotFound:
                    if store.get_file_info(new).type == fs.FileType.NotFound:
                        raise FileNotFoundError(old)
                else:
                    store.move(old, new)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    seen = Observation()
    moves.mapInArrow(run, "n long").observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("files")).write.format("noop").mode("overwrite").save()
    return seen.get["files"]


def _uri(path: str) -> str:
    """A path as Spark takes it: without a scheme it is a local one, like pyarrow's."""
    return path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))


def report(folder: str, spark) -> DataFrame:
    """(frame, reason, report) of every frame of a run into `folder`."""
    return spark.read.schema("frame string, reason string, report string").json(_uri(f"{folder.rstrip('/')}/_report"))
