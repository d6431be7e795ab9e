"""Feather (Arrow IPC) files as a Spark data source: ``spark.read.format("feather")``.

Reading makes one task per file, or per record batch range of a large file; writing makes one file per task.
Paths may be on any file system pyarrow knows (``file://``, ``hdfs://``, ``s3://``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

BATCHES_PER_TASK = 16
ROWS_PER_BATCH = 65_536
WHOLE_FILE_BYTES = 64 * 1024 * 1024  # smaller files are a task each and are not opened to plan


def _locate(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def _files(path: str):
    """The files of a path, at any depth and whatever their suffix; hidden ones (``_``, ``.``) are left out."""
    store, root = _locate(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.File:
        return store, [info]
    found = store.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
    shown = [f for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path.removeprefix(root).split("/") if p)]
    return store, sorted(shown, key=lambda f: f.path)


@dataclass
class BatchRange(InputPartition):
    file: str
    first: int
    last: int | None


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path = path
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        store, files = _files(self.path)
        ranges: list[InputPartition] = []
        for file in files:
            if file.size <= WHOLE_FILE_BYTES:
                ranges.append(BatchRange(file.path, 0, None))
                continue
            with store.open_input_file(file.path) as source:
                count = ipc.open_file(source).num_record_batches
            for first in range(0, count, BATCHES_PER_TASK):
                ranges.append(BatchRange(file.path, first, min(first + BATCHES_PER_TASK, count)))
        return ranges

    def read(self, partition: BatchRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = _locate(self.path)
        with store.open_input_file(partition.file) as source:
            stored = ipc.open_file(source)
            last = stored.num_record_batches if partition.last is None else partition.last
            for i in range(partition.first, last):
                batch = stored.get_batch(i)
                columns = [
                    batch.column(field.name).cast(field.type)
                    if field.name in batch.schema.names
                    else pa.nulls(batch.num_rows, field.type)
                    for field in self.schema
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    staged: str


class FeatherWriter(DataSourceArrowWriter):
    """Tasks write hidden files; the commit makes them visible, an abort removes them."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path = path
        self.schema = to_arrow_schema(schema)
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _locate(self.path)
        store.create_dir(root, recursive=True)
        staged = f"{root}/_part-{uuid.uuid4().hex}.feather.tmp"
        with store.open_output_stream(staged) as sink:
            with ipc.new_file(sink, self.schema) as out:
                for batch in iterator:
                    out.write_table(
                        pa.Table.from_batches([batch]).cast(self.schema), max_chunksize=ROWS_PER_BATCH
                    )
        return Written(staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _locate(self.path)
        old = [f.path for f in _files(self.path)[1]] if self.overwrite else []
        for message in messages:
            if message is not None:
                folder, _, name = message.staged.rpartition("/")
                store.move(message.staged, f"{folder}/{name[1:].removesuffix('.tmp')}")
        for name in old:
            store.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _locate(self.path)
        for message in messages:
            if message is not None:
                store.delete_file(message.staged)


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self) -> T.StructType:
        """The columns of all files; a column that a file lacks is null there."""
        store, files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Feather file below {self.options['path']}; state a schema to read none")

        def schema_of(file) -> pa.Schema:
            with store.open_input_file(file.path) as source:
                return ipc.open_file(source).schema

        with ThreadPoolExecutor(16) as pool:
            schemas = list(pool.map(schema_of, files))
        whole = pa.unify_schemas(schemas, promote_options="permissive")
        return from_arrow_schema(pa.schema([field.with_nullable(True) for field in whole]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FeatherReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> FeatherWriter:
        return FeatherWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    from pyspark import cloudpickle

    import newsloom.sources.feather as this

    cloudpickle.register_pickle_by_value(this)
    spark.dataSource.register(FeatherSource)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; without one it lies on the cluster's default file system, not on a worker's disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def read_feather(spark: SparkSession, path: str, schema: T.StructType | None = None):
    register(spark)
    reader = spark.read.format("feather")
    return (reader.schema(schema) if schema else reader).load(qualified(spark, path))


def write_feather(df, path: str, mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("feather").mode(mode).save(qualified(df.sparkSession, path))
