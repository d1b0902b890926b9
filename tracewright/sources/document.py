"""One JSON document of all rows of a frame: ``{"anomalies": [{...}, ...]}``.

A Spark data source writes it. Each task writes its rows as a part beside the target; when all are
done, head, parts in the order of the partitions, and tail are copied into one file. Parts of attempts that
failed or were doubled are named by no task that Spark committed, so they are never copied, and go with the others.
The driver copies by ``CHUNK`` bytes, whatever the number of rows. The target is any file system that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "json_document"
CHUNK = 4_000_000


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str):
        self.path, self.key, self.parts = path.rstrip("/"), key, f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        at = TaskContext.get()
        system, folder = _file_system(self.parts)
        system.create_dir(folder, recursive=True)
        path, rows = f"{folder}/{at.partitionId():08d}-{at.taskAttemptId()}", 0
        with system.open_output_stream(path) as out:
            for batch in iterator:
                lines = [json.dumps(row, ensure_ascii=False, default=str) for row in batch.to_pylist()]
                if lines:
                    out.write(((",\n" if rows else "") + ",\n".join(lines)).encode("utf-8", "surrogatepass"))
                    rows += len(lines)
        return Part(at.partitionId(), path, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = _file_system(self.path)
        written = False
        with system.open_output_stream(path) as out:
            out.write(f"{{{json.dumps(self.key)}: [\n".encode())
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                if written:
                    out.write(b",\n")
                with system.open_input_stream(part.path) as source:
                    while chunk := source.read(CHUNK):
                        out.write(chunk)
                written = True
            out.write(b"\n]}\n")
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        system, folder = _file_system(self.parts)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class JsonDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        raise ValueError("documents are read with spark.read.json(path, multiLine=True)")

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if not overwrite:
            raise ValueError("a document is written whole: use mode overwrite")
        return DocumentWriter(self.options["path"], self.options.get("key", "anomalies"))


def write_document(frame: DataFrame, path: str, key: str = "anomalies") -> None:
    """All rows of a frame as one JSON document, in the order of its partitions; an empty frame gives an empty list."""
    spark = frame.sparkSession
    spark.dataSource.register(JsonDocument)
    frame.write.format(FORMAT).mode("overwrite").option("path", path).option("key", key).save()


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a written document; each stands on a line of its own, so large files are split."""
    lines = spark.read.text(path).select(F.regexp_replace("value", ",$", "").alias("line"))
    return lines.filter("line like '{%}'").select(F.from_json("line", schema).alias("r")).select("r.*")
