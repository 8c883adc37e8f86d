"""The format "dds": files read by header and first level, and written under a commit of the whole job, in batch or as a stream.

Register with spark.dataSource.register(DdsSource).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.raster import MOST_SIDE

COLUMNS = "path string, length bigint, width int, height int, levels int, format string, status string, bytes binary, bytes_read bigint"
#: Bytes of files that a partition reads, about.
PARTITION_BYTES = 64 << 20
ATTEMPTS = ".attempts"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it. Spark writes local paths as file:/x, and as file:///x."""
    local = re.sub("^(file:)?/+", "file:///", uri)
    filesystem, path = pafs.FileSystem.from_uri(local)
    return filesystem, path.rstrip("/")


def header(data: bytes, length: int) -> dict:
    """width, height, levels, format, status and size of level 0 from a file's first 128 bytes, as raster.dds_info() gives them."""
    found = {"width": None, "height": None, "levels": None, "format": None, "size": 0}
    if len(data) < 128 or data[:4] != b"DDS ":
        return found | {"status": "not_dds"}
    height, width = struct.unpack_from("<II", data, 12)
    levels = max(1, struct.unpack_from("<I", data, 28)[0])
    flags, fourcc, bits = struct.unpack_from("<I4sI", data, 80)
    # Fixed values of the container format.
    plain = flags == 0x41 and bits == 32 and data[92:108] == bytes.fromhex("FF00000000FF00000000FF00000000FF")
    kind = "RGBA8" if plain else {b"DXT1": "BC1", b"DXT3": "BC2", b"DXT5": "BC3"}.get(fourcc) if flags & 4 else None
    fits = all(1 <= n <= MOST_SIDE for n in (width, height, levels))
    found |= {"format": kind} | ({"width": width, "height": height, "levels": levels} if fits else {})
    if kind is None:
        return found | {"status": "unsupported_format"}
    if not fits:
        return found | {"status": "bad_size"}
    size = width * height * 4 if plain else (width + 3) // 4 * ((height + 3) // 4) * (8 if kind == "BC1" else 16)
    return found | {"size": size, "status": "ok" if length >= 128 + size else "truncated"}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class DdsReader(DataSourceReader):
    """Files of a folder and those below it, read as far as the asked columns and filters need: 128 bytes, then level 0."""

    def __init__(self, folder: str, columns: list[str], partition_bytes: int):
        self.folder, self.columns, self.partition_bytes, self.filters = folder, columns, partition_bytes, []

    def pushFilters(self, filters: list) -> Iterator:
        """Takes comparisons of header columns with a value; the others stay with Spark."""
        known = {"path", "length", "width", "height", "levels", "format", "status"}
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)) and f.attribute[0] in known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        filesystem, folder = opened(self.folder)
        listed = filesystem.get_file_info(pafs.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size) for f in listed if f.type == pafs.FileType.File and f.extension.lower() == "dds" and not any(p.startswith(".") for p in f.path[len(folder) :].split("/")))
        packed, size = [], self.partition_bytes
        for path, length in files:
            if size >= self.partition_bytes:
                packed.append(Files([]))
                size = 0
            packed[-1].files.append((path, length))
            size += length + 4096
        return packed or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        filesystem, _ = opened(self.folder)
        for path, length in partition.files:
            with filesystem.open_input_file(path) as source:
                head = source.read_at(min(128, length), 0)
                row = header(head, length) | {"path": path, "length": length, "bytes": None, "bytes_read": len(head)}
                if not all(passes(f, row.get(f.attribute[0])) for f in self.filters):
                    continue
                if "bytes" in self.columns and row["status"] == "ok":
                    row["bytes"] = head + source.read_at(row["size"], 128)
                    row["bytes_read"] += row["size"]
            yield tuple(row[c] for c in self.columns)


def passes(f, value) -> bool:
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    compared = {EqualTo: value == f.value} if isinstance(f, EqualTo) else {GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}
    return compared[type(f)]


class Written(WriterCommitMessage):
    """The folder of a task's attempt."""

    attempt: str = ""


def safe(name: str) -> str:
    if not name or name.startswith("/") or ".." in name.split("/") or name.split("/")[0] == ATTEMPTS:
        raise ValueError(f"not a name for a file of this folder: {name!r}")
    return name


class _Writer:
    """Tasks write into a folder of their attempt, with a list of names. The commit names the attempts that count."""

    def __init__(self, folder: str, publish: str):
        self.folder, self.publish, self.job = folder, publish, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, folder = opened(self.folder)
        message = Written()
        message.attempt = f"{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}"
        own = f"{folder}/{message.attempt}"
        filesystem.create_dir(own, recursive=True)
        names = []
        for batch in iterator:
            for name, data in zip(batch.column("name"), batch.column("bytes"), strict=True):
                with filesystem.open_output_stream(f"{own}/{len(names)}", compression=None) as out:
                    out.write(data.as_py())
                names.append(safe(name.as_py()))
        with filesystem.open_output_stream(f"{own}/names", compression=None) as out:
            out.write(json.dumps(names).encode())
        return message

    def commit(self, messages: list) -> None:
        filesystem, folder = opened(self.folder)
        attempts = [m.attempt for m in messages if m]
        if not attempts:
            return
        job = attempts[0].split("/")[1]
        with filesystem.open_output_stream(f"{folder}/{ATTEMPTS}/{job}.part", compression=None) as out:
            out.write(json.dumps(attempts).encode())
        filesystem.move(f"{folder}/{ATTEMPTS}/{job}.part", f"{folder}/{ATTEMPTS}/{job}.json")
        if self.publish == "commit":
            for attempt in attempts:
                move_out(self.folder, attempt)
            finish(self.folder, job)  # with what attempts that failed have left

    def abort(self, messages: list) -> None:
        filesystem, folder = opened(self.folder)
        path = f"{folder}/{ATTEMPTS}/{self.job}"
        if filesystem.get_file_info(path).type == pafs.FileType.Directory:
            filesystem.delete_dir(path)


class DdsWriter(_Writer, DataSourceArrowWriter):
    pass


class DdsStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A batch's files get their names when it commits; names are the rows' own, so a batch that runs again leaves each file once."""

    def commit(self, messages: list, batchId: int) -> None:
        _Writer.commit(self, messages)

    def abort(self, messages: list, batchId: int) -> None:
        filesystem, folder = opened(self.folder)
        for m in messages:
            if m and filesystem.get_file_info(f"{folder}/{m.attempt}").type == pafs.FileType.Directory:
                filesystem.delete_dir(f"{folder}/{m.attempt}")


def move_out(folder_uri: str, attempt: str) -> int:
    """Give the files of an attempt their names. Running it again goes on where it stopped."""
    filesystem, folder = opened(folder_uri)
    own = f"{folder}/{attempt}"
    with filesystem.open_input_stream(f"{own}/names", compression=None) as source:
        names = json.loads(source.read())
    left = {f.base_name for f in filesystem.get_file_info(pafs.FileSelector(own))}
    for parent in {f"{folder}/{n}".rsplit("/", 1)[0] for n in names}:
        filesystem.create_dir(parent, recursive=True)
    for k, name in enumerate(names):
        if str(k) in left:
            filesystem.move(f"{own}/{k}", f"{folder}/{name}")
    return len(names)


def finish(folder_uri: str, job: str) -> None:
    """Forget a job whose files have their names, with the attempts that didn't count."""
    filesystem, folder = opened(folder_uri)
    for path in (f"{folder}/{ATTEMPTS}/{job}", f"{folder}/{ATTEMPTS}/{job}.json"):
        kind = filesystem.get_file_info(path).type
        if kind == pafs.FileType.Directory:
            filesystem.delete_dir(path)
        elif kind == pafs.FileType.File:
            filesystem.delete_file(path)


def publish(spark: SparkSession, folder: str) -> int:
    """Give the files of all committed jobs of a folder their names, a task for each attempt; the number of files.

    The driver reads one list of attempts a job. If it is lost on the way, publishing again ends what was begun.
    """
    filesystem, path = opened(folder)
    if filesystem.get_file_info(f"{path}/{ATTEMPTS}").type != pafs.FileType.Directory:
        return 0
    jobs = [f.base_name for f in filesystem.get_file_info(pafs.FileSelector(f"{path}/{ATTEMPTS}")) if f.base_name.endswith(".json")]
    attempts = []
    for job in jobs:
        with filesystem.open_input_stream(f"{path}/{ATTEMPTS}/{job}", compression=None) as source:
            attempts += [(a,) for a in json.loads(source.read())]
    if not attempts:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([move_out(folder, a) for a in batch.column(0).to_pylist()], pa.int64())], names=["files"])

    rows = spark.createDataFrame(attempts, "attempt string").repartition(min(len(attempts), 1000), "attempt")
    moved = rows.mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0]
    for job in jobs:
        finish(folder, job.removesuffix(".json"))
    return moved


def save(files: DataFrame, folder: str) -> int:
    """Write rows of name and bytes as files; the number of files. Their names, which may have directories, appear only once all are written."""
    files.sparkSession.dataSource.register(DdsSource)
    files.select("name", "bytes").write.format("dds").option("publish", "tasks").mode("append").save(folder)
    return publish(files.sparkSession, folder)


class DdsSource(DataSource):
    """Reads the columns of COLUMNS; a schema given to the reader picks some, and without `bytes` no content is read. Writes rows of name and bytes."""

    @classmethod
    def name(cls) -> str:
        return "dds"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return DdsReader(self.options["path"], schema.names, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DdsWriter(self.options["path"], self.options.get("publish", "commit"))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return DdsStreamWriter(self.options["path"], "commit")
