"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_BYTES = 8 << 20
_OWN_FOLDER: dict[str, str] = {}
_FOLDERS: dict[int, tuple] = {}
_SCOPES: list[list[DataFrame]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset in local mode, a folder of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="weftspark-")
    return _OWN_FOLDER[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers of ARROW_BYTES at most, where the session sets no bound: 10000 long texts would be large ones."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and lost executors cost no recomputation."""
    bounded_batches(df.sparkSession)
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    found = df.sparkSession.read.schema(df.schema).parquet(folder)
    _FOLDERS[id(found)] = weakref.ref(found, lambda _, key=id(found): _FOLDERS.pop(key, None)), folder
    if _SCOPES:
        _SCOPES[-1].append(found)
    return found


@contextmanager
def tidied() -> Iterator[list[DataFrame]]:
    """What kept() writes within is deleted at the end, but for the frames put into the list that is given."""
    made, stays = [], []
    _SCOPES.append(made)
    try:
        yield stays
    finally:
        _SCOPES.pop()
        forget(*[df for df in made if not any(df is s for s in stays)])
        if _SCOPES:
            _SCOPES[-1].extend(stays)


def forget(*frames: DataFrame | None) -> None:
    """Delete what kept() wrote for these frames, once nothing reads them any more. Other frames are left alone."""
    for df in frames:
        ref, folder = _FOLDERS.pop(id(df), (None, ""))
        if ref and ref() is df:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it, for a folder or file of the shared folder."""
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def put_file(uri: str, write: Callable) -> None:
    """Write a file under another name, then move it: readers see all of it or nothing, also when a task runs twice."""
    filesystem, path = opened(uri)
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(attempt, compression=None) as out:
        write(out)
    filesystem.move(attempt, path)


def mapped_file(uri: str) -> np.ndarray:
    """The bytes of a shared file: memory mapped if the folder is mounted, else read."""
    filesystem, path = opened(uri)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if filesystem.get_file_info(path).size else np.zeros(0, np.uint8)
    with filesystem.open_input_stream(path, compression=None) as source:
        return np.frombuffer(source.read(), np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about limit bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_bytes(batch.column(column))[1])
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def crc_of_id(column: str = "doc_id") -> Column:
    """The checksum of an id as text; that of an empty text for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
