"""The format "tree": the files and directories below a root, with the directories' own times. Register with spark.dataSource.register(TreeSource)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .dds import opened


@dataclass
class Entries(InputPartition):
    """Entries of the root: path and whether it is a directory."""

    entries: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    """The driver lists the root only; tasks walk what is below, some entries of the root each."""

    def __init__(self, root: str, entries: int):
        self.root, self.entries = root, entries

    def partitions(self) -> list[InputPartition]:
        filesystem, root = opened(self.root)
        top = sorted((f.path, f.type == pafs.FileType.Directory) for f in filesystem.get_file_info(pafs.FileSelector(root)))
        return [Entries(top[k : k + self.entries]) for k in range(0, len(top), self.entries)] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[tuple]:
        filesystem, _ = opened(self.root)
        for path, is_dir in partition.entries:
            yield self._row(filesystem.get_file_info(path))
            folders = [path] if is_dir else []
            while folders:
                for f in filesystem.get_file_info(pafs.FileSelector(folders.pop())):
                    if f.type == pafs.FileType.Directory:
                        folders.append(f.path)
                    yield self._row(f)

    @staticmethod
    def _row(f: pafs.FileInfo) -> tuple:
        is_dir = f.type == pafs.FileType.Directory
        return f.path, is_dir, None if is_dir else f.size, f.mtime


class TreeSource(DataSource):
    """path, is_dir, length (null for directories), modified. Option entries: how many of the root's entries a task walks (16)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, is_dir boolean, length bigint, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("entries", 16)))
