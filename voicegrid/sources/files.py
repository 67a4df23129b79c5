"""Files of utterances as a Spark data source: folders are listed, and files read, in tasks.

The driver sees the folders right below the root and nothing else. Paths are those of
any file system that Arrow reads; plain ones are local or mounted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders below the root that one task lists, at least as many as there are tasks for.
TASKS = 64


def opened(path: str) -> pa.NativeFile:
    """A file that can be sought in, of any file system that Arrow knows."""
    system, inside = _system(path)
    return system.open_input_file(inside)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _prefix(path: str) -> str:
    """What turns a path within the file system into the path as it was given."""
    scheme = path.split("://")[0] if "://" in path else ""
    return f"{scheme}://" if scheme and scheme != "file" else ""


class _Folders(InputPartition):
    """Folders that a task lists, or, without ``below``, only their own files."""

    def __init__(self, folders: list[str], below: bool):
        super().__init__(None)
        self.folders, self.below = folders, below


class _Listing(DataSourceReader):
    def __init__(self, path: str, suffix: str, depth: int, hidden: bool):
        self.path, self.suffix, self.depth, self.hidden = path.rstrip("/") or "/", suffix, depth, hidden

    def _children(self, folder: str) -> list[fs.FileInfo]:
        system, inside = _system(folder)
        found = system.get_file_info(fs.FileSelector(inside, recursive=False, allow_not_found=True))
        return sorted((x for x in found if self.hidden or not x.base_name.startswith(".")), key=lambda x: x.path)

    def partitions(self) -> Sequence[InputPartition]:
        prefix = _prefix(self.path)
        folders = sorted(prefix + x.path for x in self._children(self.path) if x.type == fs.FileType.Directory)
        each = -(-len(folders) // TASKS) if folders else 1
        return [_Folders([self.path], False), *(_Folders(folders[k : k + each], True) for k in range(0, len(folders), each))]

    def _wanted(self, path: str, level: int) -> bool:
        return path.endswith(self.suffix) and (not self.depth or level == self.depth)

    def _walked(self, folder: str, level: int, below: bool) -> Iterator[tuple[str, int]]:
        prefix, deeper = _prefix(folder), []
        for x in self._children(folder):
            if x.type == fs.FileType.File and self._wanted(x.path, level):
                yield prefix + x.path, x.size
            elif x.type == fs.FileType.Directory and below and (not self.depth or level < self.depth):
                deeper.append(prefix + x.path)
        for path in deeper:
            yield from self._walked(path, level + 1, True)

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        for folder in partition.folders:
            for row in self._walked(folder, 2 if partition.below else 1, partition.below):
                rows.append(row)
                if len(rows) == 10_000:
                    yield self._batch(rows)
                    rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["utt", "bytes"])


class UtteranceFiles(DataSource):
    """``spark.read.format("utterance_files").option("path", ...)``: (utt, bytes) of the files below a folder.

    Options: ``suffix`` of the names; ``depth``, the level that files are on (1: in the
    folder itself; none: any); ``hidden``, whether names that begin with a dot count.
    """

    @classmethod
    def name(cls) -> str:
        return "utterance_files"

    def schema(self) -> str:
        return "utt string, bytes long"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Listing(o["path"], o.get("suffix", ""), int(o.get("depth", 0)), o.get("hidden", "false").lower() == "true")


def listing(spark: SparkSession, path: str, suffix: str = "", depth: int = 0, hidden: bool = False):
    """(utt, bytes) of the files below a folder, listed in tasks."""
    spark.dataSource.register(UtteranceFiles)
    return spark.read.format("utterance_files").options(path=path, suffix=suffix, depth=str(depth), hidden=str(hidden)).load()
