"""Changes in folders as a stream source: spark.readStream.format("folder_changes").load(root).

Each folder right below the root is a repository and a partition. An offset is a moment; a batch has the files whose last
change lies after the offset before it, up to its own. So a file that changes twice between two batches appears once,
as a debounced watcher wants it, and a batch that is read again after a restart loses nothing: a file that has changed
since then appears in a later one. A removal shows as a change of the folder it was in (kind "folder").

Options: path (any file system that Arrow reads, by URI, or a local folder), settle (seconds that a change must be old to
be reported, 0.5), since (the first moment, in milliseconds since 1970, 0: everything that is there).
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "repo string, path string, ts timestamp, kind string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Folder(InputPartition):
    def __init__(self, uri: str, repo: str, after: int, until: int) -> None:
        self.uri, self.repo, self.after, self.until = uri, repo, after, until


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.settle, self.since = options["path"].rstrip("/"), float(options.get("settle", 0.5)), int(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {"ms": self.since}

    def latestOffset(self) -> dict:
        return {"ms": max(self.since, int((time.time() - self.settle) * 1000))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _open(self.uri)
        below = [x for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory]
        return [Folder(self.uri, x.base_name, start["ms"], end["ms"]) for x in sorted(below, key=lambda x: x.base_name)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        import datetime

        from pyarrow import fs

        system, root = _open(partition.uri)
        top = f"{root}/{partition.repo}"
        for x in system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)):
            changed = -(-x.mtime_ns // 1_000_000) if x.mtime_ns else 0
            if partition.after < changed <= partition.until:
                kind = "folder" if x.type == fs.FileType.Directory else "file"
                yield partition.repo, x.path[len(top) + 1 :], datetime.datetime.fromtimestamp(changed / 1000), kind

    def commit(self, end: dict) -> None:
        """Nothing is kept: what is on disk is what can be read again."""


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderChanges)
