"""Files of a vault as a data source of Spark, in batches and as a stream, with handlers to register.

    spark.dataSource.register(VaultFiles)                       # the built-in handlers
    spark.dataSource.register(VaultFiles.of({"yml": ("yaml", read)}))
    spark.read.format("vault_files").option("path", folder).load()
    CREATE TEMPORARY VIEW inbox USING vault_files OPTIONS (path '...')

A handler is a function of a file's bytes that gives title, body and metadata, or raises `Quarantine`. Each file gives
a row, each member of an archive one of its own; what can't be read is a row with a reason. Options: path (any that
Arrow's file systems know), maxFileBytes (larger files are quarantined unread), partitionBytes (bytes of files that one
task reads), glob (of file names). As a stream, a batch is what has come since the last one, in as many tasks as its
bytes need; a file is seen if its time (then name) is after those of the files seen before.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vaultspark.sources.ingest import HANDLERS, OUT, Quarantine, rows_of

_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
MAX_FILE_BYTES, PARTITION_BYTES = 200 << 20, 64 << 20


@dataclass(frozen=True)
class File:
    time: int
    path: str
    size: int


@dataclass
class Files(InputPartition):
    """The files of one task."""

    files: list[File]


class _Folder:
    """What both readers share: the listing, the split into tasks, and the rows of a task."""

    def __init__(self, options, handlers: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("vault_files needs the option path")
        self.most, self.step = int(options.get("maxFileBytes", MAX_FILE_BYTES)), int(options.get("partitionBytes", PARTITION_BYTES))
        self.glob, self.handlers = options.get("glob", "*"), handlers

    def store(self):
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path
        uri = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)

    def listing(self) -> list[File]:
        """Files by time and name; hidden ones are left out."""
        from pyarrow import fs

        store, root = self.store()
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            below = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in below.split("/")) and fnmatch.fnmatch(info.base_name, self.glob):
                found.append(File(info.mtime_ns or 0, info.path, info.size or 0))
        return sorted(found, key=lambda f: (f.time, f.path))

    def split(self, files: list[File]) -> list[Files]:
        out, size = [], 0
        for f in files:
            if not out or size + f.size > self.step:
                out.append(Files([]))
                size = 0
            out[-1].files.append(f)
            size += min(f.size, self.most)
        return out

    def rows(self, part: Files):
        store, _ = self.store()
        for f in part.files:
            if f.size > self.most:
                row = dict.fromkeys(_COLUMNS) | {"path": f.path, "member": f.path, "status": "quarantined", "reason": f"the file is larger than {self.most} bytes"}
                yield tuple(row[c] for c in _COLUMNS)
                continue
            try:
                with store.open_input_stream(f.path) as stream:
                    raw = stream.read()
            except OSError as error:  # gone or unreadable since it was listed
                row = dict.fromkeys(_COLUMNS) | {"path": f.path, "member": f.path, "status": "quarantined", "reason": f"{type(error).__name__}: {error}"}
                yield tuple(row[c] for c in _COLUMNS)
                continue
            for row in rows_of(f.path, raw, self.handlers):
                yield tuple(row[c] for c in _COLUMNS)


class _Reader(_Folder, DataSourceReader):
    def partitions(self):
        return self.split(self.listing()) or [Files([])]

    def read(self, partition):
        return self.rows(partition)


class _StreamReader(_Folder, DataSourceStreamReader):
    """Offsets are the time and name of the last file seen."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.listing()
        return {"time": found[-1].time, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        mine = [f for f in self.listing() if (start["time"], start["path"]) < (f.time, f.path) <= (end["time"], end["path"])]
        return self.split(mine) or [Files([])]

    def read(self, partition):
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class VaultFiles(DataSource):
    """The source with the built-in handlers."""

    handlers: dict = HANDLERS

    @classmethod
    def name(cls) -> str:
        return "vault_files"

    @classmethod
    def of(cls, handlers: dict, *, name: str = "vault_files") -> type[VaultFiles]:
        """A source with more handlers (extension to name and function), or others for the same extensions."""
        return type("VaultFiles", (cls,), {"handlers": cls.handlers | handlers, "name": classmethod(lambda _: name)})

    def schema(self) -> str:
        return OUT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.handlers)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options, self.handlers)


__all__ = ["File", "Files", "Quarantine", "VaultFiles"]
