"""Files under names of one's own, as a data source: ``spark.read.format("named_files")`` and the writer of the same name.

Reading lists the folder (option ``path``; ``pattern`` for names) and deals the files to tasks by size; rows are
(name, size_bytes, modified, content).  With the option ``contents`` "false" nothing is opened and content is null.
Writing puts every row (name, content) into a file of that name: first beside it under a name that no listing
shows, then renamed, so a reader sees an old file or the new one whole.  A task that is repeated writes the
same files again.  Both go through pyarrow's file systems: local paths and whatever store a URI names.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, size_bytes bigint, modified timestamp, content binary"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    files: list


@dataclass
class Written(WriterCommitMessage):
    names: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._path, self._pattern = options["path"], options.get("pattern", "*")
        self._contents = options.get("contents", "true").lower() != "false"
        self._bytes = int(options.get("task_bytes", 32 << 20))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, folder = _store(self._path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        shown = sorted((f.base_name, f.path, f.size, f.mtime) for f in found if f.is_file and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, self._pattern))
        parts, held = [], self._bytes
        for file in shown:
            if held >= self._bytes or len(parts[-1].files) >= 10_000:
                parts.append(Files([]))
                held = 0
            parts[-1].files.append(file)
            held += max(file[2], 4096) if self._contents else 4096
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self._path)
        for name, path, size, modified in partition.files:
            content = None
            if self._contents:
                with store.open_input_stream(path) as f:
                    content = f.read()
            yield name, size, modified, content


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self._path = options["path"]

    def write(self, rows: Iterator) -> Written:
        store, folder = _store(self._path)
        store.create_dir(folder, recursive=True)
        names = 0
        for row in rows:
            name = row["name"]
            if not name or name[0] in "._" or any(c in name for c in "/\\\0"):
                raise ValueError(f"not the name of a file in a folder: {name!r}")
            beside = f"{folder}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(beside) as f:
                f.write(bytes(row["content"] or b""))
            store.move(beside, f"{folder}/{name}")
            names += 1
        return Written(names)

    def abort(self, messages: list) -> None:
        """Parts of files that a lost task left are hidden; whole files stay, and the next try replaces them."""


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def named_files(spark: SparkSession, folder: str, pattern: str = "*", contents: bool = True) -> DataFrame:
    """(name, size_bytes, modified, content) of the folder's files; a missing folder has none."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").option("path", folder).option("pattern", pattern).option("contents", str(contents)).load()


def write_named(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files; of rows of one name any may win, other files of the folder stay."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.selectExpr("name", "cast(null as bigint) as size_bytes", "cast(null as timestamp) as modified", "cast(content as binary) as content").write.format("named_files").mode("append").option("path", folder).save()
