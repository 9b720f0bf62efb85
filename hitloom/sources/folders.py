"""A data source for folders of small files, listed and read by the tasks.

format("folder_files"), option path: a folder of folders. One row a file: folder, name,
text. Options: names (comma-separated, all by default), partitions. Unlike Spark's file
readers it sees empty files, and the driver lists nothing: each task lists the names of
the folders, keeps its share of them by a hash and reads what these hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "folder_files"


class Share(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class FolderReader(DataSourceReader):
    def __init__(self, path: str, names: frozenset[str], shares: int) -> None:
        self.path, self.names, self.shares = path, names, shares

    def partitions(self) -> list[Share]:
        return [Share(i) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[tuple[str, str, str]]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        for folder in store.get_file_info(fs.FileSelector(root)):
            if folder.type is not fs.FileType.Directory or zlib.crc32(folder.base_name.encode()) % self.shares != partition.number:
                continue
            for file in store.get_file_info(fs.FileSelector(folder.path)):
                if file.type is fs.FileType.File and (not self.names or file.base_name in self.names):
                    with store.open_input_stream(file.path) as f:
                        yield folder.base_name, file.base_name, f.read().decode("utf-8", "replace")


class FolderFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "folder string, name string, text string"

    def reader(self, schema) -> FolderReader:
        names = frozenset(n for n in self.options.get("names", "").split(",") if n)
        return FolderReader(self.options["path"], names, int(self.options.get("partitions", "32")))


def opens(path: str) -> bool:
    """Whether tasks can open a path by themselves, without Spark's file systems."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    except (OSError, ValueError):
        return False
    return True


def folder_files(spark: SparkSession, path: str, names: list[str], partitions: int = 32) -> DataFrame:
    """folder, name, text of the files with some names in every folder of a path."""
    spark.dataSource.register(FolderFiles)
    return spark.read.format(NAME).option("names", ",".join(names)).option("partitions", partitions).load(path)
