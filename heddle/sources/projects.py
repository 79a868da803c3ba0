"""Project folders as a data source: spark.read.format("heddle_projects").load(root) after register(spark).

root holds a folder for each project; every project is a partition.  The options projects, files (JSON lists of names and paths) and
prefix (the start of paths) reach the source: other projects are not listed and other files not opened.  They are options,
not pushed filters, since Spark 4.1 keeps a Python source's pushed filters for later queries of the same table, which then
miss rows.  A file that is no UTF-8 text, or cannot be opened, does not fail the job: it comes as a row without content, and
problem says why.  root is a path or a URI of a store that Arrow reaches (file, hdfs, s3, gs), which all executors must
reach too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "project string, path string, content string, n_bytes bigint, problem string"


@dataclass
class Project(InputPartition):
    name: str


class ProjectReader(DataSourceReader):
    def __init__(self, root: str, projects: list[str] | None, paths: list[str] | None, prefix: str, most_bytes: int):
        self.root, self.prefix, self.most_bytes = root.rstrip("/"), prefix, most_bytes
        self.projects = None if projects is None else set(projects)
        self.paths = None if paths is None else set(paths)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = self._store()
        found = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory)
        # Spark reads a source without partitions as one partition of None.
        return [Project(x) for x in found if self.projects is None or x in self.projects] or [Project("")]

    def _wanted(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and path.startswith(self.prefix)

    def read(self, partition: Project) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.name:
            return
        store, base = self._store()
        top = f"{base.rstrip('/')}/{partition.name}"
        files = sorted((x for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.type == fs.FileType.File), key=lambda x: x.path)
        for x in files:
            path = x.path[len(top) + 1 :]
            if not self._wanted(path):
                continue
            content = problem = None
            try:
                with store.open_input_stream(x.path, compression=None) as f:
                    data = f.read()
                content = data.decode("utf-8").removeprefix("\ufeff") if len(data) <= self.most_bytes else None
                problem = None if content is not None else f"over {self.most_bytes} bytes"
            except (OSError, UnicodeDecodeError) as wrong:
                problem = f"{type(wrong).__name__}: {wrong}"[:500]
            yield pa.RecordBatch.from_pydict({"project": [partition.name], "path": [path], "content": pa.array([content], pa.string()), "n_bytes": pa.array([x.size], pa.int64()), "problem": pa.array([problem], pa.string())})


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "heddle_projects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        names = lambda k: json.loads(self.options[k]) if k in self.options else None
        return ProjectReader(self.options["path"], names("projects"), names("files"), self.options.get("prefix", ""), int(self.options.get("mostBytes", 1 << 30)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(ProjectSource)


def read_projects(spark: SparkSession, root: str, projects: list[str] | None = None, paths: list[str] | None = None, prefix: str = "", most_bytes: int = 1 << 30) -> DataFrame:
    """project, path, content, n_bytes, problem of the files under root/<project>/: of all, or of those named.

    A file of over most_bytes comes without content.
    """
    register(spark)
    reader = spark.read.format("heddle_projects").option("prefix", prefix).option("mostBytes", most_bytes)
    for name, value in (("projects", projects), ("files", paths)):
        reader = reader.option(name, json.dumps(value)) if value is not None else reader
    return reader.load(root)
