"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []
#: The lists that note what is staged here; a thread has its own, so one pipeline never notes what another one stages.
_also: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("also", default=())


@contextlib.contextmanager
def staged_by(paths: list[str]) -> Iterator[None]:
    """Notes in paths what is staged meanwhile."""
    token = _also.set((*_also.get(), paths))
    try:
        yield
    finally:
        _also.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a folder under /tmp if neither is set and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            found = java.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file:///tmp/checkpoints/heddle"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return found.rstrip("/")


def noted(path: str) -> str:
    """path, which is staged data from now on."""
    for paths in (_staged, *_also.get()):
        paths.append(path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there and lost executors cost nothing."""
    path = noted(f"{shared_dir(df.sparkSession)}/heddle-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes staged data that no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        for known in (_staged, *_also.get()):
            if path in known:
                known.remove(path)
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables; what was made of them must be staged or saved by now."""
    for table in tables:
        delete(table.sparkSession, [table.staged_at])


def release(spark: SparkSession) -> None:
    """Deletes all that is staged; results that read it must be saved before."""
    delete(spark, _staged)
