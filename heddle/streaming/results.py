"""Streams of results: de-duplication, running summaries, retry state, request rates, a sink that takes each result once, status."""

from __future__ import annotations

import json
import threading
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def read_results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_results(results: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first result of each model and scenario; state older than the delay is dropped."""
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["model_name", "scenario_id"])


def running_summary(results: DataFrame) -> DataFrame:
    """Counts and mean score per model, updated as results come in."""
    return results.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.avg("total_score").alias("avg_total_score"), F.max("ts").alias("last"))


def retry_state(attempts: DataFrame, limit: int = 10) -> DataFrame:
    """Per model and scenario of attempts(model_name, scenario_id, success): failures so far and whether it is done.

    Keyed state holds two numbers; a pair that succeeded or used up its attempts stays done.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, ok = state.get if state.exists else (0, False)
        for rows in batches:
            ok = ok or bool(rows["success"].any())
            failures += int((~rows["success"].astype(bool)).sum())
        state.update((failures, ok))
        yield pd.DataFrame({"model_name": [key[0]], "scenario_id": [key[1]], "failures": [failures], "done": [ok or failures >= limit]})

    return attempts.groupBy("model_name", "scenario_id").applyInPandasWithState(update, "model_name string, scenario_id string, failures long, done boolean", "failures long, ok boolean", "update", "NoTimeout")


def request_rate(requests: DataFrame, ts: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """Requests per provider in sliding minutes, every ten seconds."""
    return requests.withWatermark(ts, delay).groupBy("provider", F.window(ts, "60 seconds", "10 seconds")).agg(F.count(F.lit(1)).alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


def take_once(batch: DataFrame, batch_id: int, path: str, run: str, keys: tuple[str, ...] = ("model_name", "scenario_id")) -> int:
    """Adds a batch's new results to path/results, one for each key that no earlier batch has, and notes it in path/commits.

    A batch that is noted is left alone; one that was broken off is written again in its own folder, so it adds nothing
    twice.  run tells apart streams that number their batches anew.  Returns the number of rows in the batch's folder.
    """
    spark = batch.sparkSession
    commits = _there(spark, f"{path}/commits", "run string, batch bigint, n bigint")
    known = commits.filter((F.col("run") == run) & (F.col("batch") == batch_id)).first()
    if known:
        return known["n"]
    kinds = ", ".join(f"`{k}` {batch.schema[k].dataType.simpleString()}" for k in keys)
    before = _there(spark, f"{path}/results", f"{kinds}, run string, batch bigint").filter(~((F.col("run") == run) & (F.col("batch") == batch_id)))
    new = batch.dropDuplicates(list(keys)).join(before.select(*keys), list(keys), "left_anti")
    own = f"{path}/results/run={run}/batch={batch_id}"
    new.write.mode("overwrite").parquet(own)
    n = spark.read.schema(batch.schema).parquet(own).count()
    spark.createDataFrame([(run, batch_id, n)], "run string, batch bigint, n bigint").write.mode("append").parquet(f"{path}/commits")
    return n


def append_once(results: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("model_name", "scenario_id")):
    """A stream into take_once(): results of pairs that are done, here or in an earlier stream, are not taken again."""
    run = f"{zlib.crc32(checkpoint.encode()):08x}"
    return results.writeStream.foreachBatch(lambda batch, i: take_once(batch, i, path, run, keys) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What append_once() has taken and noted; a batch that was broken off is not seen."""
    rows = _there(spark, f"{path}/results", f"{schema}, run string, batch bigint")
    noted = _there(spark, f"{path}/commits", "run string, batch bigint, n bigint").select("run", "batch").distinct()
    return rows.join(noted, ["run", "batch"], "left_semi").drop("run", "batch")


def last_results(results: DataFrame, n: int = 10, ts: str = "ts") -> DataFrame:
    """The last results, the newest first."""
    return results.orderBy(F.desc(ts), "model_name", "scenario_id").limit(n)


def watched(results: DataFrame, name: str = "results") -> DataFrame:
    """results as they are, with the counts that Status reads of every batch."""
    return results.observe(name, F.count(F.lit(1)).alias("n"), F.count_if("parsing_success").alias("ok"), F.avg("total_score").alias("mean"), F.max("ts").alias("last"))


class Status(StreamingQueryListener):
    """How far streams of watched() results are: spark.streams.addListener(Status(total)), then read() at any time."""

    def __init__(self, total: int, name: str = "results"):
        self.total, self.name, self.lock = total, name, threading.Lock()
        self.done, self.ok, self.seconds, self.last, self.running, self.error = 0, 0, 0.0, None, 0, None

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.running += 1

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is None:
            return
        with self.lock:
            self.done += told["n"]
            self.ok += told["ok"]
            self.seconds += json.loads(event.progress.json).get("durationMs", {}).get("triggerExecution", 0) / 1000
            self.last = max(filter(None, (self.last, told["last"])), default=None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.running -= 1
            self.error = event.exception or self.error

    def read(self) -> dict:
        """done, share, ok_share, per_minute, eta_seconds (null as long as nothing is done), last, running, error."""
        with self.lock:
            rate = self.done / self.seconds if self.seconds else 0.0
            left = max(0, self.total - self.done)
            return {
                "done": self.done, "share": self.done / self.total if self.total else 1.0, "ok_share": self.ok / self.done if self.done else None, "per_minute": 60 * rate,
                "eta_seconds": left / rate if rate else None, "last": self.last, "running": self.running, "error": self.error,
            }
