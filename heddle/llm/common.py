"""What the training-data operators share: staging, worker caches, word rules."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.staging import discard, noted, shared_dir, stage  # noqa: F401

#: White space of the word rule, as Java, RE2 and Python read it inside a character class.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, as texts can be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside; the session's setting is put back then."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker (functions travel by value, so module globals do not)."""
    return sys.__dict__.setdefault("_heddle_worker", {})


class Recent(dict):
    """A bounded table of two generations: the young one, this dictionary, and the one before it.

    Once the young one holds half of most, it becomes the old one.  What is looked up there is young again, so that
    frequent keys stay and rare ones go.  Keys of over 200 characters are not kept.
    """

    def __init__(self, most: int, make: Callable | None = None):
        super().__init__()
        self.half, self.make, self.old = max(1, most // 2), make, {}

    def keep(self, key: str, value: object) -> None:
        if len(key) <= 200:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def __missing__(self, key: str):
        """The value of a key that is not young: an old one, or a new one where there is a way to make it, or None."""
        value = self.old.get(key)
        if value is None:
            if not self.make:
                return None
            value = self.make(key)
        self.keep(key, value)
        return value


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def marked(docs: DataFrame, keys: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """docs(key bigint, ...) with _maybe: whether the row's key may be among keys(key).

    A bitmap of hashed keys (8 MB at most, whatever their number) goes to all tasks.  It marks all keys, and some others;
    rows that are not marked need no part in a join with keys, so their texts are not shuffled.
    """
    spark = docs.sparkSession
    bits, n = 1 << 10, keys.count()
    while bits < 16 * n and bits < most_bits:
        bits *= 2
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    found = keys.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(key), 64L) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    table = [0] * (bits // 64)
    for r in found:
        table[r["w"]] = r["b"]
    one = spark.createDataFrame([(table,)], "_bits array<bigint>")
    hit = F.expr(f"(get(_bits, cast(shiftright(pmod(xxhash64(key), {bits}L), 6) as int)) & shiftleft(1L, cast(pmod(xxhash64(key), 64L) as int))) <> 0")
    return docs.crossJoin(F.broadcast(one)).withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_bits")


def most_common(rows: DataFrame, column: str, least: int, most: int) -> list[int]:
    """At most so many values that many rows hold in column (bigint, or an array of them), the most common first.

    Counts are of values that a task meets twice or more among some million (counting takes some 60 MB); what is on the list only decides where work is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t[c > 1]), pa.array(c[c > 1].astype(np.int64))], names=["t", "c"])

        for batch in batches:
            values = batch.column(column)
            held.append((values.flatten() if pa.types.is_list(values.type) else values).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size > 1_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    seen = rows.select(column).mapInArrow(run, "t bigint, c bigint")
    counts = seen.groupBy("t").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    return [r["t"] for r in counts.orderBy(F.desc("c"), "t").limit(most).collect()]
