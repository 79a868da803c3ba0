"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source gets a target number of words (water filling under a cap of so many repeats).  Its documents are
shuffled by a hash and queued, as often as the cap allows; a copy's virtual finish time is the words its source has
queued up to its end, divided by the source's target.  All copies are range-sorted by that time and the queue is cut
where the total budget is used up.

Defined results: null and blank texts have size 0 and take nothing.  A null source is one source, after all others.
The hash is of doc_id, then of the text; rows without doc_id are shuffled by size and text.  Only rows with the same
doc_id, source and text are queued as one bundle, so that reruns agree, and take alike.  An empty table, or one without
words, takes nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import WORD, stage

WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def places(docs: DataFrame, text: str = "text") -> Column:
    """A row's place in its source's queue: md5 of doc_id and a hash of the text; md5 of size and text if doc_id is null."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.concat(F.md5(F.col("doc_id").cast("string")), F.lpad(F.hex(F.xxhash64(t)), 16, "0"))
    return F.coalesce(own, F.md5(F.concat_ws(" ", sizes(docs, text).cast("string"), F.md5(t))))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """by_source(source, source_size, ...) with rank and target: shares of the total by weight, none above cap times its size.

    One row per source passes through ungrouped windows.  A source is capped if cap * size / weight, the level at which
    it fills up, is below the level that the sources after it, in the order of that figure, would share.
    """
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick.cast("bigint")).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("full_at", "rank")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("full_at") > F.col("level"))
    # Once one source stays open all later ones do, and share the level found at the first of them.
    water = F.min(F.when(F.col("open"), F.struct("full_at", "rank", "level"))).over(whole)["level"]
    target = F.when(water.isNull() | (F.col("full_at") <= water), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * water)
    return leveled.withColumn("target", target).select("source", "source_size", "weight", "rank", "target", *[c for c in by_source.columns if c not in ("source", "source_size")])


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, bucket_rows: int = 2_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs(doc_id, source, text)."""
    return placed_mix(docs, text, weights, cap, bucket_rows).drop("place")


def placed_mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, bucket_rows: int = 2_000) -> DataFrame:
    """The rows of mix() with their place, which with the source tells them apart.

    The running sums are two-level: within hash buckets of about bucket_rows documents, then over the buckets' totals,
    so that a source with a third of all rows is spread over as many tasks as it has buckets.
    """
    slim = stage(docs.select("doc_id", "source", sizes(docs, text).alias("size"), places(docs, text).alias("place")), "mix-size")
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = stage(targets(by_source, weights, cap), "mix-goal")  # one row per source
    # A bucket is the first digits of the hash, as many as the largest source needs.
    n = goal.agg(F.max("n_docs")).first()[0] or 0
    digits = 1
    while n / 16**digits > bucket_rows:
        digits += 1
    rows = slim.join(goal.select(F.col("source").alias("_source"), "source_size", "target", "rank"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.substring("place", 1, digits))
    per_bucket = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("_n"))
    offset = per_bucket.withColumn("before", F.sum("_n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("_n")).drop("_n")
    # Peers (equal place) share one running sum: the default frame is by range.
    within = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("place"))
    queued = rows.withColumn("_in", within).join(offset, ["rank", "bucket"])
    queued = stage(queued.select("doc_id", "source", "size", "source_size", "target", "rank", "place", (F.col("before") + F.col("_in")).alias("cum")), "mix-queue")
    cut = cutoff(queued, cap)
    finish = [((F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("target")) for e in range(cap)]
    ok = [
        F.when(F.col("size") > 0, (f < cut[0]) | ((f == cut[0]) & (F.struct("rank", "place") <= F.struct(F.lit(cut[1]).alias("rank"), F.lit(cut[2]).alias("place"))))).otherwise(F.lit(False))
        if cut
        else F.lit(False)
        for f in finish
    ]
    copies = sum((F.coalesce(x, F.lit(False)).cast("bigint") for x in ok), F.lit(0).cast("bigint"))
    return queued.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "place")


def cutoff(queued: DataFrame, cap: int) -> tuple[float, int, str] | None:
    """(finish time, source's rank, place) of the last copy that the budget holds; None if there is none.

    Copies are range-partitioned by finish time and staged; partition totals (one row per partition) tell in which
    partition the budget ends, and only that partition gets a running sum.
    """
    spark = queued.sparkSession
    budget = queued.agg(F.sum("size")).first()[0] or 0
    if not budget:
        return None
    copies = queued.filter("size > 0 and target > 0").select(
        "rank", "place", "size", F.explode(F.array(*[((F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("target")) for e in range(cap)])).alias("finish")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    copies = stage(copies.repartitionByRange(parts, "finish", "rank", "place").withColumn("part", F.spark_partition_id()), "mix-copies")
    totals = copies.groupBy("part").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    last = totals.filter(F.col("before") < budget).orderBy(F.desc("part")).first()
    running = F.sum("size").over(Window.partitionBy("part").orderBy("finish", "rank", "place")) + last["before"]
    inside = copies.filter(F.col("part") == last["part"]).withColumn("running", running).filter(F.col("running") <= budget)
    end = inside.agg(F.max(F.struct("finish", "rank", "place")).alias("x")).first()["x"]
    if end is None:  # the budget ends with the partition before
        end = copies.filter(F.col("part") < last["part"]).agg(F.max(F.struct("finish", "rank", "place")).alias("x")).first()["x"]
    return tuple(end) if end else None
