"""Connected components of an undirected graph, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, stage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (smallest node reachable) for every node of edges(a bigint, b bigint).

    Alternating large-star and small-star rounds: every node points its larger, then its smaller neighbours at the
    smallest one, until nothing changes, which takes about log(longest path) rounds.  Minima are aggregated before
    they are shuffled and joined back, so a node with very many neighbours is no single task's work; each round is staged.
    RuntimeError after most_rounds rounds without an end.
    """
    e = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = last = stage(e, "cc")
    mark = None
    for _ in range(most_rounds):
        # large star: (a > b) and (b, a); larger neighbours of a node go to the least of its closed neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours of a node, and itself, go to the least of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").select("a", "b", "m")
        e = e.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = stage(e.filter("a <> b").distinct(), "cc")
        discard(last)
        last = e
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
