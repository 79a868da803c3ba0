"""Divergence of sources, term by term, from one sorted stream of counts.

The texts of a language are compared source by source: which terms a source uses more than its language does, and how far
the term distributions of two sources lie apart.

1. Every task counts the terms of its rows, block by block: (lang, term, source, block, docs, n).  Rows of a block are
   counted together, so a frequent term is a few rows a task, whatever the number of its documents.
2. These rows are dealt by (lang, term) and sorted by (lang, term, source, block).  A run-length scan over the sorted
   stream adds each run up: in how many documents of the language the term occurs, and how often in each source.
3. A second scan over the kept terms emits, run by run, what the term adds to every pair of sources, summed within the
   task, and the terms in which a source leads, the best of a task; both are then added up or ranked.

Shares are whole numbers, p = 1 + floor(scale * (count + 2) / (N + 2 V)), and so is f = floor((p - q)^2 / (p + q)); shares
are found by long division in steps that fit 64 bits, so counts up to 4 * 10^15 stay exact.

Memory: a task holds at most room counted terms, then one run (an entry for each source that has the term), then a strip
of the pair table.  The totals of the groups go to all tasks, one entry for each (lang, source); the result itself has a
row for each two of them, so that table is at most about the square root of the result.

Defined results: null texts, languages and sources are read as ''.  Every row is a document, repeated or not, whatever its
id.  A language without kept terms gives its pairs the value 0 and no term rows; a language with one source has no pairs.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import short_batches, stage

#: Bytes of a term stay, A-Z in lower case; all others become spaces.
TERM_BYTES = bytes(b if b > 0x7F or chr(b).isalpha() and chr(b).islower() else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def block_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", room: int = 200_000) -> DataFrame:
    """lang, term, source, block, docs, n: in how many rows of a block the term occurs, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        block = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            for (language, origin), (docs_of, times) in held.items():
                for terms in _parts(list(docs_of), 50_000):
                    k = len(terms)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(pa.scalar(language, pa.string()), k),
                            pa.array(terms, pa.binary()).cast(pa.string()),
                            pa.repeat(pa.scalar(origin, pa.string()), k),
                            pa.repeat(pa.scalar(block, pa.int64()), k),
                            pa.array(map(docs_of.__getitem__, terms), pa.int64(), size=k),
                            pa.array(map(times.__getitem__, terms), pa.int64(), size=k),
                        ],
                        names=["lang", "term", "source", "block", "docs", "n"],
                    )

        size = 0
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for i, where in enumerate(zip(langs, sources, strict=True)):
                words = batch.column("text")[i].as_py().translate(TERM_BYTES).split()
                docs_of, times = held.get(where) or held.setdefault(where, (Counter(), Counter()))
                size -= len(times)
                times.update(words)
                docs_of.update(set(words))
                size += len(times)
                if size > room:
                    yield from flush()
                    held, size, block = {}, 0, block + 1
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, term string, source string, block bigint, docs bigint, n bigint")


def _parts(x: list, most: int) -> Iterator[list]:
    return (x[a : a + most] for a in range(0, len(x), most))


def _starts(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return new


def run_lengths(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, docs, sources, counts of the terms that at least min_docs documents of the language hold."""

    def whole_runs(t: pa.Table) -> pa.Table:
        """One row for each (lang, term, source) of the sorted rows."""
        at = np.flatnonzero(_starts(t["lang"].combine_chunks(), t["term"].combine_chunks(), t["source"].combine_chunks()))
        sums = {k: pa.array(np.add.reduceat(t[k].to_numpy(), at)) for k in ("docs", "n")}
        return pa.table({**{k: t[k].take(pa.array(at)) for k in ("lang", "term", "source")}, **sums})

    def terms(t: pa.Table) -> pa.RecordBatch:
        """One row for each kept (lang, term); t has whole runs alone."""
        at = np.flatnonzero(_starts(t["lang"].combine_chunks(), t["term"].combine_chunks()))
        docs = np.add.reduceat(t["docs"].to_numpy(), at)
        size = np.diff(np.append(at, t.num_rows))
        kept = docs >= min_docs
        t, at = t.filter(pa.array(np.repeat(kept, size))), pa.array(at[kept])
        offsets = pa.array(np.append(0, np.cumsum(size[kept])), pa.int32())
        first = offsets.slice(0, len(at))
        lists = [pa.ListArray.from_arrays(offsets, t[k].combine_chunks()) for k in ("source", "n")]
        return pa.RecordBatch.from_arrays([t["lang"].combine_chunks().take(first), t["term"].combine_chunks().take(first), pa.array(docs[kept]), *lists], names=["lang", "term", "docs", "sources", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch.select(["lang", "term", "source", "docs", "n"]))
            t = whole_runs(pa.concat_tables([held, t]) if held else t)
            last = int(np.flatnonzero(_starts(t["lang"].combine_chunks(), t["term"].combine_chunks()))[-1])
            if last:
                yield terms(t.slice(0, last))
            held = t.slice(last)
        if held:
            yield terms(held)

    dealt = counts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    return dealt.mapInArrow(run, "lang string, term string, docs bigint, sources array<string>, counts array<bigint>")


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 2) / (total + 2 kept)), by long division in steps of 1,000; scale is a power of 1,000."""
    whole = np.asarray(total, dtype=np.int64) + 2 * kept
    out, rest = np.divmod(counts.astype(np.int64) + 2, whole)
    while scale > 1:
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
        scale //= 1000
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare(terms: DataFrame, groups: DataFrame, top: int, scale: int = 1_000_000_000, room: int = 4_000_000) -> DataFrame:
    """part, lang, source, item, value: per task, sums for the pairs of sources and the best terms of each source.

    groups holds lang, source, n (occurrences of kept terms) and v (kept terms of the language).  Where a language has so
    many sources that its pair table is over room entries, the table is worked on in strips of some sources each.
    """
    spark = terms.sparkSession
    by_lang: dict[str, list] = {}
    for r in groups.orderBy("lang", "source").collect():  # one row for each (lang, source): see the head of this file
        by_lang.setdefault(r["lang"], []).append((r["source"], r["n"], r["v"]))
    known = spark.sparkContext.broadcast(by_lang)
    strip = lambda n: max(1, min(n, room // n))
    strips = spark.createDataFrame([(k, -(-len(x) // strip(len(x)))) for k, x in by_lang.items()], "lang string, strips int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, best = None, None, {}
        names, where, n, v, low, high = [], {}, None, 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if at is None:
                return
            language = at[0]
            for i in range(low, high):
                others = [j for j in range(len(names)) if j != i]
                rows = [("pair", names[j], int(sums[i - low, j])) for j in others]
                rows += [("term", term.decode(), -value) for value, term in best.get(i, [])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.string()), pa.repeat(pa.scalar(language, pa.string()), len(rows)), pa.repeat(pa.scalar(names[i], pa.string()), len(rows)), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                        names=["part", "lang", "source", "item", "value"],
                    )

        for batch in batches:
            batch = pa.table(batch)
            new = np.flatnonzero(_starts(batch["lang"].combine_chunks(), batch["strip"].combine_chunks()))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                here = (piece["lang"][0].as_py(), piece["strip"][0].as_py())
                if here != at:
                    yield from flush()
                    group = known.value[here[0]]
                    names, n, v = [g[0] for g in group], np.array([g[1] for g in group], dtype=np.int64), group[0][2]
                    where = {s: k for k, s in enumerate(names)}
                    low = here[1] * strip(len(names))
                    high = min(len(names), low + strip(len(names)))
                    at, sums, best = here, np.zeros((high - low, len(names)), dtype=np.int64), {}
                most = max(1, room // len(names))
                for c in range(0, piece.num_rows, most):
                    some = piece.slice(c, most)
                    lists, times = some["sources"].combine_chunks(), some["counts"].combine_chunks()
                    row = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists).to_numpy())
                    coded = lists.flatten().dictionary_encode()
                    column = np.array([where[s] for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
                    count = np.zeros((some.num_rows, len(names)), dtype=np.int64)
                    count[row, column] = times.flatten().to_numpy()
                    p = shares(count, n, v, scale)
                    for i in range(low, high):
                        sums[i - low] += gap(p[:, i : i + 1], p).sum(axis=0)
                    q = shares(count.sum(axis=1), int(n.sum()), v, scale)[:, None]
                    lead = (count[:, low:high] > 0) & (p[:, low:high] > q)
                    value = gap(p[:, low:high], q)
                    labels = some["term"].to_pylist()
                    for i in range(high - low):
                        rows = np.flatnonzero(lead[:, i])
                        if len(rows) > top:  # all that are as good as the last of the best stay
                            rows = rows[value[rows, i] >= np.partition(value[rows, i], -top)[-top]]
                        if len(rows):
                            best[low + i] = heapq.nsmallest(top, [*best.get(low + i, []), *((-int(value[r, i]), labels[r].encode()) for r in rows)])
        yield from flush()

    rows = terms.join(F.broadcast(strips), "lang").withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))  # strips: one row a language
    rows = rows.select("lang", "strip", "term", "sources", "counts").sortWithinPartitions("lang", "strip")
    return rows.mapInArrow(run, "part string, lang string, source string, item string, value bigint")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10, scale: int = 1_000_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to each other one (part 'pair'), and the top terms
    in which it leads its language (part 'term'); rank is by value, the largest first, then by item."""
    spark = docs.sparkSession
    with short_batches(spark):
        terms = stage(run_lengths(block_counts(docs, text, lang, source), min_docs), "divergence-terms")
    groups = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source")))).distinct()
    totals = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = stage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "divergence-groups")
    partial = stage(compare(terms, groups, top, scale), "divergence-parts")
    # Languages without a kept term have no run that could emit their pairs.
    bare = groups.filter("v = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(bare).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = partial.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(best.select("lang", "source", "item", "value", "part", "rank"))
    return out.select("lang", "source", "part", "item", "value", "rank")
