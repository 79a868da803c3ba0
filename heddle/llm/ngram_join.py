"""Jaccard self-join of documents on their n-gram sets, with a prefix tree, up to connected components.

1. A document's set holds 64-bit hashes of its n-grams.  Documents with equal sets are one class, shown by its smallest id.
2. A set of x n-grams of which x - ceil(t x) + 1 are in no other set can have no link.  Sampled n-grams (by hash) show this
   for most sets; the others are open.
3. The n-grams of the open sets are ordered by the number of open sets that hold them, rarest first, then by hash.  In any
   global order two sets that reach the threshold share one of their first x - ceil(t x) + 1 elements; only these prefixes
   are exchanged, without the elements that one set holds alone.
4. Open sets that share a prefix element meet around its smallest id, in blocks.  A block's sets are stored in a prefix tree;
   every set goes down the tree, the overlap with a common path is counted once for all sets below it, and subtrees are left
   that the remaining lengths rule out, or that hold only sets it is linked with.
5. What these links connect is one component; sets of different components that still share a prefix element meet again,
   every block of such a group with every other one whose sizes fit, so no link between components is missed.

Links inside a component are not all listed: a spanning set of them is.  No block exceeds some block_rows sets or
block_items n-grams (one set may be longer).

Defined results: a null or blank text has an empty set (n_shingles 0) and is its own component.  A row without id has
component null.  Rows that share an id are one document with all their sets.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import discard, marked, most_common, small_batches, stage, words
from heddle.llm.components import components

UPPER = "".join(map(chr, range(65, 91)))


def ngram_set(text: Column, n: int = 3) -> Column:
    """Distinct hashes of the n-word shingles of a text in lower case (A-Z); a shorter text is one shingle."""
    return F.transform(F.array(words(F.translate(text, UPPER, UPPER.lower()))), lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))).when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>")))[0]


STRIDE = 16


class PrefixTree:
    """Sorted sets (arrays of element numbers) as a tree whose levels end at depth STRIDE, 2 STRIDE, 4 STRIDE, ...

    A node stands for the rows (in sorted order) that agree down to the end of its level; its segment holds the elements
    that its level adds.  Per level: first row, row after the last, segment start and length, least and greatest size
    below, greatest length below, first child and child after the last.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        rows = [sets[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order], dtype=np.int64)
        length = np.array([len(r) for r in rows], dtype=np.int64)
        lcp = np.full(len(rows), -1, dtype=np.int64)  # with the row before
        for i in range(1, len(rows)):
            m = min(len(rows[i - 1]), len(rows[i]))
            d = np.flatnonzero(rows[i - 1][:m] != rows[i][:m])
            lcp[i] = d[0] if len(d) else m
        self.levels: list[dict[str, np.ndarray]] = []
        begin, end, most = 0, STRIDE, int(length.max(initial=0))
        while begin < most:
            there = np.flatnonzero(length > begin)
            cut = np.minimum(length, end)
            fresh = np.ones(len(there), dtype=bool)
            fresh[1:] = (np.diff(there) > 1) | (cut[there[1:]] != cut[there[:-1]]) | (lcp[there[1:]] < cut[there[1:]])
            at = np.flatnonzero(fresh)
            lo = there[at]
            hi = there[np.append(at[1:], len(there)) - 1] + 1
            segments = [rows[a][begin:end] for a in lo.tolist()]
            n = np.array([len(x) for x in segments], dtype=np.int64)
            level = {"lo": lo, "hi": hi, "flat": np.concatenate(segments), "start": np.cumsum(n) - n, "n": n, "depth": begin + n}
            level["least"] = np.minimum.reduceat(self.sizes[there], at)
            level["most"] = np.maximum.reduceat(self.sizes[there], at)
            level["longest"] = np.maximum.reduceat(length[there], at)
            level["ends"] = level["depth"] < end if end < most else np.ones(len(lo), dtype=bool)
            level["ends"] |= length[lo] <= end
            if self.levels:
                above = self.levels[-1]
                above["child"], above["after"] = np.searchsorted(lo, above["lo"]), np.searchsorted(lo, above["hi"])
            self.levels.append(level)
            begin, end = end, 2 * end
        if self.levels:
            self.levels[-1]["child"] = self.levels[-1]["after"] = np.zeros(len(self.levels[-1]["lo"]), dtype=np.int64)
        self.length = length

    def walk(self, x: np.ndarray, n: int, held: np.ndarray, low: int, high: int, num: int, den: int, skip: np.ndarray) -> np.ndarray:
        """Rows whose sets reach the threshold num / den with x, a set of n n-grams of which the elements x are in the block.

        held is a zeroed array over the elements; sizes are from low to high; rows under skip are left out.
        """
        held[x] = 1
        upto = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
        skipped = np.concatenate([[0], np.cumsum(skip)])
        total, found = num + den, []
        nodes = np.arange(len(self.levels[0]["lo"])) if self.levels else np.empty(0, dtype=np.int64)
        got = np.zeros(len(nodes), dtype=np.int64)
        for level in self.levels:
            lo, hi = level["lo"][nodes], level["hi"][nodes]
            live = (level["most"][nodes] >= low) & (level["least"][nodes] <= high) & (skipped[hi] - skipped[lo] < hi - lo)
            nodes, got = nodes[live], got[live]
            if not len(nodes):
                break
            start, k = level["start"][nodes], level["n"][nodes]
            place = np.cumsum(k) - k
            elements = level["flat"][np.repeat(start - place, k) + np.arange(int(k.sum()))]
            got = got + np.add.reduceat(held[elements], place, dtype=np.int64)
            need = -(-num * (n + np.maximum(level["least"][nodes], low)) // total)
            left = np.minimum(len(x) - upto[elements[place + k - 1] + 1], level["longest"][nodes] - level["depth"][nodes])
            live = got + left >= need
            nodes, got = nodes[live], got[live]
            for node, g in zip(nodes[level["ends"][nodes]].tolist(), got[level["ends"][nodes]].tolist(), strict=True):
                rows = np.arange(level["lo"][node], level["hi"][node])
                rows = rows[(self.length[rows] == level["depth"][node]) & ~skip[rows]]
                found.append(rows[total * g >= num * (n + self.sizes[rows])])
            first, many = level["child"][nodes], level["after"][nodes] - level["child"][nodes]
            got = np.repeat(got, many)
            nodes = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        held[x] = 0
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def join_block(ids: list[int], sets: list[np.ndarray], comps: list[int], probes: list[bool], stored: list[bool], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between probes and stored rows of different components; only such as join two components anew."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    _, number, times = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    several = times > 1  # an element that one set holds alone is in no overlap
    place = np.cumsum(several) - 1
    ends = np.cumsum(n)
    sets = [place[x[several[x]]].astype(np.int64) for x in np.split(number, ends[:-1])] if len(n) else []
    can = [den * len(s) >= num * int(k) for s, k in zip(sets, n, strict=True)]
    at = [i for i, s in enumerate(stored) if s and can[i]]
    if not at:
        return
    tree = PrefixTree([sets[i] for i in at], [int(n[i]) for i in at])
    names: dict[int, int] = {}
    everyone = np.array([names.setdefault(c, len(names)) for c in comps], dtype=np.int64)
    label = everyone[[at[i] for i in tree.order]]
    once = all(probes) and all(stored)  # a pair is then met from its larger set's side
    held = np.zeros(int(several.sum()), dtype=np.int8)
    for p in (i for i, x in enumerate(probes) if x and can[i]):
        own, size = int(everyone[p]), int(n[p])
        rows = tree.walk(sets[p], size, held, -(-num * size // den), size if once else den * size // num, num, den, label == own)
        for r in rows.tolist():
            if (old := int(label[r])) != own:
                yield ids[p], ids[at[tree.order[r]]]
                label[label == old] = own
                everyone[everyone == old] = own


LINKS = "a bigint, b bigint"


def _blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links of rows(j1, j2, j3, id, comp, probe, stored, set), a prefix tree per job."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("id", "comp", "probe", "stored")}
        sets = []
        for chunk in table.column("set").chunks:
            flat, ends = chunk.values.to_numpy(zero_copy_only=False).view(np.uint64), chunk.offsets.to_numpy().tolist()
            sets.extend(np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))
        found = list(join_block(cols["id"], sets, cols["comp"], cols["probe"], cols["stored"], num, den))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("j1", "j2", "j3").applyInArrow(run, LINKS)


RATE = 1 << 20


def sampled_below(num: int, den: int, times: float) -> int:
    """n-grams whose hash is below this, modulo RATE, are sampled: so many times the share that a prefix has of its set."""
    return min(RATE, math.ceil(times * RATE * (den - num) / den))


def digests(docs: DataFrame, n: int, below: int) -> DataFrame:
    """id, n, k1, k2 (digest of the set), sample array<bigint>: the sampled n-grams of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set")
            flat, offsets = sets.values.to_numpy(zero_copy_only=False).view(np.uint64), sets.offsets.to_numpy()
            k1, k2, out, sizes = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                s = flat[a:b]
                size = b - a
                sizes.append(size)
                mixed = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                k1.append(int(np.bitwise_xor.reduce(s).view(np.int64)) if size else 0)
                k2.append(int(mixed.sum(dtype=np.uint64).view(np.int64)) if size else 0)
                out.append(s[s % np.uint64(RATE) < np.uint64(below)].view(np.int64))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            sample = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.array([], dtype=np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), sample], names=["id", "n", "k1", "k2", "sample"])

    return docs.select("id", ngram_set(F.col("text"), n).alias("set")).mapInArrow(run, "id bigint, n bigint, k1 bigint, k2 bigint, sample array<bigint>")


def flat_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of lists, and the row of each."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.repeat(np.arange(len(lists)), np.diff(offsets))


def set_classes(sets: DataFrame, common: list[int]) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (n, k1, k2, rep, own, copies), and the rows (k1, t) of their sampled n-grams that are not common.

    rep is the smallest id of a class, own the number of its rows; rows of copies repeat.
    """
    last = sets.sparkSession.sparkContext.broadcast(np.array(sorted(common), dtype=np.int64))

    def kept(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        t, row = flat_of(batch.column("sample"))
        if len(last.value) and len(t):
            free = last.value[np.minimum(np.searchsorted(last.value, t), len(last.value) - 1)] != t
            t, row = t[free], row[free]
        return t, row

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row = kept(batch)
            own = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "k1", "k2")), pa.array(own)], names=["id", "n", "k1", "k2", "own"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, row = kept(batch)
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array(row)), pa.array(t)], names=["k1", "t"])

    counted = sets.mapInArrow(counts, "id bigint, n bigint, k1 bigint, k2 bigint, own bigint")
    classes = counted.filter("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"), F.max("own").alias("own"), F.count(F.lit(1)).alias("copies"))
    return classes, sets.filter("n > 0 and id is not null").select("k1", "sample").mapInArrow(rows, "k1 bigint, t bigint")


def open_sets(classes: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """id of the classes that can have a link: those whose sampled n-grams of no other class do not fill a prefix.

    Common n-grams (a bounded list) are known to be shared and are not shuffled, so no n-gram here has more than a small
    share of the rows, which are dealt out by n-gram once.
    """
    same = Window.partitionBy("t")
    shared = rows.select("k1", F.min("k1").over(same).alias("_a"), F.max("k1").over(same).alias("_b")).filter("_a < _b")
    others = shared.groupBy("k1").agg(F.count(F.lit(1)).alias("others"))
    own = F.col("own") - F.coalesce(F.col("others") / F.col("copies"), F.lit(0))  # each copy has given the same rows
    return classes.join(others, "k1", "left").filter(own < prefix_length(num, den)).select(F.col("rep").alias("id")).distinct()


def prefix_length(num: int, den: int) -> Column:
    """Elements of a set of n n-grams of which one is in any set that it is linked with, whatever the order."""
    return F.expr(f"n - cast(({num} * n + {den - 1}) div {den} as bigint) + 1")


def prefixes(opened: DataFrame, num: int, den: int, common_from: int, common_most: int) -> DataFrame:
    """id, n, t, hot: the prefix elements, shared with other sets, of opened(id, s, set); hot ones are on the common list.

    The order is: by the number of sets that hold the element, then by hash; those on the list come last, the most common
    at the end.  The list is bounded, so it goes to all tasks; what is not on it is no large share of all rows.
    """
    common = most_common(opened, "set", common_from, common_most)
    rank = {t: -i for i, t in enumerate(common)}
    by_hash = np.array(sorted(common), dtype=np.int64)
    last = opened.sparkSession.sparkContext.broadcast((by_hash, np.array([rank[t] for t in by_hash.tolist()], dtype=np.int64)))

    def on_list(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, ranks = last.value
        if not len(known):
            return np.zeros(len(t), dtype=bool), np.zeros(len(t), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, t), len(known) - 1)
        return known[at] == t, ranks[at]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, row = flat_of(batch.column("set"))
            free = ~on_list(t)[0]
            take = pa.array(row[free])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("s").take(take), pa.array(t[free])], names=["id", "s", "t"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, row = flat_of(batch.column("set"))
            hot, ranks = on_list(t)
            t, row, ranks = t[hot], row[hot], ranks[hot]
            by = np.lexsort((ranks, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            n = pa.array(np.diff(batch.column("set").offsets.to_numpy()).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("s"), n, pa.ListArray.from_arrays(pa.array(ends), pa.array(t[by]))], names=["id", "s", "n", "hot"])

    held = opened.select("id", "s", "set").mapInArrow(rare, "id bigint, s int, t bigint").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("t")))
    shared = held.filter("df > 1").groupBy("id", "s").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("x"))
    sets = opened.select("id", "s", "set").mapInArrow(whole, "id bigint, s int, n bigint, hot array<bigint>")
    sets = sets.join(shared, ["id", "s"], "left").withColumn("x", F.coalesce(F.col("x.t"), F.array().cast("array<bigint>")))
    alone = F.col("n") - F.size("x") - F.size("hot")
    need = (prefix_length(num, den) - alone).cast("int")
    sets = sets.withColumn("need", need).filter("need > 0").withColumn("m", F.size("x"))
    sets = sets.select("id", "n", "m", F.posexplode(F.slice(F.concat("x", "hot"), F.lit(1), F.col("need"))).alias("pos", "t"))
    return sets.select("id", "n", "t", (F.col("pos") >= F.col("m")).alias("hot"))


def centred(post: DataFrame) -> DataFrame:
    """post(id, n, t, hot) with c, the smallest id that has t; without what one id has alone."""
    least = post.groupBy("t", "hot").agg(F.min("id").alias("c"), F.max("id").alias("_last")).filter("c < _last")
    cold = post.filter("not hot").join(least.filter("not hot").select("t", "c"), "t")
    hot = post.filter("hot").join(F.broadcast(least.filter("hot").select("t", "c")), "t")  # as long as the common list at most
    return cold.unionByName(hot)


def only_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose id may be among ids."""
    return marked(docs.withColumn("key", F.col("id")), ids.select(F.col("id").alias("key"))).filter("_maybe").drop("key", "_maybe")


def _joined(opened: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs(id, j1, j2, j3, ...) with the sets of their documents."""
    return only_among(opened.select("id", "set"), jobs.select("id").distinct()).join(jobs, "id")


def _blocks_of(rows: DataFrame, block_rows: int, block_items: int) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n") / block_items), F.lit(1)).cast("bigint").alias("nb")


def join_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100, block_rows: int = 512, block_items: int = 2_000_000, common_from: int = 64, common_most: int = 65_536, sample: float = 2.4) -> DataFrame:
    """id_col, n_shingles, component_id for every row of docs; sets link where den * |common| >= num * |union|.

    common_from, common_most: n-grams of so many sets, and at most so many of the most common, are known to be shared
    without being shuffled, and end the global order; what is on that list changes no link.  sample: a set is left out at
    the first step if a share of 1 / sample of its n-grams is its own; a greater one leaves out more sets, and counts more n-grams.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    named = docs.filter("id is not null")
    below = sampled_below(num, den, sample)
    sets = stage(digests(docs, n, below), "nj-sets")

    # Classes of equal sets; a class is shown by its smallest id.
    classes, rows = set_classes(sets, most_common(sets, "sample", common_from, common_most))
    classes = stage(classes, "nj-class")
    ids = stage(open_sets(classes, rows, num, den), "nj-open")
    slim = stage(sets.drop("sample"), "nj-digests")
    discard(sets)
    opened = only_among(named, ids).join(ids, "id").select("id", ngram_set(F.col("text"), n).alias("set"))
    opened = stage(opened.select("id", F.hash("set").alias("s"), "set"), "nj-open-sets")
    prefix = stage(prefixes(opened, num, den, common_from, common_most), "nj-prefix")
    post = stage(centred(prefix), "nj-post")
    discard(ids, prefix)

    # Meetings: a set goes where the smallest id is that it shares an element with; that one is in all blocks there.
    zero, yes = F.lit(0).cast("bigint"), F.lit(True)
    meet = stage(post.groupBy("id").agg(F.min("c").alias("c"), F.max("n").alias("n")), "nj-meet")
    blocks = meet.groupBy("c").agg(_blocks_of(meet, block_rows, block_items))
    own = meet.join(blocks, "c").filter("id <> c").select("id", F.col("c").alias("j1"), F.pmod(F.xxhash64("id"), F.col("nb")).alias("j2"))
    centres = blocks.select(F.col("c").alias("id"), F.col("c").alias("j1"), F.explode(F.sequence(zero, F.col("nb") - 1)).alias("j2"))
    jobs = own.unionByName(centres).select("id", "j1", "j2", zero.alias("j3"), F.col("id").alias("comp"), yes.alias("probe"), yes.alias("stored"))
    first_jobs = stage(jobs, "nj-jobs")
    links = stage(_blocks(_joined(opened, first_jobs), num, den), "nj-links")
    label = stage(components(links), "nj-label")

    # Sets of different components that share an element meet again, around the element's smallest id: every block of such
    # a group with every other one, so that each pair of them is held against each other.  Sizes of linked sets differ by
    # den / num at most, so in a group of several blocks a block has sizes of one step, and meets those of its own and the next.
    comp = F.coalesce("label", "id")
    size = stage(meet.select("id").join(label.withColumnRenamed("node", "id"), "id", "left").select("id", comp.alias("comp")), "nj-comp")
    here = stage(post.join(size, "id").select("id", "n", "t", "hot", "c", "comp"), "nj-here")
    several = here.groupBy("t", "hot").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b")
    cold = here.filter("not hot").join(several.filter("not hot").select("t"), "t")
    hot = here.filter("hot").join(F.broadcast(several.filter("hot").select("t")), "t")
    again = met = stage(cold.unionByName(hot).groupBy("c", "id").agg(F.max("comp").alias("comp"), F.max("n").alias("n")), "nj-again")
    alone = again.groupBy("c").agg(_blocks_of(again, block_rows, block_items)).filter("nb > 1").select("c", yes.alias("large"))
    step = 1.000001 * math.log(den / num) if num < den else 1e-6
    again = again.join(alone, "c", "left").withColumn("step", F.when(F.col("large"), F.floor(F.log("n") / step)).otherwise(zero))
    blocks = again.groupBy("c", "step").agg(_blocks_of(again, block_rows, block_items))
    above = blocks.select("c", (F.col("step") - 1).alias("step"), F.col("nb").alias("next"))
    again = again.join(blocks, ["c", "step"]).join(above, ["c", "step"], "left").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")))
    # A job is (c, step and block of the stored sets, step and block of the probes), the step and the block in one number.
    number = lambda step, b: F.shiftleft(step, 40) + b
    every = lambda k: F.explode(F.sequence(zero, k - 1)).alias("o")
    same = again.select("id", "c", "comp", "step", "b", every(F.col("nb")))
    same = same.select("id", "c", number("step", F.least("b", "o")).alias("j2"), number("step", F.greatest("b", "o")).alias("j3"), "comp", (F.col("b") <= F.col("o")).alias("probe"), (F.col("b") >= F.col("o")).alias("stored"))
    upper = again.filter("next is not null").select("id", "c", "comp", "step", "b", every(F.col("next")))
    upper = upper.select("id", "c", number("step", F.col("b")).alias("j2"), number(F.col("step") + 1, F.col("o")).alias("j3"), "comp", yes.alias("probe"), (~yes).alias("stored"))
    lower = again.select("id", "c", "comp", (F.col("step") - 1).alias("step"), "b").join(blocks, ["c", "step"]).select("id", "c", "comp", "step", "b", every(F.col("nb")))
    lower = lower.select("id", "c", number("step", F.col("o")).alias("j2"), number(F.col("step") + 1, F.col("b")).alias("j3"), "comp", (~yes).alias("probe"), yes.alias("stored"))
    jobs = same.unionByName(upper).unionByName(lower).withColumnRenamed("c", "j1")
    jobs = stage(jobs, "nj-jobs")
    more = stage(_blocks(_joined(opened, jobs), num, den), "nj-more")
    discard(opened, first_jobs, jobs, links, post, meet, here, met)
    # Links between components join them; the components' own labels stand for all their members.
    joint = more.join(size.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(size.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    merged = stage(components(joint.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "nj-merged")
    final = size.join(merged, size["comp"] == merged["node"], "left").select(F.col("id").alias("rep"), F.coalesce("label", "comp").alias("label"))

    of_class = classes.join(final.distinct(), "rep", "left").select("n", "k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    of_class = stage(of_class, "nj-classes")
    discard(classes, label, size, merged, more)
    out = slim.join(of_class, ["n", "k1", "k2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
