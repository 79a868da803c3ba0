"""Substring de-duplication by sliding sentence spans.

Every run of several consecutive sentences is hashed; runs are joined over all documents, and the sentences that a run
covers are removed wherever the run is not its first occurrence (by document id, then place).

A sentence ends with ".", "!", "?" or a line end; one of over long_words words is cut into pieces, so that a passage
without such marks is several sentences too.  Cuts are where the hash of two words is the least of those around, so they
hang on the passage and not on the words before it; only where no such place comes for long_words words is the cut by
count.  The run that starts at a sentence is the shortest of at least min_sentences sentences and min_words words; pieces
of one long sentence are a run whatever their number, if they have the words.  Runs are compared by their words, in lower
case, by a 128-bit hash.

Defined results: a null text stays null, an empty one empty, both with no sentence.  Equal rows (same id and text) are
one document, and get the same result each.  Rows with a null id come first in the order.  An empty table gives an empty
result.  Other columns are carried along, whatever their names; n_sentences, n_removed and removed are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import discard, marked, most_common, small_batches, stage

SENTENCE = r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+"
ENDS = re.compile(r"[.!?\n]")
ASCII_SPACE = " \t\n\x0b\x0c\r"


def sentences(text: str, long_words: int = 25) -> list[str]:
    """The text's sentences; they join to the text again."""
    out = []
    for s in re.findall(SENTENCE, text):
        if len(s) > 2 * long_words and len(s.split()) > long_words:
            out.extend(pieces(s, long_words))
        else:
            out.append(s)
    return out


def pieces(sentence: str, long_words: int) -> list[str]:
    """A long sentence in pieces of some nine words, which start where the hash of two words is the least among four on
    either side, or else after long_words words."""
    tokens = re.findall(r"\s*\S+\s*", sentence)
    words = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in sentence.lower().split()]), dtype=np.uint64)
    h = np.full(len(words) + 8, np.iinfo(np.uint64).max)  # four on either side that are never less
    h[4:-4] = words * np.uint64(0x9E3779B97F4A7C15)
    h[4:-5] += words[1:]
    two = np.minimum(h[1:], h[:-1])
    four = np.minimum(two[2:], two[:-2])
    # Less than the four before, not more than the four after: of equal ones the first counts.
    least = np.flatnonzero((h[4:-4] < four[: len(words)]) & (h[4:-4] <= four[5:]))
    cuts = [0]
    for c in [*least.tolist(), len(tokens)]:
        cuts.extend(range(cuts[-1] + long_words, c, long_words))
        if c > cuts[-1]:
            cuts.append(c)
    return ["".join(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]


def runs(parts: list[str], min_sentences: int = 2, min_words: int = 12) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, hash) of the shortest runs that start, and that end, at each sentence with words."""
    tokens = [p.lower().split() for p in parts]
    own = [i for i, t in enumerate(tokens) if t]  # blank pieces count for nothing
    n = [len(tokens[i]) for i in own]
    keys = [" ".join(tokens[i]) for i in own]
    open_end = [i < len(parts) - 1 and not ENDS.search(p) for i, p in enumerate(parts)]
    piece = [open_end[i] or (i > 0 and open_end[i - 1]) for i in own]  # of a long sentence
    enough = lambda length, total, cut: total >= min_words and (length >= min_sentences or cut)
    found = set()
    for step in (1, -1):  # the shortest from each start, the shortest to each end
        for x in range(len(own)) if step == 1 else range(len(own) - 1, -1, -1):
            y, total, cut = x, 0, True
            while 0 <= y < len(own) and not enough(abs(y - x), total, cut):
                total += n[y]
                cut = cut and piece[y]
                y += step
            if total < min_words:
                break  # what comes after is shorter still
            if enough(abs(y - x), total, cut):
                found.add((x, y) if step == 1 else (y + 1, x + 1))
    return [(own[a], own[b - 1] + 1, xxhash.xxh3_128_digest("\n".join(keys[a:b]))) for a, b in sorted(found)]


def spans(docs: DataFrame, min_sentences: int, min_words: int, long_words: int) -> DataFrame:
    """id, th (hash of the text), a, b, h1, h2: the runs of docs(id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b, h = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                found = runs(sentences(text, long_words), min_sentences, min_words) if text else []
                rows.extend([r] * len(found))
                for x in found:
                    a.append(x[0])
                    b.append(x[1])
                    h.append(x[2])
            take = pa.array(rows, pa.int64())
            both = np.frombuffer(b"".join(h), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("th").take(take), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                names=["id", "th", "a", "b", "h1", "h2"],
            )

    return docs.mapInArrow(run, "id bigint, th bigint, a int, b int, h1 bigint, h2 bigint")


def later_runs(all_spans: DataFrame, common_from: int, common_most: int) -> DataFrame:
    """id, th, a, b of the runs that are not the first with their hash, by id, then th, then place.

    Runs that are among the most common ones are not shuffled: their first places are aggregated in each task, and go to
    all tasks (a bounded list).  No other hash is a large share of the rows, so the rest is dealt out by hash, once.
    """
    spark = all_spans.sparkSession
    common = most_common(all_spans, "h1", common_from, common_most)
    place = F.struct("id", "th", "a")
    listed = F.broadcast(spark.createDataFrame([(h,) for h in common], "h1 bigint"))
    hot = all_spans.join(listed, "h1", "left_semi")
    first = hot.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    hot = hot.join(F.broadcast(first), ["h1", "h2"])  # hashes of the list, a second half of 64 bits apart
    same = Window.partitionBy("h1", "h2")
    cold = all_spans.join(listed, "h1", "left_anti").withColumn("first", F.min(place).over(same))
    return hot.unionByName(cold).filter(place != F.col("first")).select("id", "th", "a", "b")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_sentences: int = 2, min_words: int = 12, long_words: int = 25, common_from: int = 64, common_most: int = 65_536) -> DataFrame:
    """docs with repeated sentences removed from text, n_sentences, n_removed and removed array<struct<a, b>> (sentences a to b - 1).

    common_from, common_most: runs met so often, and at most so many of the most common, are not shuffled; what is on that
    list changes no result.  Texts of which nothing goes are not shuffled either, as far as a bitmap can tell.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    t = F.col(f"`{text}`")
    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(F.coalesce(t, F.lit("")), t.isNull()).alias("th"), t.alias("text"), whole)
    all_spans = stage(spans(keyed.select("id", "th", "text"), min_sentences, min_words, long_words), "spans")
    gone = later_runs(all_spans, common_from, common_most).groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("removed"))
    gone = stage(gone.withColumn("key", F.xxhash64("id", "th")), "spans-gone")  # per document, no more than its sentences
    discard(all_spans)
    keyed = marked(keyed.select("id", "th", "row").withColumn("key", F.xxhash64("id", "th")), gone.select("key"))
    cut = keyed.filter("_maybe").alias("k").join(gone.alias("g"), F.expr("k.key = g.key and k.th = g.th and k.id <=> g.id"), "left").select("row", "removed")
    kept = keyed.filter("not _maybe").select("row", F.lit(None).cast("array<struct<a:int,b:int>>").alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = dict(zip(columns, batch.column("row").flatten(), strict=True))
            texts, n, n_cut = [], [], []
            for t, spans_gone in zip(rows[text].to_pylist(), batch.column("removed").to_pylist(), strict=True):
                parts = sentences(t, long_words) if t else []
                n.append(len(parts))
                if not spans_gone:
                    texts.append(t)
                    n_cut.append(0)
                    continue
                keep = [True] * len(parts)
                for r in spans_gone:
                    keep[r["a"] : r["b"]] = [False] * (r["b"] - r["a"])
                texts.append("".join(p for p, k in zip(parts, keep, strict=True) if k))
                n_cut.append(keep.count(False))
            rows[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*rows.values(), pa.array(n, pa.int64()), pa.array(n_cut, pa.int64()), batch.column("removed")], names=[*columns, "n_sentences", "n_removed", "removed"])

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in columns), "n_sentences bigint, n_removed bigint, removed array<struct<a:int,b:int>>"])
    return cut.unionByName(kept).mapInArrow(run, schema)
