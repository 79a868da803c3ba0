"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised and each component is stored as bit slices: bitmap b of component d has the b-th bit of every
vector of a block.  A query adds the slices, weighted by its own components, with carry-save bitmap adders, which gives
the slices of all scores at once; the best k are taken from the most significant slice downward, and rows that tie at
the boundary are resolved by id.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither do rows without id.
Vectors of different lengths have no inner product: a query's candidates are those of its own length (empty vectors score
0 with each other).  Repeated ids are candidates each.  Fewer than k candidates give fewer rows;
an empty table gives none.  Extra columns are ignored.  Scores are exact whatever their size; where one that would be
returned, or a quantised component, does not fit in 64 bits, the query ends in a ScoreOverflow that names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import discard, small_batches, stage

INDEX_SCHEMA = "d int, ids binary, low binary, bits binary, slices binary"
QUERY_SCHEMA = "q_d int, q_ids binary, q_vectors binary"
RESULT_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


class ScoreOverflow(ArithmeticError):
    """A score among the best of a block, or a quantised component, is beyond 64 bits, so no result would be right."""


def quantise(x: Column, scale: int = 1024) -> Column:
    """floor(scale * component) as bigint, null for a vector with a null or non-finite component; an error beyond 64 bits."""
    ok = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    fits = ~F.exists(x, lambda v: F.abs(scale * v.cast("double")) >= 2.0**63)
    whole = F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("bigint"))
    return F.when(ok & fits, whole).when(ok, F.raise_error(F.lit(f"ScoreOverflow: a component times {scale} does not fit in 64 bits")))


def slice_block(ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
    """Bitmaps of the block, a component after the other, least significant bit first; low: what was taken off a component."""
    low = v.min(axis=0)
    up = (v - low).astype(np.uint64)
    bits = np.array([int(x).bit_length() for x in up.max(axis=0)], dtype=np.int64)
    out = [np.packbits((up[:, d] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little") for d in range(v.shape[1]) for b in range(bits[d])]
    return {"ids": ids.tobytes(), "low": low.tobytes(), "bits": bits.tobytes(), "slices": b"".join(x.tobytes() for x in out)}


def score_slices(q: np.ndarray, low: np.ndarray, slices: list[list[np.ndarray]], full: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of (score - constant) of all rows, and the constant.

    A component of q is taken as signed digits; a digit -1 adds the complement (all ones less the slice), which moves the constant.
    """
    columns: list[list[np.ndarray]] = []
    const = sum(a * b for a, b in zip(q.tolist(), low.tolist(), strict=True))
    for d, own in enumerate(slices):
        left, at = int(q[d]), 0
        while left:
            if left & 1:
                digit = 2 - (left & 3)
                left -= digit
                for b, x in enumerate(own):
                    while len(columns) <= at + b:
                        columns.append([])
                    columns[at + b].append(x if digit > 0 else x ^ full)
                    if digit < 0:
                        const -= 1 << (at + b)
            left >>= 1
            at += 1
    out, w = [], 0
    while w < len(columns):
        todo = columns[w]
        if len(todo) > 1 and w + 1 == len(columns):
            columns.append([])
        while len(todo) > 2:  # full adder: three bitmaps of a weight become a sum and a carry
            a, b, c = todo.pop(), todo.pop(), todo.pop()
            ab = a ^ b
            todo.append(ab ^ c)
            columns[w + 1].append((a & b) | (ab & c))
        if len(todo) == 2:
            a, b = todo
            columns[w + 1].append(a & b)
            todo = [a ^ b]
        out.append(todo[0] if todo else np.zeros_like(full))
        w += 1
    return out, const


def count(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def top_rows(score: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are among the best k for sure, and of those that tie for the places left."""
    sure, maybe = np.zeros_like(rows), rows.copy()
    for s in reversed(score):
        x = sure | (maybe & s)
        n = count(x)
        if n > k:
            maybe &= s
        elif n < k:
            sure, maybe = x, maybe & ~s
        else:
            return x, np.zeros_like(rows)
    return sure, maybe


def places(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, low: np.ndarray, slices: list[list[np.ndarray]], n_words: int, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    full = np.zeros(n_words * 8, dtype=np.uint8)
    full[: (len(ids) + 7) // 8] = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
    full = full.view(np.uint64)
    order = np.argsort(ids, kind="stable")
    for qid, vector in zip(qids.tolist(), q, strict=True):
        score, const = score_slices(vector, low, slices, full)
        rows = full.copy()
        a, b = np.searchsorted(ids, [qid, qid + 1], sorter=order)
        for r in order[a:b]:  # a query is no candidate of its own
            rows[r >> 6] &= ~np.uint64(1 << (int(r) & 63))
        sure, maybe = top_rows(score, rows, k)
        found = places(sure)
        tied = places(maybe)
        tied = tied[np.argsort(ids[tied], kind="stable")][: max(0, k - len(found))]
        for r in [*found.tolist(), *tied.tolist()]:
            total = const + sum(1 << w for w, s in enumerate(score) if int(s[r >> 6]) >> (r & 63) & 1)
            if not -(1 << 63) <= total < 1 << 63:
                raise ScoreOverflow(f"the score of query {qid} with vector {int(ids[r])}, {total}, does not fit in 64 bits")
            yield qid, int(ids[r]), total


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors (of one length) of up to 2 * most rows at a time; at most 4 * most rows are held."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    n: dict[int, int] = {}

    def block(d: int) -> tuple[np.ndarray, np.ndarray]:
        parts = held.pop(d)
        n.pop(d)
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size := pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64))
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            for at in range(0, len(rows), most):
                r = rows[at : at + most]
                held.setdefault(d, []).append((ids[r], flat[(ends[r] - d)[:, None] + np.arange(d)]))
                n[d] = n.get(d, 0) + len(r)
                if n[d] >= most:
                    yield block(d)
        while sum(n.values()) > 4 * most:
            yield block(max(n, key=n.get))
    for d in list(held):
        yield block(d)


def build_index(vectors: DataFrame, block_rows: int = 16_384) -> DataFrame:
    """Blocks of the index over vectors(id, v array<bigint>), each about block_rows rows."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _gathered(batches, block_rows):
            x = slice_block(ids, v)
            yield pa.RecordBatch.from_pylist([{"d": v.shape[1]} | x], schema=pa.schema([("d", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("bits", pa.binary()), ("slices", pa.binary())]))

    return vectors.mapInArrow(blocks, INDEX_SCHEMA)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384, query_rows: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for every row of queries; both have id_col and vector_col.

    Blocks of queries meet blocks of the index; each meeting keeps k rows a query at most, and a rank per query
    over those of all blocks ends it.  Tasks hold one block of the index and one of queries.
    """
    spark = vectors.sparkSession
    small_batches(spark, 8192)
    quantised = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), quantise(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null")
    all_rows, asked = stage(quantised(vectors), "bsi-rows"), quantised(queries)
    n = all_rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    parts = max(1, -(-n // block_rows))
    index = stage(build_index(all_rows.repartition(parts), block_rows), "bsi-index")
    discard(all_rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _gathered(batches, query_rows):
            row = {"q_d": v.shape[1], "q_ids": ids.tobytes(), "q_vectors": v.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("q_d", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary())]))

    asked = stage(asked, "bsi-asked")
    groups_wanted = max(1, -(-asked.count() // query_rows))
    groups = stage(asked.repartition(groups_wanted).mapInArrow(gather, QUERY_SCHEMA), "bsi-queries")
    discard(asked)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, low, bits = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "low", "bits"))
                n_bytes, n_words = (len(ids) + 7) // 8, (len(ids) + 63) // 64
                flat = np.zeros((int(bits.sum()), n_words * 8), dtype=np.uint8)
                flat[:, :n_bytes] = np.frombuffer(row["slices"], dtype=np.uint8).reshape(-1, n_bytes)
                flat, ends = flat.view(np.uint64), np.cumsum(bits)
                slices = [list(flat[e - n : e]) for n, e in zip(bits.tolist(), ends.tolist(), strict=True)]
                qids = np.frombuffer(row["q_ids"], dtype=np.int64)
                q = np.frombuffer(row["q_vectors"], dtype=np.int64).reshape(len(qids), -1)
                found = list(search_block(ids, low, slices, n_words, qids, q, k))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    # A task is one partition of blocks beside one of query groups; neither side is broadcast.
    groups = groups.repartition(groups_wanted)
    pairs = index.repartition(parts).hint("shuffle_replicate_nl").join(groups, F.col("d") == F.col("q_d"))
    hits = pairs.mapInArrow(meet, RESULT_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
