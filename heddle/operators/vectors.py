"""Similar vectors: exact search by blocks, and an inverted-file index for large tables.

Vectors are scaled to length 1 once.  They travel as blocks (a key, ids, and one matrix as bytes), queries likewise, and where
two blocks meet, one matrix product gives all their cosines; each meeting keeps k rows a query, and a rank over those ends
it.  In the exact search every block of queries meets every block of vectors (or those under the same key: a project); in
the index the key is the cell of the nearest centre, and queries meet the cells nearest to them.  Large cells are many blocks.

Vectors that are null, empty, or hold null, NaN or infinity take no part, neither do queries; one that is all zeros has the
cosine 0 with everything.  Vectors meet those of their own length alone.  A row is no match of a query with its own id.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.staging import stage

BLOCK = "key string, d int, ids binary, rows binary"
KINDS = pa.schema([("key", pa.string()), ("d", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())])
HITS = "query_id bigint, id bigint, score double"


def _usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def prepared(vectors: DataFrame, id_col: str, vector: str, key: Column | None = None) -> DataFrame:
    """key, id, v of the rows that take part."""
    key = F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit(""))
    return vectors.select(key.alias("key"), F.col(id_col).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v")))


def units(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1; zeros stay."""
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Places, length and matrix of the batch's vectors, by length."""
    v = batch.column("v")
    offsets = v.offsets.to_numpy()
    flat, size = v.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, d, flat[offsets[:-1][at][:, None] + np.arange(d)]


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most so many rows of one key and length, from rows(key, id, v) that are sorted by key within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(where: tuple[str, int]) -> list[dict]:
            ids, parts = (np.concatenate(x) for x in zip(*held.pop(where), strict=True))
            whole = units(parts)
            return [{"key": where[0], "d": where[1], "ids": ids[a : a + most].tobytes(), "rows": whole[a : a + most].tobytes()} for a in range(0, len(ids), most)]

        for batch in batches:
            keys, ids = np.array(batch.column("key").to_pylist(), dtype=object), batch.column("id").to_numpy()
            for at, d, matrix in _matrices(batch):
                for key in dict.fromkeys(keys[at].tolist()):
                    own = keys[at] == key
                    held.setdefault((key, d), []).append((ids[at[own]], matrix[own]))
            last = keys[-1] if len(keys) else None
            full = [w for w, x in held.items() if w[0] != last or sum(len(i) for i, _ in x) >= most]
            out = [b for w in full for b in block(w)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=KINDS)
        for where in list(held):
            yield pa.RecordBatch.from_pylist(block(where), schema=KINDS)

    return rows.mapInArrow(run, BLOCK)


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best of each meeting of a block of vectors (ids, rows) and one of queries (q_ids, q_rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["q_ids"], dtype=np.int64)
                rows, q_rows = np.frombuffer(r["rows"]).reshape(len(ids), -1), np.frombuffer(r["q_rows"]).reshape(len(q_ids), -1)
                scores = np.round(q_rows @ rows.T, 6) + 0.0
                scores[q_ids[:, None] == ids[None, :]] = -np.inf
                order = np.argsort(ids, kind="stable")  # of equal scores the smaller ids come first
                best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                at = np.repeat(np.arange(len(q_ids)), best.shape[1])
                found = scores[at, best.ravel()]
                own = found > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at][own]), pa.array(ids[best.ravel()][own]), pa.array(found[own])], names=["query_id", "id", "score"])

    return pairs.mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("q_key"), F.col("d").alias("q_d"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", key: str | None = None, block_rows: int = 4096, query_rows: int = 256) -> DataFrame:
    """query_id, rank, id, score (cosine to six places): the k most similar rows of each query, by score, then id.

    With key, a column of both tables, queries meet the rows that share it; without, a stated set of queries meets all rows.
    """
    own = F.col(key) if key else None
    rows, asked = prepared(vectors, id_col, vector, own), prepared(queries, id_col, vector, own)
    if key:
        rows, asked = (x.repartition("key").sortWithinPartitions("key", "id") for x in (rows, asked))
    index, groups = stage(blocks(rows, block_rows), "blocks"), _as_queries(stage(blocks(asked, query_rows), "query-blocks"))
    if key:
        pairs = index.join(groups, (F.col("key") == F.col("q_key")) & (F.col("d") == F.col("q_d")))
    else:
        pairs = index.hint("shuffle_replicate_nl").join(groups, F.col("d") == F.col("q_d"))
    return _ranked(_meet(pairs.select("ids", "rows", "q_ids", "q_rows"), k), k, id_col)


def fit_centres(vectors: DataFrame, cells: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of at most so many cells, by rounds of means over a sample of at most so many rows: those whose ids have the
    smallest hashes, of the length that most of them have."""
    some = prepared(vectors, id_col, vector).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    if not len(some):
        return np.zeros((0, 0))
    lengths, n = np.unique([len(x) for x in some], return_counts=True)
    rows = units(np.array([x for x in some if len(x) == lengths[n.argmax()]], dtype=np.float64))
    centres = np.unique(rows[: 4 * cells], axis=0)[np.random.default_rng(0).permutation(len(np.unique(rows[: 4 * cells], axis=0)))[:cells]]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        some = np.bincount(near, minlength=len(centres)) > 0  # a cell that lost its rows stays where it is
        centres[some] = units(sums[some])
    return centres


def _celled(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """rows(id, v) under each of the cells of its nearest centres; those of another length than the centres under the key 'other'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, d, matrix in _matrices(batch):
                if d != centres.shape[1]:
                    keys, at = ["other"] * len(at), at
                else:
                    near = np.argsort(-(units(matrix) @ centres.T), axis=1, kind="stable")[:, :probes]
                    keys, at = [str(c) for c in near.ravel().tolist()], np.repeat(at, near.shape[1])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("id").take(take), batch.column("v").take(take)], names=["key", "id", "v"])

    return rows.mapInArrow(run, "key string, id bigint, v array<double>").repartition("key", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("key", "id")


class CellIndex:
    """An inverted file over all rows of a table: blocks of vectors under the cell of their nearest centre.

    Only the centres come from a sample; every row is in the index.  It is staged and can be searched many times.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, block_rows: int = 4096):
        rows = prepared(vectors, id_col, vector)
        if cells is None:
            cells = max(1, min(4096, int(2 * vectors.count() ** 0.5)))
        self.id_col, self.vector = id_col, vector
        self.centres = fit_centres(vectors, cells, id_col, vector, sample)
        self.blocks = stage(blocks(_celled(rows, self.centres, 1), block_rows), "cells")

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, query_rows: int = 256) -> DataFrame:
        """query_id, rank, id, score over the cells nearest to each query: an eighth of them, and eight at least, unless told."""
        probes = probes or max(8, len(self.centres) // 8)
        asked = _celled(prepared(queries, self.id_col, self.vector), self.centres, probes)
        groups = _as_queries(stage(blocks(asked, query_rows), "query-blocks"))
        pairs = self.blocks.join(groups, (F.col("key") == F.col("q_key")) & (F.col("d") == F.col("q_d")))
        return _ranked(_meet(pairs.select("ids", "rows", "q_ids", "q_rows"), k), k, self.id_col)
