import random

import numpy as np
import pytest
from heddle.llm import bitsliced


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int, rank int")


def brute(rows, k):
    ok = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            if best:
                out[i] = [(j, -s) for s, j in best]
    return out


def search(spark, rows, **more):
    t = table(spark, rows)
    found = {}
    for r in sorted(bitsliced.top_k(t, t.filter("vec_id % 100 = 0"), **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], 1, 2) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1, 2) for i in range(40)]  # ties
    rows += [(800, None, 1, 2), (801, [], 1, 2), (802, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (803, [float("nan")] * 6, 1, 2), (804, [float("inf")] * 6, 1, 2), (805, [1.0], 1, 2), (None, [0.5] * 6, 1, 2)]
    assert search(spark, rows, block_rows=97, query_rows=3) == brute(rows, 10)
    assert search(spark, rows) == brute(rows, 10)


def test_few_candidates_and_none(spark):
    rows = [(0, [0.5, -0.25], 1, 2), (1, [0.25, 0.25], 1, 2)]
    assert search(spark, rows) == {0: [(1, 512 * 256 - 256 * 256)]}
    assert search(spark, rows[:1]) == {}
    assert search(spark, []) == {}


def test_zero_vectors(spark):
    rows = [(i, [0.0] * 4, 1, 2) for i in range(30)]
    assert search(spark, rows, block_rows=7)[0] == [(i, 0) for i in range(1, 11)]


def test_vectors_of_several_lengths(spark):
    """A query's candidates are the vectors of its own length, however rare that is; empty ones score 0 with each other."""
    rows = [(i, [0.5, i / 9], 1, 2) for i in range(3)] + [(100, [1.0], 1, 2), (101, [0.5], 1, 2), (200, [], 1, 2), (7, [], 1, 2), (300, [1.0] * 5, 1, 2)]
    found = search(spark, rows)
    assert found == brute(rows, 10)
    assert found[100] == [(101, 1024 * 512)] and found[200] == [(7, 0)] and 300 not in found


@pytest.mark.parametrize("large", [1e15, 1e17, 1e30])
def test_scores_beyond_64_bits_are_named(spark, large):
    rows = [(0, [0.5, 0.25]), (1, [large, 1.0]), (2, [0.25, 0.5])]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="ScoreOverflow"):
        bitsliced.top_k(t, t.filter("vec_id % 100 = 0")).collect()


def test_large_scores_that_fit(spark):
    rows = [(0, [2.0**20, -1.0]), (1, [2.0**20, 1.0]), (2, [-(2.0**20), 3.0]), (3, [2.0**21, 2.0**21])]
    t = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = [(r.vec_id, r.score) for r in bitsliced.top_k(t, t.filter("vec_id = 0")).orderBy("rank").collect()]
    dot = lambda a, b: sum(int(1024 * x) * int(1024 * y) for x, y in zip(a, b, strict=True))
    assert found == sorted(((i, dot(rows[0][1], v)) for i, v in rows[1:]), key=lambda x: (-x[1], x[0]))
