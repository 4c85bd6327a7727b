import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import ball_tree as bt

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def test_same_as_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 0, "x") for i in range(300)]
    rows += [(300 + i, [0.5] * 8, 0, "x") for i in range(40)]  # ties
    rows += [(5, rows[5][1], 0, "x"), (400, None, 0, "x"), (401, [None] * 8, 0, "x"), (402, [float("nan")] * 8, 0, "x"), (403, [], 0, "x"), (None, [1.0] * 8, 0, "x")]
    rows += [(500 + 5 * i, [r.gauss(0, 1) for _ in range(3)], 0, "x") for i in range(4)]  # another length, fewer than k
    got = bt.top_k(bt.integer_vectors(spark.createDataFrame(rows, SCHEMA), 64), F.col("vec_id") % 5 == 0, k=7, shard_rows=64).collect()
    vs = {}
    for i, e, *_ in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            vs[i] = [int(np.floor(64 * float(np.float32(x)))) for x in e]
    want = set()
    for q in vs:
        if q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(vs[q], vs[c])), c) for c in vs if c != q and len(vs[c]) == len(vs[q]))
            want |= {(q, k + 1, c, -x) for k, (x, c) in enumerate(s[:7])}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_large_products_stay_exact():
    q = np.array([[2**30, 3]], dtype=np.int64)
    assert bt.scores(q, q).tolist() == [[2**60 + 9]]


def test_huge_components(spark):
    """Products beyond a long: exact order as far as a long goes, then ties by id."""
    rows = [(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0]), (4, [3e9, 5.0]), (5, [2.0, 1e8]), (6, [1.7e308, 1.0]), (7, [0.5, -0.01])]
    got = bt.top_k(bt.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64), F.lit(True), k=4, shard_rows=3).collect()
    vs = {i: [int(np.floor(64 * x)) if abs(64 * x) < 2**53 else int(64 * x) for x in v] for i, v in rows if i != 6}
    want = set()
    for q in vs:
        s = sorted((-min(max(sum(a * b for a, b in zip(vs[q], vs[c])), -(2**63) + 1), 2**63 - 1), c) for c in vs if c != q)
        want |= {(q, k + 1, c, -x) for k, (x, c) in enumerate(s[:4])}
    assert {tuple(x) for x in got} == want


def test_empty_table(spark):
    assert bt.top_k(bt.integer_vectors(spark.createDataFrame([], SCHEMA), 64), F.col("vec_id") % 5 == 0).count() == 0
