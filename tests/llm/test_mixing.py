import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import mixing

DOCS = "doc_id long, text string, source string, size string, target int"


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        share = total - sum(3 * sizes[s] for s in full)
        out = {s: 3.0 * sizes[s] if s in full else share * w[s] / sum(w[x] for x in rest) for s in names}
        more = {s for s in rest if out[s] > 3 * sizes[s]}
        if not more:
            return out
        full |= more


def test_targets_and_totals(spark):
    r = random.Random(6)
    rows = []
    for i in range(900):
        s = r.choice(["hot"] * 6 + ["a", "b", "ü", "tiny", None])
        n = r.randint(0, 3) if s == "tiny" else r.randint(0, 60)
        rows.append((i, " ".join("w" * r.randint(1, 4) for _ in range(n)), s))
    rows += [(2000, None, "hot"), (2001, " \t\n", "a"), (2002, "", "nothing"), (None, "no id\x0bhere", "b"), (7, rows[7][1], rows[7][2]), (2003, "x " * 20_000, "a")]
    docs = spark.createDataFrame([(*x, "s", 0) for x in rows], DOCS)
    got = mixing.mix_sources(docs, chunk=32, fan=3).collect()
    assert len(got) == len(rows)
    sizes, biggest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", t or ""))
        sizes[s] += n
        biggest[s] = max(biggest[s], n)
    goal = targets(sizes)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(goal[x.source])
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 3
        taken[x.source] += x.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= biggest[s] + 1e-6
    again = mixing.mix_sources(docs.repartition(7), chunk=32, fan=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_pivot_keeps_mass_and_expectation():
    g = np.random.default_rng(3)
    share, weight = g.random(40), g.integers(1, 50, 40).astype(float)
    total, runs = np.zeros(40), 3000
    for _ in range(runs):
        out = mixing.pivot(share, weight, g.random(41))
        assert ((out == 0) | (out == 1)).sum() >= 39
        assert out @ weight == pytest.approx(share @ weight)
        total += out
    assert np.abs(total / runs - share).max() < 0.05


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
