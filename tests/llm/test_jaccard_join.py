import random

import numpy as np

from factloom.llm import jaccard_join as jj

DOCS = "doc_id long, text string, key string, n long"


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    rows, passage = [], prose(40)
    for i in range(60):
        rows.append((i, prose(r.randint(1, 80))))
    for g in range(12):  # near copies at all distances
        base = prose(r.randint(20, 200))
        for i in range(8):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((100 + 10 * g + i, own))
    for i in range(40):
        rows.append((300 + i, prose(r.randint(0, 30)) + passage + prose(r.randint(0, 30))))
    base = prose(120)
    for i in range(70):  # a large group of near copies
        own = list(base)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(120)] = r.choice(vocab)
        rows.append((400 + i, own))
    rows += [(500 + i, prose(3)) for i in range(3)] + [(600 + i, ["Same", "words"]) for i in range(9)]
    rows = [(i, " ".join(w)) for i, w in rows]
    return rows + [(700, None), (701, ""), (702, " \t\n"), (5, rows[5][1]), (None, rows[6][1]), (None, "alone here")]


def test_same_as_brute_force(spark, monkeypatch):
    for seed, frequent, hot, block in ((1, 48, 512, 256), (2, 6, 2, 4), (3, 3, 3, 8)):
        monkeypatch.setattr(jj, "BLOCK", block)
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
        got = jj.jaccard_components(docs, frequent=frequent, hot=hot).drop("th", "root").collect()
        assert len(got) == len(rows)
        assert {tuple(x) for x in got} == brute(rows, 4, 85)


def test_block_links_agree_with_sets():
    g = np.random.default_rng(2)
    sets = [np.unique(g.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)]
    x = jj._unpack(list(range(30)), [s.tobytes() for s in sets])
    found = jj.block_links(x, x, 60)
    linked = {(i, j) for i in range(30) for j in range(30) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert set(found) <= linked and len(jj._forest(*map(np.array, zip(*linked)))) == len(found)


def test_empty_table(spark):
    assert jj.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_on_which_hashes_modulo_a_power_of_two_collide(spark):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_hot_token_is_split(spark):
    """A token of many documents that the table missed: every pair once, in bounded tasks."""
    rows = [(7, k, 100 + k % 40, 1, k % 50 == 0, [7, 1000 + k // 3]) for k in range(1500)]
    sets = spark.createDataFrame(rows, "tok long, key long, n int, asks int, full boolean, toks array<long>")
    want = jj._pairs(sets, 16, 85, hot=1 << 20).collect()
    got = jj._pairs(sets, 16, 85, hot=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 500_000
    # 15 buckets make 120 pairs, dealt to 16 tasks: none has a large share.
    most = max(got.filter("a is not null").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
    assert most < len(want) // 4


def test_prefix_length_follows_the_frequencies():
    tokens = np.arange(100, dtype=np.uint64)
    table = lambda counts: (tokens[: len(counts)], np.array(counts))
    ask = lambda counts: jj.prefix_of(tokens, table(counts), 85)[1]
    assert ask([]) > 1  # rare tokens: a longer prefix costs little
    assert ask([40] * 84) == 1  # the sixteenth token on is costly: none more is sent
    assert ask([20] * 100) > 1  # all alike: more matches save verification
    assert jj.prefix_of(tokens, table([60] * 90), 85)[2]


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, "z" * 3_000_000), (4, " ".join(["the"] * 200_000))]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 199_997, 1), (2, 199_998, 1), (3, 1, 3), (4, 1, 4)]
