import hashlib
import random
from collections import Counter

import numpy as np

from factloom.llm import textkit as tk
from factloom.llm.suffix_dedup import SuffixArray, SuffixIndex, SuffixLevels, remove_repeats

DOCS = "doc_id long, text string, lang string"


def brute(rows, m):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[k : k + m] for _, t in texts for k in range(len(t) - m + 1))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - m + 1):
            if seen[t[k : k + m]] > 1:
                gone[k : k + m] = b"\1" * m
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(30)
    rows = [(i, prose(r.randint(1, 90)), "x") for i in range(20)]
    rows += [(20 + i, prose(10) + shared + prose(10), "x") for i in range(12)]
    base = prose(80)
    for i in range(15):
        k = r.randrange(len(base))
        rows.append((40 + i, base[:k] + word() + base[k + r.randint(0, 5) :], "x"))
    rows += [(60, base, "x"), (61, base, "x"), (60, base, "x"), (62, None, "x"), (63, "", None), (None, prose(50), "x")]
    rows += [(70, "a" * 300, "x"), (71, "ab" * 90, "x"), (72, shared + shared, "x"), (60, "other " + shared, "x")]
    return rows


def test_same_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for hot in (64, 2):
        got = remove_repeats(docs, min_len=60, gram=12, hot=hot).drop("kept", "spans").collect()
        key = lambda x: tuple((v is None, v) for v in x)
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 60), key=key)


def test_long_text_in_pieces(spark, monkeypatch):
    from factloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    rows = corpus()
    texts = [(t or "").encode() for _, t, _ in rows]
    windows = sum(max(0, len(t) - 59) for t in texts)
    assert sum(int(x[2].sum()) for x in suffix_dedup._runs(texts, 60, 12)) == windows


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_arrays_by_letters():
    r = random.Random(3)
    passage = "".join(r.choice("ab") for _ in range(70))
    bodies = [(passage[r.randint(0, 30) :] + "".join(r.choice("ab") for _ in range(r.randint(5, 60)))).encode() for _ in range(90)]
    for length in (8, 20, 25, 60):
        levels, texts, seen = SuffixLevels(length), b"", Counter()
        for lo in range(0, 90, 7):
            levels.add(bodies[lo : lo + 7])
        at = 0
        for b in bodies:
            seen.update(b[i : i + length] for i in range(len(b) - length + 1))
        want = []
        for b in bodies:
            want += [at + i for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1]
            at += len(b)
            texts += b
        assert levels.repeated().tolist() == want
        for level in levels.levels:
            own = [level.data[i : i + length].tobytes() for i in level.start]
            assert own == sorted(set(own))
        assert sum(map(len, levels.levels)) == len(seen) and len(levels.levels) <= 1 + len(seen).bit_length()
    assert len(SuffixArray.build([b"short"], 0, 8)[0]) == 0


def test_later_batches_meet_the_stored_levels(spark, monkeypatch):
    from factloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "BATCH", 900)
    rows = corpus()
    random.Random(1).shuffle(rows)
    index = SuffixIndex(spark, buckets=3, min_len=60, gram=12)
    key = lambda x: tuple((v is None, v) for v in x)
    for lo, hi in ((0, 25), (25, 26), (26, len(rows))):
        index.add(spark.createDataFrame(rows[lo:hi], DOCS))
        got = index.kept().drop("kept", "spans").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows[:hi], 60), key=key)
    assert index._before("dead", "id string").count() > 0
    again = SuffixIndex(spark, index.folder, buckets=3, min_len=60, gram=12)
    assert again.generations == 3


def test_a_passage_in_very_many_documents(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij ") for _ in range(r.randint(3, 9)))
    passage = " ".join(word() for _ in range(60))[:390]
    rows = [(i, " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20)), "x") for i in range(400)]
    rows += [(1000 + i, "same start " + passage + " same end", "x") for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = remove_repeats(docs, hot=5).drop("kept", "spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 400))


def test_planted_passages_of_over_50_words(spark):
    r = random.Random(13)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))
    passages = [prose(n) for n in range(51, 81)]
    passages += [prose(80)[:399], prose(80)[:400], prose(80)[:398] + "é"]
    rows, want = [], {}
    for i, p in enumerate(passages):
        for k, edge in enumerate("<>"):
            rows.append((2 * i + k, prose(r.randint(1, 90)) + edge + p + edge + prose(r.randint(1, 90)), "x"))
            want[2 * i + k] = len(p.encode()) if len(p.encode()) >= 400 else 0
    rows += [(1000 + i, prose(r.randint(50, 300)), "x") for i in range(40)]
    assert 0 < sum(n > 0 for n in want.values()) < len(want)
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).drop("kept", "spans").collect()
    assert {x["doc_id"]: x["n_removed"] for x in got} == {i: want.get(i, 0) for i, *_ in rows}
    assert sorted(map(tuple, got)) == sorted(brute(rows, 400))


def test_very_long_texts(spark, monkeypatch):
    from factloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(40_000))
    rows = [(1, long, "x"), (2, "new " + long[9_000:31_000] + " end", "x"), (3, "z" * 5000, None), (4, long[100:900], "x")]
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).drop("kept", "spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 400))


def test_no_structural_collisions():
    a = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8)
    x, y = (tk.spans(tk.prefix(v), np.array([0]), np.array([4096])) for v in (a + 97, 98 - a))
    assert x != y
