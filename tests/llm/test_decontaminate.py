import random

import numpy as np

from factloom.llm import decontaminate as dc

DOCS = "doc_id long, text string, item_id string, cover double"
ITEMS = "item_id long, text string, doc_id long"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 30))] for _ in range(2))
        assert dc.lcs(a, b) == slow_lcs(a, b)


def corpus():
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefghilmnorstué") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in", "is"]
    word = lambda: r.choice(common) if r.random() < 0.4 else r.choice(vocab)
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, prose(r.randint(12, 60))) for i in range(40)]
    docs, truth = [], set()
    for i in range(400):
        w = prose(r.randint(5, 400))
        if i % 4 == 0:
            k, own = r.choice(items)
            own = list(own)
            for _ in range(len(own) // 12 if i % 8 == 0 else 0):  # some words replaced
                own[r.randrange(len(own) - 4)] = r.choice(vocab)
            at = r.randint(0, len(w))
            w = w[:at] + own + w[at:]
            truth.add((i, k))
        docs.append((i, " ".join(w).capitalize() + "."))
    for i in range(20):  # the item alone
        docs.append((500 + i, " ".join(items[i][1]).upper()))
        truth.add((500 + i, i))
    return docs, [(i, " ".join(w) + ".") for i, w in items], truth


def test_finds_planted_items_and_nothing_else(spark):
    docs, items, truth = corpus()
    docs += [(900, None), (901, ""), (902, "...")]
    items += [(100, None), (101, "")]
    d = spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    for at_once in (4000, 15):
        got = dc.contaminated(d, b, at_once).collect()
        assert {(x.doc_id, x.item_id) for x in got} == truth and len(got) == len(truth)
        assert all(x.cover >= dc.PARAPHRASE for x in got)


def test_svd_spans_the_rows(spark):
    docs, items, _ = corpus()
    b = spark.createDataFrame([(i, t, 1) for i, t in items[:10]], ITEMS).repartition(3)
    texts = [t.encode() for _, t in items[:10]]
    w = dc._words(texts)
    vocab = np.unique(w.hash)
    idf = np.ones(len(vocab))
    v = dc.randomised_svd(b, vocab, idf, rank=10)
    a = dc._matrix([w.hash[w.first[i] : w.first[i + 1]] for i in range(10)], vocab, idf)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    assert np.linalg.norm(a - a @ v @ v.T) < 1e-2 * np.linalg.norm(a)


def test_empty_tables(spark):
    docs, items, _ = corpus()
    d = spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs[:5]], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    assert dc.contaminated(d.limit(0), b).count() == 0
    assert dc.contaminated(d, b.limit(0)).count() == 0


def brute(items, docs):
    """Pairs that the rules accept, by every stretch of every text."""
    words = lambda t: dc._words([t.encode()]).hash.tolist()
    held = lambda w, p: any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))
    docs, out = [(i, words(t)) for i, t in docs], set()
    for k, text in items:
        a, answer = words(text), dc._words([dc.answer_of(text.encode())]).hash.tolist()
        n, reach, masks = len(a), len(a) + len(a) // 2, dc.masks_of(a)
        for i, w in docs:
            if n < dc.SHORTEST:
                if n and held(w, a):
                    out.add((i, k))
                continue
            if dc.lcs(a, w, masks) < dc.PARAPHRASE * n:
                continue
            for s in range(len(w)):
                cover = dc.lcs(a, w[s : s + reach], masks) / n
                if cover >= dc.COVER or (cover >= dc.PARAPHRASE and len(answer) >= 3 and held(w[max(0, s - n // 2) : s + reach + n // 2], answer)):
                    out.add((i, k))
                    break
    return out


def found(spark, items, docs):
    return set(pairs_of(spark, items, docs))


def pairs_of(spark, items, docs):
    d = spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs], DOCS).repartition(3)
    return {(x.doc_id, x.item_id): (x.cosine, x.cover) for x in dc.contaminated(d, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)).collect()}


def writer(seed):
    """Prose and unseen words; common words are four in ten."""
    r = random.Random(seed)
    make = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 9)))
    vocab = [make() for _ in range(4000)]
    return r, lambda n: [r.choice(["the", "of", "and", "to", "in", "is"]) if r.random() < 0.4 else r.choice(vocab) for _ in range(n)], lambda: make() + "zq" + make()


def test_short_and_long_items(spark):
    r, prose, _ = writer(21)
    sizes = [1, 2, 3, 4, 5, 6, 7, 8, 9, 91, 200, 500, 800]
    items = [(k, " ".join(["q" + x for x in prose(n)] if n < 4 else prose(n)) + ".") for k, n in enumerate(sizes * 2)]
    docs = []
    for k, text in items:
        for _ in range(3):
            around = prose(300)
            at = r.randint(20, 280)
            docs.append((len(docs), " ".join([*around[:at], text[:-1], *around[at:]])))
    docs += [(len(docs) + j, " ".join(prose(400))) for j in range(20)]
    got = found(spark, items, docs)
    assert got == brute(items, docs) and got >= {(3 * k + j, k) for k, _ in items for j in range(3)}


def test_altered_copies(spark):
    r, prose, unseen = writer(22)
    items = [(k, " ".join(prose(r.randint(8, 120))) + (". " + " ".join(prose(4)) if k % 2 else "") + ".") for k in range(60)]
    docs = []
    for k, text in items:
        for share in (0.1, 0.15, 0.2, 0.3, 0.4):
            own = text.replace(".", "").split()
            for at in r.sample(range(len(own) - 4 if k % 2 else len(own)), int(share * len(own) * (0.9 if k % 2 else 1))):
                own[at] = unseen()
            for _ in range(r.choice([0, 0, len(own) // 4])):  # words put between
                own.insert(r.randrange(len(own) - 4), unseen())
            docs.append((len(docs), " ".join([*prose(r.randint(0, 150)), *own, *prose(r.randint(0, 150))])))
    truth = brute(items, docs)
    got = pairs_of(spark, items, docs)
    assert len(truth) > 200 and set(got) >= truth
    # Beyond the words' rules stands what is alike in latent space, and nothing that covers less.
    assert all(cover >= dc.PARAPHRASE and (cosine >= dc.ALIKE or x in truth) for x, (cosine, cover) in got.items())


def test_recall_of_paraphrases(spark):
    """Single-sentence items with words replaced, so that no answer helps."""
    r, prose, unseen = writer(27)
    items = [(k, " ".join(prose(r.randint(15, 60))) + ".") for k in range(60)]
    for share in (0.0, 0.1, 0.2, 0.3):
        docs = []
        for k, text in items:
            own = text[:-1].split()
            for at in r.sample(range(len(own)), round(share * len(own))):
                own[at] = unseen()
            docs.append((k, " ".join([*prose(r.randint(0, 150)), *own, *prose(r.randint(0, 150))])))
        docs += [(100 + i, " ".join(prose(300))) for i in range(60)]
        got = set(pairs_of(spark, items, docs))
        print(share, len(got))
        assert got <= {(k, k) for k, _ in items} and len(got) >= 54


def test_answer_is_of_the_document_alone():
    """Alone, together and in any order: the same items in each text."""
    r, prose, unseen = writer(28)
    texts = [" ".join(prose(r.randint(10, 50))).encode() + b"." for _ in range(40)]
    vocab = np.unique(dc._words(texts).hash)
    v = np.linalg.qr(np.random.default_rng(1).standard_normal((len(vocab), 48)))[0].astype(np.float32)
    ret = dc.Retriever(list(range(40)), texts, vocab, np.ones(len(vocab)), v, np.zeros(dc.HASHED, np.int64), 1000)
    docs = []
    for k in range(200):
        own = texts[k % 40][:-1].split()
        for at in r.sample(range(len(own)), len(own) * (k // 40) // 10):
            own[at] = unseen().encode()
        around = b" ".join(own[-3:]) if k % 3 else b" ".join(x.encode() for x in prose(9))
        docs.append(b" ".join([around, *own, around]))
    alone = [[x[1:] for x in ret.search([t])] for t in docs]
    assert sum(map(len, alone)) >= 160
    for order in (list(range(200)), r.sample(range(200), 200)):
        got = [[] for _ in docs]
        for x in ret.search([docs[i] for i in order]):
            got[order[x[0]]].append(x[1:])
        assert got == alone


def test_benchmark_of_thousands(spark):
    r, prose, _ = writer(23)
    items = [(k, " ".join(prose(r.randint(12, 60))) + ".") for k in range(3000)]
    docs = [(k, " ".join([*prose(60), items[k][1], *prose(60)])) for k in r.sample(range(3000), 600)]
    assert found(spark, items, docs) >= {(k, k) for k, _ in docs}


def test_small_kept_norm():
    """An item that the projection keeps nothing of is found all the same."""
    _, prose, _ = writer(24)
    texts = [" ".join(prose(30)).encode() for _ in range(50)]
    vocab = np.unique(dc._words(texts).hash)
    some = (vocab == dc._words(texts[:1]).hash[-1])[:, None].astype(np.float32)
    r = dc.Retriever(list(range(50)), texts, vocab, np.ones(len(vocab)), some, np.zeros(dc.HASHED, np.int64), 1000)
    around = " ".join(prose(50)).encode()
    got = r.search([around + b" " + t + b" " + around for t in texts])
    assert {x[:2] for x in got} >= {(i, i) for i in range(50)}


def test_repetitive_items(spark):
    r, prose, unseen = writer(25)
    one = lambda: [unseen() for _ in range(3)]
    items = []
    for k in range(60):
        if k % 3 == 0:  # refrain
            line = one()
            own = [w for _ in range(6) for w in [*line, r.choice(["the", "of"])]]
        elif k % 3 == 1:  # code sequence
            own = [str(r.choice([7001, 7002, 7003 + k])) for _ in range(30)]
        else:  # one term again and again
            term = unseen()
            own = [w for x in prose(15) for w in (term, x)]
        items.append((k, " ".join(own) + "."))
    items.append((60, "la " * 30 + "lu."))
    docs = [(k, " ".join([*prose(80), t, *prose(80)])) for k, t in items]
    docs.append((61, " ".join([*prose(80), *items[0][1].split()[:16], *"la la lu la".split()])))
    docs += [(100, "the " * 20000), (101, (items[0][1].split()[0] + " ") * 20000), (102, ("7001 7002 " * 5000))]
    truth = brute(items, docs[:62])
    got = found(spark, items, docs)
    assert truth >= {(k, k) for k, _ in items} and {x for x in got if x[0] < 100} == truth
