import random
from binascii import crc32

import pytest

from factloom.llm import quality, toxicity

DOCS = "doc_id long, text string, score string, predicted string"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [r.choice(vocab) for _ in range(r.randint(10, 120))]
        good, toxic = i % 5 != 0, i % 7 == 0
        if not good:
            words = [w + r.choice(["###", "|", "$$"]) for w in words]
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zonkhead", "z0nkhead", "zоnkhead", "Blargen"]))
        docs.append((i, " ".join(words), "x", "x"))
        labels.append((i, int(good), int(toxic)))
    docs += [(9000, None, "x", "x"), (9001, "", "x", "x"), (None, "text without id", "x", "x"), (3, docs[3][1], "x", "x"), (9002, "word " * 50_000, "x", "x")]
    labels += [(9000, None, None), (None, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {i: x for i, *x in labels}


@pytest.mark.parametrize("name, fn, mod, rest, at", [("quality", quality.quality_scores, 3, 1, 0), ("toxic", toxicity.toxicity_scores, 5, 0, 1)])
def test_held_out_accuracy_and_edges(spark, name, fn, mod, rest, at):
    docs, labels, truth = tables(spark)
    rows = fn(docs, labels).collect()
    assert len(rows) == docs.count()
    for x in rows:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (x.doc_id is not None and crc32(str(x.doc_id).encode()) % mod == rest)
    own = [x for x in rows if x.held_out and x.doc_id is not None and x.doc_id < 600]
    right = sum(x.predicted == truth[x.doc_id][at] for x in own)
    assert len(own) > 50 and right >= 0.95 * len(own)
    again = fn(docs, labels).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_no_labels_and_no_rows(spark):
    docs, labels, _ = tables(spark)
    for fn in (quality.quality_scores, toxicity.toxicity_scores):
        assert {round(x.score, 3) for x in fn(docs, labels.limit(0)).collect()} == {0.5}
        assert fn(docs.limit(0), labels).count() == 0


def test_folding():
    assert toxicity.fold("An 1DI0T, idіot!") == " an idiot idiot "
    assert toxicity.fold("") == "  "
    assert toxicity.fold("Réeux 2024") == " reeux "
    assert toxicity.fold("1d10t 5h1t h4t3 gr055 a55 a$$ @ss!! 455") == " idiot shit hate gross ass ass ass "
    assert toxicity.fold("(1D10T), no! |3 100% 7 x26 слово0") == f" idiot no x {toxicity.fold('слово').strip()} "
    long = "1" * 200_000 + "x" * 200_000 + "0"
    assert toxicity.fold(long) == f" {'i' * 200_000 + 'x' * 200_000}o "


def test_exceptions_take_the_weight_back():
    a = toxicity.automaton({" clown": 3.0}, {" clown fish ": 3.0})
    assert toxicity.evidence(a, toxicity.fold("a clown fish"))[0] == 0
    assert toxicity.evidence(a, toxicity.fold("a clown"))[0] > 0
