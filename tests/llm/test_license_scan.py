import random
import re

import duckdb
import pandas as pd

from factloom.llm import license_scan as ls

DOCS = "doc_id long, text string, label string, at long"


def places(words):
    out = []
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return out


def test_base_places_as_brute_force(spark):
    r = random.Random(8)
    vocab = ["gnu", "GENERAL", "public", "license", "apache", "cc", "by", "mit", "é", "2.0", "the", "x_y"]
    rows = [(i, r.choice([" ", "-", ",\n"]).join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "CC-BY"), (403, "cc by " * 5000), (5, rows[5][1]), (None, "MIT License"), (404, "GNU General Public LicensK")]
    got = sorted((tuple(x)[:6] for x in ls.license_scan(spark.createDataFrame([(*x, "l", 1) for x in rows], DOCS)).collect()), key=str)
    want = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        p = places(w)
        want.append((i, len(w), len(p), min((a for a, _ in p), default=None), max((a for a, _ in p), default=None), ",".join(sorted({x for _, x in p}))))
    assert got == sorted(want, key=str)


def test_own_labels_of_altered_sentences(spark):
    texts = {
        1: "Redistribution and use, in source or binary forms with or without any modification are permitted.",
        2: "Licensed under the terms of the Apache License, Version 2.0",
        3: "GNU Lesser General Public License",
        4: "nothing of the kind in source",
    }
    got = {x.doc_id: x for x in ls.license_scan(spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], DOCS)).collect()}
    assert got[1].labels == "bsd" and got[1].base_labels == "" and 0.7 <= got[1].score < 1
    assert got[2].labels == "apache" == got[2].base_labels and got[2].score == 1
    assert got[3].labels == "lgpl" and got[4].labels == "" and got[4].score == 0


def test_no_python_in_the_plan(spark):
    plan = ls.license_scan(spark.createDataFrame([], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert ls.license_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_verified_spans_as_in_sql(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        words = r.choice(list(ls.SENTENCES)).split() + r.choice(list(ls.SENTENCES)).split()
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([[], ["x"], [words[k], words[k]], [words[k - 1], words[k]]])
        rows.append((i, " ".join(words)))
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans")
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({ls.SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert any(0 < x[-1] < 1 for x in want) and sum(x[-2] != "" for x in want) > 300


def test_words_out_of_order_are_no_license(spark):
    sentence = "this is free and unencumbered software released into the public domain".split()
    # All word pairs stand in the text, each on a diagonal next to the one before, backwards.
    text = " x ".join(" ".join(sentence[i : i + 2]) for i in reversed(range(len(sentence) - 1)))
    assert ls.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == ""
