import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd

from factloom.llm import line_dedup as ld
from factloom.llm.textkit import U

DOCS = "doc_id long, text string, th string, drop long"


def brute(rows, chars, docs):
    key = lambda x: x.strip(ld.BLANK).lower()
    holders = defaultdict(set)
    for i, t in rows:
        for k in {key(x) for x in (t or "").encode().split(b"\n")}:
            if len(k.decode()) >= chars:
                holders[k].add(i)
    last = {k: max(v - {None}) for k, v in holders.items() if len(v - {None}) >= docs}
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()


def test_same_as_brute_force_on_both_ways(spark):
    r = random.Random(5)
    common = ["".join(r.choice("abÀßçÉ ñ") for _ in range(r.randint(8, 14))) for _ in range(30)]
    rows = []
    for i in range(150):
        lines = [r.choice(common) for _ in range(r.randint(1, 6))] + ["own line %d" % r.randrange(400)]
        lines = [" \t" * r.randrange(2) + x.upper() * 0 + (x if r.random() < 0.5 else x.replace("a", "A")) + "\r\x0b" * r.randrange(2) for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (7, rows[7][1]), (None, "\n".join(common)), (203, "\n".join(common * 50))]
    want = sorted(brute(rows, 10, 5), key=str)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(4)
    for bound in (1 << 20, 0):
        got = ld.line_dedup(docs, 10, 5, broadcast_bytes=bound).drop("th", "kept", "row").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(U)
    keys = np.unique(keys)
    assert sorted(ld.PerfectHash(keys).index(keys).tolist()) == list(range(len(keys)))


def test_empty_table(spark):
    assert ld.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_documents_are_ids_in_query_and_sql(spark):
    line, other = "a line that is long enough to be counted here", "another line that is long enough to count at all"
    rows = [(1, line), (1, line), (2, line), (3, line), (4, line + "\nx")] + [(i, other) for i in (1, 2, 3, 4, 5, 5, None)]
    pdf = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    db = duckdb.connect()
    db.register("documents", pdf)
    want = sorted(db.sql(ld.SQL).fetchall(), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (1 << 20, 0):
        got = ld.line_dedup(docs, broadcast_bytes=bound).drop("th", "kept", "row").collect()
        assert sorted(map(tuple, got), key=str) == want
    # Five rows of four ids do not reach five documents; the other line does, without the null id.
    assert sum(x[2] for x in want) == 5
