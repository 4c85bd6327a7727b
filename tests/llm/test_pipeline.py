"""The pipeline's stages against plain versions, each on the stage's own input."""

import random
from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_line_dedup import brute as lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path):
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefgilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, prose(30)) for i in range(8)]
    line = prose(12)
    docs = []
    for i in range(300):
        t = prose(r.randint(20, 120))
        if i % 6 == 0:
            t = " ".join(w + "###" for w in t.split())
        if i % 10 == 1:
            t += "\n" + line + "\n" + prose(8)
        if i % 25 == 3:
            t = prose(20) + " " + items[i % 8][1] + " " + prose(20)
        docs.append((i, t))
    docs += [(400 + k, docs[k * 7 + 2][1] + " tail") for k in range(20)] + [(500, None), (501, ""), (8, docs[8][1])]
    rows = [(i, t, "en", None if i % 40 == 0 else f"s{i % 4}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_stages(spark, tmp_path):
    items = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    made, names = [docs], docs.columns
    for k, (name, fn) in enumerate(cp.STAGES):
        out = fn(spark, made[-1], str(tmp_path))
        assert k == len(cp.STAGES) - 1 or out.columns == names
        out.write.parquet(f"{tmp_path}/out{k}")
        made.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    rows = [x.collect() for x in made]
    pairs = [[(x.doc_id, x.text) for x in r] for r in rows[:-1]]
    # Quality: the junk goes, nothing else, and what stays is unchanged.
    assert set(pairs[1]) == {(i, t) for i, t in pairs[0] if "###" not in (t or "")}
    # Lines: as the brute-force version cuts them.
    want = {(i, h) for i, _, _, h in lines(pairs[1], 40, 5)}
    import hashlib

    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs[2]} == want
    assert all(x.n_chars == len(x.text) for x in rows[2])
    # Near duplicates: one of each component, the least id.
    keep = Counter(i for i, n, c in components(pairs[2], 5, 80) if i == c)
    assert Counter(i for i, _ in pairs[3]) == keep
    # Benchmark: documents with an item go.
    assert {i for i, _ in pairs[4]} == {i for i, t in pairs[3] if not any(x in t for _, x in items)}
    # Mix: every document once, within a document of the target.
    assert Counter(x.doc_id for x in rows[5]) == Counter(x.doc_id for x in rows[4])
    for s in {x.source for x in rows[5]}:
        own = [x for x in rows[5] if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
    total = cp.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, total)) == sorted(map(str, rows[5]))


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path / "a"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/a/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{t}.parquet")
    assert cp.run(spark, str(tmp_path / "b")).count() == 0
