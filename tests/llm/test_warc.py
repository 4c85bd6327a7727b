import base64
import gzip
import hashlib
import random
from collections import defaultdict

from factloom.llm import warc

PAGES = "page_id long, url string, html string, payload string, sha int"


def want(rows):
    same = defaultdict(list)
    for i, _, h in rows:
        same[h or ""].append(i)
    for i, _, h in rows:
        data = (h or "").encode()
        ids = [x for x in same[h or ""] if x is not None]
        first = min(ids) if ids else None
        again = len(same[h or ""]) > 1 and first is not None and i != first
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None


def corpus():
    r = random.Random(2)
    rows = [(i, f"http://x/{i}", "".join(r.choice("ab<>é\n\r ") for _ in range(r.randint(0, 3000)))) for i in range(120)]
    rows += [(200 + i, "http://same", "<p>same</p>") for i in range(40)]
    rows += [(300, None, None), (301, "http://a b\nc", ""), (None, "http://n", "<p>same</p>"), (None, "u", "only here"), (7, "http://x/7", rows[7][2])]
    rows += [(400, "http://magic", "\x1f\x8b\x08 WARC/1.1 \x1f" * 500), (401, "http://long", "z" * 700_000 + "".join(r.choice("abcdefgh") for _ in range(300_000)))]
    return rows


def test_round_trip_over_splits(spark):
    rows = corpus()
    pages = spark.createDataFrame([(*x, "p", 1) for x in rows], PAGES).repartition(3)
    for split, size in ((997, 20_000), (4 << 20, 64 << 20)):
        out = warc.round_trip(pages, split=split, file_bytes=size)
        got = out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want(rows), key=str)
    texts = {x.page_id: bytes(x.payload).decode() for x in out.collect() if x.payload is not None and x.page_id is not None}
    assert all(texts[i] == h for i, _, h in rows if i is not None and i < 120)
    assert {x.url for x in out.filter("page_id = 301").collect()} == {"http://a%20b%0Ac"}


def test_magic_inside_a_member_is_no_start(tmp_path):
    inner = gzip.compress(b"not a record")
    first = warc.record([(b"WARC-Type", b"response")], inner + b"\x1f\x8b\x08junk")
    stored = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    second = stored.compress(raw) + stored.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(first + second)
    with open(path, "rb") as f:
        w = warc._Window(f, len(first + second))
        assert warc.first_member(w, 0, 10**9) == 0
        assert warc.first_member(w, 1, 10**9) == len(first)
        assert warc.first_member(w, len(first) + 1, 10**9) is None


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_record_ids_are_unique_and_ranges_get_tasks_of_their_own(spark, tmp_path):
    rows = [(5, "u", "one"), (5, "u", "two"), (5, "u", "one"), (6, "u", "one"), (None, "u", "one"), (None, "u", "x")]
    rows += [(100 + i, "u", random.Random(i).randbytes(800).hex()) for i in range(60)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a", file_bytes=20_000)
    size = manifest.agg({"bytes": "sum"}).first()[0]
    assert warc.read_archives(manifest, split=5000).rdd.getNumPartitions() == -(-size // 5000)
    ids = []
    for path in tmp_path.glob("a/*.gz"):
        ids += [x.split(b"\r\n")[0] for x in gzip.decompress(path.read_bytes()).split(b"WARC-Record-ID: ")[1:]]
    assert len(ids) == len(set(ids)) == len(rows) + manifest.count()
