"""op4: line dedup by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, A-Z lowered. Keys of at
least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their
lines except those in the largest doc_id holding the key.

1. Each document gives its distinct long keys as 128-bit hashes; the distinct ids of each key
   are counted, with the largest (first combined by key and id, which spreads a line that a
   third of the documents hold over all tasks, then by key).
2. Keys that reach ``min_docs`` are dealt to shards of bounded size. Each shard becomes a
   minimal perfect hash over the first 64 bits, which indexes compact arrays: the second 64
   bits as fingerprint, the count of documents, and the document that keeps the line.
3. Documents probe the arrays instead of joining lines. While all shards together stay
   under ``BROADCAST_BYTES`` (their measured size) they are broadcast and the documents are
   read once, without a shuffle. Beyond it each document's key hashes travel packed to the
   shards, in slices of bounded size, and the numbers of the lines to drop travel back.

Rows: null and empty texts are one empty line; a document is an id: rows of one id count once
for a line, each loses its own lines, and all rows of the keeping id keep the line. Rows
without id lose lines like others, but count for none and never keep one. An empty table gives
no rows; other columns of ``docs`` are not read by ``line_dedup``.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import textkit as tk
from factloom.llm.common import keyed, parts_for, same_row, stage, table
from factloom.llm.textkit import U

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 1 << 17
BROADCAST_BYTES = 48 << 20
#: Bytes of key hashes that one task probes against a shard.
SLICE_BYTES = 16 << 20
BLANK = bytes([0x20, *range(0x09, 0x0E)])


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys: levels of bit arrays, in each of
    which the keys that fall alone are placed; a key's index is the rank of its bit."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[np.ndarray] = []
        left = keys
        while len(left):
            size = max(64, int(gamma * len(left)))
            spot = self._spot(left, len(self.levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[spot]]
        self.ranks = [np.cumsum(x, dtype=np.int32) for x in self.levels]
        self.base = np.concatenate([[0], np.cumsum([x[-1] for x in self.ranks])]).astype(np.int64) if self.ranks else np.zeros(1, np.int64)

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tk.mix(keys + U(tk.BASE * (level + 1) & tk.MASK)) % U(size)).astype(np.int64)

    def __getstate__(self):
        return [(np.packbits(x), len(x)) for x in self.levels], self.base

    def __setstate__(self, state):
        packed, self.base = state
        self.levels = [np.unpackbits(x, count=n).astype(bool) for x, n in packed]
        self.ranks = [np.cumsum(x, dtype=np.int32) for x in self.levels]

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of keys that are not in the set, any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            spot = self._spot(keys[left], k, len(bits))
            hit = bits[spot]
            out[left[hit]] = self.base[k] + rank[spot[hit]] - 1
            left = left[~hit]
        return out


class LineIndex:
    """Perfect hash with the arrays it indexes: fingerprint, documents, keeper."""

    def __init__(self, key: np.ndarray, mark: np.ndarray, docs: np.ndarray, keeper: np.ndarray):
        self.hash = PerfectHash(key)
        at = self.hash.index(key)
        self.mark, self.docs, self.keeper = np.empty_like(mark), np.empty_like(docs), np.empty_like(keeper)
        self.mark[at], self.docs[at], self.keeper[at] = mark, docs, keeper

    def probe(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the index, and the document that keeps its lines."""
        if not len(self.mark):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = self.hash.index(key)
        return (at >= 0) & (self.mark[at] == mark), self.keeper[at]


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines; numbers of those with a long key; their hashes as (n, 2) of uint64."""
    lines = text.split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANK).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
    return lines, np.array(at, np.int64), np.frombuffer(b"".join(digests), U).reshape(-1, 2)


def _key_rows(own: DataFrame, min_chars: int) -> DataFrame:
    def scan(batches):
        for batch in batches:
            ids, texts = batch["doc_id"], tk.text_bytes(batch["text"])
            for lo, hi in tk.blocks([len(t) for t in texts], 4 << 20):
                found = [np.unique(line_keys(t, min_chars)[2], axis=0) for t in texts[lo:hi]]
                rows = np.concatenate(found)
                take = pa.array(np.repeat(np.arange(lo, hi), [len(x) for x in found]))
                a, b = (pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([a, b, ids.take(take)], names=["key", "mark", "doc_id"])

    return own.mapInArrow(scan, "key long, mark long, doc_id long")


def line_index(own: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """shard, index (bytes): the perfect hash over all keys that reach ``min_docs``."""
    rows = _key_rows(own, min_chars)
    counts = rows.filter("doc_id is not null").groupBy("key", "mark").agg(F.countDistinct("doc_id").alias("rows"), F.max("doc_id").alias("keeper"))
    often = stage(counts.filter(F.col("rows") >= min_docs), "op4-often")
    shards = parts_for(often.count(), SHARD_KEYS)

    def build(group: pa.Table) -> pa.Table:
        key, mark, docs, keeper = (group[c].to_numpy() for c in ("key", "mark", "rows", "keeper"))
        order = np.argsort(key)
        index = LineIndex(key[order].view(U), mark[order].view(U), docs[order], keeper[order])
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(index)], pa.binary())})

    dealt = often.select("key", "mark", "rows", "keeper", F.pmod("key", F.lit(shards)).cast("int").alias("shard"))
    return stage(dealt.groupBy("shard").applyInArrow(build, "shard int, index binary"), "op4-index")


def _drops(index: LineIndex, key: np.ndarray, mark: np.ndarray, doc_id: int | None) -> np.ndarray:
    found, keeper = index.probe(key, mark)
    return found if doc_id is None else found & (keeper != doc_id)


def _marked_by_broadcast(own: DataFrame, index: DataFrame, min_chars: int) -> DataFrame:
    """own with ``drop``: numbers of the lines to drop. The index's size has been checked."""
    shards = [pickle.loads(r["index"]) for r in index.orderBy("shard").collect()]
    sent = own.sparkSession.sparkContext.broadcast(shards)
    names = [*own.columns, "drop"]

    def probe(batches):
        shards = sent.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), tk.text_bytes(batch["text"])):
                _, at, h = line_keys(text, min_chars)
                gone = np.zeros(len(at), bool)
                if len(at) and shards:
                    shard = h[:, 0].view(np.int64) % len(shards)
                    for s in np.unique(shard):
                        own = shard == s
                        gone[own] = _drops(shards[s], h[own, 0], h[own, 1], doc_id)
                out.append(at[gone].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=names)

    return own.mapInArrow(probe, T.StructType([*own.schema.fields, T.StructField("drop", T.ArrayType(T.IntegerType()))]))


def _marked_by_shuffle(own: DataFrame, index: DataFrame, min_chars: int, shards: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The same beyond the bound: packed hashes go to the shards, line numbers come back.

    A shard's probes are cut into slices of about ``slice_bytes`` by their measured size, and
    its index is sent to each slice: a task holds one slice, however many documents there are.
    """

    def pack(batches):
        for batch in batches:
            rows = {k: [] for k in ("shard", "doc_id", "th", "at", "keys")}
            for doc_id, th, text in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), tk.text_bytes(batch["text"])):
                _, at, h = line_keys(text, min_chars)
                shard = h[:, 0].view(np.int64) % shards
                for s in np.unique(shard):
                    own = shard == s
                    for k, v in zip(rows, (int(s), doc_id, th, at[own].tolist(), h[own].tobytes())):
                        rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.list_(pa.int32())), ("keys", pa.binary())]))

    def probe(key, left: pa.Table, right: pa.Table) -> pa.Table:
        index = pickle.loads(right["index"][0].as_py()) if right.num_rows else None
        out = []
        for doc_id, at, keys in zip(left["doc_id"].to_pylist(), left["at"].to_pylist(), left["keys"].to_pylist()):
            h = np.frombuffer(keys, U).reshape(-1, 2)
            out.append(np.array(at)[_drops(index, h[:, 0], h[:, 1], doc_id)].tolist() if index else [])
        return pa.table({"doc_id": left["doc_id"], "th": left["th"], "drop": pa.array(out, pa.list_(pa.int32()))})

    asked = stage(own.mapInArrow(pack, "shard int, doc_id long, th long, at array<int>, keys binary"), "op4-asked")
    sizes = asked.groupBy("shard").agg(F.sum(F.length("keys")).alias("size"))
    slices = stage(sizes.select("shard", F.ceil(F.col("size") / slice_bytes).cast("int").alias("slices")), "op4-slices")
    asked = asked.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("doc_id", "th"), "slices").cast("int"))
    spread = index.join(slices, "shard").select("shard", "index", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    back = asked.groupBy("shard", "slice").cogroup(spread.groupBy("shard", "slice")).applyInArrow(probe, "doc_id long, th long, drop array<int>")
    per_doc = back.filter(F.size("drop") > 0).dropDuplicates().groupBy("doc_id", "th").agg(F.flatten(F.collect_list("drop")).alias("drop"))
    return own.join(per_doc, same_row(own, per_doc), "left").select(*(own[c] for c in own.columns), "drop")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, th, n_lines, n_dropped, kept_sha256, kept (the
    text that is left), row (struct of the other columns)."""
    own = keyed(docs, carry=True)
    index = line_index(own.select("doc_id", "th", "text"), min_chars, min_docs)
    size, shards = index.agg(F.coalesce(F.sum(F.length("index")), F.lit(0)), F.count("*")).first()
    # All shard numbers must be there for the remainder to name them.
    shards = max(shards, (index.agg(F.max("shard")).first()[0] or 0) + 1)
    full = index.count() == shards
    marked = _marked_by_broadcast(own, index, min_chars) if size <= broadcast_bytes and (full or not size) else _marked_by_shuffle(own, index, min_chars, shards)
    made = ["n_lines", "n_dropped", "kept_sha256", "kept"]
    fields = [*T._parse_datatype_string("doc_id long, th long, n_lines long, n_dropped long, kept_sha256 string, kept string"), own.schema["row"]]

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in made}
            for text, drop in zip(tk.text_bytes(batch["text"]), batch["drop"].to_pylist()):
                n, gone = text.count(b"\n") + 1, set(drop or ())
                kept = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone) if gone else text
                for k, v in zip(out, (n, len(gone), hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(v)
            cols = [pa.array(out[k], t) for k, t in zip(made, (pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *cols[:3], cols[3].cast(pa.string()), batch["row"]], names=["doc_id", "th", *made, "row"])

    return marked.mapInArrow(cut, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("th", "kept", "row")


SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM rows
), keyed AS (
  SELECT r, doc_id, n, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT d.r, d.doc_id, d.n, d.line, (o.k IS NOT NULL AND d.doc_id IS DISTINCT FROM o.keeper) AS gone
  FROM keyed d LEFT JOIN often o ON d.k = o.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY n), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
