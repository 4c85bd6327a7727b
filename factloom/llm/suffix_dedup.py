"""op1: removal of long repeated substrings by a logarithmic family of suffix arrays.

A byte goes when some ``min_len``-byte string over it also starts elsewhere in the corpus
(same document or another). Matches never cross documents and are judged on the input.

A suffix array over every byte would be many times the corpus, so suffixes are routed and
thinned first, without losing a match:

1. Of the grams in each ``min_len`` window the one of least hash is its anchor. The choice
   depends on the window's bytes only, so equal windows have equal anchors. Neighbouring
   windows of one anchor form a run (about 115 windows here); a run is the unit of routing.
2. Runs are counted by content (two hashes of 61 bits: of the anchor and of the whole run).
   A run that occurs again is repeated as a whole. A run whose anchor occurs with one content
   only has no partner. Both are settled by counts alone, which combine before the shuffle:
   groups of copies of any size cost one row each.
3. What is left, one representative of each distinct run among several of the same anchor,
   goes by anchor to ``SuffixLevels``: each arriving batch gets a suffix array, is
   merge-scanned against the levels there are, and levels of equal size merge.
4. Anchors with more than ``hot`` distinct runs (a passage that many documents embed) would
   meet in one task. Their runs are cut into slices by the distance from anchor to window
   start, and a slice is routed by the bytes that all its windows have in common (385 of 400
   here). Equal windows still meet, and they meet in the same kind of suffix arrays.

The arrays are in the order of the suffixes' letters (up to ``min_len`` of them, which is all
that a match of that length needs) and are made and compared by bytes: two suffixes count
as equal only if all ``min_len`` bytes are.

``SuffixIndex`` keeps such a family in the shared folder, for corpora that arrive in batches:
a new batch is compared with all that came before, whose texts are not scanned again (only
documents with a newly contested run are read).

Rows: null text is empty; empty and short texts keep everything; repeated rows (same id and
text) get the same answer, and being copies of each other lose all long strings; an empty
table gives no rows; other columns of ``docs`` are not read. Null ids are kept.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkit as tk
from factloom.llm.common import keyed, parts_for, same_row, shared_dir, stage, table
from factloom.llm.textkit import U

MIN_LEN = 400
GRAM = 64
HOT_RUNS = 64
SLICE = 16
RUNS_PER_TASK = 8000
PIECE = 1 << 20
#: Bytes of a batch; three ranks of that many positions fit in 63 bits.
BATCH = 1 << 20
#: Suffixes of a stored array; larger ones are not merged any more.
ARRAY_MOST = 1 << 22
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RUN = "kmer long, run long, doc_id long, th long, at int, off int, n int"
MARK = "doc_id long, th long, a int, b int"


def words_at(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as numbers in the order of their letters."""
    if not len(start):
        return np.zeros(0, U)
    return np.lib.stride_tricks.sliding_window_view(data, 8)[start].view(">u8")[:, 0].astype(U)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, their ranks (equal keys alike), and where a new key begins."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.concatenate([[True], held[1:] != held[:-1]])[: len(keys)]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank, new


class SuffixArray:
    """The suffixes of some strings in order of their first ``length`` bytes, equal ones once.

    data: the strings, one after the other; start: where each suffix begins; base: position
    of ``data`` in all that its family has been given.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, base: int, length: int):
        self.data, self.start, self.base, self.length = data, start, base, length

    def __len__(self) -> int:
        return len(self.start)

    @classmethod
    def build(cls, bodies: list[bytes], base: int, length: int) -> tuple["SuffixArray", np.ndarray]:
        """The array of all suffixes of at least ``length`` bytes, and which of them repeat.

        Ranks by the first 8 bytes give ranks by the first 24 (three neighbouring ranks make
        one key), those by 72, and so on up to ``length``.
        """
        data = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies])
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        bits, width, full = max(1, len(data).bit_length()), 8, np.zeros(len(data), np.int64)
        if 3 * bits > 64 or length < width:
            raise ValueError("a batch is too large or the length under 8")
        pos = np.flatnonzero(room >= width)
        order, rank, new = _ranks(words_at(data, pos))
        while width < length:
            full[pos] = rank
            wide = min(3 * width, length)
            pos = np.flatnonzero(room >= wide)
            key = full[pos].astype(U)
            for step in (width, wide - width) if wide > 2 * width else (wide - width,):
                key = (key << U(bits)) | full[pos + step].astype(U)
            order, rank, new = _ranks(key)
            width = wide
        again = ~new | np.concatenate([~new[1:], [False]])[: len(new)]
        return cls(data, pos[order[new]], base, length), pos[order[again]] + base

    def place(self, other: "SuffixArray") -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix of ``other`` stands among those here, and whether it is one."""
        if not len(self) or not len(other):
            return np.zeros(len(other), np.int64), np.zeros(len(other), bool)
        mine = words_at(self.data, self.start)
        words = words_at(other.data, other.start)
        lo, hi = (np.searchsorted(mine, words, side) for side in ("left", "right"))
        for depth in sorted({*range(8, self.length - 7, 8), self.length - 8} - {0}):
            some = np.flatnonzero(lo < hi)
            if not len(some):
                break
            words = words_at(other.data, other.start[some] + depth)
            lo[some], hi[some] = (self._bisect(depth, words, lo[some], hi[some], side) for side in (False, True))
        return lo, lo < hi

    def _bisect(self, depth: int, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """First place in each [lo, hi) whose word at ``depth`` is not less (``right``: is more)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            some = np.flatnonzero(lo < hi)
            if not len(some):
                return lo
            mid = (lo[some] + hi[some]) // 2
            word = words_at(self.data, self.start[mid] + depth)
            up = word <= words[some] if right else word < words[some]
            lo[some[up]], hi[some[~up]] = mid[up] + 1, mid[~up]

    def without(self, gone: np.ndarray) -> "SuffixArray":
        return SuffixArray(self.data, self.start[~gone], self.base, self.length)

    def merged(self, later: "SuffixArray", spot: np.ndarray) -> "SuffixArray":
        """With ``later``, whose strings follow; ``spot``: where its suffixes stand here."""
        out = np.empty(len(self) + len(later), np.int64)
        own = np.ones(len(out), bool)
        own[spot + np.arange(len(later))] = False
        out[own], out[~own] = self.start, later.start + len(self.data)
        return SuffixArray(np.concatenate([self.data, later.data]), out, self.base, self.length)


class SuffixLevels:
    """Logarithmic index family: levels of suffix arrays of geometrically growing size, so a
    suffix is merged O(log batches) times."""

    def __init__(self, length: int = MIN_LEN):
        self.levels: list[SuffixArray] = []
        self.hits: list[np.ndarray] = []
        self.size, self.length = 0, length

    def add(self, bodies: list[bytes]) -> None:
        """One batch of strings; its positions follow those of the batches before."""
        new, again = SuffixArray.build(bodies, self.size, self.length)
        self.size += len(new.data)
        self.hits.append(again)
        for level in self.levels:
            spot, equal = level.place(new)
            self.hits += [new.start[equal] + new.base, level.start[spot[equal]] + level.base]
            new = new.without(equal)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            later, level = self.levels.pop(), self.levels.pop()
            self.levels.append(level.merged(later, level.place(later)[0]))

    def repeated(self) -> np.ndarray:
        """Positions of the suffixes that occur again, in order."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *self.hits]))


def _pieces(texts: list[bytes], min_len: int) -> list[tuple[int, int, bytes]]:
    """(row, offset, bytes): texts beyond ``PIECE`` in parts that overlap by min_len - 1."""
    out = []
    for row, text in enumerate(texts):
        if len(text) <= PIECE:
            out.append((row, 0, text))
        else:
            step = PIECE - min_len + 1
            out += [(row, b, text[b : b + PIECE]) for b in range(0, len(text) - min_len + 1, step)]
    return [x for x in out if len(x[2]) >= min_len]


def _runs(texts: list[bytes], min_len: int, gram: int):
    """Arrays (row, start, number of windows, anchor's offset, its hash, run hash), block by block."""
    high = U(tk.MASK ^ 0xFFFFFF)
    pieces = _pieces(texts, min_len)
    for lo, hi in tk.blocks([len(x[2]) for x in pieces]):
        own = pieces[lo:hi]
        data = np.frombuffer(b"".join(x[2] for x in own), np.uint8)
        pre = tk.prefix(data)
        grams = tk.windows(pre, gram)
        packed = (grams & high) | np.arange(len(grams), dtype=U)  # ties: the leftmost
        anchor = (tk.sliding_min(packed, min_len - gram + 1) & U(0xFFFFFF)).astype(np.int64)
        sizes = np.array([len(x[2]) for x in own])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(own)), sizes)[: len(anchor)]
        inside = np.flatnonzero(np.arange(len(anchor)) + min_len <= ends[piece])
        anchor = anchor[inside]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(inside) != 1)]))
        start, at = inside[new], anchor[new]
        n = np.diff(np.concatenate([new, [len(inside)]]))
        run = tk.mix(tk.spans(pre, start, start + n - 1 + min_len) ^ (at - start).astype(U))
        piece = piece[start]
        base = np.array([x[1] for x in own]) - (ends - sizes)
        yield np.array([x[0] for x in own])[piece], start + base[piece], n, at - start, grams[at], run


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))


def run_table(docs: DataFrame, min_len: int, gram: int) -> DataFrame:
    """One row for each run of windows of one anchor."""

    def scan(batches):
        for batch in batches:
            for row, start, n, off, kmer, run in _runs(tk.text_bytes(batch["text"]), min_len, gram):
                take = pa.array(row)
                small = [pa.array(x.astype(np.int32)) for x in (start, off, n)]
                yield pa.RecordBatch.from_arrays([_int64(kmer), _int64(run), batch["doc_id"].take(take), batch["th"].take(take), *small], names=["kmer", "run", "doc_id", "th", "at", "off", "n"])

    return docs.mapInArrow(scan, RUN)


def slices_of(body: bytes, kmer: int, off: int, n: int, min_len: int) -> list[tuple[int, int, int]]:
    """(route, first window, windows) of the slices of a run; equal windows have equal routes."""
    pre = tk.prefix(np.frombuffer(body, np.uint8))
    number = np.arange((off - n + 1) // SLICE, off // SLICE + 1)
    lo, hi = np.maximum(off - (number + 1) * SLICE + 1, 0), np.minimum(off - number * SLICE, n - 1)
    core = tk.spans(pre, off - number * SLICE, off - (number + 1) * SLICE + 1 + min_len)
    route = tk.mix(core + U(kmer & tk.MASK) + number.astype(U) * U(tk.BASE)).view(np.int64)
    return list(zip(route.tolist(), lo.tolist(), (hi - lo + 1).tolist()))


def _suffix_rows(own: DataFrame, min_len: int) -> DataFrame:
    """The contested runs' bytes with the route by which equal windows meet."""

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in schema.names}
            for doc_id, th, text, runs in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), tk.text_bytes(batch["text"]), batch["runs"].to_pylist()):
                for r in runs:
                    body = text[r["at"] : r["at"] + r["n"] - 1 + min_len]
                    for route, i, n in slices_of(body, r["kmer"], r["off"], r["n"], min_len) if r["hot"] else [(r["kmer"], 0, r["n"])]:
                        for k, v in zip(out, (route, doc_id, th, r["at"] + i, r["alone"], body[i : i + n - 1 + min_len])):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("alone", pa.bool_()), ("body", pa.binary())])
    return own.mapInArrow(cut, "route long, doc_id long, th long, at int, alone boolean, body binary")


class _Origins:
    """Where the strings of a family come from: (doc_id, th, at) by position."""

    def __init__(self):
        self.size, self.first, self.rows = 0, [], []

    def add(self, bodies: list[bytes], rows: list[tuple]) -> None:
        for body, row in zip(bodies, rows):
            self.first.append(self.size)
            self.rows.append(row)
            self.size += len(body)

    def marks(self, hits: np.ndarray, min_len: int) -> pa.RecordBatch:
        """[a, b) in bytes of neighbouring repeated suffixes (``hits`` in order), by document."""
        first = np.array(self.first, np.int64)
        run = np.searchsorted(first, hits, "right") - 1
        edge = np.flatnonzero((np.diff(hits) != 1) | (np.diff(run) != 0))
        new, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(hits) - 1]])
        if not len(hits):
            new = last = np.zeros(0, np.int64)
        own = [self.rows[i] for i in run[new].tolist()]
        at = np.array([x[2] for x in own], np.int64)
        a, b = at + hits[new] - first[run[new]], at + hits[last] - first[run[new]] + min_len
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "th", "a", "b"])


def _match_levels(rows: DataFrame, min_len: int) -> DataFrame:
    """Repeated stretches of the contested runs: levels of suffix arrays."""

    def scan(batches):
        levels, origins = SuffixLevels(min_len), _Origins()
        for batch in batches:
            bodies = batch["body"].to_pylist()
            origin = list(zip(*(batch[c].to_pylist() for c in ("doc_id", "th", "at", "alone"))))
            for lo, hi in tk.blocks([len(b) for b in bodies], BATCH):
                levels.add(bodies[lo:hi])
                origins.add(bodies[lo:hi], origin[lo:hi])
        if not levels.size:
            return
        # A run that has copies is marked as a whole already.
        alone = np.array([x[3] for x in origins.rows])
        hits = levels.repeated()
        yield origins.marks(hits[alone[np.searchsorted(np.array(origins.first), hits, "right") - 1]], min_len)

    return rows.mapInArrow(scan, MARK)


def _with_runs(own: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id, th, text, runs: the documents that hold a representative, each once."""
    per_doc = stage(reps.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kmer", "at", "off", "n", "alone", "hot")).alias("runs")), "op1-per-doc")
    return own.join(per_doc, same_row(own, per_doc)).select(own["doc_id"], own["th"], "text", "runs").dropDuplicates(["doc_id", "th"])


def find_repeats(own: DataFrame, min_len: int, gram: int, hot: int) -> DataFrame:
    """doc_id, th, a, b: stretches of ``own`` (as made by ``keyed``) that occur again."""
    runs = stage(run_table(own, min_len, gram), "op1-runs")
    counts = stage(runs.groupBy("kmer", "run").agg(F.count("*").alias("copies")), "op1-counts")
    anchors = stage(counts.groupBy("kmer").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "op1-anchors")
    contested = counts.join(anchors, "kmer", "left").filter("copies > 1 or kinds > 1").select("kmer", "run", "copies", "kinds")
    found = stage(runs.join(stage(contested, "op1-contested"), ["kmer", "run"]), "op1-found")
    whole = found.filter("copies > 1").select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + min_len).alias("b"))
    one = found.filter("kinds > 1").groupBy("kmer", "run").agg(F.min(F.struct("doc_id", "th", "at", "off", "n", "copies", "kinds")).alias("r")).select("kmer", "r.*")
    reps = one.withColumns({"alone": F.col("copies") == 1, "hot": F.col("kinds") > hot})
    suffixes = stage(_suffix_rows(_with_runs(own, reps), min_len), "op1-suffixes")
    size = suffixes.agg(F.sum(F.length("body"))).first()[0] or 0
    matched = _match_levels(suffixes.repartition(parts_for(size, RUNS_PER_TASK * 512, 12), "route"), min_len)
    return whole.unionByName(matched)


def cut_marked(own: DataFrame, found: DataFrame) -> DataFrame:
    """``own`` less the stretches ``found`` in it: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept (the remaining bytes), spans (the removed [a, b), maximal, in order)."""
    marks = stage(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("marks")), "op1-marks")
    joined = own.join(marks, same_row(own, marks), "left").select(own["doc_id"], "text", "marks")

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in schema.names}
            for doc_id, text, marks in zip(batch["doc_id"].to_pylist(), tk.text_bytes(batch["text"]), batch["marks"].to_pylist()):
                gone = removed_spans([(m["a"], m["b"]) for m in marks or []])
                kept = text if not gone else b"".join(text[x:y] for x, y in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)]))
                row = (doc_id, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"a": a, "b": b} for a, b in gone])
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(span))])
    return joined.mapInArrow(cut, RESULT + ", kept binary, spans array<struct<a:int,b:int>>")


def removed_spans(cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(cover):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM, hot: int = HOT_RUNS) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans."""
    own = keyed(docs)
    return cut_marked(own, find_repeats(own, min_len, gram, hot))


class SuffixIndex:
    """A family of suffix arrays in the shared folder, for a corpus that arrives in batches.

    Each intake writes a generation: its documents and runs, the runs indexed by it, its new
    arrays, the arrays that were merged away, and the stretches found. An intake counts
    once its last table is written, so one that broke off is done again from the start.

    Arrays belong to one of ``buckets`` (by anchor). A fresh array is merge-scanned against
    each stored one of its bucket, pair by pair, so a task holds two arrays of bounded size
    however many strings share an anchor. Of a bucket's arrays of one size class two and two
    merge, up to ``ARRAY_MOST`` suffixes.
    """

    TABLES = ("docs", "runs", "indexed", "arrays", "dead", "marks")
    ARRAY = "id string, bucket int, size long, array binary"

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 4096, min_len: int = MIN_LEN, gram: int = GRAM):
        self.spark, self.buckets, self.min_len, self.gram = spark, buckets, min_len, gram
        self.folder = folder or f"{shared_dir(spark)}/op1-index-{uuid.uuid4().hex}"
        self.generations = 0
        while self._there(self.generations, self.TABLES[-1]):
            self.generations += 1

    def _path(self, generation: int, name: str) -> str:
        return f"{self.folder}/{generation:06d}-{name}"

    def _there(self, generation: int, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(generation, name) + "/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        path = self._path(self.generations, name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _before(self, name: str, schema: str) -> DataFrame:
        """The table over all generations there are."""
        paths = [self._path(i, name) for i in range(self.generations)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def marks(self) -> DataFrame:
        """The stretches of all documents taken in that occur again."""
        return self._before("marks", MARK)

    def kept(self) -> DataFrame:
        """What ``remove_repeats`` gives for all documents taken in so far."""
        return cut_marked(self._before("docs", "doc_id long, th long, text string"), self.marks())

    def add(self, docs: DataFrame) -> None:
        """Take in a batch of documents (doc_id, text, ...)."""
        own = self._write("docs", keyed(docs))
        fresh = self._write("runs", run_table(own, self.min_len, self.gram))
        known = self._before("runs", RUN)
        runs, new = known.unionByName(fresh), fresh.select("kmer", "run").distinct()
        # Only anchors and runs of this batch can change: all else is settled.
        same = stage(runs.join(new, ["kmer", "run"], "left_semi"), "op1-same")
        copied = same.groupBy("kmer", "run").agg(F.count("*").alias("copies")).filter("copies > 1")
        whole = same.join(copied, ["kmer", "run"], "left_semi").select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + self.min_len).alias("b"))
        kinds = runs.join(new.select("kmer").distinct(), "kmer", "left_semi").groupBy("kmer", "run").agg(F.min(F.struct("doc_id", "th", "at", "off", "n")).alias("r"))
        kinds = stage(kinds, "op1-kinds")
        contested = kinds.groupBy("kmer").count().filter("count > 1").select("kmer")
        reps = kinds.join(contested, "kmer", "left_semi").join(self._before("indexed", "kmer long, run long"), ["kmer", "run"], "left_anti")
        reps = self._write("indexed", reps).select("kmer", "r.*").withColumns({"alone": F.lit(True), "hot": F.lit(False)})
        every = self._before("docs", "doc_id long, th long, text string").unionByName(own)
        rows = _suffix_rows(_with_runs(every, reps), self.min_len).withColumn("bucket", F.pmod("route", F.lit(self.buckets)).cast("int"))
        made = stage(self._arrays(rows), "op1-made")
        arrays = made.filter("array is not null").select("id", "bucket", "size", "array")
        live = self._before("arrays", self.ARRAY).join(self._before("dead", "id string"), "id", "left_anti")
        other = live.withColumn("old", F.lit(True)).unionByName(arrays.withColumn("old", F.lit(False)))
        pairs = arrays.alias("x").join(other.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("y.old") | (F.col("x.id") < F.col("y.id"))))
        scanned = self._scan(pairs.select(F.col("x.array").alias("x"), F.col("y.array").alias("y")))
        found = whole.unionByName(made.filter("array is null").select("doc_id", "th", "a", "b")).unionByName(scanned)
        merged = stage(self._merge(other.drop("old")), "op1-merged")
        gone = merged.select(F.explode("gone").alias("id"))
        self._write("arrays", arrays.unionByName(merged.select("id", "bucket", "size", "array")))
        self._write("dead", gone)
        self._write("marks", found.distinct())
        self.generations += 1

    def _arrays(self, rows: DataFrame) -> DataFrame:
        """The suffix arrays of a batch's strings, bucket by bucket, and what repeats within."""
        min_len = self.min_len

        def flush(bucket, levels, origins):
            yield from _mark_rows(origins.marks(levels.repeated(), min_len))
            for level in levels.levels:
                blob = pickle.dumps((level, [(f, *r[:3]) for f, r in zip(origins.first, origins.rows) if level.base <= f < level.base + len(level.data)]))
                yield array_row(bucket, len(level), blob)

        def array_row(bucket, size, blob):
            return pa.RecordBatch.from_pydict({"id": [uuid.uuid4().hex], "bucket": [bucket], "size": [size], "array": [blob], "doc_id": [None], "th": [None], "a": [None], "b": [None]}, schema=schema)

        def _mark_rows(marks):
            empty = [pa.nulls(marks.num_rows, t) for t in (pa.string(), pa.int32(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, *marks.columns], schema=schema)

        def build(batches):
            bucket, levels, origins = None, SuffixLevels(min_len), _Origins()
            for batch in batches:
                number = batch["bucket"].to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]).tolist()
                bodies, origin = batch["body"].to_pylist(), list(zip(*(batch[c].to_pylist() for c in ("doc_id", "th", "at"))))
                for lo, hi in zip(edges, edges[1:]):
                    if hi > lo and (number[lo] != bucket or sum(map(len, levels.levels)) > ARRAY_MOST):
                        yield from flush(bucket, levels, origins)
                        bucket, levels, origins = int(number[lo]), SuffixLevels(min_len), _Origins()
                    for a, b in tk.blocks([len(x) for x in bodies[lo:hi]], BATCH):
                        levels.add(bodies[lo + a : lo + b])
                        origins.add(bodies[lo + a : lo + b], origin[lo + a : lo + b])
            yield from flush(bucket, levels, origins)

        schema = pa.schema([("id", pa.string()), ("bucket", pa.int32()), ("size", pa.int64()), ("array", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
        return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(build, f"{self.ARRAY}, {MARK}")

    def _scan(self, pairs: DataFrame) -> DataFrame:
        """Suffixes that two arrays share, as stretches on either side."""
        min_len = self.min_len

        def run(batches):
            for batch in batches:
                for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                    (x, from_x), (y, from_y) = pickle.loads(x), pickle.loads(y)
                    spot, equal = y.place(x)
                    for array, rows, hits in ((x, from_x, x.start[equal]), (y, from_y, y.start[spot[equal]])):
                        origins = _Origins()
                        origins.first, origins.rows = [r[0] for r in rows], [r[1:] for r in rows]
                        yield origins.marks(np.sort(hits) + array.base, min_len)

        return pairs.mapInArrow(run, MARK)

    def _merge(self, arrays: DataFrame) -> DataFrame:
        """id, bucket, size, array, gone (ids): arrays of a bucket and size class, two and two."""
        from pyspark.sql.window import Window

        small = arrays.filter((F.col("size") > 0) & (F.col("size") <= ARRAY_MOST // 2)).withColumn("class", F.floor(F.log2("size")).cast("int"))
        turn = F.row_number().over(Window.partitionBy("bucket", "class").orderBy("id"))
        dealt = small.select("id", "bucket", "size", "class", F.floor((turn - 1) / 2).alias("pair"), (turn % 2).alias("side"))
        pairs = dealt.filter("side = 1").drop("side").join(dealt.filter("side = 0").select(F.col("id").alias("id2"), "bucket", "class", "pair"), ["bucket", "class", "pair"])
        both = pairs.join(arrays.select("id", F.col("array").alias("x")), "id").join(arrays.select(F.col("id").alias("id2"), F.col("array").alias("y")), "id2")

        def run(batches):
            for batch in batches:
                for one, two, bucket, x, y in zip(*(batch[c].to_pylist() for c in ("id", "id2", "bucket", "x", "y"))):
                    (x, from_x), (y, from_y) = pickle.loads(x), pickle.loads(y)
                    spot, equal = x.place(y)
                    out = x.merged(y.without(equal), spot[~equal])
                    out.base = 0
                    rows = [(f - x.base, *r) for f, *r in from_x] + [(f - y.base + len(x.data), *r) for f, *r in from_y]
                    yield pa.RecordBatch.from_pydict({"id": [uuid.uuid4().hex], "bucket": [bucket], "size": [len(out)], "array": [pickle.dumps((out, rows))], "gone": [[one, two]]}, schema=schema)

        schema = pa.schema([("id", pa.string()), ("bucket", pa.int32()), ("size", pa.int64()), ("array", pa.binary()), ("gone", pa.list_(pa.string()))])
        return both.select("id", "id2", "bucket", "x", "y").mapInArrow(run, f"{self.ARRAY}, gone array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, h, unnest(range(0, length(h) // 2 - {MIN_LEN - 1})) AS i FROM d WHERE length(h) >= {2 * MIN_LEN}
), k AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, {2 * MIN_LEN})) AS k FROM w
), again AS (
  SELECT k FROM k GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {MIN_LEN} THEN 0 ELSE 1 END AS apart FROM k SEMI JOIN again USING (k)
), span AS (
  SELECT r, min(i) AS a, max(i) + {MIN_LEN} AS b FROM (SELECT *, sum(apart) OVER (PARTITION BY r ORDER BY i) AS s FROM hit) GROUP BY r, s
), gap AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span
), per AS (
  SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS upto,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * upto + 1), h))) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
