"""op6: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of words are counted over all documents (hashed to ``HASHED``
   counters, summed by Spark); they give the inverse document frequencies.
2. The benchmark's passages are a TF-IDF matrix over the benchmark's own words. A randomised
   SVD finds its ``RANK`` leading directions: every pass multiplies the rows' partitions on
   the executors and sums the small products, the driver only orthogonalises a matrix of
   words x RANK.
3. Windows of several lengths slide over every document and are compared by cosine in latent
   space (relative to what the projection keeps of an item) with the items of about their
   length. Windows whose weight lies mostly on words that no item has are passed over, and
   so are candidates of which less than half the weight lies on the item's words.
4. That search is approximate. What it passes over is found by what every match must share
   with its item: enough of the item's rarest words within one stretch (``_index`` has the
   bound, which follows from ``PARAPHRASE``), or its answer word for word. No match is outside
   the bound, so the answer does not depend on the windows.
5. Candidates are checked on the words: for some stretch of half again the item's length the
   longest common subsequence must cover ``COVER`` of the item. A paraphrase may cover
   ``PARAPHRASE`` of it if the stretch is still ``ALIKE`` the item in latent space (for items
   of which ``VARIED`` of the words differ from each other), or if the item's answer (its last sentence, of three words or more) stands as it is in the stretch or
   within half an item's length of it. All stretches are judged; those that cannot reach it by
   their count of words are passed over.

Every document is searched for itself: its neighbours in a batch change nothing.

The benchmark is taken in blocks of ``ITEMS`` items and ``BYTES`` bytes, so what is broadcast
is bounded; the documents are read once a block (one block for usual benchmarks) and never shuffled.

Rows: null, empty and wordless texts and items match nothing; items shorter than
``SHORTEST`` words must match word for word; repeated rows are reported once each; ids may be
null; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkit as tk
from factloom.llm.common import keyed, stage, table
from factloom.llm.textkit import U

HASHED = 1 << 16
RANK = 48
POWER = 2
ITEMS = 4000
#: Bytes of items that are broadcast at once, about.
BYTES = 4 << 20
LENGTHS = (8, 12, 18, 27, 40, 60, 90)
SHARE = 0.6
MEMBERS = 0.5
COSINE = 0.5
COVER = 0.8
PARAPHRASE = 0.6
ALIKE = 0.35
VARIED = 0.6
SHORTEST = 8
SEED = 5
#: least_hits is a HITS-th of the words a match needs; hits held at a time.
HITS = 4
MOST_HITS = 1 << 20

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _texts(batch) -> list[bytes]:
    return tk.text_bytes(batch["text"])


def _words(texts: list[bytes]) -> tk.Words:
    return tk.Words(texts, GAP, accents=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each hash class, and the number of documents."""

    def count(batches):
        df, n = np.zeros(HASHED, np.int64), 0
        for batch in batches:
            texts = _texts(batch)
            n += len(texts)
            for lo, hi in tk.blocks([len(t) for t in texts]):
                w = _words(texts[lo:hi])
                pairs = np.unique(w.doc * HASHED + (w.hash & U(HASHED - 1)).astype(np.int64))
                df += np.bincount(pairs % HASHED, minlength=HASHED)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = rows["slot"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(HASHED, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return df, int(n[slot < 0].sum())


def weights(hashes: np.ndarray, df: np.ndarray, docs: int) -> np.ndarray:
    return np.log((1 + docs) / (1 + df[(hashes & U(HASHED - 1)).astype(np.int64)])) + 0.1


def _matrix(hashes: list[np.ndarray], vocab: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), len(vocab)), np.float32)
    for i, h in enumerate(hashes):
        np.add.at(out[i], np.searchsorted(vocab, h), 1)
    return out * idf.astype(np.float32)


def randomised_svd(items: DataFrame, vocab: np.ndarray, idf: np.ndarray, rank: int = RANK, power: int = POWER, seed: int = SEED) -> np.ndarray:
    """Leading right singular vectors (words x rank) of the items' TF-IDF matrix."""
    spark, d = items.sparkSession, len(vocab)
    chunk = 4096

    def gram_times(q: np.ndarray) -> np.ndarray:
        """A^T A q, with A's rows where they are."""
        sent = spark.sparkContext.broadcast((vocab, idf, q))

        def part(batches):
            vocab, idf, q = sent.value
            total = np.zeros(q.shape, np.float32)
            for batch in batches:
                texts = _texts(batch)
                for lo in range(0, len(texts), 64):
                    w = _words(texts[lo : lo + 64])
                    a = _matrix([w.hash[w.first[i] : w.first[i + 1]] for i in range(len(w.first) - 1)], vocab, idf)
                    total += a.T @ (a @ q)
            for lo in range(0, d, chunk):
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([total[lo : lo + chunk].tobytes()])], names=["lo", "part"])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32) for x in group["part"].to_pylist())
            return pa.table({"lo": group["lo"][:1], "part": pa.array([total.tobytes()])})

        rows = items.select("text").mapInArrow(part, "lo long, part binary").groupBy("lo").applyInArrow(add, "lo long, part binary").collect()
        sent.destroy()
        out = np.zeros(q.shape)
        for r in rows:
            out[r["lo"] : r["lo"] + chunk] += np.frombuffer(r["part"], np.float32).reshape(-1, q.shape[1])
        return out

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(rank, d))))[0]
    for _ in range(power):
        q = np.linalg.qr(gram_times(q.astype(np.float32)))[0]
    small = q.T @ gram_times(q.astype(np.float32))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)]).astype(np.float32)


def masks_of(a: list) -> dict:
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def lcs(a: list, b: list, masks: dict | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks = masks_of(a) if masks is None else masks
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_end(a: list, b: list) -> int:
    """Words of ``b`` from its start that have its whole common subsequence with ``a``."""
    masks, full, end = masks_of(a), (1 << len(a)) - 1, 0
    v = full
    for i, x in enumerate(b):
        u = v & masks.get(x, 0)
        new = ((v + u) | (v - u)) & full
        if new.bit_count() < v.bit_count():
            end = i + 1
        v = new
    return end


def least(share: float, n: int) -> int:
    """The smallest k with k / n >= share."""
    return int(np.ceil(share * n - 1e-9))


def word_prefix(h: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``textkit.spans`` hashes any run of words."""
    return tk.running(tk.times(tk.reduce(h), tk.powers(len(h) + 1)[0][: len(h)]))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them) for every i."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def answer_of(text: bytes) -> bytes:
    """The last sentence that has a word."""
    parts = [x for x in text.replace(b"\n", b". ").replace(b"?", b".").replace(b"!", b".").split(b".") if len(_words([x]))]
    return parts[-1] if parts else b""


class Retriever:
    """Items in latent space, their rarest words, and the search for both in a block of texts."""

    def __init__(self, ids, texts, vocab, idf, vectors, df, docs):
        w = _words(texts)
        hashes = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(texts))]
        self.ids, self.words = ids, [h.tolist() for h in hashes]
        self.answers = [_words([answer_of(t)]).hash.tolist() for t in texts]
        self.vocab, self.idf, self.vectors, self.df, self.docs = vocab, idf, vectors, df, docs
        latent, norm = np.zeros((len(hashes), vectors.shape[1]), np.float32), np.zeros(len(hashes))
        for i, h in enumerate(hashes):
            at, n = np.unique(np.searchsorted(vocab, h), return_counts=True)
            latent[i], norm[i] = (n * idf[at]) @ vectors[at], np.sqrt(((n * idf[at]) ** 2).sum())
        self.size = np.array([len(h) for h in hashes])
        self.own = np.unique(np.concatenate([i * len(vocab) + np.searchsorted(vocab, h) for i, h in enumerate(hashes)])) if len(vocab) else np.zeros(0, np.int64)
        # An item's cosine with its own projection; a copy of it reaches as much and no more.
        self.kept = np.maximum(np.linalg.norm(latent, axis=1), 1e-12) / np.maximum(norm, 1e-12)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        self.reach = self.size + self.size // 2
        # Where words repeat, a common subsequence is soon long and says little.
        self.varied = [len(np.unique(h)) >= VARIED * len(h) for h in hashes]
        self.bags = [np.unique(h, return_counts=True) for h in hashes]
        self.masks: dict[int, dict] = {}
        self._index(hashes)

    def _index(self, hashes: list[np.ndarray]) -> None:
        """What any match must share with its item, on the item's rarest words.

        ``PARAPHRASE`` of n words leaves out at most n - k of them. So of any n - k + m words of
        the item at least m stand in the stretch; the rarest are taken, m is ``least_hits``.
        Short items and answers stand word for word: they are found at their rarest word.
        """
        self.least_hits = np.zeros(len(hashes), np.int64)
        pairs, phrases = [], []
        for i, h in enumerate(hashes):
            n = len(h)
            if not n:
                continue
            at = np.searchsorted(self.vocab, h)
            if n < SHORTEST:
                phrases.append((i, h))
                continue
            k = least(PARAPHRASE, n)
            self.least_hits[i] = m = max(1, k // HITS)
            rare = at[np.argsort(-self.idf[at], kind="stable")][: n - k + m]
            pairs.append(i * len(self.vocab) + np.unique(rare))
            if len(self.answers[i]) >= 3:
                phrases.append((i, np.array(self.answers[i], U)))
        pairs = np.concatenate([np.zeros(0, np.int64), *pairs])
        self.pair_item, self.pair_word = pairs // max(1, len(self.vocab)), pairs % max(1, len(self.vocab))
        at = [np.searchsorted(self.vocab, h) for _, h in phrases]
        off = [int(np.argmax(self.idf[x])) for x in at]
        order = np.argsort([x[o] for x, o in zip(at, off)], kind="stable").astype(int)
        self.phrase_word = np.array([at[j][off[j]] for j in order], np.int64)
        self.phrase_item = np.array([phrases[j][0] for j in order], np.int64)
        self.phrase_off = np.array([off[j] for j in order], np.int64)
        self.phrase_len = np.array([len(phrases[j][1]) for j in order], np.int64)
        self.phrase_hash = np.array([tk.spans(word_prefix(phrases[j][1]), np.array([0]), np.array([len(phrases[j][1])]))[0] for j in order], U)

    def phrases(self, w: tk.Words, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start and length of the short items and answers that stand in the texts."""
        pos = np.flatnonzero(known)
        lo, hi = (np.searchsorted(self.phrase_word, at[pos], side) for side in ("left", "right"))
        row, pos = spread(lo, hi - lo), np.repeat(pos, hi - lo)
        start = pos - self.phrase_off[row]
        end = start + self.phrase_len[row]
        inside = (start >= w.first[w.doc[pos]]) & (end <= w.first[w.doc[pos] + 1])
        row, start, end = row[inside], start[inside], end[inside]
        same = tk.spans(word_prefix(w.hash), start, end) == self.phrase_hash[row]
        return self.phrase_item[row[same]], start[same], end[same] - start[same]

    def stretches(self, w: tk.Words, at: np.ndarray, known: np.ndarray):
        """(item, first start, last start) of the stretches that hold ``least_hits`` of an
        item's rarest words. Items are taken in groups of at most ``MOST_HITS`` such words."""
        pos = np.flatnonzero(known)
        pos = pos[np.argsort(at[pos], kind="stable")]
        begin = np.searchsorted(at[pos], np.arange(len(self.vocab) + 1))
        n = np.diff(begin)[self.pair_word]
        upto = np.cumsum(n)
        item_end = np.append(np.flatnonzero(np.diff(self.pair_item)) + 1, len(n))
        lo = 0
        while lo < len(n):
            base = upto[lo - 1] if lo else 0
            ends = item_end[item_end > lo]
            hi = ends[max(0, np.searchsorted(upto[ends - 1], base + MOST_HITS, "right") - 1)]
            key = np.repeat(self.pair_item[lo:hi], n[lo:hi]) * len(w) + pos[spread(begin[self.pair_word[lo:hi]], n[lo:hi])]
            lo = hi
            key.sort()
            item, p = key // len(w), key % len(w)
            last = np.arange(len(key)) + self.least_hits[item] - 1
            ok = last < len(key)
            item, p, last = item[ok], p[ok], last[ok]
            near = (key[last] - item * len(w) < np.minimum(p + self.reach[item], w.first[w.doc[p] + 1])) & (key[last] < (item + 1) * len(w))
            item, p, q = item[near], p[near], key[last[near]] % len(w)
            if not len(item):
                continue
            first = np.maximum(q - self.reach[item] + 1, w.first[w.doc[p]])
            new = np.append(True, (np.diff(item) != 0) | (first[1:] > p[:-1] + 1))
            a = np.flatnonzero(new)
            yield from zip(item[a].tolist(), first[a].tolist(), p[np.append(a[1:], len(p)) - 1].tolist())

    def best(self, item: int, region: np.ndarray, starts: int, need: int) -> tuple[int, int]:
        """(words of the item in order, start) of the best stretch from one of the first
        ``starts`` words of the region; (0, 0) if none has ``need``."""
        own, count = self.bags[item]
        n, reach = int(self.size[item]), int(self.reach[item])
        spot = np.minimum(np.searchsorted(own, region), len(own) - 1)
        p = np.flatnonzero(own[spot] == region)
        if len(p) < need:
            return 0, 0
        order = np.argsort(spot[p], kind="stable")
        p, x = p[order], spot[p[order]]
        # An occurrence counts for the starts that have less than the item's count before it.
        back = np.arange(len(p)) - count[x]
        known = np.maximum(back, 0)
        before = np.where((back >= 0) & (x[known] == x), p[known], -1)
        first = np.maximum(np.maximum(before, p - reach) + 1, 0)
        common = np.cumsum(np.bincount(first, minlength=len(region) + 1) - np.bincount(p + 1, minlength=len(region) + 1))[:starts]
        at = np.flatnonzero(common >= need)
        if not len(at):
            return 0, 0
        words, masks = region.tolist(), self.masks.get(item)
        if masks is None:
            masks = self.masks[item] = masks_of(self.words[item])
        found, i = (0, 0), 0
        while i < len(at):
            s = int(at[i])
            k = lcs(self.words[item], words[s : s + reach], masks)
            if k >= need:
                found, need = (k, s), k + 1
                if k == n:
                    break
                at = at[(at > s) & (common[at] >= need)]
                i = 0
            else:  # a step of one word adds one at most
                i = int(np.searchsorted(at, s + need - k))
        return found

    def cosine(self, item: int, at: np.ndarray, known: np.ndarray, weight: np.ndarray) -> float:
        """Of a stretch with an item: in latent space, relative to what it keeps of the item."""
        x = (self.vectors[at] * np.where(known, weight, 0)[:, None]).sum(axis=0)
        return float(min(1.0, x @ self.latent[item] / (max(np.sqrt((weight**2).sum()), 1e-12) * self.kept[item])))

    def match(self, w: tk.Words, doc: int, item: int, ranges: list[tuple[int, int]]) -> tuple[int, int, int]:
        """(words of the item in order, start, end) of the narrowest part of the best stretch
        that begins in the ranges; zeros if none has ``PARAPHRASE`` of the item."""
        size, reach, best = int(self.size[item]), int(self.reach[item]), (0, 0)
        for lo, hi in _merged(ranges):
            k, s = self.best(item, w.hash[lo : min(hi + reach, w.first[doc + 1])], hi - lo + 1, max(least(PARAPHRASE, size), best[0] + 1))
            if k:
                best = (k, lo + s)
            if k == size:
                break
        if not best[0]:
            return 0, 0, 0
        k, s = best
        stretch = w.hash[s : min(s + reach, w.first[doc + 1])].tolist()
        e = s + lcs_end(self.words[item], stretch)
        return k, e - lcs_end(self.words[item][::-1], stretch[: e - s][::-1]), e

    def windows(self, w: tk.Words, known: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) in words of the windows that may be copies."""
        mass = np.concatenate([[0], np.cumsum(weight**2)])
        own = np.concatenate([[0], np.cumsum(np.where(known, weight, 0) ** 2)])
        starts, ends = [], []
        last = w.first[w.doc + 1]
        for length in LENGTHS:
            # From each document's first word on, so that its neighbours change nothing.
            s = np.flatnonzero((np.arange(len(w)) - w.first[w.doc]) % max(1, length // 4) == 0)
            e = np.minimum(s + length, last[s])
            ok = own[e] - own[s] >= SHARE * (mass[e] - mass[s])
            starts.append(s[ok])
            ends.append(e[ok])
        both = np.unique(np.column_stack([np.concatenate(starts), np.concatenate(ends)]), axis=0)
        return both[:, 0], both[:, 1]

    def members(self, a, b, start, n, at, mass) -> np.ndarray:
        """Weight (squared) of the words of window a[i] that are words of item b[i]."""
        out = np.zeros(len(a))
        for lo in range(0, len(a), 4096):
            x, y = a[lo : lo + 4096], b[lo : lo + 4096]
            m = n[x]
            flat = np.repeat(start[x] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            key = np.repeat(y, m) * len(self.vocab) + at[flat]
            spot = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
            out[lo : lo + 4096] = np.add.reduceat(np.where(self.own[spot] == key, mass[flat], 0), np.cumsum(m) - m)
        return out

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, float, int]]:
        """(text, item id, cosine, cover, first word) of each item found in a text, for the
        narrowest part of its best stretch."""
        w = _words(texts)
        if not len(w) or not len(self.vocab):
            return []
        at = np.minimum(np.searchsorted(self.vocab, w.hash), len(self.vocab) - 1)
        known = self.vocab[at] == w.hash
        every = known.copy()
        for k in range(1, 9):  # a word said over and over speaks for no item
            known[k:] &= (w.hash[k:] != w.hash[:-k]) | (w.doc[k:] != w.doc[:-k])
        weight = weights(w.hash, self.df, self.docs)
        start, end = self.windows(w, known, weight)
        # (text, item): ranges of starts where a match may begin, anywhere and near the answer
        hits: dict[tuple[int, int], tuple[list, list]] = {}
        spots = lambda doc, item: hits.setdefault((doc, item), ([], []))
        for lo in range(0, len(start), 2048):
            s, e = start[lo : lo + 2048], end[lo : lo + 2048]
            n = e - s
            flat = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = self.vectors[at[flat]] * np.where(known[flat], weight[flat], 0)[:, None].astype(np.float32)
            x = np.add.reduceat(rows, np.cumsum(n) - n, axis=0)
            norm = np.sqrt(np.add.reduceat(weight[flat] ** 2, np.cumsum(n) - n))
            cos = (x @ self.latent.T) / (np.maximum(norm, 1e-12)[:, None] * self.kept[None, :])
            fits = (n[:, None] >= np.minimum(0.5 * self.size, LENGTHS[-2])[None, :]) & (n[:, None] <= 1.3 * self.size[None, :])
            a, b = np.nonzero((cos >= COSINE) & fits)
            near = self.members(a, b, s, n, at, np.where(known, weight**2, 0)) >= MEMBERS * norm[a] ** 2
            for a, b in zip(a[near], b[near]):
                if self.size[b] >= SHORTEST:
                    spots(int(w.doc[s[a]]), int(b))[0].append((max(int(e[a] - self.reach[b]), int(w.first[w.doc[s[a]]])), int(s[a])))
        for b, s, e in self.stretches(w, at, every):
            spots(int(w.doc[s]), b)[0].append((s, e))
        whole: dict[tuple[int, int], tuple[int, int]] = {}
        for b, s, n in zip(*(x.tolist() for x in self.phrases(w, at, every))):
            doc, size = int(w.doc[s]), int(self.size[b])
            if size < SHORTEST:
                whole.setdefault((doc, b), (s, s + n))
            else:
                lo, hi = s + n - int(self.reach[b]) - size // 2, s + size // 2
                spots(doc, b)[1].append((max(lo, int(w.first[doc])), min(hi, int(w.first[doc + 1]) - 1)))
        out = [(doc, self.ids[item], self.cosine(item, at[s:e], every[s:e], weight[s:e]), 1.0, int(s - w.first[doc])) for (doc, item), (s, e) in whole.items()]
        for (doc, item), (anywhere, answered) in hits.items():
            size = int(self.size[item])
            for ranges in (anywhere, answered):
                k, s, e = self.match(w, doc, item, ranges)
                cosine = self.cosine(item, at[s:e], every[s:e], weight[s:e]) if k else 0.0
                if k and (ranges is answered or k >= least(COVER, size) or (self.varied[item] and cosine >= ALIKE)):
                    out.append((doc, self.ids[item], cosine, k / size, int(s - w.first[doc])))
                    break
        return sorted(out, key=lambda x: (x[0], x[4]))


def _merged(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of starts, overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spots):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def retrievers(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS):
    """One ``Retriever`` for each block of the benchmark, as broadcast variables."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    items = stage(items, "op6-items")
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    if not count:
        return
    blocks = max(-(-count // items_at_once), -(-size // BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    df, n = document_frequencies(docs)
    for k in range(blocks):
        some = items.filter(F.col("block") == k)
        rows = some.orderBy("item_id", "text").collect()
        ids, texts = [r["item_id"] for r in rows], [r["text"].encode() for r in rows]
        vocab = np.unique(_words(texts).hash)
        idf = weights(vocab, df, n)
        vectors = randomised_svd(some, vocab, idf) if len(vocab) else np.zeros((0, 1), np.float32)
        yield spark.sparkContext.broadcast(Retriever(ids, texts, vocab, idf, vectors, df, n))


def _found(texts: list[bytes], retriever: Retriever) -> list[tuple]:
    out = []
    for lo, hi in tk.blocks([len(t) for t in texts]):
        out += [(lo + x[0], *x[1:]) for x in retriever.search(texts[lo:hi])]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) ->
    doc_id, th, item_id, cosine, cover, first_word: the items found in each document."""
    schema = "doc_id long, th long, item_id long, cosine double, cover double, first_word long"
    own = keyed(docs)
    out = docs.sparkSession.createDataFrame([], schema)

    def find(sent):
        def run(batches):
            for batch in batches:
                found = _found(_texts(batch), sent.value)
                if found:
                    row = pa.array([x[0] for x in found])
                    cols = [pa.array([x[i + 1] for x in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(row), batch["th"].take(row), *cols], names=["doc_id", "th", "item_id", "cosine", "cover", "first_word"])

        return own.mapInArrow(run, schema)

    for sent in retrievers(docs, benchmark, items_at_once):
        out = out.unionByName(find(sent))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, items_at_once: int = ITEMS) -> DataFrame:
    """``docs`` with all its columns, less the documents in which an item is found."""

    def keep(rows: DataFrame, sent) -> DataFrame:
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in _found(_texts(batch), sent.value)]] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    out = docs
    for sent in retrievers(docs, benchmark, items_at_once):
        out = keep(out, sent)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
