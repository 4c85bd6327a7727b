"""op8: exact Jaccard self-join on word shingles by adaptive multi-match prefixes.

Two documents link when ``100 * |A n B| >= percent * |A u B|`` for their sets of distinct
shingles. All sets are put in one order of tokens. If a set of size n links with another,
they share at least ceil(t n) tokens, so their prefixes of n - ceil(t n) + l tokens share l.

1. Token frequencies. Tasks count tokens that repeat inside their own documents; the sums give
   a table of the more frequent ones (at most ``COUNTED_MAX``, the most frequent first), which
   is broadcast: its size is bounded. It serves as order (rare first, frequent last by count)
   and as cost estimate. Any order is exact; a token the table misses only costs time.
2. Prefixes. Each document takes the l from 1 to ``MATCHES`` that makes its estimated cost
   least: the tokens it sends, the pairs that they bring (their frequencies summed over the
   prefix), and the verification of those pairs that are expected to share l of them. A prefix
   whose further tokens are rare grows and asks for more shared tokens; where the next tokens
   are frequent it stays short.
3. Pairs. Documents meet by token. A token of more than ``HOT`` documents that the table missed
   is dealt anew: its documents go into buckets of at most ``HOT``, and pairs of buckets to
   tasks of their own.
4. Documents whose prefix needs frequent tokens (almost all of their text is frequent: large
   groups of near copies) are "full". They are compared among themselves by products of 0/1
   matrices over blocks of bounded size, in neighbouring size classes, and only a spanning
   forest of the links is returned: first within blocks, then one document of each group found
   so far with one of each other, and, once the components of these links are known, of what
   is still apart, blocks of different groups. A group of near copies, however large, is compared with others only.
   With all other documents full ones share a rare prefix token.
5. Candidate pairs are counted; count and prefix lengths bound the possible overlap; what is
   left is verified on the whole sets: first each document with its least candidate, then
   the pairs that are not yet in one component.

Documents of equal sets form one class from the start (by a 64-bit hash of the set).

Rows: null and empty texts have no shingles, link with nothing and are their own component;
fewer words than ``n`` are one shingle; repeated rows get the same answer; null ids never
name a component unless all its ids are null (then it is null); an empty table gives no
rows; other columns of ``docs`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkit as tk
from factloom.llm.common import keyed, parts_for, same_row, stage, table
from factloom.llm.components import components
from factloom.llm.textkit import U

SHINGLE = 4
PERCENT = 85
FREQUENT = 48
#: Tokens of more documents than this are in the table, at most so many of them.
COUNTED = 4
COUNTED_MAX = 1 << 20
MATCHES = 4
BLOCK = 256
HOT = 512
PAIRS_PER_TASK = 8 << 20
#: In units of a token sent: other documents expected for a token that is not in the table, and
#: the cost of verifying a pair.
UNSEEN, VERIFY = 0.25, 8


def token_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    out = []
    for lo, hi in tk.blocks([len(t) for t in texts]):
        w = tk.Words(texts[lo:hi])
        for i in range(hi - lo):
            h = w.hash[w.first[i] : w.first[i + 1]]
            out.append(np.unique(tk.ngrams(h, min(n, len(h)))) if len(h) else np.zeros(0, U))
    return out


def set_key(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64)))


def least_shared(n, percent: int):
    """ceil(t n), in integers."""
    return -(-n * percent // 100)


def frequent_tokens(own: DataFrame, n: int, above: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of more than ``above`` documents, as far as single tasks see them repeat."""

    def count(batches):
        seen, held, size = set(), [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["tok", "n"])

        for batch in batches:
            for tokens in token_sets(tk.text_bytes(batch["text"]), n):
                key = set_key(tokens)
                if len(tokens) and key not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
                    if size > 2_000_000:
                        yield flush()
                        seen, held, size = set(), [], 0
        if held:
            yield flush()

    often = own.mapInArrow(count, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).filter(F.col("n") > above)
    rows = often.orderBy(F.desc("n"), "tok").limit(COUNTED_MAX).toArrow()
    tokens, counts = rows["tok"].to_numpy().view(U), rows["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix_of(tokens: np.ndarray, table: tuple[np.ndarray, np.ndarray], percent: int, frequent: int = FREQUENT) -> tuple[np.ndarray, int, bool]:
    """The tokens a set sends, the matches it asks for, and whether it is full."""
    often, counts = table
    df = np.ones(len(tokens), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
        hit = often[at] == tokens
        df[hit] = counts[at[hit]]
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    base = len(tokens) - least_shared(len(tokens), percent) + 1
    if df[base - 1] > frequent:
        return tokens[:base][df[:base] <= frequent], 1, True
    # Documents that each token brings along, summed over the prefix.
    others = np.cumsum(np.where(df > 1, df - 1, UNSEEN))
    best, cost = 1, None
    for l in range(1, MATCHES + 1):
        p = base + l - 1
        if p > len(tokens) or df[p - 1] > frequent:
            break
        now = p + others[p - 1] * (1 + VERIFY / l**2)
        if cost is None or now < cost:
            best, cost = l, now
    return tokens[: base + best - 1], best, False


def _sets(own: DataFrame, n: int, percent: int, often, frequent: int) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast(often)

    def scan(batches):
        for batch in batches:
            out = {k: [] for k in ("n", "key", "asks", "full", "toks", "body")}
            for tokens in token_sets(tk.text_bytes(batch["text"]), n):
                toks, asks, full = prefix_of(tokens, sent.value, percent, frequent) if len(tokens) else (tokens, 1, False)
                body = tokens.tobytes() if full else None
                for k, v in zip(out, (len(tokens), set_key(tokens), asks, full, toks.view(np.int64), body)):
                    out[k].append(v)
            cols = [batch["doc_id"], batch["th"], pa.array(out["n"], pa.int32()), pa.array(out["key"], pa.int64()), pa.array(out["asks"], pa.int32()), pa.array(out["full"], pa.bool_()), pa.array(out["toks"], pa.list_(pa.int64())), pa.array(out["body"], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "key", "asks", "full", "toks", "body"])

    return own.mapInArrow(scan, "doc_id long, th long, n int, key long, asks int, full boolean, toks array<long>, body binary")


PAIR = "a long, b long, na int, nb int, la int, lb int"
MEMBER = ("tok", "key", "n", "asks", "full")


def _meet(got: pa.Table, percent: int, group: np.ndarray, side: np.ndarray | None = None):
    """All pairs a < b of different keys of a group that may link, in batches. With ``side``
    only those of different sides."""
    key, n, asks, full = (got[c].to_numpy() for c in MEMBER[1:])
    order = np.lexsort((key, group))
    group, key = group[order], key[order]
    keep = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])[: len(key)]  # copies
    order, group, key = order[keep], group[keep], key[keep]
    n, asks, full = n[order], asks[order], full[order]
    side = None if side is None else side[order]
    last = np.searchsorted(group, group, side="right")
    # Every member with the d-th after it, for d = 1, 2, ...
    d, left = 1, np.arange(len(group))
    while True:
        left = left[left + d < last[left]]
        if not len(left):
            return
        x, y = left, left + d
        ok = (100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y])) & ~(full[x] & full[y])
        if side is not None:
            ok &= side[x] != side[y]
        x, y = x[ok], y[ok]
        if len(x):
            yield [key[x], key[y], n[x], n[y], asks[x], asks[y]]
        d += 1


def _pairs(sets: DataFrame, parts: int, percent: int, hot: int = HOT) -> DataFrame:
    """a < b: classes that share a rare prefix token, a row for each token they share."""
    rows = sets.filter("n > 0").select(F.explode("toks").alias("tok"), "key", "n", "asks", "full")
    names = ["a", "b", "na", "nb", "la", "lb", *MEMBER]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def meet(batches):
        # A token that many documents hold is in the table, so a task's share stays even.
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        got = pa.Table.from_batches(got)
        tok = got["tok"].to_numpy()
        uniq, at, members = np.unique(tok, return_inverse=True, return_counts=True)
        many = members[at] > hot
        for cols in _meet(got.filter(pa.array(~many)), percent, tok[~many]):
            yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(cols, kinds)), *(pa.nulls(len(cols[0]), t) for t in kinds[6:])], names=names)
        if many.any():
            for x in got.filter(pa.array(many)).to_batches():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(x.num_rows, t) for t in kinds[:6]), *(x[c].cast(t) for c, t in zip(MEMBER, kinds[6:]))], names=names)

    met = stage(rows.repartition(parts, "tok").mapInArrow(meet, f"{PAIR}, tok long, key long, n int, asks int, full boolean"), "op8-met")
    pairs, left = met.filter("a is not null").select("a", "b", "na", "nb", "la", "lb"), met.filter("a is null").select(*MEMBER)
    counts = stage(left.groupBy("tok").agg(F.ceil(F.countDistinct("key") / hot).cast("int").alias("buckets")), "op8-hot")
    load = counts.agg(F.sum(F.col("buckets").cast("double") ** 2)).first()[0]
    if not load:
        return pairs
    dealt = left.join(counts, "tok").withColumn("mine", F.pmod(F.xxhash64("key"), "buckets").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("other"))
    dealt = dealt.select(*MEMBER, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def cross(batches):
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        got = pa.Table.from_batches(got)
        where = np.stack([got[c].to_numpy().astype(np.int64) for c in ("tok", "i", "j")])
        _, group = np.unique(where, axis=1, return_inverse=True)
        group, own = group.ravel(), where[1] == where[2]
        for some, side in ((own, None), (~own, got["mine"].to_numpy())):
            for cols in _meet(got.filter(pa.array(some)), percent, group[some], None if side is None else side[some]):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=names[:6])

    return pairs.unionByName(dealt.repartition(min(1 << 15, parts_for(int(load) * hot**2, PAIRS_PER_TASK, parts)), "tok", "i", "j").mapInArrow(cross, PAIR))


def _verify(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    left = pairs.join(bodies.select(F.col("key").alias("a"), F.col("body").alias("x")).hint("merge"), "a")
    both = left.join(bodies.select(F.col("key").alias("b"), F.col("body").alias("y")).hint("merge"), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _unpack(keys: list[int], bodies: list[bytes]):
    sizes = np.array([len(b) // 8 for b in bodies])
    return np.array(keys, np.int64), sizes, np.repeat(np.arange(len(keys)), sizes), np.frombuffer(b"".join(bodies), U)


def block_links(x, y, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of sets (a block with itself too)."""
    (ka, na, ra, ta), (kb, nb, rb, tb) = x, y
    common = np.intersect1d(ta, tb)
    shared = np.zeros((len(ka), len(kb)), np.float32)
    for lo in range(0, len(common), 8192):
        part = common[lo : lo + 8192]
        dense = []
        for rows, toks, size in ((ra, ta, len(ka)), (rb, tb, len(kb))):
            at = np.minimum(np.searchsorted(part, toks), len(part) - 1)
            hit = part[at] == toks
            m = np.zeros((size, len(part)), np.float32)
            m[rows[hit], at[hit]] = 1
            dense.append(m)
        shared += dense[0] @ dense[1].T
    shared = shared.astype(np.int64)
    i, j = np.nonzero(100 * shared >= percent * (na[:, None] + nb[None, :] - shared))
    return _forest(ka[i], kb[j])


def _packed(dealt: DataFrame, name: str) -> DataFrame:
    """band, block (string), keys, bodies: one row for each block of ``dealt`` (band, block, key, body)."""

    def pack(group: pa.Table) -> pa.Table:
        keys, bodies = group["key"].to_pylist(), group["body"].to_pylist()
        return pa.table({"band": group["band"][:1], "block": group["block"][:1], "keys": pa.array([keys], pa.list_(pa.int64())), "bodies": pa.array([bodies], pa.list_(pa.binary()))})

    packed = dealt.select("band", "block", "key", "body").groupBy("band", "block").applyInArrow(pack, "band int, block string, keys array<long>, bodies array<binary>")
    return stage(packed, name)


def _compare(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Forests of the links between the blocks of each pair (band, i, other, j)."""
    left = pairs.join(blocks.select("band", F.col("block").alias("i"), F.col("keys").alias("ka"), F.col("bodies").alias("ba")), ["band", "i"])
    both = left.join(blocks.select(F.col("band").alias("other"), F.col("block").alias("j"), F.col("keys").alias("kb"), F.col("bodies").alias("bb")), ["other", "j"])

    def compare(batches):
        for batch in batches:
            for ka, ba, kb, bb in zip(*(batch[c].to_pylist() for c in ("ka", "ba", "kb", "bb"))):
                found = block_links(_unpack(ka, ba), _unpack(kb, bb), percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return both.select("ka", "ba", "kb", "bb").mapInArrow(compare, "a long, b long")


#: A set links with none that is more than this many size classes away (two, as rounding of the
#: logarithm can put a set on the edge into the next class).
REACH = 2


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (band, ...) with those of ``right`` (other, ...) of bands in reach."""
    ask = left.withColumn("other", F.explode(F.array(*[F.col("band") + d for d in range(-REACH, REACH + 1)])))
    return ask.join(right, "other")


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of about ``BLOCK`` sets, by hash of key inside a band."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # A row for each size class, of which there are a few dozen.
    dealt = rows.join(F.broadcast(sizes), "band").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("string"))
    return _packed(dealt, name)


def _full_sets(sets: DataFrame, percent: int) -> DataFrame:
    """key, n, body, band of the full sets."""
    full = sets.filter("full").groupBy("key").agg(F.min("n").alias("n"), F.first("body").alias("body"))
    step = float(np.log(100 / percent))
    return stage(full.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step).cast("int")), "op8-full")


def _full_links(full: DataFrame, percent: int) -> DataFrame:
    """Links within blocks of full sets, as stars around the least key of each group, and among
    those of different blocks."""

    def group(batches):
        for batch in batches:
            for keys, bodies in zip(batch["keys"].to_pylist(), batch["bodies"].to_pylist()):
                x = _unpack(keys, bodies)
                head = {k: k for k in keys}
                for a, b in block_links(x, x, percent):  # a forest: following it upwards ends
                    while head[a] != a:
                        a = head[a]
                    while head[b] != b:
                        b = head[b]
                    head[max(a, b)] = min(a, b)
                for k in keys:
                    while head[k] != head[head[k]]:
                        head[k] = head[head[k]]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([head[k] for k in keys], pa.int64())], names=["key", "head"])

    within = stage(_dealt(full, "op8-first").select("keys", "bodies").mapInArrow(group, "key long, head long"), "op8-within")
    heads = _dealt(full.join(within.filter("key = head").select("key"), "key"), "op8-heads")
    names = heads.select("band", F.col("block").alias("i"))
    pairs = _near(names, heads.select(F.col("band").alias("other"), F.col("block").alias("j"))).filter("band < other or (band = other and i <= j)")
    return within.filter("key != head").select(F.col("head").alias("a"), F.col("key").alias("b")).unionByName(_compare(pairs, heads, percent))


def _full_apart(full: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between full sets that ``roots`` (node, root) holds apart. A large group has blocks
    of its own, which meet those of other groups only; small groups share blocks."""
    owned = full.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    per = stage(owned.groupBy("band", "root").agg(F.count("*").alias("n")), "op8-groups")
    if per.select("root").distinct().limit(2).count() < 2:
        return full.sparkSession.createDataFrame([], "a long, b long")
    large = per.filter(F.col("n") >= BLOCK).select("band", "root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = per.filter(F.col("n") < BLOCK).groupBy("band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("mixed"))
    dealt = owned.join(large, ["band", "root"], "left").join(F.broadcast(rest), "band", "left")
    own = F.concat_ws("/", F.col("root").cast("string"), F.pmod(F.xxhash64("key"), "blocks").cast("string"))
    block = F.when(F.col("blocks").isNotNull(), own).otherwise(F.concat(F.lit("m"), F.pmod(F.xxhash64("root"), "mixed").cast("string")))
    blocks = _packed(dealt.withColumn("block", block), "op8-apart")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = lambda n: F.concat(F.lit("m"), F.col(n).cast("string"))
    as_other = lambda rows, n: rows.withColumnsRenamed({"band": "other", **{x: f"{x}_2" for x in n}})
    groups = _near(large, as_other(large, ["root", "blocks"])).filter("root < root_2")
    groups = groups.select("band", "other", "root", "root_2", "blocks_2", number("blocks").alias("x")).select("band", "other", F.concat_ws("/", "root", "x").alias("i"), F.col("root_2"), number("blocks_2").alias("y"))
    groups = groups.select("band", "i", "other", F.concat_ws("/", "root_2", "y").alias("j"))
    some = _near(large, as_other(rest, [])).select("band", "other", "root", "blocks", number("mixed").alias("y"))
    some = some.select("band", "other", "root", "y", number("blocks").alias("x")).select("band", F.concat_ws("/", "root", "x").alias("i"), "other", named("y").alias("j"))
    few = _near(rest, as_other(rest, ["mixed"])).filter("band <= other").select("band", "other", "mixed_2", number("mixed").alias("x"))
    few = few.select("band", "other", "x", number("mixed_2").alias("y")).filter("band < other or x <= y").select("band", named("x").alias("i"), "other", named("y").alias("j"))
    return _compare(groups.unionByName(some).unionByName(few), blocks, percent)


def jaccard_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, th, n_shingles, component_id, root (number of the
    component; documents without shingles share one and are no group)."""
    own = keyed(docs)
    often = frequent_tokens(own, n, min(COUNTED, frequent))
    sets = stage(_sets(own, n, percent, often, frequent), "op8-sets")
    tokens = sets.agg(F.sum(F.size("toks"))).first()[0] or 0
    grouped = _pairs(sets, parts_for(tokens, 400_000, 12), percent, hot).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("la").alias("la"), F.min("lb").alias("lb"))
    sent = lambda m, l: F.col(m) - F.ceil(F.col(m) * percent / 100.0 - 1e-9) + F.col(l)
    rest = F.greatest(F.col("na") - sent("na", "la"), F.col("nb") - sent("nb", "lb"))
    enough = (F.col("c") >= F.least("la", "lb")) & ((100 + percent) * (F.col("c") + rest) >= percent * (F.col("na") + F.col("nb")))
    pairs = stage(grouped.filter(enough).select("a", "b"), "op8-pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    rows = sets.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    rows = stage(rows.join(wanted, "key").select("key", "r.doc_id", "r.th"), "op8-rows")
    # A sort-merge join at every size: these sides grow with the documents.
    texts = own.join(rows.hint("merge"), same_row(own, rows)).select("key", "text").dropDuplicates(["key"])

    def bodies_of(batches):
        for batch in batches:
            sets = token_sets(tk.text_bytes(batch["text"]), n)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "body"])

    bodies = stage(texts.mapInArrow(bodies_of, "key long, body binary"), "op8-bodies")
    near = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links, full = _verify(near, bodies, percent), _full_sets(sets, percent)
    held = bool(full.limit(1).count())
    links = stage(links.unionByName(_full_links(full, percent)) if held else links, "op8-links")
    roots = stage(components(links), "op8-roots")
    left = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    left = left.filter("ra is null or rb is null or ra != rb").select("a", "b")
    more = _verify(left.join(near.withColumn("done", F.lit(1)), ["a", "b"], "left_anti"), bodies, percent)
    more = stage(more.unionByName(_full_apart(full, roots, percent)) if held else more, "op8-more")
    if more.limit(1).count():
        roots = stage(components(links.unionByName(more)), "op8-roots")
    owner = sets.groupBy("key").agg(F.min("doc_id").alias("first"))
    classes = owner.join(roots, owner["key"] == roots["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    classes = stage(classes, "op8-classes")
    least = stage(classes.groupBy("root").agg(F.min("first").alias("component_id")), "op8-least")
    named = stage(classes.join(least, "root").select("key", "component_id", "root"), "op8-named")
    out = sets.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "key").join(named, "key")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("th", "root")


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), links AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS root FROM w UNION SELECT b, root FROM r JOIN links ON a = doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON w.doc_id = c.doc_id
"""
