"""op2: exact inner-product top-k by branch and bound over one ball tree per shard.

Vectors are dealt to shards by id; each shard becomes one row that holds its ball tree.
Queries are packed into blocks. A block first searches one shard, which gives every query
a k-th score; that score goes along to all other shards, where a node is entered only by
the queries whose upper bound ``q.c + |q| r`` reaches it. Work and traffic are those of a
stated query set against all rows in blocks; nothing is broadcast or collected.

Scores are exact: products are of integers, in float32 or float64 while they stay below 2**24
or 2**53, in int64 below 2**63 and in Python's integers beyond; a score that no long can hold
is the nearest long, and such scores tie.

Shards grow with the table (``shard_size``), so that a block's traffic, its queries once to
every shard, stays small against the products. Vectors travel in the least integer type that
holds them.

Rows: vectors that are null, empty or hold a null or non-finite component take no part (nor do
those of which a component is too large to be scaled), nor do rows without id. A row that repeats (same id, same vector) counts once; rows of the
query's own id are not its candidates. Only vectors of the query's length are compared.
Ties go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import parts_for, stage, table

K = 20
SCALE = 64
QUERY_STEP = 20
SHARD_ROWS = 8192
SHARD_MOST = 1 << 17
SHARDS = 256
LEAF = 256
SHARDS_PER_BLOCK = 4


class BallTree:
    """Vectors in leaf order with nodes (lo, hi, centre, radius, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf, self.order, self.nodes = leaf, np.arange(len(ids)), []
        self._split(vectors, 0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _split(self, v: np.ndarray, lo: int, hi: int) -> int:
        own = v[self.order[lo:hi]].astype(np.float64)
        centre = own.mean(axis=0)
        # Widened a little, so that rounding never cuts off a point on the rim.
        with np.errstate(over="ignore"):
            radius = np.sqrt(((own - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9) + 1e-9
        at = len(self.nodes)
        self.nodes.append([lo, hi, centre, radius, -1, -1])
        if hi - lo > self.leaf and radius > 1e-6:
            side = own[:, own.var(axis=0).argmax()].argsort(kind="stable")
            self.order[lo:hi] = self.order[lo:hi][side]
            mid = (lo + hi) // 2
            self.nodes[at][4] = self._split(v, lo, mid)
            self.nodes[at][5] = self._split(v, mid, hi)
        return at


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as int64 (what lies beyond is the nearest int64)."""
    most = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))
    top = most(q) * most(v) * q.shape[1]
    if top < 2**53:
        kind = np.float32 if top < 2**24 else np.float64
        return (q.astype(kind) @ v.astype(kind).T).astype(np.int64)
    if top < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object)
    exact = whole(q) @ whole(v).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
    """(query position, id, score) of all that may be in a query's top k, given that k
    candidates elsewhere reach ``floor``; ``floor`` is raised in place.

    Nodes are taken in order of their upper bound (the greatest over the block's queries), each
    by the queries whose own bound still reaches their k-th score.
    """
    none = np.iinfo(np.int64).min
    best = np.full((len(q), k), none)
    wide = q.astype(np.float64)
    with np.errstate(over="ignore"):
        norm = np.sqrt((wide**2).sum(axis=1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _, _ = tree.nodes[node]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = wide[active] @ centre + norm[active] * radius
        # A sum too large for a float bounds nothing.
        return np.where(np.isfinite(reach), reach + np.abs(reach) * 1e-9 + 1e-6, np.inf)

    every = np.arange(len(q))
    heap = [(0.0, 0, every, np.full(len(q), np.inf))]
    while heap:
        _, node, active, reach = heapq.heappop(heap)
        active = active[reach >= floor[active]]
        if not len(active):
            continue
        lo, hi, _, _, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                reach = bound(child, active)
                heapq.heappush(heap, (-reach.max(), child, active, reach))
            continue
        step = max(1, (1 << 22) // max(1, hi - lo))
        for part in (active[i : i + step] for i in range(0, len(active), step)):
            got = scores(q[part], tree.vectors[lo:hi])
            got[ids[part][:, None] == tree.ids[lo:hi][None, :]] = none
            both = np.concatenate([best[part], got], axis=1)
            best[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            floor[part] = np.maximum(floor[part], best[part].min(axis=1))
            row, col = np.nonzero((got >= floor[part][:, None]) & (got > none))
            found.append((part[row], tree.ids[lo:hi][col], got[row, col]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row, cand, score = (np.concatenate(x) for x in zip(*found))
    keep = score >= floor[row]
    row, cand, score = row[keep], cand[keep], score[keep]
    order = np.lexsort((cand, -score, row))
    row, cand, score = row[order], cand[order], score[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], cand[keep], score[keep]


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v (array<double> of the integers floor(scale * x)): the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    # floor() gives a long, and a double from 2**53 on is whole already.
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter(usable)
        .filter(~bad)
        .select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("v"))
        .dropDuplicates(["vec_id", "dim", "v"])
    )


def _pack(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ids and the matrix of a group's vectors, by id."""
    ids = batch["vec_id"].to_numpy()
    flat = batch["v"].combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    v = flat.flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*v.T[:1], ids))
    return ids[order], least_type(v[order])


def least_type(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the least integer type that holds them; as floats from 2**53 on."""
    top = float(np.abs(v).max(initial=0))
    for kind, most in ((np.int16, 2**15), (np.int32, 2**31), (np.int64, 2**53)):
        if top < most:
            return v.astype(kind)
    return v


def shard_size(rows: int) -> int:
    """Rows of a shard: the table in about ``SHARDS`` of them, within bounds of memory."""
    return min(SHARD_MOST, max(SHARD_ROWS, rows // SHARDS))


def _tree(group: pa.Table) -> pa.Table:
    ids, v = _pack(group)
    return pa.table({"dim": pa.array([group["dim"][0].as_py()], pa.int32()), "shard": pa.array([group["shard"][0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(BallTree(ids, v))], pa.binary())})


def _block(group: pa.Table) -> pa.Table:
    ids, v = _pack(group)
    floor = np.full(len(ids), np.iinfo(np.int64).min)
    return pa.table({"dim": pa.array([group["dim"][0].as_py()], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int32()), "home": pa.array([min(group["shard"].to_pylist())], pa.int32()), "queries": pa.array([pickle.dumps((ids, v, floor))], pa.binary())})


def _search_rows(pairs: DataFrame, k: int) -> DataFrame:
    """dim, block, query_id, vec_id, score and, on the first row of a pair, the block with
    the floors as they are now."""

    def run(batches):
        floors: dict = {}
        for batch in batches:
            for dim, block, tree, queries in zip(*(batch[c].to_pylist() for c in ("dim", "block", "tree", "queries"))):
                ids, v, floor = pickle.loads(queries)
                if (dim, block) in floors:
                    floor = np.maximum(floor, floors[dim, block])
                row, cand, score = search(pickle.loads(tree), ids, v, floor, k)
                floors[dim, block] = floor
                n = len(row)
                out = [pickle.dumps((ids, v, floor)), *[None] * n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * (n + 1), pa.int32()), pa.array([block] * (n + 1), pa.int32()), pa.array([None, *ids[row].tolist()], pa.int64()), pa.array([None, *cand.tolist()], pa.int64()), pa.array([None, *score.tolist()], pa.int64()), pa.array(out, pa.binary())],
                    names=["dim", "block", "query_id", "vec_id", "score", "queries"],
                )

    return pairs.select("dim", "block", "tree", "queries").mapInArrow(run, "dim int, block int, query_id long, vec_id long, score long, queries binary")


def top_k(vectors: DataFrame, is_query, k: int = K, shard_rows: int | None = None) -> DataFrame:
    """vectors (vec_id, dim, v) -> query_id, rank, vec_id, score for rows where ``is_query``."""
    vectors = stage(vectors, "op2-vectors")
    rows = vectors.count()
    shards = parts_for(rows, shard_rows or shard_size(rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = stage(dealt.groupBy("dim", "shard").applyInArrow(_tree, "dim int, shard int, tree binary"), "op2-trees")
    asked = dealt.filter(is_query).withColumn("block", F.floor(F.col("shard") / SHARDS_PER_BLOCK).cast("int"))
    blocks = asked.groupBy("dim", "block").applyInArrow(_block, "dim int, block int, home int, queries binary")
    first = stage(_search_rows(blocks.join(trees.withColumnRenamed("shard", "home"), ["dim", "home"]), k), "op2-first")
    again = first.filter("queries is not null").select("dim", "block", "queries")
    homes = blocks.select("dim", "block", "home")
    spread = again.join(homes, ["dim", "block"]).select("dim", "block", "queries", "home", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).filter("shard != home")
    rest = _search_rows(spread.join(trees, ["dim", "shard"]), k)
    hits = first.unionByName(rest).filter("query_id is not null").select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings"), SCALE), F.col("vec_id") % QUERY_STEP == 0)


SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {QUERY_STEP} = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
