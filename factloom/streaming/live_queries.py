"""Live queries over a stream of facts: impact test, shared evaluation, diffs, size guard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.live import fingerprint, query_diff
from factloom.operators.log import DELETE

MAX_ROWS = 250
CACHE = 256


class ResultTooLarge(ValueError):
    pass


@dataclass
class LiveQuery:
    plan_key: str
    table: str
    page: Callable[[int], DataFrame]  # LSN -> page (key, lsn, value)
    impact: Column | None = None  # which upserts can change the page; None: all
    result_id: str = ""
    rows: DataFrame | None = None
    keys: set[str] = field(default_factory=set)


class LiveQueries:
    """Queries by id. ``refresh`` is what a ``foreachBatch`` sink calls."""

    def __init__(self, most_rows: int = MAX_ROWS):
        self.queries: dict[str, LiveQuery] = {}
        self.cache: dict[tuple[int, str], tuple[str, DataFrame, set[str]]] = {}
        self.most_rows, self.evaluations = most_rows, 0

    def _evaluate(self, q: LiveQuery, lsn: int) -> tuple[str, DataFrame, set[str]]:
        """One evaluation for each (LSN, plan), however many queries share it."""
        if (lsn, q.plan_key) not in self.cache:
            rows = q.page(lsn).select("key", "lsn", "value").limit(self.most_rows + 1).collect()
            if len(rows) > self.most_rows:
                raise ResultTooLarge(f"more than {self.most_rows} rows")
            self.evaluations += 1
            spark = q.page(lsn).sparkSession
            page = spark.createDataFrame(rows, "key string, lsn long, value string") if rows else spark.createDataFrame([], "key string, lsn long, value string")
            while len(self.cache) >= CACHE:
                self.cache.pop(next(iter(self.cache)))
            self.cache[lsn, q.plan_key] = (fingerprint(page).first()["result_id"], page, {r["key"] for r in rows})
        return self.cache[lsn, q.plan_key]

    def subscribe(self, query_id: str, q: LiveQuery, lsn: int, resume: str | None = None) -> DataFrame | None:
        """The snapshot page; None if the subscriber already has this result."""
        q.result_id, q.rows, q.keys = self._evaluate(q, lsn)
        self.queries[query_id] = q
        return None if resume == q.result_id else q.rows

    def affected(self, batch: DataFrame) -> list[str]:
        """Queries the batch may change: deletes of the table, upserts that pass the impact
        test, or any fact on a key of the last page."""
        if not self.queries:
            return []
        tests = []
        for n, q in enumerate(self.queries.values()):
            upsert = F.lit(True) if q.impact is None else q.impact
            on_page = F.col("key").isin(*q.keys) if q.keys else F.lit(False)
            tests.append(F.coalesce(F.max((F.col("tbl") == q.table) & ((F.col("kind") == DELETE) | upsert | on_page)), F.lit(False)).alias(f"q{n}"))
        hit = batch.agg(*tests).first()
        return [i for n, i in enumerate(self.queries) if hit[f"q{n}"]]

    def refresh(self, batch: DataFrame, lsn: int) -> dict[str, DataFrame]:
        """Diffs of the queries whose result changed; the others send nothing."""
        out = {}
        deletes = batch.filter(F.col("kind") == DELETE).groupBy("key").agg(F.max("lsn").alias("lsn"))
        for query_id in self.affected(batch):
            q = self.queries[query_id]
            before, old = q.rows, q.result_id
            q.result_id, q.rows, q.keys = self._evaluate(q, lsn)
            if q.result_id != old:
                out[query_id] = query_diff(before, q.rows, deletes)
        return out
