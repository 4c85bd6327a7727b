"""A training-data pipeline over the documents table: five stages, each on one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate as op6
from factloom.llm import jaccard_join as op8
from factloom.llm import line_dedup as op4
from factloom.llm import mixing as op10
from factloom.llm import quality as op9
from factloom.llm.common import keyed, same_row, scratch, shared_dir, stage, table

#: Near-duplicate stage: five-word shingles, Jaccard similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score under 0.5).

    Null and empty texts are scored like others; repeated rows get the same score; rows without
    id or label are scored, not learned from; an empty table stays empty.
    """
    model = op9.train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    rows = docs.select("text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    kept = op9.score_table(rows, model).filter("score >= 0.5")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; documents stay, with what is left of their text.

    Null texts become empty ones; rows without id lose lines and keep none; rows of one id
    count as one document; n_chars follows the text. All columns but these two stay.
    """
    done = op4.line_dedup(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (least id) of each group of linked documents.

    Documents without words are linked with nothing and all stay, repeated ones too; of other
    rows that repeat (same id and text) one stays; rows without id stay only where no row of
    their group has one. Null texts become empty ones.
    """
    found = stage(op8.jaccard_components(docs, SHINGLE, PERCENT), "near-found")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    best = found.filter("n_shingles > 0").groupBy("root").agg(F.min(first).alias("r")).select("r.doc_id", "r.th")
    keep = stage(best, "near-keep")
    own = keyed(docs, carry=True)
    wordless = F.col("text").rlike(r"^[\x20\x09-\x0D]*$")
    worded = own.filter(~wordless)
    kept = worded.join(keep.hint("merge"), same_row(worded, keep)).select(*(worded[c] for c in worded.columns))
    # A repeated row is a copy of itself: one stays.
    kept = kept.dropDuplicates(["doc_id", "th"]).unionByName(own.filter(wordless))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; ids are not looked at.
    """
    return op6.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, taken, copies.

    Null and empty texts have size 0 and are taken 0 times; null sources are one source, the
    last; repeated rows are documents of their own; null ids stay null.
    """
    return op10.mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

#: The classifier, the latent search and the rounding are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with scratch(spark):  # what the operators staged goes once the stage's result is written
            done = fn(spark, docs, sf_dir)
            done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
