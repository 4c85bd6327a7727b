"""op9: quality classifier on supervised subword embeddings.

Word unigrams and bigrams and character n-grams (over UTF-8 bytes, A-Z lowered) hash to
buckets; each bucket has a learned vector, a document is the mean of its vectors, and a
softmax layer gives the classes. Trained by stochastic gradient descent in numpy on at
most ``SAMPLE`` labelled documents. Since the mean and the last layer are linear, each bucket's
contribution to the log odds is computed once; scoring whole texts is then one gather and
one sum an n-gram, whatever the vectors' length.

Rows: null and empty texts have no n-grams and get the classifier's prior; texts of any
length are scored whole; null ids are scored and never held out; without any label all
scores are 0.5; an empty table gives no rows; no other column of ``docs`` is read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textkit as tk
from factloom.llm.common import table
from factloom.llm.labelled import held_out, learn, training_rows
from factloom.llm.textkit import U

SAMPLE = 2000
BUCKETS = 1 << 16
DIM = 8
WIDTHS = (3, 5)
EPOCHS = 12
RATE = 0.5
MOD, REST = 3, 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket) of every n-gram of the texts."""
    w = tk.Words(texts)
    doc, h = [w.doc], [w.hash]
    if len(w) > 1:
        pair = w.doc[1:] == w.doc[:-1]
        doc.append(w.doc[1:][pair])
        h.append(tk.ngrams(w.hash, 2)[pair])
        again = pair & (w.hash[1:] == w.hash[:-1])  # a word that repeats is a feature by itself
        doc.append(w.doc[1:][again])
        h.append(np.full(int(again.sum()), 1 << 40, U))
    size = np.diff(w.offsets)
    owner = np.repeat(np.arange(len(texts)), size)
    for width in WIDTHS:
        if len(w.data) > width:
            start = np.arange(len(w.data) - width)
            inside = start + width < w.offsets[owner[: len(start)] + 1]  # the closing newline is no text
            doc.append(owner[: len(start)][inside])
            h.append(tk.windows(w.prefix, width)[: len(start)][inside])
    salted = [((x >> U(7)) + U(i * 0x9E3779B1)) & U(BUCKETS - 1) for i, x in enumerate(h)]
    return np.concatenate(doc), np.concatenate(salted).astype(np.int64)


def fit(texts: list[str], y: np.ndarray, seed: int = 11) -> bytes:
    """Log odds by bucket and the prior, as bytes."""
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "replace") for t in texts]
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in tk.blocks([len(t) for t in raw]):
        doc, bucket = features(raw[lo:hi])
        for i in range(hi - lo):
            b, n = np.unique(bucket[doc == i], return_counts=True)
            bags.append((b.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - steps / total)
            steps += 1
            b, share = bags[i]
            hidden = share @ vectors[b]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # A bucket holds a small share of its document; the root keeps its step visible.
            vectors[b] -= rate * np.sqrt(share)[:, None] * back
    return pickle.dumps(((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])))


def score_table(docs: DataFrame, model: bytes | None, schema: str = "score double") -> DataFrame:
    """docs (text first, then columns that are passed on) with ``score`` appended."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.loads(model) if model else None)
    rest = docs.columns[1:]

    def run(batches):
        for batch in batches:
            texts = tk.text_bytes(batch["text"])
            score = np.full(len(texts), 0.5)
            if sent.value is not None:
                weight, prior = sent.value
                for lo, hi in tk.blocks([len(t) for t in texts]):
                    doc, bucket = features(texts[lo:hi])
                    n = np.bincount(doc, minlength=hi - lo)
                    z = np.bincount(doc, weights=weight[bucket], minlength=hi - lo) / np.maximum(n, 1) + prior
                    score[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(score)], names=[*rest, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[1:])
    return docs.mapInArrow(run, f"{kept}, {schema}")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> bytes | None:
    return learn(training_rows(docs, labels, "quality", MOD, REST, most), fit)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted."""
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), MOD, REST).alias("held_out"))
    return score_table(rows, train(docs, labels, most)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
