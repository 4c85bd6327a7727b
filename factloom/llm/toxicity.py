"""op7: toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers letters, strips accents, maps look-alike letters of other scripts and digits
or signs that stand for letters in words (anywhere in a word of letters and such signs, but for
``!`` and ``|`` at its end; else between letters), and turns all else into single spaces. The
lexicon is learned from at most ``SAMPLE`` labelled documents: folded words and stems
(beginnings of words) whose log odds of standing in a toxic document are high; a term is
left out where a shorter one says as much. Phrases around a term that stand in clean
documents only are its exceptions: they take the term's weight back where they match. The sum
of weights is normalised by length, and a logistic curve fitted on the same sample makes it
a score.

Rows: null and empty texts have no match and get the curve's value for none; texts of any
length are matched whole; null ids are scored and never held out; without any label all
scores are 0.5 less a little (predicted 0); an empty table gives no rows; no other column
of ``docs`` is read.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.labelled import held_out, learn, training_rows

SAMPLE = 4000
STEMS = range(4, 10)
LEAST_DOCS = 4
LEAST_ODDS = 2.0
EXCEPTION_DOCS = 3
MOD, REST = 5, 0

#: Look-alike letters of other scripts, and what stands for a letter.
LOOK_ALIKES = "аaеeоoрpсcуyхxіiјjѕsԁdһhԛqԝwвbкkмmнhтtαaβbεeιiκkνvοoρpτtυuχxωw"
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_PAIRS = dict(zip(LOOK_ALIKES[::2], LOOK_ALIKES[1::2]))
_SIGNS = re.escape("".join(STAND_INS))
#: A word of letters and stand-ins with at least one of these. Possessive, from its start only: linear in the text.
_MIXED = re.compile(rf"(?<![\w{_SIGNS}])[a-z]*+[{_SIGNS}][a-z{_SIGNS}]*+(?!\w)")
_INSIDE = re.compile(rf"(?<=[a-z])[{_SIGNS}]+(?=[a-z])|(?<!\w)[{_SIGNS}](?=[a-z]{{2}})")
_LETTER = re.compile("[a-z]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_ASCII = {c: chr(c).lower() for c in range(65, 91)}
_STOOD_FOR = str.maketrans(STAND_INS)


def _mixed(m: re.Match) -> str:
    """A mixed word with its stand-ins folded; marks at its end stay, a number too."""
    core = m[0].rstrip("!|")
    return core.translate(_STOOD_FOR) + m[0][len(core) :] if _LETTER.search(core) else m[0]


class _Fold(dict):
    """Character map for str.translate, filled as characters are met."""

    def __missing__(self, code: int):
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        self[code] = "".join(_PAIRS.get(x, x) for x in base)
        return self[code]


_FOLD = _Fold(_ASCII)


def fold(text: str) -> str:
    """Folded words with single spaces between and around them."""
    text = text.lower() if text.isascii() else text.translate(_FOLD)
    text = _INSIDE.sub(lambda m: m[0].translate(_STOOD_FOR), _MIXED.sub(_mixed, text))
    return " " + _NOT_LETTERS.sub(" ", text).strip() + " "


def _lexicon(folded: list[str], y: np.ndarray) -> dict[str, float]:
    """Terms with weights. ``" word "`` is a whole word, ``" stem"`` a beginning."""
    counts = (Counter(), Counter())
    for text, label in zip(folded, y):
        words = set(text.split())
        terms = {f" {w} " for w in words if len(w) > 2}
        terms |= {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}
        counts[int(label)].update(terms)
    toxic, clean = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    odds = {t: float(np.log((n + 0.5) / toxic) - np.log((counts[0][t] + 0.5) / clean)) for t, n in counts[1].items() if n >= LEAST_DOCS}
    found = {t: v for t, v in odds.items() if v >= LEAST_ODDS}
    out: dict[str, float] = {}
    for t in sorted(found, key=lambda t: (len(t), t)):
        shorter = [t[:k] for k in range(3, len(t)) if t[:k] in out]
        if not shorter or found[t] > max(out[s] for s in shorter) + 2:
            out[t] = found[t]
    return out


def _spans(words: list[str], i: int) -> list[str]:
    """Phrases of two and three words around word i."""
    out = []
    for a, b in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2)):
        if a >= 0 and b <= len(words):
            out.append(" " + " ".join(words[a:b]) + " ")
    return out


def automaton(lexicon: dict[str, float], exceptions: dict[str, float]):
    """Aho-Corasick automaton: a term adds its weight, an exception phrase takes it back."""
    a = ahocorasick.Automaton()
    weights: dict[str, float] = defaultdict(float)
    for t, w in lexicon.items():
        weights[t] += w
    for t, w in exceptions.items():
        weights[t] -= w
    for t, w in weights.items():
        a.add_word(t, w)
    if weights:
        a.make_automaton()
    return a


def evidence(a, text: str) -> tuple[float, float]:
    """Sum of weights and its share a word, both dampened."""
    total = max(0.0, sum(w for _, w in a.iter(text))) if len(a) else 0.0
    words = max(1, text.count(" ") - 1)
    return np.log1p(total), np.log1p(100 * total / words)


def fit(texts: list[str], y: np.ndarray) -> bytes:
    folded = [fold(t) for t in texts]
    lexicon = _lexicon(folded, y)
    phrases = (Counter(), Counter())
    whole = {t.strip() for t in lexicon if t.endswith(" ")}
    stems = tuple(t[1:] for t in lexicon if not t.endswith(" "))
    for text, label in zip(folded, y):
        words = text.split()
        hits = [i for i, w in enumerate(words) if w in whole or (stems and w.startswith(stems))]
        phrases[int(label)].update({p for i in hits for p in _spans(words, i)})
    plain = automaton(lexicon, {})
    clean = [p for p, n in phrases[0].items() if n >= EXCEPTION_DOCS and not phrases[1][p]]
    exceptions = {p: sum(w for _, w in plain.iter(p)) for p in clean}
    a = automaton(lexicon, exceptions)
    x = np.array([evidence(a, t) for t in folded]).reshape(-1, 2)
    x = np.column_stack([x, x[:, 0] > 0, np.ones(len(x))])
    w = np.zeros(4)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return pickle.dumps((lexicon, exceptions, w.tolist()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, model: bytes | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted."""
    model = model or learn(training_rows(docs, labels, "toxic", MOD, REST, most), fit)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.loads(model) if model else ({}, {}, [0.0, 0.0, 0.0, -1e-6]))
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), MOD, REST).alias("held_out"))

    def run(batches):
        lexicon, exceptions, w = sent.value
        a = automaton(lexicon, exceptions)
        for batch in batches:
            score = []
            for text in batch["text"].to_pylist():
                x, density = evidence(a, fold(text or ""))
                z = float(np.clip(x * w[0] + density * w[1] + (x > 0) * w[2] + w[3], -500, 500))
                score.append(1 / (1 + np.exp(-z)))
            score = np.array(score)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
