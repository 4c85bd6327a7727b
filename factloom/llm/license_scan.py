"""op3: license scan by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a text is hashed and joined to the pairs of the license
templates (a fixed table of a few hundred rows, broadcast). A hit votes for the diagonal
``word position - template position``. Votes are a bit set of template positions, so
repeated hits count once. A diagonal with all positions is the template word for word
(hits compare the words, not hashes alone). Neighbouring diagonals (an inserted or missing
word) merge. A merged span is verified before it counts: template positions are taken in
order, each at its first place in the text, and only places behind all earlier ones count, so
words out of order do not; the stretch may have twice the template's words at most. What no
merged span shows, its best diagonal alone may. A span (or diagonal) that covers enough of a
longer template gives its label too.

Each text adds one sentinel pair that joins a sentinel template. It carries the text's word
count and number of rows through the join, so the texts are read once and never shuffled.

Rows: null and empty texts have no words, null positions, empty labels and score 0; repeated
rows come out as often as they came in; ids may be null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import table

#: The phrases of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Well-known sentences of public licenses, for the method's own labels.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "you should have received a copy of the gnu general public license along with this program if not see": "gpl",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
COVER = 0.7
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, base, pairs, position, word, next word); template -1 is the sentinel."""
    rows = [(-1, "", False, 1, 0, "", "")]
    for t, (phrase, label) in enumerate([*BASE.items(), *SENTENCES.items()]):
        words = phrase.split()
        rows += [(t, label, phrase in BASE, len(words) - 1, i, *words[i : i + 2]) for i in range(len(words) - 1)]
    return rows


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {base}, {pairs}, {pos}, '{a}', '{b}')" for t, label, base, pairs, pos, a, b in template_rows())


def templates(spark: SparkSession) -> DataFrame:
    made = spark.sql(f"SELECT * FROM VALUES {_values()} AS t(tpl, label, base, pairs, pos, wa, wb)")
    return made.withColumns({"h": F.xxhash64("wa", "wb"), "vote": F.expr("shiftleft(1L, pos)")})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP, -1), "")


def verified(diagonals: Column, pairs: Column) -> Column:
    """Template positions of a merged span that stand in the text in the template's order."""
    voted = lambda p: F.filter(diagonals, lambda x: x["votes"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p)) != 0)
    place = lambda p: F.array_min(F.transform(voted(p), lambda x: x["diagonal"] + p))
    places = F.transform(F.sequence(F.lit(0), pairs - 1), place)
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("n"), none.alias("first"), none.alias("last"))

    def step(acc: Column, at: Column) -> Column:
        later = at.isNotNull() & (acc["last"].isNull() | (at > acc["last"]))
        return F.when(later, F.struct((acc["n"] + 1).alias("n"), F.coalesce(acc["first"], at).alias("first"), at.alias("last"))).otherwise(acc)

    chain = F.aggregate(places, start, step, lambda acc: F.when(acc["last"] - acc["first"] < 2 * pairs, acc["n"]).otherwise(0))
    return F.greatest(chain, F.array_max(F.transform(diagonals, lambda x: F.bit_count(x["votes"]))))


def license_scan(docs: DataFrame, cover: float = COVER) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (label, first word, coverage of the merged spans)."""
    body = F.coalesce("text", F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), words_of(body).alias("w"))
    sentinel = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    rows = words.select("doc_id", "th", F.size("w").alias("n_words"), F.posexplode(F.concat(sentinel, F.coalesce(pairs, F.array().cast("array<struct<a:string,b:string>>")))).alias("at", "p"))
    rows = rows.select("doc_id", "th", "n_words", (F.col("at") - 1).alias("at"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    rows = rows.withColumn("h", F.xxhash64("a", "b"))
    tpl = F.broadcast(templates(docs.sparkSession))
    hits = rows.join(tpl, (rows["h"] == tpl["h"]) & (rows["a"] == tpl["wa"]) & (rows["b"] == tpl["wb"])).drop("h")
    who = ["doc_id", "th", "n_words"]
    diagonals = hits.groupBy(*who, "tpl", "label", "base", "pairs", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.bit_or("vote").alias("votes"), F.count("*").alias("rows")
    )
    near = Window.partitionBy("doc_id", "th", "tpl").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= 1, 0).otherwise(1)
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(near))
    exact = F.col("base") & (F.bit_count("votes") == F.col("pairs"))
    spans = merged.groupBy(*who, "tpl", "label", "base", "pairs", "span").agg(
        F.collect_list(F.struct("diagonal", "votes")).alias("diagonals"), F.min("diagonal").alias("first"), F.sum("rows").alias("rows"), F.sum(exact.cast("long")).alias("places"), F.min(F.when(exact, F.col("diagonal"))).alias("lo"), F.max(F.when(exact, F.col("diagonal"))).alias("hi")
    )
    covered = F.when(F.col("tpl") >= 0, verified(F.col("diagonals"), F.col("pairs")) / F.col("pairs"))
    spans = spans.withColumn("covered", covered)
    covered = F.col("covered")
    # Parts of a phrase of two or three words say nothing; longer templates may miss some words.
    counts = (F.col("tpl") >= 0) & ((F.col("places") > 0) | ((F.col("pairs") >= 4) & (covered >= cover)) | (~F.col("base") & (covered == 1)))
    out = spans.groupBy(*who).agg(
        F.coalesce(F.sum(F.when(F.col("tpl") == -1, F.col("rows"))), F.lit(0)).alias("copies"),
        F.sum("places").alias("n_base"),
        F.min("lo").cast("long").alias("first_word"),
        F.max("hi").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(counts, F.col("label"))))).alias("labels"),
        F.max(F.when(counts, covered).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(counts, F.struct("first", "label", covered.alias("cover"))))).alias("spans"),
    )
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_values()}) AS v(tpl, label, base, pairs, pos, wa, wb) WHERE tpl >= 0),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM docs
), pairs AS (
  SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM words
), diagonals AS (
  SELECT doc_id, tpl, label, base, pairs, i - pos AS diagonal, bit_or(1::BIGINT << pos) AS votes
  FROM pairs JOIN t ON a = wa AND b = wb GROUP BY ALL
), steps AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= 1 THEN 0 ELSE 1 END AS apart
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, tpl ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) AS span,
         base AND bit_count(votes) = pairs AS exact
  FROM steps
), spots AS (
  SELECT doc_id, tpl, span, pairs, p, min(diagonal + p) AS spot
  FROM (SELECT *, unnest(range(pairs)) AS p FROM numbered) WHERE votes & (1::BIGINT << p) <> 0 GROUP BY ALL
), ordered AS (
  SELECT *, coalesce(spot > max(spot) OVER (PARTITION BY doc_id, tpl, span ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS later FROM spots
), chains AS (
  SELECT doc_id, tpl, span, CASE WHEN max(spot) FILTER (later) - min(spot) FILTER (later) < 2 * any_value(pairs) THEN count(*) FILTER (later) ELSE 0 END AS n
  FROM ordered GROUP BY ALL
), spans AS (
  SELECT s.doc_id, s.tpl, label, base, pairs, span, greatest(any_value(n), max(bit_count(votes))) AS n,
         count(*) FILTER (exact) AS places, min(diagonal) FILTER (exact) AS lo, max(diagonal) FILTER (exact) AS hi
  FROM numbered s JOIN chains USING (doc_id, tpl, span) GROUP BY ALL
), judged AS (
  SELECT *, places > 0 OR (pairs >= 4 AND n / pairs >= {COVER}) OR (NOT base AND n = pairs) AS counts FROM spans
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(sum(places), 0) AS BIGINT) AS n_base,
       CAST(min(lo) AS BIGINT) AS first_word, CAST(max(hi) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counts), '') AS labels,
       coalesce(max(n / pairs) FILTER (counts), 0.0::DOUBLE) AS score
FROM docs d LEFT JOIN judged j ON d.doc_id = j.doc_id
GROUP BY d.doc_id, d.w
"""
