"""Full-text search, prefix search, look-alikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import letter_pairs

#: The usual BM25 parameters.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case words of letters, marks and digits, in any script."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda w: F.lower(w))


def bm25(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, text) to (id, score) of documents with all terms, by BM25.

    One scan counts words and terms of each document beside its row; the corpus
    counts are one aggregation.  No postings of other words are made.
    """
    words = docs.select("id", tokens(F.col("text")).alias("_w"))

    def times(term: str) -> Column:
        return F.size(F.filter("_w", lambda x: x == F.lit(term)))

    counted = words.select("id", F.size("_w").alias("_len"), *(times(t).alias(f"_t{k}") for k, t in enumerate(terms)))
    c = counted.agg(F.count("*").alias("_docs"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_t{k}") > 0).alias(f"_n{k}") for k in range(len(terms))))
    j = counted.where(" AND ".join(f"_t{k} > 0" for k in range(len(terms)))).join(F.broadcast(c))  # the counts are one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.log((F.col("_docs") - F.col(f"_n{k}") + 0.5) / (F.col(f"_n{k}") + 0.5) + 1)
        tf = F.col(f"_t{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return j.select("id", score.alias("score"))


def prefix_search(words: DataFrame, query: str, most: int = 40) -> DataFrame:
    """(word, n) to the words that are or begin with `query`: tier 0 exact, 1 the same but for case, 2 prefix; by length, then commonest."""
    tier = F.when(F.col("word") == query, 0).when(F.lower("word") == query.lower(), 1).when(F.lower("word").startswith(query.lower()), 2)
    return words.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.length("word"), F.desc("n"), "word").limit(most)


def look_alikes(words: DataFrame, probes: DataFrame, least: float = 0.3, apart: int = 3, most: int = 5) -> DataFrame:
    """(word) twice to (probe, word, dice, rank): Dice over letter pairs, lengths no more than `apart` apart."""
    from .relational import top_by

    w = words.select("word", letter_pairs(F.lower("word")).alias("_p")).select("word", F.size("_p").alias("_n"), F.explode("_p").alias("_e"))
    p = probes.select(F.col("word").alias("probe"), letter_pairs(F.lower("word")).alias("_q")).select("probe", F.size("_q").alias("_m"), F.explode("_q").alias("_e"))
    same = p.join(w, "_e").where((F.col("probe") != F.col("word")) & (F.abs(F.length("probe") - F.length("word")) <= apart))
    dice = same.groupBy("probe", "word").agg(F.round(2 * F.count("*") / (F.max("_n") + F.max("_m")), 6).alias("dice")).where(F.col("dice") >= least)
    return top_by(dice, ["probe"], [F.desc("dice"), F.col("word")], most)
