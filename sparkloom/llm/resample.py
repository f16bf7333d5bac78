"""Importance resampling towards a target corpus, by integer scores.

Features of a text (runs of words) are hashed to a fixed number of buckets.  A bucket's gain is the log ratio of its share
among the target's features and among all documents'; a document's weight is the mean gain of its features, and
its score the weight with Gumbel noise of its id, so that the highest scores are a draw without replacement.  All are whole numbers.

The draw needs no global sort: scores are counted in a histogram, whose suffix sums say how many documents lie above each score; scores
that begin within the quota survive, and only within each of these are documents numbered by id.

Scale: gains are an array of as many numbers as there are buckets, a parameter of checked size, whatever the corpus; a
task counts its texts in one such array.  Scores lie between bounds that follow from the range of 64-bit counts and 32-bit
noise, so that the histogram has at most 250,000 rows.  A score with many documents is split by ranges of ids.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .exchange import NO_ID, doc_long
from .shared import stash

#: The buckets, the run length, the noise's seed and the quota of the contract.
BUCKETS, RUN, SEED, PERCENT, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: The most buckets: gains are sent to every worker.
MOST_BUCKETS = 1_000_000
#: Documents of one score that are numbered in one group, about.
GROUP = 1_000_000
#: The least significant bits of a score, which the second step of the suffix sums adds up.
LOW_BITS = 8

# letters and digits for themselves, A-Z lower-cased, whatever isn't ASCII as it is, all else a blank
_WORD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; a null text has none."""
    return text.encode().translate(_WORD).split() if text else []


def features_of(words: list[bytes], run: int) -> Iterator[bytes]:
    """All runs of 1 to `run` words, a blank between."""
    return chain(words, *(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) for n in range(2, run + 1)))


def buckets_of(words: list[bytes], buckets: int, run: int) -> np.ndarray:
    """The bucket of each feature."""
    return np.fromiter(map(zlib.crc32, features_of(words, run)), np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n) of all features of the column text: a row a bucket that has any.  Every task counts its texts in an array first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                found = buckets_of(words_of(x.as_py()), buckets, run)
                if len(found) < buckets // 8:
                    np.add.at(n, found, 1)
                else:
                    n += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(n[there], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, corpus: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from two counts of bucket_counts(): floor(1000 ln of the ratio of smoothed shares)."""
    both = target.withColumn("of", F.lit(0)).unionByName(corpus.withColumn("of", F.lit(1)))
    n = np.zeros((2, buckets))
    for r in both.collect():  # at most two rows a bucket
        n[r.of, r.bucket] = r.n
    (t, s), (all_t, all_s) = n, n.sum(axis=1)
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise_of(ids: list[str], seed: int = SEED) -> np.ndarray:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of seed:id."""
    h = np.array([int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) for i in ids], np.float64)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 2**32))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs (doc_id, text)."""
    of = docs.sparkSession.sparkContext.broadcast(gain)
    out = ("n_words", "n_features", "weight", "score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, weight = [], [], []
            for x in batch.column(2):
                words = words_of(x.as_py())
                at = buckets_of(words, len(of.value), run)
                n_words.append(len(words))
                n.append(len(at))
                weight.append(int(of.value[at].sum()) // len(at) if len(at) else 0)
            score = np.array(weight, np.int64) + noise_of(batch.column(1).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, weight, score))], ["doc_id", *out])

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    schema = StructType([docs.schema["doc_id"], *(StructField(x, LongType()) for x in out)])
    return docs.select("doc_id", name.cast(StringType()).alias("name"), "text").mapInArrow(score, schema)


def above(histogram: DataFrame) -> DataFrame:
    """(score, n) with `above`, the documents of higher scores: suffix sums over the scores' high bits, of which there
    are at most a thousand, and within each over the low ones."""
    h = histogram.withColumn("high", F.shiftright("score", LOW_BITS))
    upper = h.groupBy("high").agg(F.sum("n").alias("in_high"))
    upper = upper.select("high", (F.sum("in_high").over(Window.orderBy(F.desc("high"))) - F.col("in_high")).alias("over"))
    inside = F.sum("n").over(Window.partitionBy("high").orderBy(F.desc("score"))) - F.col("n")
    return h.join(F.broadcast(upper), "high").select("score", "n", (F.col("over") + inside).alias("above"))


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, group: int = GROUP) -> DataFrame:
    """A written table of scored() with `rank`, 1 for the highest score, for the floor(percent * N / 100) highest of the N rows
    of `least_words` words or more; ties go to smaller ids (null before all), then to fewer features; null for all others."""
    able = F.col("n_words") >= least_words
    histogram = stash(scores.where(able).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    quota = percent * (histogram.agg(F.sum("n")).first()[0] or 0) // 100
    survive = stash(above(histogram).where(F.col("above") < quota), "scores")
    most = survive.agg(F.max("n")).first()[0] or 0
    marked = scores.join(F.broadcast(survive.select("score", "above")), "score", "left")
    live = able & F.col("above").isNotNull()
    among = marked.where(live).withColumn("id", doc_long())
    parts = -(-most // group)
    # ranges of ids, so that no score is numbered in one piece; where exactly they are cut doesn't matter
    cuts = among.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or [] if parts > 1 else []
    at = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    among = among.withColumn("range", at)
    if cuts:
        ranges = among.groupBy("score", "range").agg(F.count("*").alias("size"))
        before = F.sum("size").over(Window.partitionBy("score").orderBy("range")) - F.col("size")
        ranges = ranges.select(F.col("score").alias("of_score"), F.col("range").alias("of_range"), before.alias("before"))
        among = among.join(ranges, (F.col("score") == F.col("of_score")) & (F.col("range") == F.col("of_range")))
    else:
        among = among.withColumn("before", F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("score", "range").orderBy("id", "n_features"))
    rank = F.col("above") + F.col("before") + place
    cols = scores.columns
    numbered = among.withColumn("rank", rank).select(*cols, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank"))
    return numbered.unionByName(marked.where(~live).select(*cols, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED, least_words: int = LEAST_WORDS, group: int = GROUP) -> DataFrame:
    """Takes docs (doc_id, a whole number, and text) and target (text); returns a row per row of
    docs: doc_id, n_words, n_features, weight, score and rank (null where not drawn).

    Null or empty text, or no words: no features, weight 0, never drawn.  A null id has the noise of an empty
    string and comes before others of its score.  Repeated rows are rows of their own and are drawn each.  Without
    target texts, gains still tell frequent buckets from rare ones.  No rows: no rows.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets: 1 to {MOST_BUCKETS}")
    gain = gains(bucket_counts(target, buckets, run), bucket_counts(docs, buckets, run), buckets)
    return drawn(stash(scored(docs, gain, run, seed), "scored"), percent, least_words, group)


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs whose ids are drawn, all columns; an id of several rows stands for all of them."""
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(doc_long().alias("__id")).distinct()
    return docs.join(ids, doc_long() == F.col("__id"), "left_semi")


__all__ = ["NO_ID", "above", "bucket_counts", "draw", "drawn", "gains", "resample", "scored"]
