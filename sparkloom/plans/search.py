"""Queries of the stored full-text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fulltext import Index
from ..sources.shared import new_path
from .registry import Registry, Tables
from .texts import _TOKENS

query = Registry()
_held: dict[tuple[str, str], Index] = {}


def index(spark, sf_dir) -> Index:
    """The index of all documents below sf_dir, made once a session: a segment for English ones, another for all others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        made = Index(spark, new_path(spark, "fulltext"))
        docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text", "lang")
        english = F.col("lang").eqNullSafe("en")
        made.append(docs.where(english))
        made.append(docs.where(~english))
        _held[key] = made
    return _held[key]


def _times(unit: tuple[str, ...]) -> str:
    """SQL for how often a unit occurs in the words w."""
    fits = [f"starts_with(w[i + {k}], '{x[:-1]}')" if x.endswith("*") else f"w[i + {k}] = '{x}'" for k, x in enumerate(unit, 1)]
    return f"len(list_filter(range(0, len(w) - {len(unit) - 1}), lambda i: {' AND '.join(fits)}))"


def _ranked(units: list[tuple[str, ...]], digits: int = 4) -> str:
    """SQL with the scores of documents that have all units, by looking at every word."""
    score = " + ".join(f"ln((docs - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE) + 1) * t{k} * 2.2::DOUBLE / (t{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for k in range(len(units)))
    return f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
c AS (SELECT doc_id, coalesce(len(w), 0) AS n, {", ".join(f"{_times(u)} AS t{k}" for k, u in enumerate(units))} FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"count(*) FILTER (WHERE t{k} > 0) AS n{k}" for k in range(len(units)))} FROM c)
SELECT doc_id, round({score}, {digits}) AS score FROM c, s WHERE {" AND ".join(f"t{k} > 0" for k in range(len(units)))}"""


def _scores(spark, sf_dir, units):
    return index(spark, sf_dir).match(units).select(F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


_WORDS = [("thing",), ("erst",)]
_PHRASE = [("of", "the"), ("and",)]
_PREFIX = [("is", "th*"), ("ent*",)]


@query(_ranked(_WORDS) + " ORDER BY score DESC, doc_id LIMIT 20")
def fts_match(spark, sf_dir):
    """The twenty best are the report."""
    return _scores(spark, sf_dir, _WORDS).orderBy(F.desc("score"), "doc_id").limit(20)


@query(_ranked(_PHRASE))
def fts_phrase(spark, sf_dir):
    """All documents with a phrase and a word."""
    return _scores(spark, sf_dir, _PHRASE)


@query(_ranked(_PREFIX))
def fts_prefix(spark, sf_dir):
    """All documents with a phrase that ends in a prefix, and another prefix."""
    return _scores(spark, sf_dir, _PREFIX)


@query(f"""SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term""")
def fts_terms(spark, sf_dir):
    """The whole vocabulary of the index."""
    return index(spark, sf_dir).terms()
