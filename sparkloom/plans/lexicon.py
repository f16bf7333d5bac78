"""Named commands over the relational copy of a dictionary, and SQL as a way out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators.text import bm25

GAPS = {"syn": "relation", "ant": "relation", "rel": "relation", "ex": "example", "ety": "scalar", "ipa": "scalar"}


class Lexicon:
    """words(word, ipa, rs, ety), senses(word, ord, pos, gloss, example), rel(word, kind, ord, target), morph(word, ord, kind, id, ...)."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)

    def views(self) -> None:
        """Temporary views of the tables."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def sql(self, query: str, limit: int | None = 200) -> DataFrame:
        """Any query over the views; None or 0 for all rows."""
        self.views()
        out = self.spark.sql(query)
        return out.limit(limit) if limit else out

    def define(self, word: str) -> DataFrame:
        """Senses of a word as spelled, else of all its spellings."""
        s = self.tables["senses"]
        exact = s.where(F.col("word") == word).withColumn("tier", F.lit(0))
        return exact.unionByName(s.where((F.lower("word") == word.lower()) & (F.col("word") != word)).withColumn("tier", F.lit(1))).orderBy("tier", "word", "ord")

    def with_piece(self, kind: str, ident: str) -> DataFrame:
        """Words with a prefix, root or suffix."""
        if kind not in ("prefix", "root", "suffix"):
            raise ValueError(f"no kind {kind}")
        return self.tables["morph"].where((F.col("kind") == kind) & (F.col("id") == ident)).select("word").distinct().orderBy("word")

    def missing(self, what: str, kind: str | None = None, ident: str | None = None) -> DataFrame:
        """Words without synonyms, antonyms, related words, an example, an etymology or a
        pronunciation; of those with a piece, if one is given."""
        if what not in GAPS:
            raise ValueError(f"no gap {what}")
        words = self.tables["words"]
        if kind is not None:
            words = words.join(self.with_piece(kind, ident or ""), "word", "left_semi")
        if GAPS[what] == "scalar":
            found = words.where(rel.blank(F.col(what)))
        else:
            other = self.tables["rel"].where(F.col("kind") == what) if GAPS[what] == "relation" else self.tables["senses"].where("example IS NOT NULL")
            found = words.join(other, "word", "left_anti")
        return found.select("word").distinct().orderBy("word")

    def search(self, *terms: str) -> DataFrame:
        """Words whose glosses and etymology hold all terms, best first."""
        glosses = self.tables["senses"].groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "gloss"))), lambda x: x["gloss"]), " · ").alias("g"))
        body = self.tables["words"].join(glosses, "word", "left").select(F.col("word").alias("id"), F.concat_ws(" ", "g", "ety").alias("text"))
        return bm25(body, [t.lower() for t in terms]).orderBy(F.desc("score"), "id")

    def dangling(self, folded: bool = True) -> DataFrame:
        """Targets that are no headword, with counts; case-blind or exact."""
        f = F.lower if folded else F.col
        r = self.tables["rel"].select(f("target").alias("t"))
        return rel.dangling(r, "t", self.tables["words"].select(f("word").alias("w")), "w")

    def counts(self) -> DataFrame:
        out = None
        for name, df in sorted(self.tables.items()):
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionAll(one)
        return out
