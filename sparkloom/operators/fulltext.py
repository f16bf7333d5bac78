"""A stored full-text index: postings by term, searched by words, prefixes and phrases, ranked by BM25.

An index is a folder.  Every append writes a segment: postings (term, id, len, positions) in files that are ranges of terms, the
documents' lengths, and last a manifest with the first and last term of each file, by which the segment counts as there.
A search reads the manifest, opens only files whose range has one of its terms, and within them the row groups that
Parquet's statistics leave.  Other texts and other terms are never read, and old segments never written again.

Scale: postings are dealt by ranges of (term, id), so that a term that is in every document fills many files, each of
them a task.  A search shuffles the postings of its own terms by document, once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from .text import K1, B, tokens

#: Bytes of text whose postings are one file, about.
FILE_BYTES = 64_000_000
_MANIFEST = "segment string, file string, first string, last string, postings long, documents long, words long"
#: Behind all words with a prefix.
_END = "\U0010ffff"


class Index:
    """An index in the folder `path`, which any Spark file system can hold.

    A unit of a search is a word ("word",), a prefix ("pre*",) or a phrase of them ("two", "words", "th*"); words are
    lower-cased runs of letters, marks and digits, as in text.tokens().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- what is stored

    def _segments(self) -> list[str]:
        """Folders of segments that were finished."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(top))
        return [n for n in names if fs.exists(hadoop.Path(f"{self.path}/{n}/manifest/_SUCCESS"))]

    def manifest(self) -> DataFrame:
        """A row a file: its segment, first and last term and postings; and a row a segment, without a file, of its documents and words."""
        found = [f"{self.path}/{s}/manifest" for s in self._segments()]
        return self.spark.read.schema(_MANIFEST).parquet(*found) if found else self.spark.createDataFrame([], _MANIFEST)

    def documents(self) -> DataFrame | None:
        """(id, len) of all documents, those without words too; None before the first append."""
        found = [f"{self.path}/{s}/documents" for s in self._segments()]
        return self.spark.read.parquet(*found) if found else None

    def append(self, docs: DataFrame) -> None:
        """Adds docs (id, text), none of which may be there yet; null text has no words.  Nothing of an append that fails is seen."""
        lengths = docs.select("id", tokens(F.col("text")).alias("w")).select("id", F.coalesce(F.size("w"), F.lit(0)).alias("len"))
        lengths = lengths.withColumn("len", F.greatest("len", F.lit(0)))
        segment = f"segment-{len(self._segments()):06d}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{segment}"
        lengths.write.parquet(f"{at}/documents")
        mine, old = self.spark.read.parquet(f"{at}/documents"), self.documents()
        twice = mine.groupBy("id").count().where("count > 1 OR id IS NULL")
        if not twice.isEmpty() or (old is not None and not mine.join(old, "id", "left_semi").isEmpty()):
            raise ValueError("an id is null, there twice or indexed already")
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        words = docs.select("id", tokens(F.col("text")).alias("w")).select("id", F.size("w").alias("len"), F.posexplode("w").alias("at", "term"))
        # dealt by ranges of (term, id): the groups below need no other shuffle, and no term is in one piece
        dealt = words.repartitionByRange(max(1, ceil(size / FILE_BYTES)), "term", "id")
        postings = dealt.groupBy("term", "id", "len").agg(F.array_sort(F.collect_list("at")).alias("positions")).sortWithinPartitions("term", "id")
        postings.write.parquet(f"{at}/postings")
        self._finish(segment)

    def _finish(self, segment: str) -> None:
        """Writes a segment's manifest, from its own files."""
        at = f"{self.path}/{segment}"
        written = self.spark.read.parquet(f"{at}/postings").select("term", F.col("_metadata.file_name").alias("file"))
        files = written.groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("postings"))
        none = F.lit(None).cast("long")
        rows = files.select(F.lit(segment).alias("segment"), "file", "first", "last", "postings", none.alias("documents"), none.alias("words"))
        sums = self.spark.read.parquet(f"{at}/documents").agg(F.count("*").alias("documents"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
        text = F.lit(None).cast("string")
        total = sums.select(F.lit(segment).alias("segment"), text.alias("file"), text.alias("first"), text.alias("last"), none.alias("postings"), "documents", "words")
        rows.unionByName(total).write.parquet(f"{at}/manifest")

    def merge(self) -> None:
        """All segments as one, so that a search opens fewer files; postings are dealt and sorted anew, texts aren't read."""
        old = self._segments()
        if len(old) < 2:
            return
        segment = f"segment-{0:06d}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{segment}"
        self.documents().write.parquet(f"{at}/documents")
        files = self.manifest().where("file IS NOT NULL").count()
        everything = self.spark.read.parquet(*(f"{self.path}/{s}/postings" for s in old))
        everything.repartitionByRange(max(1, files // len(old)), "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{at}/postings")
        # the old ones go first: between the two steps an index has too little rather than postings twice
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in old:
            fs.delete(hadoop.Path(f"{self.path}/{s}/manifest"), True)
        self._finish(segment)
        for s in old:
            fs.delete(hadoop.Path(f"{self.path}/{s}"), True)

    # -- searches

    def files(self, units: Sequence[Sequence[str]]) -> list[str]:
        """The postings files that can hold terms of these units."""
        hit = F.lit(False)
        for word in sorted({w for u in units for w in u}):
            low, high = (word[:-1], word[:-1] + _END) if word.endswith("*") else (word, word)
            hit = hit | ((F.col("first") <= high) & (F.col("last") >= low))
        rows = self.manifest().where(F.col("file").isNotNull() & hit).select("segment", "file").collect()  # of the search's own terms
        return sorted(f"{self.path}/{r.segment}/postings/{r.file}" for r in rows)

    def postings(self, units: Sequence[Sequence[str]]) -> DataFrame | None:
        """The postings of the units' terms, from the files that can have them; None if there are none."""
        files, held = self.files(units), self.documents()
        if not files:
            return None
        kind: DataType = held.schema["id"].dataType
        schema = StructType([StructField("term", StringType()), StructField("id", kind), StructField("len", IntegerType()), StructField("positions", ArrayType(IntegerType()))])
        words = sorted({w for u in units for w in u})
        plain, stems = [w for w in words if not w.endswith("*")], [w[:-1] for w in words if w.endswith("*")]
        wanted = F.col("term").isin(plain) if plain else F.lit(False)
        for s in stems:
            wanted = wanted | F.col("term").startswith(s)
        return self.spark.read.schema(schema).parquet(*files).where(wanted)

    def match(self, units: Sequence[Sequence[str]]) -> DataFrame:
        """(id, score) of documents that have every unit, by BM25 with a unit's occurrences as its frequency.

        No units, or units that no document has: no rows.  Scores are of the whole index, whatever its segments.
        """
        kind = self.documents()
        found = self.postings(units) if units else None
        if found is None:
            schema = StructType([StructField("id", kind.schema["id"].dataType if kind is not None else LongType())])
            return self.spark.createDataFrame([], schema).withColumn("score", F.lit(0.0))

        def of(word: str) -> Column:
            return F.col("term").startswith(word[:-1]) if word.endswith("*") else F.col("term") == word

        def begun(word: str, place: int) -> Column:
            """Where a unit would begin whose word at `place` this is."""
            return F.flatten(F.collect_list(F.when(of(word), F.transform("positions", lambda p: p - place))))

        places = [begun(w, k).alias(f"_{u}_{k}") for u, words in enumerate(units) for k, w in enumerate(words)]
        by_doc = found.groupBy("id").agg(F.first("len").alias("_len"), *places)
        begins = []
        for u, words in enumerate(units):
            at = F.col(f"_{u}_0")
            for k in range(1, len(words)):
                at = F.array_intersect(at, F.col(f"_{u}_{k}"))
            begins.append(F.size(at).alias(f"_t{u}"))
        counted = by_doc.select("id", "_len", *begins)
        times = [F.col(f"_t{u}") for u in range(len(units))]
        total = self.manifest().agg(F.sum("documents").alias("_docs"), F.sum("words").alias("_words"))
        have = counted.agg(*(F.count_if(t > 0).alias(f"_n{u}") for u, t in enumerate(times)))
        all_ = F.lit(True)
        score = F.lit(0.0)
        for u, t in enumerate(times):
            all_ = all_ & (t > 0)
            idf = F.log((F.col("_docs") - F.col(f"_n{u}") + 0.5) / (F.col(f"_n{u}") + 0.5) + 1)
            score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_len") * F.col("_docs") / F.col("_words")))
        j = counted.where(all_).join(F.broadcast(have)).join(F.broadcast(total))  # both are one row
        return j.select("id", score.alias("score"))

    def terms(self) -> DataFrame:
        """(term, documents, occurrences) of the whole vocabulary."""
        found = [f"{self.path}/{s}/postings" for s in self._segments()]
        if not found:
            return self.spark.createDataFrame([], "term string, documents long, occurrences long")
        p = self.spark.read.parquet(*found)
        return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).cast("long").alias("occurrences"))
