"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of postings (term, block, number, position), in segments that are
each sorted by term, then document: columns of one term's list follow one another, packed as runs
and small numbers, and the statistics of pages lead to a term's lists.  A block has at most 65,536
documents of one segment.  A word at `position` of the term at `place` of an item says that the item would start at
position - place.  For every window of an item the lists of its rarest terms, by their counts
over all documents, are shifted by place and intersected, rarest first; what is left is
intersected with the lists of the item's other terms; runs of adjacent places are the exact
phrases.  DataFrame functions only.

Scale: texts are read and cut once, and segments need no shuffle.  Lists are
intersected by term and block, so a frequent term's postings are never in one place.  The
benchmark's terms are broadcast only below a checked number of rows; what grows with
the documents is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, row_key, stash

#: Fixed value: what separates words once A-Z are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: At most so many rows of terms (of the benchmark, not of documents) are broadcast.
BROADCAST_TERMS = 500_000
#: Before a document's key, which the index holds like a term; no word begins with it.
_MARK = "\0"


def words(text: Column) -> Column:
    """Lower-cased words in order; null text: null."""
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """df, marked for broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct (item, item_id, terms) with at least a word, written; `item` numbers pairs of id and text."""
    named = benchmark.select("item_id", "text").dropDuplicates(["item_id", "text"])
    named = named.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    return stash(named.withColumn("item", F.monotonically_increasing_id()), "items")


def index(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(term, block, number, position) of all words of docs, written.

    Every row also posts its key (doc_id, or the column given) as a term of its own, with its
    number of words as the position: documents() reads them.  docs are best a written table,
    whose rows keep their order when a lost task is run again.
    """
    named = F.concat(F.lit(_MARK), F.coalesce(F.concat(F.lit("k"), (F.col("doc_id") if key is None else key).cast("string")), F.lit("")))
    all_ = F.concat(F.array(named), F.coalesce(words(F.col("text")), F.array().cast("array<string>")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), all_.alias("all"))
    # all_ is never empty; an inner explode would have it evaluated again, by an inferred filter
    each = rows.select("row", F.size("all").alias("size"), F.posexplode_outer("all").alias("at", "term"))
    each = each.select("term", "row", (F.when(F.col("at") == 0, F.col("size")).otherwise(F.col("at")) - 1).alias("position"))
    each = each.sortWithinPartitions("term", "row", "position")
    return stash(each.select("term", F.shiftright("row", 16).alias("block"), F.col("row").bitwiseAND(0xFFFF).cast("int").alias("number"), "position"), "index", compression="zstd")


def documents(index_: DataFrame) -> DataFrame:
    """(doc, block, number, n_words) of every row of an index; doc is its key as a string."""
    key = F.when(F.length("term") > 1, F.substring("term", 3, 2**31 - 1))
    return index_.where(F.col("term") < F.lit("\1")).select(key.alias("doc"), "block", "number", F.col("position").cast("long").alias("n_words"))


def postings(index_: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms (distinct, one column `term`)."""
    return index_.where(F.col("term") >= F.lit("\1")).join(_small(terms, BROADCAST_TERMS), "term")


def _place() -> Column:
    """Number and position in one long: differences of places are those of positions."""
    return F.shiftleft(F.col("number").cast("long"), 32) + F.col("position")


def term_counts(index_: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all documents, for the terms given; reads no other column."""
    return postings(index_.select("term"), terms).groupBy("term").agg(F.count("*").alias("n"))


def rarest(items: DataFrame, counts: DataFrame, window: int, probes: int) -> DataFrame:
    """(item, probes): of each window the places and terms of its `probes` rarest terms,
    rarest first.  A window with a term that no document has is left out."""
    spread = items.select("item", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    spread = spread.join(counts, "term", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    span = F.least(F.lit(window), F.col("length"))
    first = F.greatest(F.lit(0), F.col("place") - window + 1)
    last = F.least(F.col("place"), F.col("length") - span)
    windows = spread.withColumn("start", F.explode(F.sequence(first, last)))
    by_window = windows.groupBy("item", "start").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("all"))  # `window` terms at most
    chosen = by_window.where(F.col("all")[0]["n"] > 0).select("item", F.slice("all", 1, probes).alias("probes"))
    return chosen.select("item", F.transform("probes", lambda x: F.struct(x["place"].alias("place"), x["term"].alias("term"))).alias("probes")).distinct()


def offsets(index_: DataFrame, items: DataFrame, window: int = 10, probes: int = 2) -> DataFrame:
    """(item, block, start) where the lists of a window's rarest terms agree; start is where the item's first word would be."""
    terms = items.select(F.explode("terms").alias("term")).distinct()
    counts = stash(term_counts(index_, terms), "counts")
    chosen = stash(rarest(items, counts, window, probes), "probes")
    asked = chosen.select(F.explode("probes.term").alias("term")).distinct()
    lists = stash(postings(index_, asked).groupBy("term", "block").agg(F.collect_list(_place()).alias("places")), "lists")
    begun = _small(chosen.withColumn("term", F.col("probes")[0]["term"]), BROADCAST_TERMS).join(lists, "term")
    # `at`: places of the last probe; a list is shifted by the distance to the next probe, the shorter one being hashed
    found = begun.select("item", "probes", "block", F.col("places").alias("at"), F.col("probes")[0]["place"].alias("place"))
    for k in range(1, probes):
        probe = F.get("probes", F.lit(k))
        met = found.withColumn("term", probe["term"]).withColumn("by", probe["place"] - F.col("place")).join(lists, ["term", "block"])
        moved = F.transform("at", lambda x: x + F.col("by"))
        met = met.select("item", "probes", "block", F.array_intersect("places", moved).alias("at"), probe["place"].alias("place")).where(F.size("at") > 0)
        found = met.unionByName(found.where(F.size("probes") <= k))
    return found.select("item", "block", "place", F.explode("at").alias("at")).select("item", "block", (F.col("at") - F.col("place")).alias("start")).distinct()


def phrases(index_: DataFrame, benchmark: DataFrame, window: int = 10, probes: int = 2) -> DataFrame:
    """Exact phrases: (block, number, item_id, start, length), maximal runs of at least
    `window` words (or a whole shorter item) that a document shares with an item;
    `start` counts the document's words from 0; documents() names block and number."""
    items = items_of(benchmark)
    found = stash(offsets(index_, items, window, probes), "offsets")
    wanted = found.join(items, "item").select("item", "item_id", "block", "start", F.size("terms").alias("whole"), F.posexplode("terms").alias("at", "term"))
    wanted = wanted.withColumn("place", F.col("start") + F.col("at"))
    lists = postings(index_, items.select(F.explode("terms").alias("term")).distinct()).select("term", "block", _place().alias("place"))
    same = lists.join(wanted.hint("merge"), ["term", "block", "place"])  # both grow with the documents
    run = Window.partitionBy("block", "item", "start").orderBy("at")
    same = same.withColumn("run", F.col("at") - F.row_number().over(run))
    runs = same.groupBy("block", "item", "item_id", "start", "run").agg(F.min("place").alias("first"), F.count("*").alias("length"), F.max("whole").alias("whole"))
    runs = runs.where(F.col("length") >= F.least(F.lit(window), F.col("whole")))
    return runs.select("block", F.shiftright("first", 32).cast("int").alias("number"), "item_id", F.col("first").bitwiseAND(2**32 - 1).cast("int").alias("start"), "length")


def proximity(docs: DataFrame, benchmark: DataFrame, slack: int = 5, share: float = 0.6, window: int = 10, probes: int = 2) -> DataFrame:
    """Proximity matches: (doc_id, item_id, at, n_places): of an item's rarest places at
    least `share` occur in the document, in offsets that differ by less than
    2 * slack from a common one - reworded or cut passages.  `at` is about where; doc_id is a string."""
    items, index_ = items_of(benchmark), index(docs)
    terms = items.select(F.explode("terms").alias("term")).distinct()
    counts = stash(term_counts(index_, terms), "counts")
    anchors = rarest(items, counts, window, probes).select("item", F.explode("probes").alias("p")).select("item", "p.place", "p.term").distinct()
    anchors = stash(anchors, "anchors")
    of_item = anchors.groupBy("item").agg(F.countDistinct("place").alias("of"))
    hits = postings(index_, anchors.select("term").distinct()).join(_small(anchors, BROADCAST_TERMS), "term")
    hits = hits.select("block", "number", "item", "place", (F.col("position") - F.col("place")).alias("offset"))
    # every offset falls into two overlapping bands, so that close ones share one
    hits = hits.withColumn("band", F.explode(F.array(F.floor(F.col("offset") / (2 * slack)), F.floor((F.col("offset") + slack) / (2 * slack)) + F.lit(0.5))))
    near = hits.groupBy("block", "number", "item", "band").agg(F.countDistinct("place").alias("n_places"), F.min("offset").alias("at"))
    near = near.join(of_item, "item").where(F.col("n_places") >= F.lit(share) * F.col("of"))
    best = near.groupBy("block", "number", "item").agg(F.max(F.struct("n_places", "at")).alias("b"))
    named = best.join(items.select("item", "item_id"), "item").join(documents(index_), ["block", "number"])
    return named.select(F.col("doc").alias("doc_id"), "item_id", F.col("b.at").alias("at"), F.col("b.n_places").alias("n_places"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, probes: int = 2) -> DataFrame:
    """Takes doc_id and text of docs, item_id and text of benchmark.

    Returns a row per row of docs: doc_id, n_words, n_hit (words inside an
    occurrence of a window of any item), item_ids (sorted strings) and contaminated.

    Null or empty text: no words, not contaminated; such items have no window.
    Repeated documents: a row each, with the same figures.  Repeated items count
    once; items that share an id count as one.  A null id of an item is ''.
    """
    index_ = index(docs)
    found = stash(phrases(index_, benchmark, window, probes), "phrases")
    covered = found.select("block", "number", F.explode(F.sequence("start", (F.col("start") + F.col("length") - 1).cast("int"))).alias("position")).distinct()
    n_hit = covered.groupBy("block", "number").agg(F.count("*").alias("n_hit"))
    which = found.groupBy("block", "number").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    verdict = stash(n_hit.join(which, ["block", "number"]), "verdict")
    out = documents(index_).join(verdict, ["block", "number"], "left")
    none = F.array().cast("array<string>")
    kind = docs.schema["doc_id"].dataType
    return out.select(F.col("doc").cast(kind).alias("doc_id"), "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, probes: int = 2) -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item."""
    index_ = index(docs, row_key())
    found = phrases(index_, benchmark, window, probes).select("block", "number").distinct()
    leaks = stash(documents(index_).join(found, ["block", "number"]).select(F.col("doc").alias("__doc")).distinct(), "leaks")
    return docs.join(leaks, row_key() == leaks["__doc"], "left_anti")
