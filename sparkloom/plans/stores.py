"""Queries that write the documents' vocabulary, parts and orders in the formats of sources and sinks, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import djb2
from ..sources import shards
from ..sources.shared import new_path
from .lexicon import Lexicon
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()


def _entries(spark, sf_dir):
    """Words of documents as entries with one or two senses, some with synonyms or an etymology."""
    w, n = F.col("word"), F.col("n")
    sense = lambda p, g, x: F.struct(F.lit(p).alias("p"), F.concat(F.lit(g), w).alias("g"), x.alias("x"))
    none = F.lit(None).cast("string")
    senses = F.when(n % 2 == 0, F.array(sense("noun", 'a "', none), sense("verb", "to ", F.concat(F.lit("they\\"), w)))).otherwise(F.array(sense("noun", "a ", none)))
    return vocabulary(Tables(spark, sf_dir).documents).select("word", senses.alias("d"), F.when(n % 3 == 0, F.array(F.concat(F.lower(w), F.lit("s")), F.lower(w))).alias("s"), F.when(n % 4 == 0, F.concat(F.lit("From "), w)).alias("e"))


def _lexicon(spark, sf_dir) -> Lexicon:
    path = new_path(spark, "shards")
    shards.write_json_shards(_entries(spark, sf_dir), path)
    return Lexicon(spark, shards.relational(shards.read_shards(spark, f"{path}/*")))


_SENSES = f"""WITH {_VOCABULARY}, s AS (SELECT word, 0 AS ord, 'noun' AS pos, CASE WHEN n % 2 = 0 THEN 'a "' ELSE 'a ' END || word AS gloss, NULL AS example FROM vocabulary UNION ALL SELECT word, 1, 'verb', 'to ' || word, 'they\\' || word FROM vocabulary WHERE n % 2 = 0)"""


@query(f"{_SENSES} SELECT word, ord, pos, gloss, example FROM s")
def shard_senses(spark, sf_dir):
    """Written as JSON shards, read back and laid flat."""
    return _lexicon(spark, sf_dir).tables["senses"].select("word", "ord", "pos", "gloss", "example")


@query(f"WITH {_VOCABULARY} SELECT word, 'syn' AS kind, k AS ord, CASE k WHEN 0 THEN lower(word) || 's' ELSE lower(word) END AS target FROM vocabulary, (VALUES (0), (1)) v(k) WHERE n % 3 = 0")
def shard_relations(spark, sf_dir):
    return _lexicon(spark, sf_dir).tables["rel"].select("word", "kind", "ord", "target")


@query(f"{_SENSES} SELECT word, ord, gloss, CASE WHEN word = 'that' THEN 0 ELSE 1 END AS tier FROM s WHERE lower(word) = 'that'")
def lexicon_lookup(spark, sf_dir):
    """The senses of one word, as it is spelled and otherwise: the word is the query's parameter."""
    return _lexicon(spark, sf_dir).define("that").select("word", "ord", "gloss", "tier")


@query(f"WITH {_VOCABULARY} SELECT pos, count(*) AS n, count(example) AS examples FROM (SELECT 'noun' AS pos, NULL AS example FROM vocabulary UNION ALL SELECT 'verb', word FROM vocabulary WHERE n % 2 = 0) GROUP BY pos")
def lexicon_sql(spark, sf_dir):
    """A caller's own SQL over the lexicon's views."""
    return _lexicon(spark, sf_dir).sql("SELECT pos, count(*) AS n, count(example) AS examples FROM senses GROUP BY pos", None)


def _dump(spark, sf_dir):
    """Parts as lines of a dictionary dump, compressed, with broken lines between them; read back."""
    size = F.col("p_size")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    args = F.map_from_entries(F.array(entry("1", F.lit("en")), entry("10", F.col("p_type")), entry("2", F.lower("p_type")), entry("t", F.col("p_brand"))))
    examples = F.array(F.struct(F.lit("x").alias("text"), F.concat(F.lit("in "), F.lit(1600) + size * 7, F.lit(", a book")).alias("ref"), F.lit("quotation").alias("type")), F.struct(F.lit("y").alias("text"), F.lit("1999").alias("ref"), F.lit("example").alias("type")))
    senses = F.array(
        F.struct(F.array(F.lit("general"), F.col("p_name")).alias("glosses"), examples.alias("examples")),
        F.struct(F.array(F.repeat("p_name", F.lit(12))).alias("glosses"), F.array().cast("array<struct<text:string,ref:string,type:string>>").alias("examples")),
    )
    line = F.struct(
        F.concat("p_name", F.lit("#"), "p_partkey").alias("word"), F.lit("en").alias("lang_code"), F.when(size % 2 == 0, "noun").otherwise("verb").alias("pos"), (size % 3).alias("etymology_number"),
        F.array(F.struct(F.lit("der").alias("name"), args.alias("args"))).alias("etymology_templates"), senses.alias("senses"),
        F.array(F.struct(F.lit(None).cast("string").alias("ipa")), F.struct(F.concat(F.lit("/"), "p_brand", F.lit("/")).alias("ipa"))).alias("sounds"),
        F.array(F.struct(F.col("p_type").alias("word")), F.struct(F.col("p_type").alias("word"))).alias("derived"),
    )
    p = Tables(spark, sf_dir).part
    path = new_path(spark, "dump")
    p.select(F.to_json(line).alias("value")).union(p.select(F.concat(F.lit('{"word": "broken'), "p_partkey"))).write.option("compression", "gzip").text(path)
    return shards.read_lines(spark, path, shards.DUMP)


@query("""SELECT p_name || '#' || p_partkey AS w, 'en' AS l, CASE WHEN p_size % 2 = 0 THEN 'noun' ELSE 'verb' END AS p, (p_size % 3)::INT AS n, p_name || ' | ' || CASE WHEN length(p_name) * 12 > 120 THEN repeat(p_name, 12)[:118] || '…' ELSE repeat(p_name, 12) END AS g,
  '/' || p_brand || '/' AS ipa, 'der en ' || lower(p_type) || ' ' || p_type || ' ' || p_brand AS et, p_type AS dv FROM part""")
def slim_records(spark, sf_dir):
    """The slim records of a compressed dump with broken lines."""
    r = shards.slim(_dump(spark, sf_dir))
    t = F.get("et", F.lit(0))
    return r.select("w", "l", "p", "n", F.array_join("g", " | ").alias("g"), "ipa", F.concat_ws(" ", t["n"], F.array_join(t["a"], " "), t["t"]).alias("et"), F.array_join("dv", " ").alias("dv"))


@query("""SELECT p_name || '#' || p_partkey AS word, (p_size % 3)::INT AS ety_num, k AS ord, CASE k WHEN 0 THEN p_name ELSE repeat(p_name, 12) END AS gloss, CASE k WHEN 0 THEN least(1600 + p_size * 7, 1999)::INT END AS attest_year FROM part, (VALUES (0), (1)) v(k)""")
def rich_senses(spark, sf_dir):
    """The senses of a dump as a flat table, with the first year of their examples."""
    return shards.rich(_dump(spark, sf_dir))["sense"].select("word", "ety_num", "ord", "gloss", "attest_year")


@query(f"WITH {_VOCABULARY} SELECT word, n AS rank FROM vocabulary")
def rank_report(spark, sf_dir):
    """A report with tabs and a header, read as a table of ranks."""
    path = new_path(spark, "report")
    shards.write_report(vocabulary(Tables(spark, sf_dir).documents), path)
    return shards.read_ranks(spark, path)


@query("SELECT o_orderkey // 1024 AS chunk, count(*) AS n, max(o_orderkey) AS last, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def chunked_orders(spark, sf_dir):
    """Orders in chunks of 1,024 keys."""
    path = new_path(spark, "chunks")
    shards.write_chunks(Tables(spark, sf_dir).orders, path, "o_orderkey")
    c = spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk"))
    return c.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_DJB2 = "list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(word, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (h * 33 + x) % 4294967296)"


@query(f"WITH {_VOCABULARY} SELECT {_DJB2} % 256 AS part, count(*) AS words, min(word) AS first, sum(n)::BIGINT AS n FROM vocabulary GROUP BY 1")
def hashed_words(spark, sf_dir):
    """Words in 256 folders by their hash."""
    path = new_path(spark, "hashed")
    shards.write_hashed(vocabulary(Tables(spark, sf_dir).documents), path, F.col("word"), 256, djb2)
    return spark.read.parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("words"), F.min("word").alias("first"), F.sum("n").alias("n"))


@query(r"SELECT CASE WHEN regexp_matches(lower(w[1]), '^[a-z]$') THEN lower(w[1]) ELSE '_' END AS letter, count(*) AS words, max(w) AS last FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM documents) GROUP BY 1")
def letter_files(spark, sf_dir):
    """Words in folders by their first letter."""
    path = new_path(spark, "letters")
    words = Tables(spark, sf_dir).documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    words.withColumn("letter", shards.first_letter(F.col("word"))).repartition("letter").write.partitionBy("letter").parquet(path)
    return spark.read.parquet(path).groupBy("letter").agg(F.count("*").alias("words"), F.max("word").alias("last"))
