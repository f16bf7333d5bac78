"""Dictionary shards, line files and partitioned tables: readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import shard_key

SENSE = "struct<p:string,g:string,x:string,dom:string,cl:array<string>>"
PIECE = "struct<s:string,k:string,g:string,o:string,src:string,id:string,disp:string>"
ENTRY = (
    f"struct<d:array<{SENSE}>,e:string,s:array<string>,a:array<string>,r:array<string>,i:string,rs:string,au:string,b:array<{PIECE}>,"
    f"bWhole:array<struct<s:string,k:string,g:string,o:string,src:string>>,cl:array<string>,vars:array<string>,forms:array<string>,"
    "rel:struct<t:string,l:string,by:string,at:string>,wp:array<struct<t:string,g:string>>,ss:map<string,string>,_at:string>"
)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of {word: entry} as rows (file, ord, word, entry fields).

    `ord` is the entry's place in its file, so that first-wins picks can be made.
    A file is a shard of bounded size, read whole.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    entries = files.select("file", F.posexplode(F.map_entries(F.from_json("value", f"map<string,{ENTRY}>"))).alias("ord", "x"))
    return entries.select("file", "ord", F.col("x.key").alias("word"), "x.value.*")


def relational(entries: DataFrame) -> dict[str, DataFrame]:
    """Words, senses and relations of entries as flat tables."""
    words = entries.select("word", F.col("i").alias("ipa"), "rs", F.col("e").alias("ety"))
    senses = entries.select("word", F.posexplode("d").alias("ord", "x")).select("word", "ord", F.col("x.p").alias("pos"), F.col("x.g").alias("gloss"), F.col("x.x").alias("example"))
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("targets")) for k, c in (("syn", "s"), ("ant", "a"), ("rel", "r"))))
    rel = entries.select("word", F.explode(lists).alias("l")).select("word", "l.kind", F.posexplode("l.targets").alias("ord", "target"))
    morph = entries.select("word", F.posexplode("b").alias("ord", "x")).select("word", "ord", F.col("x.k").alias("kind"), F.col("x.id").alias("id"), F.col("x.s").alias("surface"), F.col("x.o").alias("origin"), F.col("x.g").alias("meaning"))
    return {"words": words, "senses": senses, "rel": rel, "morph": morph}


def write_shards(entries: DataFrame, path: str) -> None:
    """Partitioned by the first two letters."""
    entries.withColumn("shard", shard_key(F.col("word"))).repartition("shard").sortWithinPartitions("shard", "word").write.mode("overwrite").partitionBy("shard").parquet(path)


def write_json_shards(entries: DataFrame, path: str) -> None:
    """Rows (word, entry fields) as JSON files of {word: entry}, which read_shards() reads: a folder for each two letters, a word a line, in order of the
    words. A shard is one file of bounded size, as its readers expect; a file that doesn't read back as it was written is a ValueError."""
    fields = [c for c in entries.columns if c != "word"]
    line = F.concat(F.to_json(F.array("word")).substr(F.lit(2), F.length(F.to_json(F.array("word"))) - 2), F.lit(": "), F.to_json(F.struct(*fields)))
    lines = entries.select(shard_key(F.col("word")).alias("shard"), F.struct("word", line.alias("line")).alias("l"))
    files = lines.groupBy("shard").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), ",\n").alias("body"), F.count("*").alias("n"))
    files.select("shard", F.concat(F.lit("{\n"), "body", F.lit("\n}")).alias("value")).repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)
    spark = entries.sparkSession
    back = spark.read.text(f"{path}/*", wholetext=True).select(F.size(F.from_json("value", "map<string,string>")).alias("n")).agg(F.sum("n")).first()[0]
    if (back or 0) != entries.select("word").distinct().count():
        raise ValueError(f"{path} doesn't hold what was written")


def read_lines(spark: SparkSession, path: str, schema: str, holds: str | None = None) -> DataFrame:
    """JSON lines, bad ones left out; with `holds`, only lines with that string are parsed."""
    if holds is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = spark.read.text(path).where(F.col("value").contains(holds))
    return lines.select(F.from_json("value", schema).alias("x")).where("x IS NOT NULL").select("x.*")


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """A table of word, rank with tabs and a header."""
    return spark.read.schema("word string, rank long").option("sep", "\t").option("header", True).csv(path)


def write_chunks(df: DataFrame, path: str, key: str = "id", size: int = 1024) -> None:
    """Chunks of `size` ids, each a folder that a filter on `chunk` reads alone."""
    df.withColumn("chunk", F.floor(F.col(key) / size)).repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(path)


def write_hashed(df: DataFrame, path: str, key: Column, n: int = 256, hashed: Callable[[Column], Column] = F.xxhash64) -> None:
    """n folders by a hash of the key."""
    df.withColumn("part", F.pmod(hashed(key), F.lit(n))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def write_bands(df: DataFrame, path: str, order: Sequence[Column], size: int = 400) -> None:
    """Bands of `size` rows in order."""
    from ..operators.relational import bands

    bands(df, order, size).repartition("band").write.mode("overwrite").partitionBy("band").parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose keys the table at path lacks; how many they were.  Safe to run again."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    new = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti") if there else df
    before = spark.read.parquet(path).count() if there else 0
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


#: A line of a dictionary dump, as far as it is read.
DUMP = (
    "word string, lang string, lang_code string, pos string, etymology_number int, etymology_text string, etymology_templates array<struct<name:string,args:map<string,string>,expansion:string>>, "
    "senses array<struct<glosses:array<string>,tags:array<string>,topics:array<string>,form_of:array<struct<word:string>>,alt_of:array<struct<word:string>>,examples:array<struct<text:string,ref:string,type:string>>>>, "
    "sounds array<struct<ipa:string,ogg_url:string,mp3_url:string,tags:array<string>>>, derived array<struct<word:string>>"
)


def slim(dump: DataFrame) -> DataFrame:
    """Lines of a dump as slim records: word, language, part of speech, number, first gloss of each
    sense (cut at 120 characters), first IPA, relation templates with arguments in order, derived words."""
    first = F.filter(F.transform("senses", lambda s: F.element_at(s["glosses"], -1)), lambda g: g.isNotNull())
    cut = F.transform(first, lambda g: F.when(F.length(g) > 120, F.concat(F.substring(g, 1, 118), F.lit("…"))).otherwise(g))

    def template(t: Column) -> Column:
        ordered = F.array_sort(F.filter(F.map_entries(t["args"]), lambda e: e["key"].rlike("^[0-9]+$")), lambda a, b: a["key"].cast("int") - b["key"].cast("int"))
        return F.struct(t["name"].alias("n"), F.transform(ordered, lambda e: e["value"]).alias("a"), F.coalesce(F.try_element_at(t["args"], F.lit("t")), F.lit("")).alias("t"))

    return dump.select(
        F.col("word").alias("w"), F.col("lang_code").alias("l"), F.col("pos").alias("p"), F.col("etymology_number").alias("n"), cut.alias("g"),
        F.get(F.filter("sounds", lambda s: s["ipa"].isNotNull()), F.lit(0))["ipa"].alias("ipa"), F.transform("etymology_templates", template).alias("et"), F.array_distinct(F.transform("derived", lambda d: d["word"])).alias("dv"),
    )


def rich(dump: DataFrame) -> dict[str, DataFrame]:
    """Lines of a dump as flat tables: sections, senses with tags and the first year of an example, sounds."""
    section = dump.select("word", F.col("etymology_number").alias("ety_num"), "pos", F.col("etymology_text").alias("etymology"))
    years = F.filter(F.transform("x.examples", lambda e: F.regexp_extract(F.coalesce(e["ref"], F.lit("")), r"\b(1[0-9]{3}|20[0-9]{2})\b", 1).try_cast("int")), lambda y: y.isNotNull())
    sense = dump.select("word", F.col("etymology_number").alias("ety_num"), "pos", F.posexplode("senses").alias("ord", "x")).select(
        "word", "ety_num", "pos", "ord", F.element_at("x.glosses", -1).alias("gloss"), F.col("x.tags").alias("tags"), F.col("x.topics").alias("topics"),
        F.get("x.alt_of", F.lit(0))["word"].alias("alt_of"), F.get("x.form_of", F.lit(0))["word"].alias("form_of"), F.array_min(years).alias("attest_year"),
    )
    sound = dump.select("word", F.explode("sounds").alias("x")).select("word", "x.ipa", "x.ogg_url", "x.mp3_url", "x.tags")
    return {"section": section, "sense": sense, "sound": sound}


def best_audio(sounds: DataFrame) -> DataFrame:
    """One recording a word: MP3 before other kinds, American before others, then the first by name."""
    url = F.coalesce("mp3_url", "ogg_url")
    score = F.when(F.col("mp3_url").isNotNull(), 2).otherwise(0) + F.when(F.array_contains("tags", "US"), 1).otherwise(0)
    return sounds.where(url.isNotNull()).groupBy("word").agg(F.min_by(url, F.struct(-F.coalesce(score, F.lit(0)), url)).alias("audio"))


def first_letter(word: Column) -> Column:
    """a to z, else _."""
    c = F.lower(F.substring(word, 1, 1))
    return F.when(c.rlike("^[a-z]$"), c).otherwise(F.lit("_"))


def write_report(df: DataFrame, path: str) -> None:
    """Rows with tabs and a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
