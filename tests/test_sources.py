"""Readers, writers and the lexicon's commands on hand-made shards."""

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.lexicon import Lexicon
from sparkloom.sources import shards

ENTRIES = {
    "ab.json": {"abc": {"d": [{"p": "noun", "g": "the letters", "x": "my abc"}, {"p": "verb", "g": "to spell"}], "s": ["alphabet"], "i": "/x/", "b": [{"s": "ab", "k": "root", "id": "ab"}, {"s": "c", "k": "suffix", "id": "c"}]}, "Abel": {"d": [{"p": "name", "g": "a man"}], "e": "From Hebrew."}},
    "al.json": {"alphabet": {"d": [{"p": "noun", "g": "letters in order"}], "s": ["abc", "nothing"], "e": ""}},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("shards")
    for name, data in ENTRIES.items():
        (path / name).write_text(json.dumps(data))
    return str(path)


@pytest.fixture(scope="module")
def lexicon(spark, folder):
    return Lexicon(spark, shards.relational(shards.read_shards(spark, folder)))


def column(df, name="word"):
    return [r[name] for r in df.collect()]


def test_commands(lexicon):
    assert column(lexicon.define("abel"), "gloss") == ["a man"] and column(lexicon.define("abc"), "gloss") == ["the letters", "to spell"]
    assert column(lexicon.with_piece("root", "ab")) == ["abc"]
    assert column(lexicon.missing("syn")) == ["Abel"] and column(lexicon.missing("ety")) == ["abc", "alphabet"]
    assert column(lexicon.missing("ex")) == ["Abel", "alphabet"] and column(lexicon.missing("ant", "suffix", "c")) == ["abc"]
    assert column(lexicon.dangling(), "target") == ["nothing"]
    assert column(lexicon.search("letters"), "id")[0] in ("abc", "alphabet") and column(lexicon.search("hebrew"), "id") == ["Abel"]
    assert {r["name"]: r.n for r in lexicon.counts().collect()} == {"words": 3, "senses": 4, "rel": 3, "morph": 2}
    assert lexicon.sql("SELECT word FROM words ORDER BY word LIMIT 2", None).count() == 2
    for bad in (lambda: lexicon.missing("x"), lambda: lexicon.with_piece("x", "y")):
        with pytest.raises(ValueError):
            bad()


def test_round_trips(spark, folder, tmp_path):
    e = shards.read_shards(spark, folder).drop("file", "ord")
    shards.write_shards(e, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(column(back)) == ["Abel", "abc", "alphabet"] and {r.shard for r in back.collect()} == {"ab", "al"}
    n = spark.range(3000)
    shards.write_chunks(n, str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.where("chunk = 2").count() == 3000 - 2048
    shards.write_hashed(n, str(tmp_path / "hashed"), F.col("id"), 8)
    assert spark.read.parquet(str(tmp_path / "hashed")).select("part").distinct().count() == 8
    shards.write_bands(n, str(tmp_path / "bands"), [F.col("id")], 1000)
    assert sorted((r.band, r["count"]) for r in spark.read.parquet(str(tmp_path / "bands")).groupBy("band").count().collect()) == [(0, 1000), (1, 1000), (2, 1000)]


def test_lines_and_appends(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"w": "a", "n": 1}\nbroken\n{"w": "b"}\n')
    assert sorted(column(shards.read_lines(spark, str(tmp_path / "lines.jsonl"), "w string, n long"), "w")) == ["a", "b"]
    assert column(shards.read_lines(spark, str(tmp_path / "lines.jsonl"), "w string, n long", '"n"'), "w") == ["a"]
    (tmp_path / "r.tsv").write_text("word\trank\na\t1\n")
    assert [tuple(r) for r in shards.read_ranks(spark, str(tmp_path / "r.tsv")).collect()] == [("a", 1)]
    out = str(tmp_path / "log")
    assert [shards.append_new(spark.range(k), out, ["id"]) for k in (3, 5, 5)] == [3, 2, 0]


def test_dump(spark, tmp_path):
    import gzip

    line = {
        "word": "calm", "lang": "English", "lang_code": "en", "pos": "adj", "etymology_number": 1, "etymology_text": "From French.",
        "etymology_templates": [{"name": "der", "args": {"1": "en", "2": "fr", "3": "calme", "10": "x", "t": "still"}, "expansion": "calme"}],
        "senses": [{"glosses": ["still"], "tags": ["UK"], "examples": [{"text": "A calm sea.", "ref": "1719, Defoe"}, {"text": "x", "ref": "from 1650"}]}, {"glosses": ["top", "g" * 130], "form_of": [{"word": "be"}]}],
        "sounds": [{"ipa": "/kɑm/"}, {"ogg_url": "a.ogg", "tags": ["US"]}, {"mp3_url": "b.mp3"}], "derived": [{"word": "calmly"}, {"word": "calmly"}],
    }
    path = str(tmp_path / "dump.jsonl.gz")
    with gzip.open(path, "wt") as f:
        f.write(json.dumps(line) + "\nbroken\n")
    dump = shards.read_lines(spark, path, shards.DUMP)
    r = shards.slim(dump).collect()
    assert len(r) == 1 and r[0].w == "calm" and r[0].g == ["still", "g" * 118 + "…"] and r[0].dv == ["calmly"] and r[0].ipa == "/kɑm/"
    assert [tuple(t) for t in r[0].et] == [("der", ["en", "fr", "calme", "x"], "still")]
    t = shards.rich(dump)
    assert [(x.gloss[:5], x.form_of, x.attest_year) for x in t["sense"].orderBy("ord").collect()] == [("still", None, 1650), ("ggggg", "be", None)]
    assert t["section"].count() == 1 and shards.best_audio(t["sound"]).first()["audio"] == "b.mp3"
    shards.write_report(t["section"], str(tmp_path / "report"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "report")).count() == 1


def test_json_shards(spark, tmp_path):
    """Words of any characters come back as they were written, a word a line in order; a word that is there twice is refused."""
    words = ['say "x"', "back\\slash", "né", "a b", "ab", "aB", "{", "tab\there", "it's", "zz"]
    frame = spark.createDataFrame([(w, [(f"gloss of {w}",)], w.upper()) for w in words], "word string, d array<struct<g:string>>, e string")
    path = str(tmp_path / "json")
    shards.write_json_shards(frame, path)
    back = shards.read_shards(spark, f"{path}/*")
    assert {r.word: (r.d[0].g, r.e) for r in back.collect()} == {w: (f"gloss of {w}", w.upper()) for w in words}
    of = [r.value for r in spark.read.text(f"{path}/shard=ab").collect()]
    assert [x.split('"')[1] for x in of[1:-1]] == ["aB", "ab"]
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark's own error, or ours
        shards.write_json_shards(frame.union(frame), str(tmp_path / "twice"))
