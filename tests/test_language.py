"""Pronunciation, etymology and layout functions."""

from math import hypot

from pyspark.sql import functions as F

from sparkloom.functions import etymology as ety
from sparkloom.functions import language, phonetic, predicates
from sparkloom.operators.layout import radial


def test_pronunciation():
    assert phonetic.pronounce("W ER1 D") == ("/wɝd/", "wurd")
    assert phonetic.pronounce("AH0 B AW1 T") == ("/əˈbaʊt/", "uh-BOWT")
    assert phonetic.pronounce("EH1 K S T R AH0") == ("/ˈɛkstrə/", "EHK-struh")
    assert phonetic.pronounce("?") is None
    assert phonetic.respell("/əˈbaʊt/, /x/") == "uh-BOWT" and phonetic.respell(None) == ""
    assert phonetic.signs("tʃat") == ["tʃ", "a", "t"]
    assert phonetic.consonant_difference("uh-BOWT", "uh-BOWD") == 2


def test_terms():
    assert ety.bracketed("a<t:b<c>><id:d>") == ("a", ["t:b<c>", "id:d"])
    assert ety.term("fr:mot<t:word>", "en") == ety.Term("fr", "mot", "word") and ety.term("x<alt:y>", "en").text == "x"
    assert [ety.connection(x) for x in (" + ", ", or borrowed from ", ". Compare ", ", from ", ". Ultimately from ", " and further from ")] == ["+", "&", ".", "", "", ""]
    assert not ety.is_word("ine-pro:") and ety.is_word("mot")


def test_steps():
    got = ety.steps("en", [("inh", ["en", "enm", "word"], ""), ("inh", ["en", "ang", "word"], ""), ("der", ["en", "gem-pro", "*-dą"], ""), ("cog", ["de", "Wort"], "."), ("suffix", ["en", "word", "y"], "")])
    assert [(s.child.text if s.child else None, s.parent.language, s.parent.text, s.kind, s.inferred) for s in got] == [(None, "enm", "word", "inh", False), ("word", "ang", "word", "inh", True), ("word", "gem-pro", "*-dą", "part", True), (None, "en", "word", "part", False), (None, "en", "-y", "part", False)]
    assert [s.kind for s in ety.steps("en", [("bor", ["en", "fr", "a"], ""), ("bor", ["en", "la", "b"], "."), ("root", ["en", "ine-pro", "*bʰ-"], "")])] == ["bor", "root"]


def test_prose():
    text = "From Latin verbum (“word”), c. 1300. Cognate with Gothic waurd."
    assert ety.sentences(text) == ["From Latin verbum (“word”), c. 1300.", "Cognate with Gothic waurd."]
    assert ety.shortened(text, 40) == "From Latin verbum (“word”), c. 1300."
    assert ety.source_words(text, ("Latin", "Gothic")) == [ety.Term("Latin", "verbum", "word"), ety.Term("Gothic", "waurd")]
    once = ety.with_fact(text, "Doublet of verb.")
    assert once.endswith("verb.") and ety.with_fact(once, "Doublet of verb.") == once
    assert ety.parents_of([1, 2, 3, 2, 1, 2]) == [None, 0, 1, 0, None, 4]
    assert ety.tile("biology", ["bio", "logy", "b", "iology"]) == ["bio", "logy"] and ety.tile("word", ["wor"]) is None
    assert ety.corroboration([("bio", "life"), ("logy", "study")], "from bio- and study") == "ok" and ety.corroboration([("x", "y")], "nothing") == "suspect"
    assert ety.roman(1994) == "MCMXCIV"


def test_layout(spark):
    rows = [(1, 1, None, -4000), (1, 2, 1, -50), (1, 3, 2, 2000), (1, 4, 1, 1500), (2, 9, None, 100)]
    got = {r.node: (r.x, r.y) for r in radial(spark.createDataFrame(rows, "tree long, node long, parent long, year int")).collect()}
    assert got[1] == (0, 0) and got[9] == (0, 0)
    assert 0 < hypot(*got[2]) < hypot(*got[3])


def test_spellings_and_references(spark):
    words = {"color": 1, "colour": -1, "organize": 1, "organise": -1, "dialog": 1, "dialogue": -1, "defense": 1, "offence": -1, "fence": 0, "traveled": 1, "travelled": -1, "or": 0, "colors or colours": -1, "analyze the dialogue": 0, "doors": 1}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", language.american(F.col("w")).alias("n"))
    assert {r.w: r.n for r in rows.collect()} == words
    glosses = {"a piece in this style": True, "of the same kind": True, "With The Above regard": True, "in that room": False, "kind of this": False}
    rows = spark.createDataFrame([(g,) for g in glosses], "g string").select("g", predicates.refers_back(F.col("g")).alias("b"))
    assert {r.g: r.b for r in rows.collect()} == glosses
