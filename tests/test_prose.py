"""Etymologies: prose from rows, rows from prose."""

import pytest

from sparkloom.functions.prose import parse
from sparkloom.operators import etymology

LANGUAGES = frozenset("Latin|French|Greek|English|German|Indo-European|Germanic|Ottoman Turkish|Norse".split("|"))


def read(prose, word="entry"):
    return [tuple(x) for x in parse(word, prose, LANGUAGES)]


def test_chains():
    assert read("From Middle French hostel (“inn”), from Old French ostel, from Late Latin hospitāle.") == [
        ("der", "Middle French", "hostel", "inn", "", -1), ("der", "Old French", "ostel", "", "", 0), ("der", "Late Latin", "hospitāle", "", "", 1),
    ]
    assert read("Borrowed from Latin a; probably from Greek b.") == [("bor", "Latin", "a", "", "", -1)]
    assert read("First attested in 1534, probably inherited from Old Norse x, ultimately from Proto-Germanic *y.") == [("inh", "Old Norse", "x", "", "probably", -1), ("der", "Proto-Germanic", "*y", "", "ultimately", 0)]
    assert read("Learned borrowing from Ottoman Turkish k via French l.") == [("lbor", "Ottoman Turkish", "k", "", "", -1), ("via", "French", "l", "", "", 0)]
    assert read("From French feminine form of Latin bonus, or from Greek z.") == [("der", "Latin", "bonus", "", "", -1)]


def test_brackets_nest():
    """What a bracket explains is the step before it; behind it the text goes on from there."""
    got = read("From French a (“one (two)”, from Latin b (“b's”, itself from Greek c)), from German d.")
    assert got == [("der", "French", "a", "one (two)", "", -1), ("der", "Latin", "b", "b's", "", 0), ("der", "Greek", "c", "", "", 1), ("der", "German", "d", "", "", 0)]
    assert read("From Latin a (compare German b, see c), from Greek d") == [("der", "Latin", "a", "", "", -1), ("der", "Greek", "d", "", "", 0)]
    for broken in ("From Latin a (“open", "From Latin a ((from", "(((", "From", "From (“x”)", "Doublet of", "+ + +", "“", ")", "From Latin a) b (", None, ""):
        assert len(read(broken)) <= 1


def test_parts_and_lists():
    assert read("From in- (“not”) + crēdibilis.") == [("part", "English", "in-", "not", "", -1), ("part", "English", "crēdibilis", "", "", -1)]
    assert read("From Latin in- + crēdō (“believe”), from Greek x.")[:2] == [("part", "Latin", "in-", "", "", -1), ("part", "Latin", "crēdō", "believe", "", -1)]
    assert read("Equivalent to un- + heard.") == [("part", "English", "un-", "", "", -1), ("part", "English", "heard", "", "", -1)]
    assert [x[:3] for x in read("Doublet of hotel, hostel, entry and hospital. See also x y, c.")] == [("doublet", "English", w) for w in ("hotel", "hostel", "hospital")] + [("see", "English", "x y"), ("see", "English", "c")]
    assert [x[:4] for x in read("Cognate with German Haus (“house”), Latin x and y, English z.")] == [("cognate", "German", "Haus", "house"), ("cognate", "Latin", "x", ""), ("cognate", "Latin", "y", ""), ("see", "English", "z", "")]
    assert [x[0] for x in read("From Latin a, cognate with Greek b. From Greek c.")] == ["der", "cognate"]


def test_deep_and_long():
    deep = "From Latin a " + "(from Greek b " * 40 + ")" * 40 + ", from German z."
    got = read(deep)
    assert len(got) == 42 and [x[5] for x in got] == [*range(-1, 40), 0]
    assert len(read("From Latin a, " + "from Greek b, " * 2000)) == 2001


def test_assembled(spark):
    rows = [
        ("hotel", 1, "borrowed_from", "French", " hôtel ", 0), ("hotel", 2, "derived_from", "French", "hôtel", 0), ("hotel", 3, "inherited_from", "Latin", "hospitale", 0), ("hotel", 4, "inherited_from", None, None, 0),
        ("lab", 1, "clipping_of", "English", "laboratory", 0), ("lab", 2, "named_after", "Latin", "x", 0), ("unheard", 1, "has_prefix", "English", "un", 0), ("unheard", 2, "has_affix", "English", "heard", 1), ("unheard", 3, "has_suffix", "English", "-ed", 2),
        ("one", 1, "has_suffix", "English", "ing", 0), ("deep", 9, "has_affix", "Greek", "b", 1), ("deep", 8, "has_affix", "English", "a", 1), ("deep", 7, "has_affix", "Greek", "b", 5), ("other", 1, "cognate_of", "Greek", "b", 5), (None, 1, "clipping_of", "", "x", 0),
        *(("long", k, "inherited_from", f"L{k}", f"t{k}", 0) for k in range(9)), *(("wide", k, "compound_of", "", f"part{k}", k) for k in range(300)),
    ]
    relations = spark.createDataFrame(rows, "word string, row long, reltype string, language string, term string, position long")
    glosses = spark.createDataFrame([("Latin", "hospitale", "inn"), ("Latin", "hospitale", "guest house"), ("French", "hôtel", "no"), ("L4", "t4", "")], "language string, term string, gloss string")
    got = {r.word: r.prose for r in etymology.assembled(relations, glosses).collect()}
    assert got == {
        "hotel": "Borrowed from French hôtel, from Latin hospitale (“guest house”).", "lab": "Clipping of laboratory.", "unheard": "By surface analysis, un- + heard + -ed.", "deep": "By surface analysis, a + Greek b.",
        "long": "From L0 t0, from L1 t1, from L2 t2, from L3 t3, from L4 t4.", "wide": ("By surface analysis, " + " + ".join(f"part{k}" for k in range(300)))[:400],
    }
    # and read back
    back = etymology.parsed(spark.createDataFrame(list(got.items()), "word string, prose string"), ["French", "Latin", "Greek", *(f"L{k}" for k in range(9))]).collect()
    assert [(r.kind, r.language, r.term, r.gloss) for r in sorted(back, key=lambda r: r.place) if r.word == "hotel"] == [("bor", "French", "hôtel", ""), ("der", "Latin", "hospitale", "guest house")]


@pytest.mark.parametrize(
    ("prose", "want"),
    [
        ("Compound of melon + head.", [("English", "melon", "part"), ("English", "head", "part")]), ("Compound of melon + feet.", []), ("Latin fēmina + -ist + -in", [("Latin", "fēmina", "part"), ("English", "-ist", "affix"), ("English", "-in", "affix")]),
        ("From head.", [("English", "head", "der")]), ("From Head (“top”), from Latin x.", [("English", "Head", "der")]), ("Clipping of the noun Berlin", [("English", "Berlin", "der")]), ("Variant of entry.", []), ("From head and foot.", []),
        ("-ist + -in", []), ("Diminutive of berlin. From x.", [("English", "berlin", "der")]), ("Clipping of feet.", []), (None, []), ("", []), ("(1534) from head", [("English", "head", "der")]), ("a + b + c + d + e", []),
    ],
)
def test_derived(spark, prose, want):
    heads = spark.createDataFrame([("melon",), ("head",), ("Berlin",), ("entry",)], "word string")
    rows = etymology.derived(spark.createDataFrame([("entry", prose), ("entry", prose)], "word string, prose string"), heads, languages=["Latin"]).collect()
    assert [(r.language, r.term, r.kind) for r in sorted(rows, key=lambda r: r.place)] == want
