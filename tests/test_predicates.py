"""Predicates, language rules and the rest of the graph's operators."""

from pyspark.sql import functions as F

from sparkloom.functions import language as lang
from sparkloom.functions import predicates as pred
from sparkloom.operators import graph


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_glosses(spark):
    said = {"A city in France.": True, "A male given name.": True, "A piece of furniture.": False, "Of Napoleon, after Paris and Rome.": True, "An inhabitant of Rome.": True, "The state of being calm.": False}
    for gloss, want in said.items():
        assert one(spark, pred.proper_gloss(F.lit(gloss))) == want, gloss
    assert tuple(one(spark, pred.pointer(F.lit("Alternative spelling of colour (US).")))) == ("spelling", "colour")
    assert tuple(one(spark, pred.pointer(F.lit("plural of mouse")))) == ("inflection", "mouse") and one(spark, pred.pointer(F.lit("A small animal."))) is None
    assert one(spark, pred.only_pointers(F.array(F.lit("plural of mouse"), F.lit("Obsolete form of mouse.")))) == "mouse"
    assert one(spark, pred.only_pointers(F.array(F.lit("plural of mouse"), F.lit("An animal.")))) is None
    assert one(spark, pred.quizzable(F.lit("calm"), F.lit("Free from disturbance."))) and not one(spark, pred.quizzable(F.lit("calm"), F.lit("Being calm in mind.")))
    assert [one(spark, pred.word_shape(F.lit(w))) for w in ("calm", "xviii", "brrr", "Calm")] == [True, False, False, False]
    assert [one(spark, pred.usable_example(F.lit(t))) for t in ("This is a good example.", "1893, Harte, A Story.", "short", "Слово о полку Игореве.")] == [True, False, False, False]
    assert one(spark, pred.entry_type(F.lit("Paris"), F.lit("A city in France."), F.lit(False))) == "name"
    ex = F.array(F.struct(F.lit("A quotation, long enough.").alias("text"), F.lit("quotation").alias("type"), F.lit("x").alias("ref")), F.struct(F.lit("An own example, here.").alias("text"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("ref")))
    assert one(spark, pred.best_example(ex)) == "An own example, here."
    assert one(spark, pred.quotation_ok(F.lit("Words in a line."), F.lit(10), F.lit(2), F.lit(10))) and not one(spark, pred.quotation_ok(F.lit("1970, Arendt"), F.lit(10), F.lit(0), F.lit(10)))


def test_language(spark):
    assert [one(spark, lang.era(F.lit(x))) for x in ("Latin", "Proto-Samic", "Old Javanese", "Late Middle Javanese", "Finnish", "Proto-Turkic")] == [-50, -1500, 1000, 1450, 1850, -500]
    assert [one(spark, lang.family(F.lit(x))) for x in ("English", "Old English", "Old Norse", "Finnish", "Klingon")] == ["English", "Older English", "Germanic", "Uralic, Turkic & Caucasian", "Other"]
    assert lang.title("*ḱḗr", "Proto-Indo-European") == "ḱēr" and lang.title("verbō", "Latin") == "verbo" and lang.title("root *x", "Gothic") == "x"
    assert one(spark, lang.title_key(F.lit("mōdor"), F.lit("Old English"))) == "modor" and one(spark, lang.folded(F.lit("*Été "))) == "ete"
    assert [one(spark, lang.nominative(F.lit(x))) for x in ("civitatem", "stationem", "actorem", "legionem")] == ["civitas", "statio", "actor", "legio"]
    assert one(spark, lang.kin(F.lit("egotistic"), F.lit("egotistical"))) and not one(spark, lang.kin(F.lit("cat"), F.lit("cats")))
    assert one(spark, lang.american(F.lit("colorize"))) > one(spark, lang.american(F.lit("colourise")))
    assert one(spark, lang.mentions_form(F.lit("They hoped so."), F.lit("hope"))) and not one(spark, lang.mentions_form(F.lit("shop"), F.lit("hop")))
    back = one(spark, lang.edge_of_bits(lang.edge_bits(F.lit("der"), F.lit("d"))))
    assert tuple(back) == ("der", True, False)
    assert one(spark, lang.snippet(F.lit("a" * 300), F.lit(150))).startswith("…") and one(spark, lang.size_byte(F.lit(0))) == 0
    assert one(spark, lang.edge_sentence(F.lit("bor"), F.lit("mot"), F.lit("French"))) == "borrowed from French mot"


def test_more_graph(spark):
    e = spark.createDataFrame([(1, 2, "inh"), (2, 3, "bor"), (4, 3, "der"), (3, 5, "inh"), (8, 9, "inh")], "child long, parent long, kind string")
    reach = graph.closure(e)
    n = lambda *x: spark.createDataFrame([(k,) for k in x], "node long")
    assert {r.child for r in graph.keep_ancestry(e, n(1)).collect()} == {1, 2, 3}
    deep = spark.createDataFrame([(k, k + 1) for k in range(15)] + [(15, 14)], "child long, parent long")
    assert graph.keep_ancestry(deep, n(0)).count() == 16
    assert {r.ancestor for r in graph.common_ancestors(reach, n(1, 4)).collect()} == {3, 5}
    got = {(r.node, r.role) for r in graph.focus(e.drop("kind"), 3).collect()}
    assert got == {(5, "ancestor"), (2, "child"), (4, "child"), (1, "grandchild")}
    langs = spark.createDataFrame([(1, "English"), (2, "Middle English"), (3, "French"), (5, "Latin"), (4, "English"), (9, "Proto-X"), (8, "English")], "node long, language string")
    assert {r.node: r.donor for r in graph.donor(reach, langs, ["English", "Middle English"]).collect()} == {1: "French", 2: "French", 3: "Latin", 4: "French", 8: None}
    assert [(r.nodes, r.kept) for r in graph.depth_report(reach, graph.closure(e.where("child <> 2"))).collect()] == [(5, 3)]
    nodes = spark.createDataFrame([(1, "English", "a"), (20, "English", "b"), (21, "Old English", "b"), (22, "Middle English", "b")], "node long, language string, title string")
    edges = spark.createDataFrame([(21, 3), (1, 2)], "child long, parent long")
    stages = spark.createDataFrame([("English", "Middle English", 0), ("English", "Old English", 1)], "language string, older string, ord int")
    assert [(r.child, r.parent) for r in graph.bridge(nodes, edges, stages).collect()] == [(20, 21)]
    rec = spark.createDataFrame([("w", 1, "g1"), ("w", 2, "g2"), ("v", 3, None)], "title string, ord int, g string")
    assert {r.title: (r.ord, r.glosses, r.merged) for r in graph.merge_nodes(rec, ["title"], [F.col("ord")], "g").collect()} == {"w": (1, ["g1", "g2"], 2), "v": (3, [], 1)}
    assert [r.child for r in graph.lineage_rows(reach, e, 1).collect()] == [5, 3, 2, 1]
    assert graph.reaches(e, spark.createDataFrame([(1, 5), (5, 1)], "node long, ancestor long")).count() == 1
    fam = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (2, "a", "b")], "child long, child_family string, parent_family string")
    assert [r.child for r in graph.fold_set(fam).collect()] == [1]
    ties = graph.tie_weights(spark.createDataFrame([(1, 8), (4, 9), (1, 2)], "child long, parent long"), spark.createDataFrame([(1, 5), (2, 5), (4, 5), (8, 9), (9, 9)], "node long, root long"))
    assert [tuple(r) for r in ties.collect()] == [(5, 9, 2)]


def test_names(spark):
    said = {"A surname.": True, "A female given name from Latin.": True, "A river in Germany": True, "An inhabitant of the coast.": False, "A Greek goddess of Hunt.": True, "A poet (1770–1850).": True, "The language of love.": False, None: False}
    for gloss, want in said.items():
        assert one(spark, pred.proper_gloss(F.lit(gloss).cast("string"))) == want, gloss
    assert one(spark, pred.only_name(F.array(F.lit("name")), F.lit("A city in Spain."))) and not one(spark, pred.only_name(F.array(F.lit("name")), F.lit("The third month of the year.")))
    assert not one(spark, pred.only_name(F.array(F.lit("name"), F.lit("noun")), F.lit("A city.")))
    assert [one(spark, pred.author(F.lit(x))) for x in ("Victor Hugo", "J. W. von Goethe", "Suhrkamp Verlag", "The Times", "of the sea 1990")] == [True, True, False, False, False]
    assert [one(spark, pred.publisher(F.lit(x))) for x in ("Suhrkamp Verlag", "Penguin Books", "Victor Hugo")] == [True, True, False]
    assert [one(spark, pred.press(F.lit(x))) for x in ("The New York Times", "Die Zeitung", "Victor Hugo")] == [True, True, False]
