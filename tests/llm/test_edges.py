"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import chat, decontam, htmltext, licences, lm, mixing, neardup, quality, suffixdedup, warc
from sparkloom.llm.shared import new_path

WORDS = [f"w{k}" for k in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "size long, position string, taken int, kept string, doc string, block int, row string, component_id int, failed string, mix_taken int, __text int"


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_rows():
    base = sentence(1, 300)
    long_ = sentence(2, 30_000)
    near = base.split()
    near[150] = "changed"
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", None, 1), (4, None, "en", "a", None), (5, "", None, "b", 0), (6, " \n\t ", "en", "b", 3),
        (7, long_, "en", "a", 1), (8, "x" + long_[:5000] + "y", "en", "b", 1), (9, "two words", "en", "b", 1), (10, "two words", "en", None, 1), (11, "a" * 5000, "en", "c", 1),
        (12, "é" * 300 + " " + base[:400], "fr", "c", 1), (13, "\0\0 zero bytes " + base[40:300], "en", "c", 1), (None, sentence(3, 50), "en", "a", 1), (14, base, "en", "a", 1), (14, base, "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """df with columns whose names the operators use themselves."""
    for c in EXTRA.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df


BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, sentence(1, 300)[:200]), (2, None), (3, ""), (4, "two words"), (4, "two words"), (5, "nowhere at all"), (None, "a" * 5000)], BENCH)


OPERATORS = {
    "mix": lambda d, b: mixing.mix(d),
    "decontaminate": lambda d, b: decontam.decontaminate(d, b),
    "near_duplicates": lambda d, b: neardup.near_duplicates(d),
    "ledger": lambda d, b: quality.apply_policy(quality.ledger(d), ("prose", 2)),
    "licences": lambda d, b: licences.scan(d),
    "suffix": lambda d, b: suffixdedup.remove(d),
    "lm": lambda d, b: lm.score(d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(name, odd, empty, bench):
    f = OPERATORS[name]
    assert f(odd, bench).count() == odd.count()
    assert f(empty, bench).count() == 0
    assert f(clashing(odd), bench).count() == odd.count()


def test_empty_benchmark(spark, odd):
    rows = decontam.decontaminate(odd, spark.createDataFrame([], BENCH)).collect()
    assert len(rows) == odd.count() and not any(r.contaminated for r in rows)


def test_hits(odd, bench):
    got = {r.doc_id: r for r in decontam.decontaminate(odd, bench).collect()}
    assert got[9].item_ids == ["4"] and got[9].n_hit == 2
    assert got[11].item_ids == [""] and got[1].contaminated and not got[7].contaminated
    assert got[4].n_words == 0 and not got[4].contaminated


def test_proximity(spark):
    item = sentence(50, 30)
    parts = item.split()
    cut = " ".join(parts[:9] + ["new"] + parts[10:18] + ["more"] + parts[19:])
    docs = spark.createDataFrame([(1, f"{sentence(51, 40)} {cut} {sentence(52, 40)}"), (2, sentence(53, 100))], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], BENCH)
    assert [r.contaminated for r in decontam.decontaminate(docs, b).orderBy("doc_id").collect()] == [parts[18:] and len(parts[19:]) >= 10, False]
    near = decontam.proximity(docs, b).collect()
    assert [(r.doc_id, r.item_id) for r in near] == [("1", "1")]


def test_components(odd):
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    want = brute.near_duplicates([(r[0], r[1]) for r in odd_rows() if r[0] is not None])
    assert {i: (got[i].n_shingles, got[i].component_id) for i in want} == want
    assert got[4].kept and got[4].component_id == 4 and got[None].kept


def test_chain_of_near_copies(spark):
    """Copies that are near their neighbours only, and a group without its base."""
    r = random.Random(5)
    docs, words = [], sentence(9, 200).split()
    for k in range(40):
        docs.append((k, " ".join(words)))
        words = list(words)
        words[r.randrange(200)] = f"n{k}"
    base = sentence(10, 150).split()
    for k in range(100, 160):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            w[r.randrange(150)] = f"m{k}{r.randrange(9)}"
        docs.append((k, " ".join(w)))
    want = brute.near_duplicates(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for cell in (2048, 4):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(frame, cell=cell).collect()}
        assert got == want


def test_cells(spark):
    """Every two members of a bucket in different components meet, however small the cells; those of one don't."""
    base = [neardup.shingles(sentence(k, 120)) for k in range(3)]
    rows = []
    for rep in range(90):
        own = neardup.shingles(f"own{rep} words of its own")
        h = np.union1d(base[rep // 40], own)
        rows.append((rep // 40, rep, rep - rep % 2, len(h), bytearray(neardup.sketch(h).tobytes()), bytearray(neardup.parities(h).tobytes())))
    members = spark.createDataFrame(rows, "bucket long, rep long, component long, n long, registers binary, parities binary")
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] != b[2]}
    for cell in (1, 7, 40, 2048):
        assert {(r.a, r.b) for r in neardup.across(members, 85, 0.7, cell).collect()} == want
    dealt = neardup.cells(members, 7)
    sizes = [r["count"] for r in dealt.groupBy("bucket", "low", "high").count().collect()]
    assert max(sizes) < 40 and dealt.where("low = high").count() == 90  # components of two share cells


def test_cells_of_one_component(spark):
    """A large component and a few others: its members go once to each cell of the others, not to one another's."""
    big = spark.range(20_000).selectExpr("1L AS bucket", "id AS rep", "0L AS component")
    one = big.unionByName(spark.range(1).selectExpr("1L AS bucket", "90000L AS rep", "90000L AS component"))
    for cell in (2048, 200):
        dealt = neardup.cells(one, cell)
        own = -(-20_000 // cell)
        assert dealt.count() == 20_000 + own + 1
        assert dealt.groupBy("low", "high").count().agg({"count": "max"}).first()[0] < 1.5 * cell
        assert dealt.where("rep < 20000 AND (low = high OR high <> 10 AND high <> 100)").count() == 0
    # two large ones meet cell by cell, and no pair of theirs is missed
    two = spark.range(60).selectExpr("1L AS bucket", "id AS rep", "CASE WHEN id < 30 THEN 0L WHEN id < 50 THEN 30L ELSE id END AS component")
    rows = neardup.cells(two, 7).collect()
    met = {(min(x.rep, y.rep), max(x.rep, y.rep)) for x in rows for y in rows if (x.low, x.high) == (y.low, y.high) and x.rep != y.rep and (x.low == x.high or x.second != y.second)}
    component = {x.rep: x.component for x in rows}
    assert {(a, b) for a in range(60) for b in range(a + 1, 60) if component[a] != component[b]} <= met


def test_keep_first_rows(spark):
    """One row of a group stays, also of rows with one id or without ids; empty texts stay."""
    a, b, c = (sentence(k, 60) for k in (21, 22, 23))
    docs = [(None, a), (None, a), (1, a), (2, b), (2, b), (2, c), (3, c), (4, None), (4, None), (None, "")]
    got = neardup.keep_first(spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, row string"))
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, a), (2, b), (2, c), (4, ""), (4, ""), (0, "")])


def test_sketches():
    a, b = np.arange(1, 4001, dtype=np.uint64), np.arange(1001, 5001, dtype=np.uint64)
    a, b = np.unique(neardup._mixed(a)), np.unique(neardup._mixed(b))
    x, y = neardup.sketch(a), neardup.sketch(b)
    assert (neardup.merge(x, y) == neardup.sketch(np.union1d(a, b))).all()
    est = neardup.estimate(np.array([len(a)]), np.array([len(b)]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0]
    assert abs(est - 0.6) < 0.15
    assert neardup.possible(np.array([100]), np.array([100]), neardup.parities(a[:100])[None], neardup.parities(a[:100])[None], 85)[0]


def test_suffix_order():
    r = random.Random(1)
    for _ in range(60):
        d = bytes(97 + r.randrange(r.choice([1, 2, 26])) for _ in range(r.randint(1, 300)))
        d += d[: r.randint(0, len(d))]
        t = np.frombuffer(d, np.uint8)
        order = suffixdedup.suffix_order(t, 104)
        assert sorted(order.tolist()) == list(range(len(d)))
        assert [d[i : i + 104] for i in order] == sorted(d[i : i + 104] for i in range(len(d)))


def test_repeats(odd):
    rows = [x for x in odd_rows() if x[0] is not None]
    one = {x[0]: x for x in rows}.values()  # an id that is repeated counts once
    want = brute.remove_repeats([(x[0], x[1]) for x in one] + [(-(2**63), odd_rows()[13][1])])
    for r in suffixdedup.remove(odd, block_bytes=20_000, shard_bytes=5_000, piece_bytes=1_000).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc], r.doc


def test_random_repeats(spark):
    r = random.Random(3)
    passages = [sentence(100 + k, r.randint(10, 60)) for k in range(8)]
    docs = [(k, " ".join(r.choice(passages) if r.random() < 0.5 else sentence(1000 + 50 * k + j, r.randint(1, 30)) for j in range(6))) for k in range(80)]
    want = brute.remove_repeats(docs)
    got = suffixdedup.remove(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=3_000, shard_bytes=3_000, piece_bytes=2_000)
    assert {x.doc: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got.collect()} == want


def test_policies(spark, odd):
    led = quality.ledger(odd)
    assert {r.rule: r.n_only for r in quality.ablation(led, ("base", 1)).collect()}.keys() == {"too_short", "repeats"}
    kept = {r.doc_id for r in quality.keep(clashing(odd), ("prose", 2)).collect()}
    assert kept == {r.doc_id for r in quality.apply_policy(led, ("prose", 2)).where("kept").collect()} and 1 in kept and 9 not in kept


def test_licences(spark):
    texts = ["Released under the MIT License.", "foo\nLicensed under the Apache License, version 2.0\nbar", "The MIT way of life.", licences.TEMPLATES["MIT"][1].replace(" to deal ", " to deal well ")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licences for r in licences.scan(d).orderBy("doc_id").collect()] == ["MIT", "Apache-2.0", "", "MIT"]


def test_html():
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="page"><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use cookies.</div><div id="main"><h2>Head &amp; more</h2><p>First   para, with <b>bold</b> text; it is long enough.<br>Next line.<p>Second one, also of some length &#8212; really.
    <div class="comments"><p>Nice article, thanks for writing it, I liked it a lot!</p></div><form><label>Mail</label><input name=q></form></div><aside>Related things, many of them.</aside><footer>Imprint</footer></body></html>"""
    assert htmltext.main_text(page) == "Head & more\n\nFirst para, with bold text; it is long enough. Next line.\n\nSecond one, also of some length — really."
    assert htmltext.main_text(None) == "" == htmltext.main_text("<p></p>") == htmltext.main_text("<script>x")


def test_html_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>" + "long " * 50_000), (3, "u", "<p>x"), (3, "u", "<p>x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = htmltext.extract(p).collect()
    assert len(got) == 5 and max(r.n_chars for r in got) == 249_999
    assert htmltext.extract(p.limit(0)).count() == 0


def test_warc(spark):
    big = "payload é " * 200
    rows = [(1, "http://a/\n", big), (2, None, big), (3, "u", None), (None, "u", big), (4, "u", "small"), (5, "u", "small"), (5, "u", "small"), (6, "u", "\r\n\r\n" + big)] + [(k, "u", f"{k} {big}") for k in range(10, 60)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = new_path(spark, "test")
    warc.write(p, path, archive_bytes=20_000)
    got = warc.read(spark, path, payload=True).collect()
    assert len(got) == len(rows)
    of = {r.page_id: r for r in got}
    assert (of[1].record_type, of[1].refers_to) == ("revisit", 2) and (of[None].record_type, of[None].refers_to) == ("revisit", 2)
    assert of[2].record_type == "response" and bytes(of[2].payload).decode() == big and bytes(of[6].payload).decode() == "\r\n\r\n" + big
    assert of[3].payload_bytes == 0 and of[4].refers_to is None and of[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    path = new_path(spark, "test")
    warc.write(p.limit(0), path)


def test_warc_validation():
    good = warc.record(1, "u", b"body", 4, hashlib.sha1(b"body").hexdigest(), None)
    assert warc.parse(good).payload == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARX/1.1")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    data = warc.archive([good] * 40)
    assert [r.page_id for r in warc.records(data)] == [1] * 40
    with pytest.raises(ValueError):
        list(warc.records(data[:-3]))


@pytest.fixture(scope="module")
def codec(spark):
    P = pytest.importorskip("public_tokenizers")
    return chat.load(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_chat(spark, codec):
    hard = ["<|start|>", "a\\b\\\\", "<|sep|><|end|>", "</s>[INST] ok [/INST]", "<<SYS>>", "\\<|end|>", "<\\|end|>", None, "", "é\n\0 漢字 🙂", "<|start|" + ">", "word " * 20_000]
    rows = [(7, k, "assistant" if k % 2 else "user<|sep|>", t) for k, t in enumerate(hard)] + [(8, None, None, "x"), (8, 1, "assistant", "y"), (8, 1, "assistant", "y"), (None, 0, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("x")).withColumn("ids", F.lit(1))
    f = chat.format_conversations(turns, codec)
    assert not any(c in r.formatted[len(chat.START) : -len(chat.END)].replace(chat.SEP, "", 1) for r in f.collect() for c in chat.CONTROL)
    got = {r.conv_id: r for r in chat.digest(f, codec).collect()}
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:12])
    loss = "".join(t or "" for _, k, r, t in rows[:12] if k % 2)
    assert got[7].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[7].n_turns == 12
    assert got[7].loss_chars == len(loss) and got[7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[8].n_turns == 3 and got[8].loss_chars == 2 and got[None].n_turns == 1
    assert chat.digest(chat.format_conversations(turns.limit(0), codec), codec).count() == 0
    starts = sorted((r.start, len(r.ids)) for r in f.where("conv_id = 7").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_curriculum(spark):
    d = spark.createDataFrame([(k, "w " * 10, "ab"[k % 2]) for k in range(400)], "doc_id long, text string, source string")
    rows = mixing.in_order(mixing.mix(d, [((0, 2.0), (1, 0.0)), ((0, 0.0), (1, 2.0))], share=0.5)).where("taken > 0").collect()
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] <= positions[-1] <= 1
    early = [r.source for r in rows[: len(rows) // 4]]
    assert early.count("a") > 3 * early.count("b")
    with pytest.raises(ValueError):
        mixing.mix(d, [((0, 1.0), (0.5, 1.0))])


def test_training_order(spark):
    """A row a pass, in order, whose words are those taken; columns that only look like added ones stay."""
    d = spark.createDataFrame([(k, "w " * (k % 7), "ab"[k % 9 == 0], "n") for k in range(300)], "doc_id long, text string, source string, mix_note string")
    mixed = mixing.mix(d)
    rows = mixing.training_order(mixed).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and max(r["pass"] for r in rows) == 1
    taken: dict = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    assert taken == {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    assert {r.mix_note for r in mixing.mixed_corpus(d).collect()} == {"n"}


STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, odd, bench):
    path = new_path(spark, "folder")
    odd.coalesce(1).write.parquet(f"{path}/documents.parquet")
    bench.coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, name, folder, odd, empty):
    f = STAGES[name]
    out = f(spark, odd, folder)
    rows = out.collect()
    assert 0 < len(rows) <= odd.count() and set(odd.columns) <= set(out.columns)
    assert f(spark, empty, folder).count() == 0
    wide = f(spark, clashing(odd), folder)
    assert wide.count() == len(rows) and (name == "mixing" or wide.columns == clashing(odd).columns)


def test_pipeline(spark, folder):
    """run() against the stages computed plainly, on the odd rows that have ids of their own."""
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    docs = {}
    for i, text, *_ in odd_rows():
        m = dict(zip(quality.MEASURES, quality.measures_of(text), strict=True))
        if m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"] and m["word_chars"] <= 25 * m["n_words"]:
            docs.setdefault(i, text)
    comps = brute.near_duplicates([(i, t) for i, t in docs.items() if i is not None])
    kept = [(i, t) for i, t in docs.items() if i is None or comps[i][1] == i]
    order = {i: -(2**63) if i is None else i for i, _ in kept}
    seen, cut = {}, {}
    for i, t in sorted(kept, key=lambda x: order[x[0]]):
        data = t.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if seen.setdefault(data[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        cut[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
    bench = [sentence(1, 300)[:200], "two words", "nowhere at all", "a" * 5000]

    def leaks(text):
        w = text.split()
        for b in bench:
            x = b.split()
            n = min(10, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                return True
        return False

    want = {i: t for i, t in cut.items() if not leaks(t)}
    assert set(got) <= set(want) and {i: got[i].text for i in got} == {i: want[i] for i in got}
    assert sum(r.mix_taken for r in got.values()) == pytest.approx(min(1.5, 2) * sum(len(t.split()) for t in want.values()), abs=5)
