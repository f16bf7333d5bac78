"""Queries with functions of text in Python, ordered folds and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import morph
from ..operators import phrases, state
from ..streaming import events as streams
from ..streaming import sync
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()


def _right():
    return (F.col("event_type") != "error").alias("right")


def _folded(columns: str, start: str, step: str, result: str) -> str:
    """SQL that folds each user's events in order, `step` being the columns after one of them."""
    return f"""WITH RECURSIVE o AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type <> 'error' AS right, least(1.0, value / 20)::DOUBLE AS score, event_id % 8 AS words FROM events),
f({columns}) AS (SELECT DISTINCT user_id, 0::BIGINT, {start} FROM events UNION ALL SELECT f.user_id, o.k, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, {result} FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""


_SM2 = _folded(
    "user_id, k, ease, days, repetitions",
    "2.5::DOUBLE, 0.0::DOUBLE, 0::BIGINT",
    """CASE WHEN o.right THEN ease ELSE greatest(1.3, ease - 0.54::DOUBLE) END,
  CASE WHEN NOT o.right OR repetitions = 0 THEN 1.0 WHEN repetitions = 1 THEN 6.0 WHEN days * ease < 9007199254740992 THEN floor(days * ease + 0.5) ELSE days * ease END::DOUBLE, CASE WHEN o.right THEN repetitions + 1 ELSE 0 END""",
    "ease, days, repetitions",
)


@query(_SM2)
def sm2_fold(spark, sf_dir):
    """An error is a lapse; the state after each user's last event."""
    e = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", _right())
    return state.ordered_fold(e, "user_id", ["ts", "event_id"], ["right"], lambda: (2.5, 0.0, 0), state.sm2, "ease double, days double, repetitions long")


@query(
    _folded(
        "user_id, k, step, minutes, misses, ease, held",
        "0::BIGINT, 0.0::DOUBLE, 0::BIGINT, 1.0::DOUBLE, false",
        """CASE WHEN held AND o.right THEN step WHEN NOT o.right THEN 0 ELSE step + 1 END,
  CASE WHEN held AND o.right THEN minutes WHEN NOT o.right THEN 8.0 WHEN step = 4 THEN 0.0 ELSE [1440, 4320, 11520, 30240][step + 1] * least(1.6, ease + 0.04::DOUBLE) END::DOUBLE,
  CASE WHEN o.right THEN misses ELSE misses + 1 END,
  CASE WHEN held AND o.right THEN ease WHEN held THEN 1.0 WHEN NOT o.right AND step > 0 THEN greatest(0.55, ease - 0.2::DOUBLE) WHEN NOT o.right AND misses > 0 THEN greatest(0.55, ease - 0.1::DOUBLE)
    WHEN NOT o.right OR step = 4 THEN ease ELSE least(1.6, ease + 0.04::DOUBLE) END::DOUBLE, o.right AND (held OR step = 4)""",
        "step, minutes, misses, ease, held",
    )
)
def ladder_fold(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", _right())
    return state.ordered_fold(e, "user_id", ["ts", "event_id"], ["right"], lambda: (0, 0.0, 0, 1.0, False), state.ladder, "step long, minutes double, misses long, ease double, held boolean")


_MEAN = "list_avg(list_append(scores, o.score)[-5:])"
_ENOUGH = "o.words >= 3 AND len(scores) >= 3"


@query(
    _folded(
        "user_id, k, level, scores",
        "(user_id % 60 + 24)::BIGINT, []::DOUBLE[]",
        f"""CASE WHEN {_ENOUGH} AND {_MEAN} >= 0.85 AND level > 26 THEN CASE WHEN level > 70 THEN 62 ELSE level - 2 END WHEN {_ENOUGH} AND {_MEAN} < 0.5 AND level < f.user_id % 60 + 32 THEN level + 2 ELSE level END,
  CASE WHEN o.words < 3 THEN scores WHEN {_ENOUGH} AND ({_MEAN} >= 0.85 AND level > 26 OR {_MEAN} < 0.5 AND level < f.user_id % 60 + 32) THEN [] ELSE list_append(scores, o.score)[-8:] END""",
        "level, len(scores)::BIGINT AS n_scores",
    )
)
def level_fold(spark, sf_dir):
    """Users start at levels 24 to 83."""
    e = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", F.least(F.lit(1.0), F.col("value") / 20).alias("score"), (F.col("event_id") % 8).alias("words"), (F.col("user_id") % 60 + 24).alias("first"))
    step = lambda s, score, words, first: state.level(s or (first, first, ""), score, words)
    out = state.ordered_fold(e, "user_id", ["ts", "event_id"], ["score", "words", "first"], tuple, step, "level long, first long, scores string")
    return out.select("user_id", "level", F.when(F.col("scores") == "", 0).otherwise(F.size(F.split("scores", ","))).cast("long").alias("n_scores"))


@query(r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '\p{L}+(?:[''’\-]\p{L}+)*|[^\p{L}]+') AS l FROM conversations),
r AS (SELECT *, row_number() OVER () AS row FROM p),
u AS (SELECT conv_id, turn, row, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS token, unnest(list_transform(l, lambda x: length(x))) AS length FROM r),
c AS (SELECT *, sum(length) OVER (PARTITION BY row ORDER BY k ROWS UNBOUNDED PRECEDING) - length AS start FROM u)
SELECT conv_id, turn, start::BIGINT AS start, length, token FROM c WHERE regexp_matches(token, '^\p{L}')""")
def tokenize_offsets(spark, sf_dir):
    """Tokens of all turns with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [(c, t, s, n, w) for c, t, x in zip(*(k.to_pylist() for k in b.columns), strict=True) for s, n, w in morph.tokens(x or "")]
                kinds = [b.schema.field(0).type, b.schema.field(1).type, pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "turn", "start", "length", "token"])

    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "text")
    return c.mapInArrow(run, "conv_id long, turn long, start long, length long, token string")


#: Words that may stand between a phrase's words.
GAPS = ("the", "a", "an", "of", "le", "la", "de", "que", "die", "das", "und")
_STREAM = r"""list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+|[,.;:!?()«»"—–\n]'), lambda x: lower(x))"""
_SIGNS = """[',', '.', ';', ':', '!', '?', '(', ')', '«', '»', '"', '—', '–', chr(10)]"""
_GAP = "(" + ", ".join(f"'{g}'" for g in GAPS) + ")"


@query(f"""WITH RECURSIVE b AS (SELECT {_STREAM} AS w FROM benchmark),
runs AS (SELECT w[s + 1 : s + n] AS ws FROM (SELECT w, n, unnest(range(0, len(w) - n + 1)) AS s FROM b, (VALUES (2), (3)) v(n) WHERE len(w) >= n)),
ph AS (SELECT DISTINCT array_to_string(ws, ' ') AS phrase, ws, len(ws) AS size FROM runs WHERE NOT list_has_any(ws, {_SIGNS})),
t AS (SELECT doc_id, i - 1 AS p, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {_STREAM} AS w FROM documents))),
g AS (SELECT doc_id, p FROM t WHERE x IN {_GAP}),
pairs AS (
  SELECT t.doc_id, t.p AS a, u.p AS b, t.x AS x, u.x AS y FROM t JOIN t u ON t.doc_id = u.doc_id AND u.p BETWEEN t.p + 1 AND t.p + 3
  LEFT JOIN g g1 ON u.p > t.p + 1 AND g1.doc_id = t.doc_id AND g1.p = t.p + 1 LEFT JOIN g g2 ON u.p > t.p + 2 AND g2.doc_id = t.doc_id AND g2.p = t.p + 2
  WHERE (u.p = t.p + 1 OR g1.p IS NOT NULL) AND (u.p < t.p + 3 OR g2.p IS NOT NULL)),
c AS (
  SELECT doc_id, phrase, a AS start, [a, b] AS places, b - a - 1 AS gaps, [b - a - 1] AS spread FROM pairs JOIN ph ON size = 2 AND x = ws[1] AND y = ws[2]
  UNION ALL SELECT k.doc_id, phrase, k.a, [k.a, k.b, l.b], l.b - k.a - 2, [k.b - k.a - 1, l.b - l.a - 1] FROM pairs k JOIN ph ON size = 3 AND k.x = ws[1] AND k.y = ws[2]
    JOIN pairs l ON l.doc_id = k.doc_id AND l.a = k.b AND l.y = ws[3] WHERE l.b - k.a - 2 <= 2),
one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, phrase, start ORDER BY spread) = 1),
r AS (SELECT *, max(places[-1]) OVER (PARTITION BY doc_id ORDER BY start, phrase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one),
st AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY doc_id ORDER BY start, phrase) AS stretch FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stretch ORDER BY gaps, len(places) DESC, start, phrase) AS k FROM st),
f AS (
  SELECT doc_id, stretch, 1 AS k, places AS taken, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.stretch, o.k, CASE WHEN list_has_any(taken, places) THEN taken ELSE list_concat(taken, places) END, NOT list_has_any(taken, places)
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.stretch = f.stretch AND o.k = f.k + 1)
SELECT doc_id, phrase, start::BIGINT AS start, array_to_string(places, ',') AS places, gaps::BIGINT AS gaps FROM f JOIN o USING (doc_id, stretch, k) WHERE kept""")
def phrase_match(spark, sf_dir):
    """Pairs and triples of words in the benchmark, in all documents, with up to two gaps."""
    t = Tables(spark, sf_dir)
    w = t.benchmark.select(phrases.stream(F.col("text")).alias("w")).where(F.size("w") > 1)
    runs = F.concat(*(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.slice("w", i, F.lit(n))) for n in (2, 3)))
    own = w.select(F.explode(runs).alias("words")).where(F.size("words") >= 2).where(~F.exists("words", lambda x: x.rlike(r"^[^\p{L}\p{M}\p{N}]$"))).select(F.array_join("words", " ").alias("phrase"), "words")
    found = phrases.match(t.documents.select(F.col("doc_id").alias("id"), "text"), own, GAPS)
    return found.select(F.col("id").alias("doc_id"), "phrase", F.col("start").cast("long").alias("start"), F.array_join(F.col("places").cast("array<string>"), ",").alias("places"), F.col("gaps").cast("long").alias("gaps"))


@query(f"""WITH {_VOCABULARY}, w AS (SELECT DISTINCT lower(word) AS w FROM vocabulary WHERE length(word) >= 4),
s AS (SELECT w, unnest(range(4, length(w) - 3)) AS k, unnest(['', 's', 'n']) AS linker FROM (SELECT w FROM w WHERE length(w) >= 8)),
x AS (SELECT w, k, l.linker FROM (SELECT w, unnest(range(4, length(w) - 3)) AS k FROM w WHERE length(w) >= 8) CROSS JOIN (VALUES (''), ('s'), ('n')) l(linker)),
c AS (SELECT x.w, w[1 : k] AS first, linker, w[k + length(linker) + 1 :] AS last FROM x WHERE w[k + 1 : k + length(linker)] = linker)
SELECT c.w AS word, first, linker, last FROM c JOIN w a ON a.w = first JOIN w b ON b.w = last
QUALIFY row_number() OVER (PARTITION BY c.w ORDER BY length(last) DESC, length(linker), first) = 1""".replace("""s AS (SELECT w, unnest(range(4, length(w) - 3)) AS k, unnest(['', 's', 'n']) AS linker FROM (SELECT w FROM w WHERE length(w) >= 8)),
""", ""))
def compound_split(spark, sf_dir):
    """Words that are two words of the vocabulary with a linker: the longest last part."""
    w = vocabulary(Tables(spark, sf_dir).documents).where(F.length("word") >= 4).select(F.lower("word").alias("w")).distinct()
    long_ = w.where(F.length("w") >= 8).withColumn("k", F.explode(F.sequence(F.lit(4), F.length("w") - 4)))
    c = long_.withColumn("linker", F.explode(F.array(F.lit(""), F.lit("s"), F.lit("n"))))
    c = c.where(F.expr("substring(w, k + 1, length(linker)) = linker"))
    c = c.selectExpr("w AS word", "substring(w, 1, k) AS first", "linker", "substring(w, k + length(linker) + 1) AS last").where(F.length("last") >= 4)
    ok = c.join(w.withColumnRenamed("w", "first"), "first", "left_semi").join(w.withColumnRenamed("w", "last"), "last", "left_semi")
    best = ok.groupBy("word").agg(F.min_by(F.struct("first", "linker", "last"), F.struct(-F.length("last"), F.length("linker"), "first")).alias("b"))
    return best.select("word", "b.first", "b.linker", "b.last")


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return streams.run(streams.tumbling(streams.source(spark, sf_dir)), spark, "tumbling", "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_lww(spark, sf_dir):
    return streams.run(streams.latest(streams.source(spark, sf_dir)), spark, "latest", "complete")


@query("""WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 6 HOUR AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
w AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS start, n FROM w WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_session(spark, sf_dir):
    """Sessions of users, closed ones only."""
    return streams.run(streams.sessions(streams.source(spark, sf_dir)), spark, "sessions", "append")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return streams.run(streams.deduplicated(streams.source(spark, sf_dir)), spark, "dedup", "append")




@query(_SM2)
def stream_sm2(spark, sf_dir):
    """The streaming twin of sm2_fold: each user's last state."""
    states = streams.run(streams.sm2_states(streams.source(spark, sf_dir)), spark, "sm2", "update")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("ease", "days", "repetitions"), "n").alias("s"))
    return last.select("user_id", "s.*")


_QUIET = 3 * 3600 * 1000


@query(f"""WITH c AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id AS id, event_type AS key, floor(value / 100)::BIGINT AS value FROM events),
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, id) > {_QUIET} AS gap FROM c),
r AS (SELECT *, 1 + sum(coalesce(gap, false)::INT) OVER (PARTITION BY user_id ORDER BY ms, id) AS round FROM g),
sizes AS (SELECT user_id, round, min(ms) AS start_ms, max(ms) AS last, count(*) AS n_changes, count(DISTINCT key) AS n_keys FROM r GROUP BY 1, 2),
closed AS (SELECT * FROM sizes WHERE last + {_QUIET} <= (SELECT max(ms) - 3600000 FROM c)),
k AS (SELECT user_id, round, key, arg_max(value, (ms, id)) AS value FROM r GROUP BY 1, 2, 3),
d AS (SELECT *, lag(value) OVER (PARTITION BY user_id, key ORDER BY round) AS before FROM k),
w AS (SELECT user_id, round, count(*) FILTER (WHERE before IS NULL OR before <> value) AS n_written FROM d GROUP BY 1, 2)
SELECT user_id, round::BIGINT AS round, start_ms, n_changes, n_keys, n_written FROM closed JOIN w USING (user_id, round) WHERE n_written > 0""")
def stream_sync(spark, sf_dir):
    """Each user's events as changes, synchronised when nothing has come for three hours."""
    with sync.with_rocks(spark):
        return streams.run(sync.rounds(sync.of_events(streams.source(spark, sf_dir)), _QUIET), spark, "sync", "append")
