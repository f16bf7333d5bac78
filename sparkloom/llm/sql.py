"""DuckDB SQL with the rows of this package's queries."""

from .chat import CONTROL, END, SEP, START
from .licences import LEAST, TEMPLATES

#: Plain words of a text.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
run AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM sized),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS sched FROM sized GROUP BY source),
w AS (SELECT *, CASE sched WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS mix FROM w),
c AS (
  SELECT *, sum(cap) OVER o AS caps, (sum(weight) OVER ()) - (sum(weight) OVER o) AS free FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, CASE WHEN caps + ratio * free >= mix THEN (mix - (caps - cap)) / (free + weight) END AS own FROM c),
lev AS (SELECT own AS level FROM l WHERE own IS NOT NULL ORDER BY ratio, source NULLS LAST LIMIT 1),
goals AS (SELECT source, source_size, sched, least(cap, level * weight) AS target FROM l, lev),
m AS (
  SELECT run.doc_id, size, source_size, target, sched, start, floor(target)::BIGINT AS goal
  FROM run JOIN goals ON run.source IS NOT DISTINCT FROM goals.source),
p AS (
  SELECT *, greatest(0, least(size, goal - start)) AS one, greatest(0, least(size, goal - source_size - start)) AS two FROM m),
q AS (
  SELECT *, CASE WHEN one > 0 THEN (start + one / 2) / target END AS u,
    CASE sched WHEN 0 THEN 4.0 / 3 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS w0,
    CASE sched WHEN 0 THEN -2.0 / 3 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS slope FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  round(2 * u / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * u))), 9) AS position FROM q
"""

_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP2 = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({_LOW.format("text")}, '{_CLASS}') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW.format("text")}, '{_CLASS}') AS w FROM documents),
grams AS (
  SELECT row, n, s, array_to_string(w[s + 1 : s + n], ' ') AS words
  FROM (SELECT row, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT row, item_id, s, grams.n FROM grams JOIN windows USING (words) WHERE grams.n = windows.n),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hits) GROUP BY row),
which AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN which USING (row)
"""

OP4 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (
  SELECT row, s, array_to_string(w[s + 1 : s + 8], ' ') AS words FROM (SELECT row, w, unnest(range(0, len(w) - 7)) AS s FROM t WHERE len(w) >= 8)),
rep AS (SELECT row, s FROM g QUALIFY count(*) OVER (PARTITION BY row, words) > 1),
cov AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(s, s + 8)) AS p FROM rep) GROUP BY row),
ln AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
  FROM (SELECT row, unnest(lines) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_stutter,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters
  FROM t LEFT JOIN ln USING (row) LEFT JOIN cov USING (row)),
f AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
    + 8 * (2 * n_upper > n_letters)::BIGINT + 16 * (n_lines >= 5 AND 2 * n_dup_lines > n_lines)::BIGINT
    + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (100 * n_stutter > 30 * n_words)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed = 0 AS kept, failed FROM f
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TERMS = r"list_filter(string_split(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_PLACES = "SELECT {0}, unnest(range(0, len(w) - 1)) AS {1}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b"
OP5 = rf"""
WITH RECURSIVE templates(licence, template, part) AS (VALUES {", ".join(f"({_quoted(n)}, {k}, {_quoted(t)})" for n, ts in TEMPLATES.items() for k, t in enumerate(ts))}),
tw AS (SELECT licence, template, {_TERMS} AS w FROM templates),
tb AS (SELECT *, count(*) OVER (PARTITION BY licence, template, b) AS often FROM ({_PLACES.format("licence, template, len(w) - 1 AS size", "place")} FROM tw)),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
dw AS (SELECT row, {_TERMS.replace("part", "text")} AS w FROM docs WHERE text IS NOT NULL),
db AS ({_PLACES.format("row, len(w) - 1 AS n_doc", "pos")} FROM dw WHERE len(w) >= 2),
once AS (SELECT DISTINCT licence, template, size, b, often FROM tb),
hits AS (SELECT row, licence, template, size, b, often, pos FROM db JOIN once USING (b) WHERE n_doc >= size * ({LEAST} / (2 - {LEAST}))),
many AS (
  SELECT x.row, x.licence, x.template, x.size, x.pos AS first FROM hits x JOIN hits y ON y.row = x.row AND y.licence = x.licence AND y.template = x.template AND y.pos >= x.pos AND y.pos < x.pos + floor(x.size * (2 - {LEAST}) / {LEAST} + 1e-9)
  GROUP BY ALL HAVING count(*) >= ceil(x.size * {LEAST} / (2 - {LEAST}) - 1e-9)),
w AS (
  SELECT m.row, m.licence, m.template, m.size, m.first, h.pos AS last, row_number() OVER (PARTITION BY m.row, m.licence, m.template, m.first, h.b ORDER BY h.pos) <= h.often AS counts
  FROM many m JOIN hits h ON h.row = m.row AND h.licence = m.licence AND h.template = m.template AND h.pos >= m.first AND h.pos < m.first + floor(m.size * (2 - {LEAST}) / {LEAST} + 1e-9)),
e AS (
  SELECT row, licence, template, first, last, 2.0::DOUBLE * sum(counts::INT) OVER (PARTITION BY row, licence, template, first ORDER BY last)::DOUBLE / (last - first + 1 + size) AS dice FROM w),
d AS (SELECT row, licence, template, first, max(dice) AS dice, arg_max(last, (dice, last)) AS last FROM e GROUP BY row, licence, template, first),
good AS (SELECT *, max(last) OVER (PARTITION BY row ORDER BY first, last, licence, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d WHERE dice >= {LEAST}),
numbered AS (SELECT *, sum((reach IS NULL OR first > reach)::INT) OVER (PARTITION BY row ORDER BY first, last, licence, template ROWS UNBOUNDED PRECEDING) AS stretch FROM good),
o AS (SELECT *, row_number() OVER (PARTITION BY row, stretch ORDER BY dice DESC, last - first DESC, licence, first) AS k FROM (SELECT DISTINCT row, stretch, dice, first, last, licence FROM numbered)),
g AS (
  SELECT row, stretch, k, [first] AS fs, [last] AS ls, true AS kept FROM o WHERE k = 1
  UNION ALL SELECT row, stretch, next, CASE WHEN free THEN list_append(fs, first) ELSE fs END, CASE WHEN free THEN list_append(ls, last) ELSE ls END, free FROM (
    SELECT g.row, g.stretch, o.k AS next, fs, ls, o.first, o.last, len(list_filter(range(1, len(fs) + 1), lambda i: fs[i] <= o.last AND ls[i] >= o.first)) = 0 AS free FROM g JOIN o ON o.row = g.row AND o.stretch = g.stretch AND o.k = g.k + 1)),
best AS (SELECT row, licence, dice FROM g JOIN o USING (row, stretch, k) WHERE kept),
by_doc AS (SELECT row, string_agg(DISTINCT licence, ',' ORDER BY licence) AS l, count(*) AS u, max(dice) AS m FROM best GROUP BY row)
SELECT doc_id, coalesce(l, '') AS licences, coalesce(u, 0)::BIGINT AS n_units, coalesce(m, 0.0)::DOUBLE AS best_dice
FROM docs LEFT JOIN by_doc USING (row)
"""

OP3 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN 's ' || array_to_string(w, ' ') ELSE array_to_string(w[s + 1 : s + 5], ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS s FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
pair AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM pair UNION SELECT reach.doc_id, pair.b FROM reach JOIN pair ON reach.other = pair.a),
comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, t.doc_id) AS component_id, t.doc_id = coalesce(c, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
later AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS again FROM w),
b AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, n)) AS p FROM d)),
c AS (
  SELECT doc_id, p, x, max(coalesce(again, false)::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS 99 PRECEDING) AS gone
  FROM b LEFT JOIN later USING (doc_id, p)),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM c),
f AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone = 1 AND was = 0) AS n_spans,
    string_agg(x, '' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS size, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest AS d, max(page_id) AS first FROM p WHERE size >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON digest = d
"""

_CONTROL = "|".join("".join(f"\\{c}" if c in "<>|[]/" else c for c in x) for x in CONTROL)
_ESCAPED = rf"(length(regexp_replace(replace(coalesce({{0}}, ''), '\', '\\'), '({_CONTROL})', '\1~', 'g')))"
OP10 = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {sum(map(len, (START, SEP, END)))} + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: CRC-32 of strings: a table of 256 entries by the polynomial's rule, then a fold over a string's bytes.
_CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(strlen({0})), lambda i: ('0x' || hex({0})[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295)"""

OP11 = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW.format("text")}, '{_CLASS}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOW.format("text")}, '{_CLASS}') AS w FROM benchmark),
dn AS (SELECT row, x, count(*) AS n FROM (SELECT row, unnest(w) AS x FROM d) GROUP BY row, x),
bn AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY x),
place AS (SELECT x, {_CRC.format("x")} % 10000 AS bucket FROM (SELECT x FROM dn UNION SELECT x FROM bn), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dn JOIN place USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bn JOIN place USING (x) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), (SELECT coalesce(sum(s), 0) AS all_s FROM s), (SELECT coalesce(sum(t), 0) AS all_t FROM t)),
sums AS (SELECT row, sum(n * gain) AS total FROM dn JOIN place USING (x) JOIN gain USING (bucket) GROUP BY row),
weighed AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total / len(w)), 0)::BIGINT AS weight,
    ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM d LEFT JOIN sums USING (row)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    10 * count(*) FILTER (WHERE n_features >= 20) OVER () // 100 AS quota FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= quota THEN place END AS rank FROM ranked
"""

OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
hashed AS (SELECT w, n, {_CRC.format("(d || w)")} AS h FROM (SELECT d, w, count(*) AS n FROM runs GROUP BY d, w), crc_table),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (
  SELECT word, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT less.word AS a, v.word AS b FROM less JOIN v ON less.rest = v.word
  UNION SELECT v.word, less.word FROM less JOIN v ON less.rest = v.word
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (
  SELECT a, count(*) AS n_near, min({{'less': -v.n, 'word': b}}) AS best FROM pairs JOIN v ON b = v.word GROUP BY a),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 10 * n THEN best.word END AS form, CASE WHEN -best.less >= 10 * n THEN -best.less END AS form_n
  FROM v LEFT JOIN near ON word = a),
way AS (
  SELECT word, word AS last FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON way.last = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT way.word, last AS root FROM way JOIN forms ON way.last = forms.word WHERE forms.form IS NULL)
SELECT word, n, n_near, form, form_n::BIGINT AS form_n, root FROM forms JOIN ends USING (word)
"""

SQL = {
    "op1_mixing": OP1, "op2_decontamination": OP2, "op3_near_duplicates": OP3, "op4_quality_rules": OP4,
    "op5_licence_scan": OP5, "op6_suffix_dedup": OP6, "op8_warc": OP8, "op10_chat_format": OP10,
    "op11_resample": OP11, "op12_spelling_variants": OP12,
}
