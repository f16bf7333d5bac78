"""Every query of the package against its SQL, or a plain re-computation."""

import os

import brute
import plain_html
import pytest
from compare import DATA, compare

from sparkloom.llm import lm, queries
from sparkloom.llm.shared import table

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare(queries.queries()[name](spark, DATA), SQL[name]) > 0


def texts(spark):
    return [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]


def test_near_duplicates(spark):
    want = brute.near_duplicates(texts(spark))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_near_duplicates(spark, DATA).collect()}
    assert got == want


def test_suffix_dedup(spark):
    want = brute.remove_repeats(texts(spark))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, DATA).collect()}
    assert got == want


def test_html(spark):
    rows = {r.page_id: r for r in queries.op7_html_text(spark, DATA).collect()}
    pages = table(spark, DATA, "pages").collect()
    assert len(rows) == len(pages)
    for p in pages:
        assert rows[p.page_id].text == plain_html.main_text(p.html) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_lm(spark):
    want = brute.lm_scores(texts(spark), lm.MU)
    got = {r.doc_id: r for r in queries.op9_lm_scores(spark, DATA).collect()}
    assert set(got) == set(want)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_mix_targets(spark):
    rows = queries.op1_mixing(spark, DATA).collect()
    again = queries.op1_mixing(spark, DATA).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert all(r.taken <= 2 * r.size for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 1 for (_, target), t in by.items())
    assert sum(sum(t) for t in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows), abs=len(by))


def test_entry_has_them(spark):
    os.environ.setdefault("TZ", "UTC")
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
