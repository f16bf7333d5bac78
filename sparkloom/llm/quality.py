"""Quality rules as a bitmask ledger.

measure() evaluates every rule's measurement once per document; ledger() turns
them into one failure bit a rule.  Policies are named, versioned sets of rules:
apply_policy() is a bitwise AND, and ablation() counts what each rule decides
alone from the bit patterns, which are few however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: the symbols that are counted.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A document fails if `test`, SQL over the measures, holds."""

    name: str
    test: str


#: Each rule has the bit of its place; places are never reused.
RULES: tuple[Rule, ...] = (
    Rule("too_short", "n_words < 20"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("duplicate_lines", "n_lines >= 5 AND 2 * n_dup_lines > n_lines"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("stutter", "100 * n_stutter > 30 * n_words"),
)

#: Policies by (name, version): the names of their rules.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("too_short", "repeats"),
    ("prose", 1): ("too_short", "repeats", "symbols", "shouting"),
    ("prose", 2): ("too_short", "repeats", "symbols", "shouting", "duplicate_lines", "long_words", "stutter"),
}


def _repeated(words: list[bytes], span: int) -> int:
    """Words inside windows of `span` words that the text has twice or more."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = np.zeros(n, np.uint64)
    for k in range(span):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(g, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures_of(text: str | None, span: int = 8) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at exactly \x20 \x09-\x0D
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    codes = np.frombuffer(data, np.uint8)
    upper = int(np.count_nonzero((codes - 65) < 26))
    letters = upper + int(np.count_nonzero((codes - 97) < 26))
    return len(words), len(text) - blanks, symbols, len(lines), len(lines) - len(set(lines)), _repeated(words, span), sum(map(eq, words, words[1:])), upper, letters


def measure(docs: DataFrame, span: int = 8) -> DataFrame:
    """doc_id and the measures of every row of docs (doc_id, text); null text: all 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures_of(x.as_py(), span) for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _failed(tests: list[str]) -> Column:
    """The bits of the tests that hold."""
    bits = [F.when(F.expr(t), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, t in enumerate(tests)]
    return sum(bits[1:], bits[0])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, span: int = 8) -> DataFrame:
    """A row per row of docs: doc_id, the measures and `failed`, a bit a rule.

    Null or empty text has measures 0 and fails too_short.  Repeated rows are
    rows of their own; no rows: no rows.
    """
    return measure(docs, span).withColumn("failed", _failed([r.test for r in rules]))


def mask(policy: tuple[str, int], rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> int:
    """The bits of a policy's rules."""
    names = [r.name for r in rules]
    return sum(1 << names.index(x) for x in policies[policy])


def passes(policy: tuple[str, int], rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> Column:
    """Over a ledger: none of the policy's rules failed."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy, rules, policies))) == 0


def apply_policy(ledger_: DataFrame, policy: tuple[str, int], rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """The ledger with `kept`; texts aren't read again."""
    return ledger_.withColumn("kept", passes(policy, rules, policies))


def ablation(ledger_: DataFrame, policy: tuple[str, int], rules: tuple[Rule, ...] = RULES, policies: dict = POLICIES) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail each of the policy's rules, and
    those that would be kept without it.  Rows meet as counts of bit patterns."""
    all_ = mask(policy, rules, policies)
    patterns = ledger_.groupBy(F.col("failed").bitwiseAND(F.lit(all_)).alias("bits")).agg(F.count("*").alias("n"))
    own = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if all_ >> k & 1))
    each = patterns.select("bits", "n", F.explode(own).alias("r"))
    has, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_only"))


def keep(docs: DataFrame, policy: tuple[str, int] = ("prose", 2)) -> DataFrame:
    """The rows of docs, all columns, that pass the policy.  The ledger is made in one pass beside the row; no join."""
    names = docs.columns
    mark = "__" + "_" * max((len(n) for n in names if n.startswith("__")), default=0)  # no column begins so
    at = [n.lower() for n in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures_of(x.as_py()) for x in batch.column(at)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names, *(mark + m for m in MEASURES)])

    schema = StructType([*docs.schema.fields, *(StructField(mark + m, LongType()) for m in MEASURES)])
    measured = docs.mapInArrow(run, schema)

    def renamed(test: str) -> str:
        return " ".join(f"`{mark}{x}`" if x in MEASURES else x for x in test.split(" "))

    failed = _failed([renamed(r.test) for r in RULES])
    return measured.where(failed.bitwiseAND(F.lit(mask(policy))) == 0).select(*names)
