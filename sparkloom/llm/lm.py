"""Scores of texts under an n-gram model run as a weighted backoff automaton.

The model has order 3, with Dirichlet smoothing over a discounted unigram model:
P(w | g h) = (c(g, h, w) + MU[1] P(w | h)) / (c(g, h) + MU[1]),  P(w | h) = (c(h, w) + MU[0] P(w)) / (c(h) + MU[0]),
P(w) = (c(w) - D) / N, where what is discounted, D V / N, is the probability of an unknown word.

As an automaton: a state for every pair (g, h) and every word h seen in training (a text's start
is a word), and the root.  From (g, h) an arc for every w that followed it, of weight log P(w | g h), and a failure
arc to h, of weight log MU[1] / (c(g, h) + MU[1]); from h arcs likewise and a failure arc to the root, which
has an arc for every known word and one for all others.  A text is traversed from left to
right: each token is taken from the state that the tokens before it lead to, falling along
failure arcs until there is an arc for it, and the weights are summed.

Scale: the automaton of the corpus is never in one place.  Each block of
documents sends its distinct n-grams, with their training counts, to shards by
hash; a shard sums counts over all documents and answers every block about the
n-grams that it has; a block thus holds the part of the automaton that its texts
can reach.  All counts cover all training documents, none is cut off.  A block sends nothing to shards
that have none of its n-grams, so an exchange is never more than a row an n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import block, cuts, doc_long, key, lean, pack, parts, shard_of, small, text_bytes, thin, unpack, unsmall, unthin
from .neardup import _MIX, _mixed
from .shared import stash

#: Weights of the lower order, for states of one word and of two: the best of a few on held-out texts of sf0.1 (3.06 digits a token).
MU, DISCOUNT = (3000.0, 10.0), 0.5
_END = np.uint64(xxhash.xxh3_64_intdigest(b"end of a text"))
_START = np.uint64(xxhash.xxh3_64_intdigest(b"start of a text"))
_START_KEY = key(_mixed(np.array([_START])))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased, and of the end."""
    words = (text or "").encode().lower().split()
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h[-1] = _END
    return h


class Block:
    """The n-grams of a block of documents.

    grams[k] are the sorted distinct keys of n-grams of k + 1 tokens, at[k] each token's place
    among them, for the n-gram that ends in it, and n[k] their training counts.  A text's
    start stands before its first token; the n-gram of three that would begin before it is missing (-1).
    `before` is the place in grams[0] of what stands before each token.
    """

    def __init__(self, texts, trained: np.ndarray):
        each = [tokens(t) for t in texts]
        self.lengths = np.array([len(x) for x in each], np.int64)
        flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        first = np.zeros(len(flat), bool)
        first[self.starts] = True
        in_training = np.repeat(trained, self.lengths)
        previous = np.roll(flat, 1)
        previous[self.starts] = _START
        pairs = _mixed(_mixed(previous) * _MIX + flat)
        triples = _mixed(np.roll(pairs, 1) * _MIX + flat)
        # the start is a word too, so that its count is known: once a text
        words, at = np.unique(np.concatenate([key(_mixed(flat)), np.repeat(_START_KEY, len(each))]), return_inverse=True)
        pair_keys, pair_at = np.unique(key(pairs), return_inverse=True)
        triple_keys, triple_at_ = np.unique(key(triples[~first]), return_inverse=True)
        triple_at = np.full(len(flat), -1, np.int64)
        triple_at[~first] = triple_at_
        count = lambda at, weights, n: np.bincount(at, weights, n).astype(np.int64)
        self.grams = [words, pair_keys, triple_keys]
        self.n = [count(at, np.concatenate([in_training, trained]), len(words)), count(pair_at, in_training, len(pair_keys)), count(triple_at_, in_training[~first], len(triple_keys))]
        self.at = [at[: len(flat)], pair_at, triple_at]
        self.before = np.roll(self.at[0], 1)
        self.before[self.starts] = at[len(flat) :]


class Automaton:
    """The part of the automaton that a block's texts can reach, from corpus-wide counts of its n-grams.

    States are numbered root, words, pairs: 0, 1 + place among words, 1 + number of words + place
    among pairs.  arcs[k] and fail hold log10 weights, nan where there is no arc; falls is where failure arcs lead.
    """

    def __init__(self, b: Block, counts: list[np.ndarray], total: int, vocabulary: int, mu: tuple[float, float] = MU):
        words, pairs, triples = counts
        root = np.where(words > 0, words - DISCOUNT, DISCOUNT * vocabulary) / total if total else np.ones(len(words))
        # what ends a gram, and the places of the shorter grams within it, from any of its tokens
        last, left = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        last[b.at[1]], left[b.at[1]] = b.at[0], b.before
        p2 = (pairs + mu[0] * root[last]) / (words[left] + mu[0])
        whole = np.flatnonzero(b.at[2] >= 0)
        tail, head = np.zeros(len(triples), np.int64), np.zeros(len(triples), np.int64)
        tail[b.at[2][whole]], head[b.at[2][whole]] = b.at[1][whole], b.at[1][whole - 1]
        p3 = (triples + mu[1] * p2[tail]) / (pairs[head] + mu[1])
        seen = lambda n, p: np.where(n > 0, np.log10(p), np.nan)
        self.arcs = [np.log10(root), seen(pairs, p2), seen(triples, p3)]
        self.fail = np.concatenate([[0.0], np.log10(mu[0] / (words + mu[0])), np.log10(mu[1] / (pairs + mu[1]))])
        self.falls = np.concatenate([np.zeros(1 + len(words), np.int64), 1 + last])
        self.words, self.known_pairs = len(words), pairs > 0

    def states(self, b: Block) -> np.ndarray:
        """The state before each token: that of the two tokens before, if training has the pair, else of the last."""
        state = 1 + b.before
        before = np.roll(b.at[1], 1)
        deep = (b.at[2] >= 0) & self.known_pairs[before]
        state[deep] = 1 + self.words + before[deep]
        return state

    def traverse(self, b: Block) -> np.ndarray:
        """Every text's sum of weights, falling from state to state until a token has an arc."""
        state, weight = self.states(b), np.zeros(len(b.before))
        falling = np.arange(len(state))
        while len(falling):
            s = state[falling]
            order = (s > 0).astype(np.int64) + (s > self.words)
            arc = np.choose(order, [self.arcs[k][b.at[k][falling]] if len(self.arcs[k]) else np.full(len(falling), np.nan) for k in range(3)])
            there = ~np.isnan(arc)
            weight[falling[there]] += arc[there]
            falling, s = falling[~there], s[~there]
            weight[falling] += self.fail[s]
            state[falling] = self.falls[s]
        return np.add.reduceat(weight, b.starts) if len(b.starts) else weight  # each text has a token at least


def score(docs: DataFrame, held_out, mu: tuple[float, float] = MU, block_bytes: int = 8_000_000, shard_bytes: int = 24_000_000) -> DataFrame:
    """Takes doc_id (a whole number) and text; held_out is a boolean column over doc_id:
    the documents that the model doesn't learn from.

    Returns a row per row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10).

    Null or empty text: only the end.  A null held_out counts as false.  Repeated rows
    are rows of their own, in training too.  Without training documents every
    token is unknown.  No rows: no rows.
    """
    size = text_bytes(docs)
    n_blocks, n_shards = parts(size, block_bytes), parts(size, shard_bytes)
    d = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), block(doc_long(), n_blocks).alias("block"))
    binary = lambda x: np.frombuffer(x, np.uint8)

    def made(t: pa.Table) -> Block:
        return Block((x.as_py() for x in t.column("text")), ~np.asarray(t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool))

    def ask(k, t):
        lean()
        b = made(t)
        ends = [cuts(g, n_shards) for g in b.grams]
        rows = []
        for s in np.flatnonzero(np.logical_or.reduce([e[1:] > e[:-1] for e in ends])).tolist():
            own = [slice(e[s], e[s + 1]) for e in ends]
            rows.append((s, pack(*(binary(x) for o, g, n in zip(own, b.grams, b.n, strict=True) for x in (thin(g[o]), small(n[o]))))))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([k[0].as_py()] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct keys, their totals, and for every array of keys their totals."""
        each, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(each)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        return each, n, np.split(n[at], ends)

    def answer(k, t):
        lean()
        got = [unpack(x.as_py(), *(np.uint8,) * 6) for x in t.column("data")]
        back = []
        for g in range(3):
            each, n, split = sums([unthin(x[2 * g].tobytes()) for x in got], [unsmall(x[2 * g + 1].tobytes()) for x in got])
            back.append(split)
            if g == 0:  # the start isn't a token: it is left out of the totals
                token = (each != _START_KEY[0]) & (n > 0)
                n_words, n_kinds = int(n[token].sum()), int(token.sum())
        data = [pack(*(binary(small(x)) for x in row)) for row in zip(*back, strict=True)]
        one = [k == 0 for k in range(len(data))]  # a shard's totals stand in one of its rows
        return pa.table(
            {"block": t.column("block").combine_chunks(), "shard": t.column("shard").combine_chunks(), "words": pa.array([n_words * x for x in one], pa.int64()), "kinds": pa.array([n_kinds * x for x in one], pa.int64()), "data": pa.array(data, pa.binary())}
        )

    asked = d.groupBy("block").applyInArrow(ask, "shard int, block int, data binary")
    answered = stash(asked.groupBy("shard").applyInArrow(answer, "block int, shard int, words long, kinds long, data binary"), "counts")
    totals = answered.agg(F.sum("words"), F.sum("kinds")).first()
    total, vocabulary = (int(x or 0) for x in totals)

    def finish(k, t, answers):
        lean()
        b = made(t)
        got = [unpack(x.as_py(), *(np.uint8,) * 3) for x in answers.sort_by("shard").column("data")]
        counts = [np.concatenate([unsmall(x[g].tobytes()) for x in got]) if got else np.zeros(0, np.int64) for g in range(3)]
        n = len(b.lengths)
        words = counts[0][b.at[0]]
        add = lambda x: np.add.reduceat(x, b.starts) if n else x
        base = np.log10((words + 0.5) / (total + 0.5 * (vocabulary + 1)))
        weight = Automaton(b, counts, total, vocabulary, mu).traverse(b)
        return pa.table(
            {"doc_id": t.column("doc_id").combine_chunks(), "held_out": t.column("held_out").combine_chunks(), "n_tokens": pa.array(b.lengths), "n_known": pa.array(add((words > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(weight)}
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.groupBy("block").cogroup(answered.select("block", "shard", "data").groupBy("block")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


__all__ = ["DISCOUNT", "MU", "Automaton", "Block", "score", "shard_of", "tokens"]
