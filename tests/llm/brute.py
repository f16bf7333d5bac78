"""Plain re-computations, written from the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = SPACE.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_duplicates(docs):
    """{doc_id: (n, component)} by all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = {}
    for i in ids:
        for s in sets[i]:
            inverted.setdefault(s, []).append(i)
    both = Counter()
    for members in inverted.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def remove_repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    seen, out = {}, {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            seen.setdefault(data[p : p + length], (i, p))
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen[data[p : p + length]] != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def lm_scores(docs, mu):
    """{doc_id: (held out, tokens, known, N, base, score)}."""
    toks = {i: [*SPACE.findall((t or "").encode().lower()), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, _ in docs:
        if not held[i]:
            uni.update(toks[i])
            seq = ["^", *toks[i]]
            uni["^"] += 1
            bi.update(zip(seq, seq[1:], strict=False))
            tri.update(zip(seq, seq[1:], seq[2:], strict=False))
    n, v = sum(uni.values()) - uni["^"], len(uni) - (uni["^"] > 0)
    out = {}
    for i, _ in docs:
        base = score = 0.0
        seq = ["^", *toks[i]]
        for k, w in enumerate(toks[i]):
            base += math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1)))
            p = ((uni[w] - 0.5 if uni[w] else 0.5 * v) / n) if n else 1.0
            p = (bi[seq[k], w] + mu[0] * p) / (uni[seq[k]] + mu[0])
            if k:
                pair = (seq[k - 1], seq[k])
                p = (tri[(*pair, w)] + mu[1] * p) / (bi[pair] + mu[1])
            score += math.log10(p)
        out[i] = (held[i], len(toks[i]), sum(uni[w] > 0 for w in toks[i]), n, base, score)
    return out
