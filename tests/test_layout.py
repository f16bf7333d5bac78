"""The radial layout against a walk of each tree."""

import random
from math import cos, log, pi, sin, sqrt

import pytest

from sparkloom.operators.layout import MIN_GAP, radial


def plain(rows, spacing):
    """{(tree, node): (x, y)} by walking from the root."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == tree]
        kids, year = {}, {n: y for n, _, y in own}
        for n, p, _ in own:
            kids.setdefault(p, []).append(n)
        time = {n: -log(2400 - min(float(y), 2000.0)) for n, y in year.items()}
        leaves = lambda n: sum(map(leaves, kids[n])) if n in kids else 1  # noqa: E731, B023
        (root,) = kids[None]
        place, todo = {root: (0.0, 0.0, 2 * pi)}, [root]
        while todo:
            n = todo.pop()
            r, start, width = place[n]
            for k in sorted(kids.get(n, []), key=lambda k: (-leaves(k), k)):
                part = width * leaves(k) / leaves(n)
                place[k] = (max(r + MIN_GAP, time[k] - time[root]), start, part)
                start += part
                todo.append(k)
        rim = max(1e-6, *(r for r, _, _ in place.values()))
        scale = max(leaves(root) * spacing / (2 * pi) / rim, 3.5, 0.8 * sqrt(len(place)) / rim)
        out |= {(tree, n): (r * scale * cos(s + w / 2), r * scale * sin(s + w / 2)) for n, (r, s, w) in place.items()}
    return out


@pytest.mark.parametrize("spacing", [1.0, 40.0])
def test_trees(spark, spacing):
    r = random.Random(4)
    rows = []
    for tree, size in enumerate((1, 2, 60)):
        rows += [(tree, k, r.randrange(k) if k else None, r.randrange(-4000, 2100)) for k in range(size)]
    lost = [(9, 1, 2, 100), (9, 2, 1, 100)]  # a cycle
    got = {(x.tree, x.node): (x.x, x.y) for x in radial(spark.createDataFrame([*rows, *lost], "tree long, node long, parent long, year int"), spacing).collect()}
    want = plain(rows, spacing)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_none(spark):
    assert radial(spark.createDataFrame([], "tree long, node long, parent long, year int")).count() == 0
