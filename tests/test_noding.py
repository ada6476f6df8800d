"""Snap rounding against a plain restatement in whole numbers, and what it promises."""

import random
from fractions import Fraction

import pytest

from tidewright.operators import graph
from tidewright.operators.noding import node_edges, node_pieces

R = random.Random(4)


def brute(segments):
    """Pieces as (seg_id, piece, u, v), segment by segment."""
    floor = lambda f: f.numerator // f.denominator
    hot = {p for _, a, b in segments for p in (a, b)}
    for i, (_, a, b) in enumerate(segments):
        for _, c, d in segments[i + 1 :]:
            r, s, q = (b[0] - a[0], b[1] - a[1]), (d[0] - c[0], d[1] - c[1]), (c[0] - a[0], c[1] - a[1])
            den = r[0] * s[1] - r[1] * s[0]
            if den and 0 <= Fraction(q[0] * s[1] - q[1] * s[0], den) <= 1 and 0 <= Fraction(q[0] * r[1] - q[1] * r[0], den) <= 1:
                t = Fraction(q[0] * s[1] - q[1] * s[0], den)
                hot.add(tuple(floor(a[k] + t * r[k] + Fraction(1, 2)) for k in (0, 1)))
    out = set()
    for i, a, b in segments:
        inside = []
        for p in hot:
            low, high = Fraction(0), Fraction(1)  # the share of the segment inside the pixel, by clipping
            for k in (0, 1):
                d, left, right = b[k] - a[k], Fraction(2 * p[k] - 1, 2) - a[k], Fraction(2 * p[k] + 1, 2) - a[k]
                if d == 0:
                    if not left <= 0 < right:
                        high = Fraction(-1)
                else:
                    low, high = max(low, min(left / d, right / d)), min(high, max(left / d, right / d))
            corner = all(a[k] + low * (b[k] - a[k]) == Fraction(2 * p[k] - 1, 2) for k in (0, 1)) if low == high else False
            if low < high or corner:
                inside.append(((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), p))
        inside.sort()
        out |= {(i, k, u, v) for k, ((_, u), (_, v)) in enumerate(zip(inside, inside[1:]), 1)}
    return out


@pytest.mark.parametrize("wide,n", [(14, 40), (3000, 60)])
def test_pieces(spark, wide, n):
    at = lambda: (R.randint(-wide, wide), R.randint(-wide, wide))
    segments = [(i, at(), at()) for i in range(n)]
    segments += [(n, (0, 0), (6, 3)), (n + 1, (2, 1), (10, 5)), (n + 2, (4, 2), (0, 0))]  # on one line
    segments = [x for x in segments if x[1] != x[2]]
    rows = [(i, a[0] * 0.5, a[1] * 0.5, b[0] * 0.5, b[1] * 0.5) for i, a, b in segments] + [(999, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seg_id long, x0 double, y0 double, x1 double, y1 double")
    pieces = node_pieces(df, pixel=0.5, cell=max(4, wide // 5))
    found = {(r["seg_id"], r["piece"], (r["ux"], r["uy"]), (r["vx"], r["vy"])) for r in pieces.collect()}
    assert found == brute(segments)
    # every piece has its ends in common with others, or nothing
    edges = sorted({tuple(sorted((u, v))) for _, _, u, v in found})
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 1 :]:
            side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
            if len({a, b, c, d}) == 4:
                assert not (side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0)
    # and they are edges of a graph
    whole = graph.build_edges(node_edges(pieces, 0.5))
    assert whole.count() == len(edges)
    assert graph.components(whole).count() == len({p for e in edges for p in e})


def test_rounding_is_exact():
    import numpy as np

    from tidewright.operators.noding import MOST, _rounded

    rng = np.random.default_rng(5)
    den = rng.integers(1, MOST**2 * 2, 3000)
    t, r = rng.integers(0, den + 1), rng.integers(-MOST, MOST, 3000)
    den[:1000] = rng.integers(1, 9, 1000)  # halves
    t[:1000] = rng.integers(0, den[:1000] + 1)
    assert _rounded(t, r, den).tolist() == [(2 * a * b + c) // (2 * c) for a, b, c in zip(t.tolist(), r.tolist(), den.tolist(), strict=True)]


def test_segments_meet_in_the_cells_they_pass_only(spark):
    """A long slanting segment used to be sent to all cells of its box."""
    from tidewright.operators.noding import _met

    df = spark.createDataFrame([(0, 5, 5, 9995, 9995)], "seg_id long, ax long, ay long, bx long, by long")
    cells = {(r["cx"], r["cy"]) for r in _met(df, 100).collect()}
    assert {(i, i) for i in range(100)} <= cells
    assert len(cells) < 400
