"""Drawing against pixel-by-pixel rules, and composed images."""

import random

from tessera.operators import raster as R


def pixels(spans):
    return {(x, y) for y, a, b in spans.tolist() for x in range(a, b + 1)}


def brush(x0, y0, x1, y1, px, w, h):
    """A square at every pixel of the unclipped line."""
    out = set()
    for x, y in R.line_pixels(x0, y0, x1, y1):
        out |= {(x - px // 2 + i, y - px // 2 + j) for i in range(px) for j in range(px)}
    return {(x, y) for x, y in out if 0 <= x < w and 0 <= y < h}


def test_strokes_are_brushed_lines():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(4)]
        px = rng.randrange(1, 7)
        assert pixels(R.stroke_spans(*a, px, 40, 40)) == brush(*a, px, 40, 40)
    assert len(R.stroke_spans(0, 0, 9, 9, 0, 10, 10)) == len(R.stroke_spans(-90, -5, -9, -5, 2, 10, 10)) == 0
    assert pixels(R.stroke_spans(-50, 3, 50, 3, 1, 10, 10)) == {(x, 3) for x in range(10)}


def crossings(rings, y):
    out = []
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            if min(y0, y1) <= y < max(y0, y1):
                out.append(x0 + int((y - y0) * (x1 - x0) / (y1 - y0)))
    return sorted(out)


def test_fills_are_even_odd():
    assert pixels(R.fill_spans([[(1, 1), (4, 1), (4, 3), (1, 3)]], 10, 10)) == {(x, y) for x in range(1, 5) for y in (1, 2)}
    hole = [[(0, 0), (9, 0), (9, 9), (0, 9)], [(3, 3), (6, 3), (6, 6), (3, 6)]]
    assert not {(4, 4), (5, 5)} & pixels(R.fill_spans(hole, 10, 10))
    rng = random.Random(5)
    for _ in range(200):
        rings = [[(rng.randrange(-20, 60), rng.randrange(-20, 60)) for _ in range(rng.randrange(3, 7))] for _ in range(rng.randrange(1, 3))]
        want = set()
        for y in range(40):
            c = crossings(rings, y)
            want |= {(x, y) for a, b in zip(c[::2], c[1::2]) for x in range(max(a, 0), min(b, 39) + 1)}
        assert pixels(R.fill_spans(rings, 40, 40)) == want
    assert len(R.fill_spans([[(0, 0), (5, 5)]], 9, 9)) == len(R.fill_spans([], 9, 9)) == 0


def test_painting(spark):
    p = lambda *xy: [dict(x=x, y=y) for x, y in xy]
    rows = [(1, 0, "rect", 0x0000FF, 0, [p((-5, 0), (25, 3))]), (1, 1, "stroke", 0x00FF00, 1, [p((0, 1), (7, 1))]), (1, 2, "point", 0xFF0000, 0, [p((2, 1), (99, 99))]), (1, 3, "other", 1, 0, [p((0, 0))]), (2, 0, "fill", 0xFFFFFF, 0, [p((0, 0), (4, 0), (4, 2), (0, 2))]), (2, 1, "fill", 5, 0, None)]
    shapes = spark.createDataFrame(rows, "frame int, ordinal int, shape string, rgb int, px int, paths array<array<struct<x: int, y: int>>>")
    got = {r.frame: bytes(r.image) for r in R.images(R.composite(R.spans(shapes, 8, 4)), 8, 4).collect()}
    head = b"P6\n8 4\n255\n"
    blue, green, red, black, white = b"\0\0\xff", b"\0\xff\0", b"\xff\0\0", bytes(3), b"\xff" * 3
    assert got[1] == head + blue * 8 + green * 2 + red + green * 5 + blue * 8 + black * 8
    assert got[2] == head + (white * 5 + black * 3) * 2 + black * 16
    assert R.spans(shapes.limit(0), 8, 4).count() == 0
