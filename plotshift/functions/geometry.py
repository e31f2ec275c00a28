"""Polygon measures as column expressions over ``rings``: ``array<struct<hole, pts: array<struct<x, y>>>>``.

All sums of a polygon are taken in one pass over its vertices (:func:`shape_sums`); every measure is then plain
arithmetic on that struct. Coordinates are shifted to the first vertex before they are multiplied, so polygons far
from the origin keep their precision. Null rings give null; an empty polygon has area and perimeter 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotshift.vocabulary import EPS, MERCATOR_RADIUS

POINTS = "array<struct<x:double,y:double>>"


SUMS = ("a2", "sx", "sy", "len", "lx", "ly")
BOX = ("minx", "miny", "maxx", "maxy")


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _local_edges(pts: str, ox: str, oy: str) -> str:
    """SQL text: every edge relative to (ox, oy) with its cross product c and length l, each computed once.

    The last vertex is joined to the first, which adds nothing to a closed ring.
    """
    following = f"get({pts}, (i + 1) % size({pts}))"
    ends = _struct({"x0": f"p.x - {ox}", "y0": f"p.y - {oy}", "x1": f"{following}.x - {ox}", "y1": f"{following}.y - {oy}"})
    fields = {**{k: f"e.{k}" for k in ("x0", "y0", "x1", "y1")}, "c": "e.x0 * e.y1 - e.x1 * e.y0", "l": "hypot(e.x1 - e.x0, e.y1 - e.y0)"}
    return f"transform(transform({pts}, (p, i) -> {ends}), e -> {_struct(fields)})"


def shape_sums(rings: str = "rings") -> Column:
    """One struct per polygon holding every sum that area, length, centroid and bounds need.

    ``rings`` names a column. The expression is written as SQL: one parse instead of a thousand small calls.
    """
    ox, oy = f"get(get({rings}, 0).pts, 0).x", f"get(get({rings}, 0).pts, 0).y"
    start = {**{k: "0D" for k in SUMS}, **{k: "CAST(NULL AS DOUBLE)" for k in BOX}}
    step = {
        "a2": "s.a2 + e.c",
        "sx": "s.sx + (e.x0 + e.x1) * e.c",
        "sy": "s.sy + (e.y0 + e.y1) * e.c",
        "len": "s.len + e.l",
        "lx": "s.lx + (e.x0 + e.x1) * e.l",
        "ly": "s.ly + (e.y0 + e.y1) * e.l",
        **{k: f"{'least' if k.startswith('min') else 'greatest'}(s.{k}, e.{k[-1]}0)" for k in BOX},
    }
    # An exterior ring counts positive and a hole negative, whichever way it was digitised.
    sign = "if((s.a2 < 0) != r.hole, -1D, 1D)"
    signed = {**{k: f"{sign} * s.{k}" for k in SUMS[:3]}, **{k: f"s.{k}" for k in SUMS[3:] + BOX}}
    per_ring = f"transform({rings}, r -> aggregate({_local_edges('r.pts', ox, oy)}, {_struct(start)}, (s, e) -> {_struct(step)}, s -> {_struct(signed)}))"
    step = {
        **{k: f"t.{k} + r.{k}" for k in SUMS},
        **{k: f"{'least' if k.startswith('min') else 'greatest'}(t.{k}, r.{k})" for k in BOX},
    }
    box = {k: f"t.{k} + {ox if k[-1] == 'x' else oy}" for k in BOX}
    last = {**{k: f"t.{k}" for k in SUMS}, **box, "ox": ox, "oy": oy}
    return F.expr(f"aggregate({per_ring}, {_struct(start)}, (t, r) -> {_struct(step)}, t -> {_struct(last)})")


def area(s: Column) -> Column:
    return F.abs(s["a2"]) / 2


def perimeter(s: Column) -> Column:
    return s["len"]


def centroid(s: Column, axis: str) -> Column:
    """Area-weighted centroid; a polygon without area falls back to the middle of its outline, a point to itself."""
    origin, by_area, by_length = s[f"o{axis}"], s[f"s{axis}"], s[f"l{axis}"]
    return (
        F.when(s["a2"] != 0, origin + by_area / (F.lit(3.0) * s["a2"]))
        .when(s["len"] > 0, origin + by_length / (F.lit(2.0) * s["len"]))
        .otherwise(origin)
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null on a zero denominator."""
    return F.try_divide(numerator, denominator)


def floor_at(value: Column, low: float) -> Column:
    """``max(value, low)`` that keeps nulls, which ``greatest`` alone would drop."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def compactness(a: Column, p: Column, variant: str = "isoperimetric") -> Column:
    """Three formulas share this name: ``isoperimetric_eps`` 4*pi*A/(P^2+1e-9), ``plain_eps`` A/(P^2+1e-6), ``isoperimetric`` 4*pi*A/P^2."""
    if variant == "isoperimetric_eps":
        return 4 * math.pi * a / (p * p + EPS)
    if variant == "plain_eps":
        return a / (p * p + 1e-6)
    if variant == "isoperimetric":
        return ratio(4 * math.pi * a, p * p)
    raise ValueError(f"unknown compactness variant {variant!r}")


def elongation(variant: str, *, w: Column = None, h: Column = None, a: Column = None, p: Column = None) -> Column:
    """``box`` is w/(h+1e-9), ``box_inverse`` h/(w+1e-9), ``shape_index`` P/sqrt(A)."""
    if variant == "box":
        return w / (h + EPS)
    if variant == "box_inverse":
        return h / (w + EPS)
    if variant == "shape_index":
        return ratio(p, F.sqrt(a))
    raise ValueError(f"unknown elongation variant {variant!r}")


def aspect_ratio(w: Column, h: Column, variant: str = "raw") -> Column:
    """``raw`` is w/h (null when flat), ``clamped`` is w/max(h, 1e-9)."""
    return ratio(w, h) if variant == "raw" else w / floor_at(h, EPS)


def all_points(rings: str) -> str:
    return f"flatten(transform({rings}, r -> r.pts))"


def hull_rings(rings: str = "rings") -> Column:
    """Convex hull of all vertices as a one-ring polygon; store it in a column and measure it with :func:`shape_sums`.

    Points are visited in x order while a chain is kept. On a convex chain the vertices that stay are exactly those
    before which the turn towards the new point is still to the left, so a filter does the popping.
    """
    pts = f"sort_array(array_distinct({all_points(rings)}))"
    before = "get(chain, i - 1)"
    turn = f"(q.x - {before}.x) * (p.y - {before}.y) - (q.y - {before}.y) * (p.x - {before}.x)"
    extend = f"(chain, p) -> concat(filter(chain, (q, i) -> i = 0 OR {turn} > 0), array(p))"
    half = lambda points: f"aggregate({points}, CAST(array() AS {POINTS}), {extend})"
    hull = f"concat({half(pts)}, {half(f'reverse({pts})')})"
    return F.expr(f"if(size({all_points(rings)}) > 0, array(named_struct('hole', false, 'pts', {hull})), NULL)")


def ring_closed(pts: str) -> str:
    """SQL text: at least four points, the last repeating the first."""
    return f"(size({pts}) >= 4 AND get({pts}, 0) = get({pts}, size({pts}) - 1))"


def _segments_meet() -> str:
    """SQL text: closed segments e and f, structs (ax, ay, bx, by), share a point."""
    overlap = " AND ".join(
        f"greatest({p}.a{z}, {p}.b{z}) >= least({q}.a{z}, {q}.b{z})" for z in "xy" for p, q in (("e", "f"), ("f", "e"))
    )
    side = lambda s, p: f"signum(({s}.bx - {s}.ax) * ({p}y - {s}.ay) - ({s}.by - {s}.ay) * ({p}x - {s}.ax))"
    return f"{overlap} AND {side('e', 'f.a')} * {side('e', 'f.b')} <= 0 AND {side('f', 'e.a')} * {side('f', 'e.b')} <= 0"


def rings_edges(rings: str = "rings") -> Column:
    """Numbered edges of every ring, repeated vertices taken once: array<array<struct<i, n, ax, ay, bx, by>>>."""
    edge = _struct({"i": "i", "n": "size(q) - 1", "ax": "p.x", "ay": "p.y", "bx": "get(q, i + 1).x", "by": "get(q, i + 1).y"})
    once = f"transform({rings}, r -> filter(r.pts, (p, i) -> i = 0 OR p <> get(r.pts, i - 1)))"
    return F.expr(f"transform({once}, q -> slice(transform(q, (p, i) -> {edge}), 1, greatest(size(q) - 1, 0)))")


def edges_simple(edges: str) -> Column:
    """No two edges that share no vertex meet, and none turns back on the one before.

    Quadratic in the vertex count, meant for rings of ordinary size.
    """
    apart = "f.i > e.i + 1 AND NOT (e.i = 0 AND f.i = e.n - 1)"
    beside = "(f.i = e.i + 1 OR (f.i = 0 AND e.i = e.n - 1))"
    turn = "(e.bx - e.ax) * (f.by - f.ay) - (e.by - e.ay) * (f.bx - f.ax)"
    back = f"{turn} = 0 AND (e.bx - e.ax) * (f.bx - f.ax) + (e.by - e.ay) * (f.by - f.ay) < 0"
    return F.expr(
        f"forall({edges}, ring -> NOT exists(ring, e -> exists(ring, f -> ({apart} AND {_segments_meet()}) OR ({beside} AND {back}))))"
    )


def to_mercator(rings: str = "rings") -> Column:
    """Longitude/latitude degrees to spherical Mercator metres (EPSG:4326 to EPSG:3857)."""
    point = _struct(
        {
            "x": f"{MERCATOR_RADIUS}D * radians(p.x)",
            "y": f"{MERCATOR_RADIUS}D * ln(tan(pi() / 4 + radians(p.y) / 2))",
        }
    )
    return F.expr(f"transform({rings}, r -> named_struct('hole', r.hole, 'pts', transform(r.pts, p -> {point})))")


# Numerators of the moments of one edge (x0, y0)-(x1, y1) with cross product c, and their common divisors.
MOMENTS = {
    "m00": ("c", 2),
    "m10": ("c * (x0 + x1)", 6),
    "m01": ("c * (y0 + y1)", 6),
    "m20": ("c * (x0 * x0 + x0 * x1 + x1 * x1)", 12),
    "m11": ("c * (x0 * (2 * y0 + y1) + x1 * (y0 + 2 * y1))", 24),
    "m02": ("c * (y0 * y0 + y0 * y1 + y1 * y1)", 12),
    "m30": ("c * (x0 + x1) * (x0 * x0 + x1 * x1)", 20),
    "m21": ("c * (x0 * x0 * (3 * y0 + y1) + 2 * x0 * x1 * (y0 + y1) + x1 * x1 * (y0 + 3 * y1))", 60),
    "m12": ("c * (y0 * y0 * (3 * x0 + x1) + 2 * y0 * y1 * (x0 + x1) + y1 * y1 * (x0 + 3 * x1))", 60),
    "m03": ("c * (y0 + y1) * (y0 * y0 + y1 * y1)", 20),
}


def raw_moments(rings: str = "rings") -> Column:
    """Moments up to order three of the first exterior ring, relative to its first vertex (Green's theorem)."""
    pts = f"get({rings}, 0).pts"
    fill = lambda text: re.sub(r"\b(x0|y0|x1|y1|c)\b", r"e.\1", text)
    start = {k: "0D" for k in MOMENTS}
    step = {k: f"s.{k} + {fill(t)}" for k, (t, _) in MOMENTS.items()}
    last = {k: f"if(s.m00 < 0, -1D, 1D) * s.{k} / {d}" for k, (_, d) in MOMENTS.items()}
    edges = _local_edges(pts, f"get({pts}, 0).x", f"get({pts}, 0).y")
    return F.expr(f"aggregate({edges}, {_struct(start)}, (s, e) -> {_struct(step)}, s -> {_struct(last)})")


def normalized_moments(m: str) -> Column:
    """Central moments scaled by area: eta_pq = mu_pq / m00^(1 + (p+q)/2). Null without area."""
    x, y = f"try_divide({m}.m10, {m}.m00)", f"try_divide({m}.m01, {m}.m00)"
    mu = {
        "n20": f"{m}.m20 - {x} * {m}.m10",
        "n11": f"{m}.m11 - {x} * {m}.m01",
        "n02": f"{m}.m02 - {y} * {m}.m01",
        "n30": f"{m}.m30 - 3 * {x} * {m}.m20 + 2 * {x} * {x} * {m}.m10",
        "n21": f"{m}.m21 - 2 * {x} * {m}.m11 - {y} * {m}.m20 + 2 * {x} * {x} * {m}.m01",
        "n12": f"{m}.m12 - 2 * {y} * {m}.m11 - {x} * {m}.m02 + 2 * {y} * {y} * {m}.m10",
        "n03": f"{m}.m03 - 3 * {y} * {m}.m02 + 2 * {y} * {y} * {m}.m01",
    }
    power = lambda k: 2.0 if int(k[1]) + int(k[2]) == 2 else 2.5
    return F.expr(_struct({k: f"try_divide({v}, power({m}.m00, {power(k)}D))" for k, v in mu.items()}))


def hu_invariants(n: str) -> Column:
    """The seven rotation invariants of Hu (1962) as an array; 0 where the polygon is missing, empty or flat."""
    p, q = f"({n}.n30 + {n}.n12)", f"({n}.n21 + {n}.n03)"
    u, v = f"({n}.n30 - 3 * {n}.n12)", f"(3 * {n}.n21 - {n}.n03)"
    d, e = f"({n}.n20 - {n}.n02)", f"{n}.n11"
    even, odd = f"({p} * {p} - 3 * {q} * {q})", f"(3 * {p} * {p} - {q} * {q})"
    values = [
        f"{n}.n20 + {n}.n02",
        f"{d} * {d} + 4 * {e} * {e}",
        f"{u} * {u} + {v} * {v}",
        f"{p} * {p} + {q} * {q}",
        f"{u} * {p} * {even} + {v} * {q} * {odd}",
        f"{d} * ({p} * {p} - {q} * {q}) + 4 * {e} * {p} * {q}",
        f"{v} * {p} * {even} - {u} * {q} * {odd}",
    ]
    return F.expr("array(" + ", ".join(f"coalesce({h}, 0D)" for h in values) + ")")


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))
