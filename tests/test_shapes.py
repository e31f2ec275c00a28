import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plotshift.operators import shapes

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
TRIANGLE = [(0, 0), (3, 0), (0, 4), (0, 0)]
L = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]
BIG, HOLE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
BOW = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]
LINE = [(0, 0), (1, 1), (2, 2), (0, 0)]


def rows(df):
    return [r.asDict() for r in df.orderBy("fid").collect()]


def test_closed_forms(rings):
    got = rows(shapes.with_hull(shapes.with_shape(shapes.with_core(rings([SQUARE], [TRIANGLE], [L], [BIG, HOLE], [SQUARE[::-1]])))))
    assert [r["area"] for r in got] == [1, 6, 3, 15, 1]
    assert [r["perimeter"] for r in got] == [4, 12, 8, 20, 4]
    assert got[0]["compactness"] == pytest.approx(math.pi / 4)
    assert (got[1]["centroid_x"], got[1]["centroid_y"]) == pytest.approx((1, 4 / 3))
    assert got[2]["solidity"] == pytest.approx(3 / 3.5)
    assert got[3]["centroid_x"] == pytest.approx((16 * 2 - 1.5) / 15)
    assert got[0]["solidity"] == got[0]["convexity"] == 1


def test_missing_empty_and_flat(rings):
    got = rows(shapes.with_bounds(shapes.with_core(rings(None, [], [BOW], [LINE]))))
    assert got[0]["area"] is None and got[1]["area"] == 0 and got[1]["centroid_x"] is None
    assert got[2]["area"] == 0 and (got[2]["centroid_x"], got[2]["centroid_y"]) == pytest.approx((5, 5))
    assert got[3]["aspect_ratio"] == 1
    zero = rows(shapes.with_core(rings(None), missing_as_zero=True))
    assert zero[0]["area"] == 0 and zero[0]["centroid_y"] == 0


def test_validity(rings):
    open_ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
    df = rings([SQUARE], [L], [BOW], [LINE], [], None, [open_ring], [BIG, HOLE])
    want = [True, True, False, False, False, None, False, True]
    assert [r["is_valid"] for r in rows(shapes.with_validity(df))] == want
    assert [r["is_valid"] for r in rows(shapes.with_validity(df, long_rings=True))] == want
    assert shapes.drop_invalid(shapes.drop_empty(shapes.drop_missing(df))).count() == 3


def test_long_rings_are_swept(rings):
    t = np.linspace(0, 2 * np.pi, 2001)[:-1]
    circle = list(zip(np.cos(t), np.sin(t)))
    circle.append(circle[0])
    eight = list(zip(np.sin(t + 0.1), np.sin(2 * (t + 0.1))))
    eight.append(eight[0])
    saw = [(i, (i % 2) * 0.5) for i in range(600)] + [(599, 5), (0, 5), (0, 0)]
    got = rows(shapes.with_validity(rings([circle], [eight], [saw]), long_rings=True))
    assert [r["is_valid"] for r in got] == [True, False, True]


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_repeated_vertices_and_spikes(rings):
    twice = [p for p in L for _ in range(2)]
    spike = [(0, 0), (2, 0), (2, 3), (2, 2), (0, 2), (0, 0)]
    df = rings([twice], [spike], [twice, box(0.2, 0.2, 0.5)], [spike, box(0.2, 0.2, 0.5)])
    assert [r["is_valid"] for r in rows(shapes.with_validity(df))] == [True, False, True, False]


def test_holes(rings):
    outer = box(0, 0, 10)
    cases = {
        "inside": ([outer, box(2, 2, 2), box(6, 6, 2)], True),
        "crosses its outline": ([outer, box(8, 2, 4)], False),
        "outside": ([outer, box(20, 2, 4)], False),
        "touches at a point": ([outer, [(0, 5), (3, 4), (3, 6), (0, 5)]], True),
        "runs along the outline": ([outer, box(0, 2, 3)], False),
        "leaves through vertices": ([outer, [(5, 0), (10, 5), (12, -2), (5, 0)]], False),
        "hole in a hole": ([outer, box(2, 2, 6), box(4, 4, 1)], False),
        "crossing holes": ([outer, box(2, 2, 4), box(4, 4, 4)], False),
        "crosses itself": ([outer, [(2, 2), (5, 6), (6, 2), (2, 5), (2, 2)]], False),
    }
    got = [r["is_valid"] for r in rows(shapes.with_validity(rings(*[c for c, _ in cases.values()])))]
    assert dict(zip(cases, got)) == {k: v for k, (_, v) in cases.items()}


def test_parts(spark):
    """Outlines with holes of their own: apart, in a hole of another, touching, overlapping, one in the other."""
    part = lambda *r: [(i > 0, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(r)]
    frame, lake = box(0, 0, 10), box(2, 2, 6)
    cases = [
        (part(frame, lake) + part(box(20, 0, 5)), True),
        (part(frame, lake) + part(box(3, 3, 2)), True),
        (part(box(0, 0, 4)) + part(box(4, 4, 4)), True),
        (part(box(0, 0, 4)) + part(box(3, 3, 4)), False),
        (part(frame) + part(box(3, 3, 2)), False),
        (part(frame) + part(box(20, 0, 5), lake), False),
    ]
    schema = "fid bigint, rings array<struct<hole:boolean,pts:array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], schema)
    assert [r["is_valid"] for r in rows(shapes.with_validity(df))] == [v for _, v in cases]


def test_mercator(rings):
    got = rows(shapes.with_bounds(shapes.reproject(rings([[(0, 0), (180, 0), (180, 45), (0, 45), (0, 0)]]))))[0]
    assert got["maxx"] == pytest.approx(20037508.342789244)
    assert got["maxy"] == pytest.approx(5621521.486192, rel=1e-9)
    with pytest.raises(ValueError):
        shapes.reproject(rings([SQUARE]), "EPSG:2154")


star = st.lists(st.integers(1, 50), min_size=3, max_size=10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(radii=star, dx=st.integers(-10**6, 10**6), dy=st.integers(-10**6, 10**6))
def test_invariances(rings, radii, dx, dy):
    t = np.arange(len(radii)) * 2 * np.pi / len(radii)
    pts = [(round(r * math.cos(a), 3), round(r * math.sin(a), 3)) for r, a in zip(radii, t)]
    moved = [(x + dx, y + dy) for x, y in pts]
    df = rings([pts + pts[:1]], [moved + moved[:1]], [(pts + pts[:1])[::-1]])
    a, b, c = rows(shapes.with_hu(shapes.with_hull(shapes.with_core(df))))
    for k in ("area", "perimeter", "solidity", "convexity", *[f"hu_moment_{i}_log" for i in range(7)]):
        assert a[k] == pytest.approx(b[k], rel=1e-5, abs=1e-6)
        assert a[k] == pytest.approx(c[k], rel=1e-9, abs=1e-9)
    assert a["solidity"] <= 1 + 1e-9 and a["convexity"] >= 1 - 1e-9


def test_nested_polygons_use_all_cores(spark, sf):
    from plotshift.plans import features

    assert features.geom_nested(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_polygons_tested_together_as_one_by_one(monkeypatch):
    """Random rings on a coarse grid (crossing, touching, nested, repeated points): the same answer together and alone."""
    import pyarrow as pa

    rng = np.random.default_rng(5)

    def ring():
        if rng.random() < 0.6:  # a box
            (x, y), (w, h) = rng.integers(0, 6, 2), rng.integers(1, 7, 2)
            pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        else:
            pts = [tuple(p) for p in rng.integers(0, 8, (rng.integers(2, 6), 2))]
        pts = [p for p in pts for _ in range(1 + (rng.random() < 0.1))]
        return [tuple(map(float, p)) for p in pts + pts[:1]]

    polygons = [None if k % 40 == 7 else [ring() for _ in range(rng.integers(1, 5))] for k in range(1500)]
    boxes = lambda *b: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)] for x, y, w in b]
    polygons += [boxes((0.0, 0.0, 100.0), (float(x), 5.0, 60.0), (x + 5.0, 10.0, float(w))) for x in (5, 35, 40, 60) for w in (20, 50, 55, 60)]
    holes = [None if p is None else [k < 1500 and rng.random() < 0.1 if i == 0 else i % 2 == 1 for i in range(len(p))] for k, p in enumerate(polygons)]
    part = lambda d: pa.array([p and [[q[d] for q in r] for r in p] for p in polygons], pa.list_(pa.list_(pa.float64())))
    args = part(0), part(1), pa.array(holes, pa.list_(pa.bool_()))
    monkeypatch.setattr(shapes, "_sweep_is_simple", lambda rings, f=shapes._sweep_is_simple: alone.append(1) or f(rings))
    alone = []
    together = shapes._are_simple(*args)
    assert not alone
    monkeypatch.setattr(shapes, "PAIRS_TOGETHER", 500)
    assert (shapes._are_simple(*args) == together).all()
    monkeypatch.setattr(shapes, "FEW_POINTS", 0)
    assert (shapes._are_simple(*args) == together).all() and alone
    assert 50 < together.sum() < 1400
