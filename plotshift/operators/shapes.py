"""Geometry feature operators. Each adds columns row by row: no shuffle, no Python worker (except for several rings and very long ones)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from plotshift.functions import geometry as G
from plotshift.vocabulary import EPS

# Rings with more vertices than this are tested for crossings by a sweep in an Arrow batch, as polygons of several rings are.
LONG_RING = 256
# Pairs of edges that the sweep compares at once.
PAIRS_AT_ONCE = 1 << 16
# Polygons of so many points at most are compared together, with about so many pairs of points at once.
FEW_POINTS, PAIRS_TOGETHER = 64, 1 << 18


def with_sums(df: DataFrame, name: str = "_s") -> DataFrame:
    return df.withColumn(name, G.shape_sums("rings"))


def with_core(df: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """``area``, ``perimeter``, ``centroid_x``, ``centroid_y``; the zero variant turns a missing polygon's values into 0."""
    s = F.col("_s")
    values = {
        "area": G.area(s),
        "perimeter": G.perimeter(s),
        "centroid_x": G.centroid(s, "x"),
        "centroid_y": G.centroid(s, "y"),
    }
    if missing_as_zero:
        values = {k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()}
    return with_sums(df).withColumns(values).drop("_s")


def with_bounds(df: DataFrame) -> DataFrame:
    """Bounding box columns and the measures derived from them."""
    s = F.col("_s")
    df = with_sums(df).withColumns(
        {
            "area": G.area(s),
            "minx": s["minx"],
            "miny": s["miny"],
            "maxx": s["maxx"],
            "maxy": s["maxy"],
            "bounding_width": s["maxx"] - s["minx"],
            "bounding_height": s["maxy"] - s["miny"],
        }
    )
    w, h, a = F.col("bounding_width"), F.col("bounding_height"), F.col("area")
    return df.drop("_s").withColumns(
        {
            "bounding_diagonal": F.hypot(w, h),
            "aspect_ratio": G.aspect_ratio(w, h),
            "aspect_ratio_clamped": G.aspect_ratio(w, h, "clamped"),
            "elongation_box": G.elongation("box", w=w, h=h),
            "elongation_ratio": G.elongation("box_inverse", w=w, h=h),
            "bbox_area_ratio": G.ratio(a, w * h),
            "diagonal_area_ratio": F.hypot(w, h) / (a + EPS),
        }
    )


def with_shape(df: DataFrame) -> DataFrame:
    """Area/perimeter measures, one column per formula variant. Needs ``area`` and ``perimeter``."""
    a, p = F.col("area"), F.col("perimeter")
    return df.withColumns(
        {
            "elongation_shape": G.elongation("shape_index", a=a, p=p),
            "elongation_log": F.log1p(G.elongation("shape_index", a=a, p=p)),
            "compactness": G.compactness(a, p),
            "compactness_eps": G.compactness(a, p, "isoperimetric_eps"),
            "compactness_plain": G.compactness(a, p, "plain_eps"),
            "irregularity": G.ratio(p * p, 4 * np.pi * a),
            "compactness_inv": 1 - G.compactness(a, p),
            "area_perimeter_ratio": a / (p + EPS),
        }
    )


def with_hull(df: DataFrame) -> DataFrame:
    """Convex hull measures. Needs ``area`` and ``perimeter``; a polygon without hull falls back to itself."""
    df = df.withColumn("_hull", G.hull_rings("rings"))
    df = df.withColumn("_h", G.shape_sums("_hull"))
    h = F.col("_h")
    df = df.withColumns(
        {
            "convex_hull_area": F.coalesce(G.area(h), F.col("area")),
            "convex_hull_perimeter": F.coalesce(G.perimeter(h), F.col("perimeter")),
        }
    ).drop("_h", "_hull")
    df = df.withColumns(
        {
            "solidity": G.ratio(F.col("area"), F.col("convex_hull_area")),
            "convexity": G.ratio(F.col("perimeter"), F.col("convex_hull_perimeter")),
        }
    )
    return df.withColumns(
        {
            "convexity_log": F.log1p("convexity"),
            "solidity_ratio": G.ratio(F.col("solidity"), F.col("convexity")),
        }
    )


def with_hu(df: DataFrame) -> DataFrame:
    """``hu_moment_0..6`` and their signed logarithms."""
    df = df.withColumn("_m", G.raw_moments("rings"))
    df = df.withColumn("_n", G.normalized_moments("_m"))
    df = df.withColumn("_hu", G.hu_invariants("_n"))
    df = df.withColumns({f"hu_moment_{i}": F.get("_hu", F.lit(i)) for i in range(7)})
    return df.withColumns({f"hu_moment_{i}_log": G.signed_log(F.col(f"hu_moment_{i}")) for i in range(7)}).drop(
        "_m", "_n", "_hu"
    )


def reproject(df: DataFrame, source: str = "EPSG:4326", target: str = "EPSG:3857") -> DataFrame:
    """Bring ``rings`` into metres. The identity when the frame is already in the target system."""
    if source == target:
        return df
    if (source, target) != ("EPSG:4326", "EPSG:3857"):
        raise ValueError(f"only EPSG:4326 to EPSG:3857 is supported, not {source} to {target}")
    return df.withColumn("rings", G.to_mercator("rings"))


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(start, end, ring, place, edges of the ring) of every edge of all rings."""
    sizes = [len(r) - 1 for r in rings]
    start, end = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    place = np.concatenate([np.arange(n) for n in sizes])
    return start, end, np.repeat(np.arange(len(rings)), sizes), place, np.repeat(sizes, sizes)


def _cross(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Side of the points p on the line from a to b: -1, 0 or 1."""
    return np.sign((b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0]))


def _sweep_is_simple(rings: list[np.ndarray]) -> bool:
    """No forbidden meeting of edges, found by a sweep: edges sorted by left end meet only those that start before their right end.

    Edges of one ring meet at common vertices only, and no edge turns back on the one before. Edges of two rings may
    touch, but neither cross nor run along each other.
    """
    a, b, ring, place, of = _edges(rings)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    stop = np.searchsorted(low[order, 0], high[order, 0], side="right")
    counts = stop - np.arange(1, len(order) + 1)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(order):  # pairs of edges, so many at once that arrays stay small
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + PAIRS_AT_ONCE, side="right")))
        some = counts[lo:hi]
        first = np.repeat(np.arange(lo, hi), some)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some)
        i, j, lo = order[first], order[second], hi
        near = (low[j, 1] <= high[i, 1]) & (high[j, 1] >= low[i, 1])
        if _forbidden(a, b, ring, place, of, i[near], j[near]).any():
            return False
    return True


def _forbidden(a: np.ndarray, b: np.ndarray, ring: np.ndarray, place: np.ndarray, of: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of edges meet as they must not."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    c, d, e, f = _cross(a[i], b[i], a[j]), _cross(a[i], b[i], b[j]), _cross(a[j], b[j], a[i]), _cross(a[j], b[j], b[i])
    own = ring[j] == ring[i]
    gap = np.abs(place[j] - place[i])
    beside = own & ((gap == 1) | (gap == of[i] - 1))
    meet = (c * d <= 0) & (e * f <= 0)
    # On one line, edges share more than a point where their extents overlap.
    shared = (np.minimum(high[i], high[j]) - np.maximum(low[i], low[j])).max(1) > 0
    along = (c == 0) & (d == 0) & shared
    return np.where(own & ~beside, meet, along | (~beside & (c * d < 0) & (e * f < 0)))


def _side_of_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """1 for points inside a ring, -1 outside, 0 on it."""
    a, b = ring[:-1], ring[1:]
    out = np.empty(len(points), np.int8)
    step = max(1, (1 << 20) // len(a))
    for at in range(0, len(points), step):
        p = points[at : at + step, None]
        side = _cross(a, b, p)
        within = ((p >= np.minimum(a, b)) & (p <= np.maximum(a, b))).all(2)
        upward = (a[:, 1] <= p[..., 1]) & (b[:, 1] > p[..., 1]) & (side > 0)
        downward = (a[:, 1] > p[..., 1]) & (b[:, 1] <= p[..., 1]) & (side < 0)
        inside = (upward.sum(1) - downward.sum(1)) != 0
        out[at : at + step] = np.where(((side == 0) & within).any(1), 0, np.where(inside, 1, -1))
    return out


def _nested_well(rings: list[np.ndarray], holes: list[bool]) -> bool:
    """Every hole lies in its own outline and in an odd number of rings in all, every outline in an even number."""
    outline = -1
    for i, ring in enumerate(rings):
        outline = outline if holes[i] else i
        probes = np.concatenate([ring[:-1], (ring[:-1] + ring[1:]) / 2])
        depth, held = 0, not holes[i]
        for j, other in enumerate(rings):
            if i == j:
                continue
            apart = (ring.min(0) > other.max(0)).any() or (ring.max(0) < other.min(0)).any()
            sides = np.array([-1]) if apart else _side_of_ring(probes, other)
            if (sides > 0).any() and (sides < 0).any():
                return False  # it leaves the other ring through its vertices
            # A ring all of whose vertices and middles lie on the other one is within it.
            inside = not (sides < 0).any()
            depth += inside
            held |= inside and j == outline
        if not held or depth % 2 != holes[i]:
            return False
    return True


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in it) of every member of groups of so many members."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def _meet_well(points: np.ndarray, sizes: np.ndarray, polygon: np.ndarray, n: int) -> np.ndarray:
    """What :func:`_sweep_is_simple` says of each of ``n`` polygons; ``sizes`` has the points of every ring, ``polygon`` its polygon."""
    ring, place = _each(sizes - 1)
    at = place + (np.cumsum(sizes) - sizes)[ring]
    a, b, of, owner = points[at], points[at + 1], (sizes - 1)[ring], polygon[ring]
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((low[:, 0], owner))
    sorted_owner = owner[order]
    first, more = _each(np.searchsorted(sorted_owner, sorted_owner, side="right") - np.arange(1, len(order) + 1))
    i, j = order[first], order[first + 1 + more]
    near = (low[j, 0] <= high[i, 0]) & (low[j, 1] <= high[i, 1]) & (high[j, 1] >= low[i, 1])
    i, j = i[near], j[near]
    return np.bincount(owner[i[_forbidden(a, b, ring, place, of, i, j)]], minlength=n) == 0


def _all_nested_well(points: np.ndarray, sizes: np.ndarray, polygon: np.ndarray, hole: np.ndarray, n: int) -> np.ndarray:
    """What :func:`_nested_well` says of each of ``n`` polygons of several rings."""
    begin, edges = np.cumsum(sizes) - sizes, sizes - 1
    low, high = np.minimum.reduceat(points, begin), np.maximum.reduceat(points, begin)
    rings = np.bincount(polygon, minlength=n)
    lowest = (np.cumsum(rings) - rings)[polygon]
    i, j = _each(rings[polygon])
    j += lowest[i]
    apart = (low[i] > high[j]).any(1) | (high[i] < low[j]).any(1)
    met = (i != j) & ~apart
    i, j = i[met], j[met]  # rings that are apart are outside each other
    pair, place = _each(2 * edges[i])  # probes: the vertices of ring i, then the middles of its edges
    at = begin[i[pair]] + place % edges[i[pair]]
    probe = np.where((place < edges[i[pair]])[:, None], points[at], (points[at] + points[at + 1]) / 2)
    asked, place = _each(edges[j[pair]])
    at = begin[j[pair[asked]]] + place
    a, b, p = points[at], points[at + 1], probe[asked]
    side = _cross(a, b, p)
    on = (side == 0) & ((p >= np.minimum(a, b)) & (p <= np.maximum(a, b))).all(1)
    upward = (a[:, 1] <= p[:, 1]) & (b[:, 1] > p[:, 1]) & (side > 0)
    downward = (a[:, 1] > p[:, 1]) & (b[:, 1] <= p[:, 1]) & (side < 0)
    turns = np.bincount(asked, upward.astype(float) - downward, len(pair))
    sides = np.where(np.bincount(asked[on], minlength=len(pair)) > 0, 0, np.where(turns != 0, 1, -1))
    within, without = (np.bincount(pair[s], minlength=len(i)) > 0 for s in (sides > 0, sides < 0))
    inside = ~without
    outline = np.maximum.accumulate(np.where(hole, -1, np.arange(len(sizes))))
    depth, held = np.bincount(i[inside], minlength=len(sizes)), ~hole
    held[i[inside & (j == outline[i])]] = True
    wrong = ~held | (depth % 2 != hole)
    out = (np.bincount(polygon[wrong], minlength=n) == 0) & (np.bincount(polygon[i[within & without]], minlength=n) == 0)
    return out | (rings == 1)


def _are_simple(xs: pa.Array, ys: pa.Array, holes: pa.Array) -> np.ndarray:
    """Whether rings meet and nest as they may, for every polygon that is not null: those of few points together, others one by one."""
    polygon, out = pc.list_parent_indices(xs).to_numpy(), np.zeros(len(xs), bool)
    rings = xs.flatten()
    hole = holes.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    sizes = pc.list_value_length(rings).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.stack([a.flatten().flatten().to_numpy(zero_copy_only=False) for a in (xs, ys)], 1)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(points), bool)
    keep[1:] = (np.diff(points, axis=0) != 0).any(1) | (ring[1:] != ring[:-1])
    points, ring = points[keep], ring[keep]
    sizes = np.bincount(ring, minlength=len(sizes))
    total = np.bincount(polygon, sizes, len(xs))
    whole = np.bincount(polygon[sizes < 4], minlength=len(xs)) == 0
    for k in np.flatnonzero(whole & (total > FEW_POINTS)).tolist():
        mine = slice(*np.searchsorted(polygon, [k, k + 1]))
        parts = np.split(points[slice(*np.searchsorted(ring, [mine.start, mine.stop]))], np.cumsum(sizes[mine])[:-1])
        out[k] = _sweep_is_simple(parts) and (len(parts) == 1 or _nested_well(parts, hole[mine].tolist()))
    some = np.flatnonzero(whole & (total > 0) & (total <= FEW_POINTS))
    cost = np.cumsum(2 * total[some] ** 2) // PAIRS_TOGETHER
    for part in np.split(some, np.flatnonzero(np.diff(cost)) + 1) if len(some) else []:
        new = np.full(len(xs), -1)
        new[part] = np.arange(len(part))
        mine = new[polygon] >= 0
        args = points[mine[ring]], sizes[mine], new[polygon[mine]]
        fine = _meet_well(*args, len(part))
        out[part] = fine & _all_nested_well(*args, hole[mine], len(part))
    return out


@F.arrow_udf(BooleanType())
def _swept(xs: pa.Array, ys: pa.Array, holes: pa.Array) -> pa.Array:
    return pa.array(_are_simple(xs, ys, holes), mask=xs.is_null().to_numpy(zero_copy_only=False))


def with_validity(df: DataFrame, long_rings: bool = True) -> DataFrame:
    """``is_valid``: every ring closed, at least four points, no crossing of edges, holes in their outlines, and an area.

    A vertex may be repeated. Holes follow the outline they belong to; holes and outlines may touch at points, and an
    outline may lie in a hole of another. One ring of ordinary size is tested by an expression inside the JVM; several
    rings, and those above ``LONG_RING`` vertices, by a sweep in Arrow batches, to which only they are sent.
    ``long_rings=False`` leaves a single long ring to the expression, which takes quadratic time.
    """
    rings, s = F.col("rings"), F.col("_s")
    shaped = F.expr(f"forall(rings, r -> {G.ring_closed('r.pts')})")
    is_swept = F.size(rings) > 1
    if long_rings:
        is_swept = is_swept | F.expr(f"exists(rings, r -> size(r.pts) > {LONG_RING})")
    df = with_sums(df).withColumn("_edges", F.when(~is_swept, G.rings_edges("rings")))
    sent = F.when(is_swept & shaped, rings)
    xs = F.transform(sent, lambda r: F.transform(r["pts"], lambda p: p["x"]))
    ys = F.transform(sent, lambda r: F.transform(r["pts"], lambda p: p["y"]))
    df = df.withColumn("_long", _swept(xs, ys, F.transform(sent, lambda r: r["hole"])))
    simple = F.when(is_swept, F.col("_long")).otherwise(G.edges_simple("_edges"))
    valid = (F.size(rings) > 0) & shaped & (s["a2"] != 0) & simple
    return df.withColumn("is_valid", F.when(rings.isNotNull(), F.coalesce(valid, F.lit(False)))).drop("_s", "_long", "_edges")


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(F.col("rings").isNotNull())


def drop_empty(df: DataFrame) -> DataFrame:
    """Keep polygons whose first ring can enclose something."""
    return df.where(F.coalesce(F.size(F.get("rings", F.lit(0))["pts"]) >= 4, F.lit(False)))


def drop_invalid(df: DataFrame, long_rings: bool = True) -> DataFrame:
    return with_validity(df, long_rings).where("is_valid").drop("is_valid")
