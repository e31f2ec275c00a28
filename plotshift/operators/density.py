"""Gaussian kernel density of points, evaluated at the points.

Coordinates are whitened by the covariance and divided by Scott's bandwidth, so the kernel is exp(-d^2/2). Points are
summarised per half-bandwidth cell by the moments of the kernel's Taylor series; a density is then a sum over nearby
cells instead of nearby points, so the work grows with the table and not with its square. Twelve terms per axis leave
a relative error below 1e-8; contributions beyond 8.6 bandwidths are below double precision and left out.

The moments travel by shuffles: square tiles of cells meet the cells around them, and a tile carries the moments to its
own cells along u first and along v second. A cell receives the kernel sum at a grid of Chebyshev nodes, and its points
interpolate there. Nothing is collected, a task holds one tile at a time, and a tile's size does not depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.session import materialize

CUTOFF = 8.6
SIDE = 0.5
TERMS = 12
# Chebyshev nodes per axis at which a cell knows the kernel sum; twelve leave 1e-15 of the kernel's height.
NODES = 12
# Cells along the side of a tile, and cells around it that reach into it.
TILE = 64
REACH = math.ceil(CUTOFF / SIDE)
# Points interpolated at once.
AT_ONCE = 1 << 14

CHUNK = "g long, cu long, cv long, ids array<long>, us array<double>, vs array<double>, factors array<double>"
FIELD = "g long, cu long, cv long, field array<double>"


def whitened(df: DataFrame, x: str, y: str, key: str, by: str | None) -> DataFrame:
    """(id, g, u, v, factor): coordinates in bandwidth units of the row's group, and what turns kernel sums into densities."""
    df = df.select(
        F.col(key).cast("long").alias("id"),
        (F.col(by) if by else F.lit(0)).cast("long").alias("g"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    ).dropna()
    stats = df.groupBy("g").agg(
        F.count("*").alias("n"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.covar_samp("x", "x").alias("cxx"),
        F.covar_samp("x", "y").alias("cxy"),
        F.covar_samp("y", "y").alias("cyy"),
    )
    # Cholesky factor (a, b, c) of the covariance and Scott's bandwidth h for two dimensions.
    # A group of one row, or of rows on one line, has no such factor.
    stats = stats.selectExpr(
        "g", "n", "mx", "my", "nullif(sqrt(cxx), 0D) AS a", "cxy / nullif(sqrt(cxx), 0D) AS b",
        "nullif(sqrt(greatest(cyy - cxy * cxy / nullif(cxx, 0D), 0D)), 0D) AS c", "power(n, -1D / 6) AS h",
    )
    return df.join(stats, "g").selectExpr(
        "id",
        "g",
        "(x - mx) / (a * h) AS u",
        "(y - my - (x - mx) * (b / a)) / (c * h) AS v",
        "1 / (2 * pi() * h * h * a * c * n) AS factor",
    )


def kernel_density(df: DataFrame, x: str, y: str, key: str = "fid", by: str | None = None) -> DataFrame:
    """(id, density) for every row with both coordinates; ``by`` estimates within each class of an integer code.

    The density is null in a class of one row and in one whose points lie on a line.
    """
    white = whitened(df, x, y, key, by)
    flat = white.where("u IS NULL OR v IS NULL").select("id", F.lit(None).cast("double").alias("density"))
    placed = white.where("u IS NOT NULL AND v IS NOT NULL")
    placed = materialize(placed.selectExpr("*", f"floor(u / {SIDE}D) AS cu", f"floor(v / {SIDE}D) AS cv"), "white")
    # The id splits cells that hold a large part of the table; a cell's points are sent to its field in chunks.
    ordered = placed.repartitionByRange("g", "cu", "cv", "id").sortWithinPartitions("g", "cu", "cv")
    chunks = ordered.select("g", "cu", "cv", "id", "u", "v", "factor").mapInArrow(_chunks, CHUNK)
    found = chunks.join(cell_fields(cell_moments(placed)), ["g", "cu", "cv"])
    dense = found.select("cu", "cv", "ids", "us", "vs", "factors", "field").mapInArrow(_interpolate, "id long, density double")
    return dense.unionByName(flat)


def cell_moments(placed: DataFrame) -> DataFrame:
    """(g, cu, cv, m): per cell the sums of exp(-(s^2+t^2)/2) s^a t^b over its points, (s, t) being offsets from its centre."""
    centred = placed.selectExpr("g", "cu", "cv", f"u - (cu + 0.5D) * {SIDE}D AS s", f"v - (cv + 0.5D) * {SIDE}D AS t")
    weighted = centred.selectExpr("*", "exp(-(s * s + t * t) / 2) AS e")
    powers = [f"power(s, {i}) AS s{i}" for i in range(TERMS)] + [f"power(t, {i}) AS t{i}" for i in range(TERMS)]
    names = [(a, b) for a in range(TERMS) for b in range(TERMS)]
    sums = [F.expr(f"sum(e * s{a} * t{b}) AS m{a}_{b}") for a, b in names]
    moments = weighted.selectExpr("g", "cu", "cv", "e", *powers).groupBy("g", "cu", "cv").agg(*sums)
    return moments.select("g", "cu", "cv", F.array(*[f"m{a}_{b}" for a, b in names]).alias("m"))


def cell_fields(moments: DataFrame) -> DataFrame:
    """(g, cu, cv, field): at every occupied cell the kernel sum over all cells in reach, at NODES x NODES places.

    A cell is sent to its own tile and to those within its reach, at most four in all.
    """
    tiles = lambda c: f"sequence(floor(({c} - {REACH}) / {TILE}), floor(({c} + {REACH}) / {TILE}))"
    sent = moments.withColumn("tu", F.explode(F.expr(tiles("cu")))).withColumn("tv", F.explode(F.expr(tiles("cv"))))
    return sent.groupBy("g", "tu", "tv").applyInArrow(_tile_fields, FIELD)


def nodes() -> np.ndarray:
    """Offsets of the Chebyshev nodes from a cell's centre."""
    return SIDE / 2 * np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def _basis() -> np.ndarray:
    """exp(-t^2/2) t^a / a! for the offset t of every node to the centre of every cell in reach: (node, cell, a)."""
    t = nodes()[:, None] - np.arange(-REACH, REACH + 1)[None, :] * SIDE
    terms = np.cumprod(np.concatenate([np.exp(-t * t / 2)[:, :, None], np.repeat(t[:, :, None], TERMS - 1, 2)], 2), 2)
    return terms / np.array([math.factorial(i) for i in range(TERMS)], dtype=float)


def _tile_fields(table: pa.Table) -> pa.Table:
    """Fields of a tile's own cells, from the moments of the cells in it and around it."""
    g, cu, cv, tu, tv = (table.column(c).to_numpy() for c in ("g", "cu", "cv", "tu", "tv"))
    m = table.column("m").combine_chunks().flatten().to_numpy().reshape(-1, TERMS, TERMS)
    u, v = cu - tu * TILE, cv - tv * TILE
    own = np.nonzero((u >= 0) & (u < TILE) & (v >= 0) & (v < TILE))[0]
    fields = np.empty((len(own), NODES, NODES))
    if len(own):
        around = np.zeros((TILE + 2 * REACH, TILE + 2 * REACH, TERMS, TERMS))
        around[u + REACH, v + REACH] = m
        basis, width = _basis(), 2 * REACH + 1
        for i in np.unique(u[own]):
            along_u = np.tensordot(basis, around[i : i + width], ([1, 2], [0, 2]))
            for r in np.nonzero(u[own] == i)[0]:
                j = v[own[r]]
                fields[r] = np.tensordot(along_u[:, j : j + width], basis, ([1, 2], [1, 2]))
    starts = np.arange(len(own) + 1, dtype=np.int32) * NODES * NODES
    lists = pa.ListArray.from_arrays(starts, pa.array(fields.ravel()))
    return pa.table({"g": g[own], "cu": cu[own], "cv": cv[own], "field": lists})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of points of one cell, packed into one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy() for c in ("g", "cu", "cv")])
        first = np.concatenate([[0], np.nonzero((np.diff(place) != 0).any(0))[0] + 1])
        offsets = pa.array(np.append(first, batch.num_rows), pa.int32())
        packed = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("id", "u", "v", "factor")]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(p) for p in place[:, first]], *packed], names=["g", "cu", "cv", "ids", "us", "vs", "factors"]
        )


def lagrange(offset: np.ndarray) -> np.ndarray:
    """The Lagrange polynomials of the nodes at every offset from a cell's centre: one row per point."""
    at = nodes()
    gap = offset[:, None] - at[None, :]
    hit = gap == 0
    weight = (-1.0) ** np.arange(NODES) * np.sin((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    terms = weight / np.where(hit, 1.0, gap)
    return np.where(hit.any(1)[:, None], hit.astype(float), terms / terms.sum(1)[:, None])


def _interpolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Densities of the points of chunks, from the fields of their cells."""
    for batch in batches:
        sizes = batch.column("ids").value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
            part = batch.slice(row, stop - row)
            ids, u, v, factor, field = (part.column(c).flatten().to_numpy() for c in ("ids", "us", "vs", "factors", "field"))
            of = np.repeat(np.arange(stop - row), sizes[row:stop])
            cu, cv = (part.column(c).to_numpy()[of] for c in ("cu", "cv"))
            fields = field.reshape(-1, NODES, NODES)[of]
            lu, lv = lagrange(u - (cu + 0.5) * SIDE), lagrange(v - (cv + 0.5) * SIDE)
            out = ((lu[:, None, :] @ fields)[:, 0, :] * lv).sum(1) * factor
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out)], names=["id", "density"])
            row = stop
