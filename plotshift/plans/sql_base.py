"""The parcel table in ANSI-style SQL, for checking the registered queries on another engine."""

from __future__ import annotations

from plotshift.sources.parcels import BAND_OFFSETS, BOW_TIE, DIRECTIONS, GEOGRAPHY, STATUSES, URBAN
from plotshift.vocabulary import BANDS, CHANGE_TYPES


def lit(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def pick(values, index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expr}, {digits}) END)"


# Wichura's rational approximations of the inverse normal (algorithm AS 241), highest power first: the middle,
# the tails up to 5, and beyond.
INVERSE_NORMAL = (
    (
        "2509.0809287301226727 33430.575583588128105 67265.770927008700853 45921.953931549871457 13731.693765509461125 "
        "1971.5909503065514427 133.14166789178437745 3.3871328727963666080",
        "5226.4952788528545610 28729.085735721942674 39307.895800092710610 21213.794301586595867 5394.1960214247511077 "
        "687.18700749205790830 42.313330701600911252 1.0",
    ),
    (
        "7.74545014278341407640e-4 2.27238449892691845833e-2 2.41780725177450611770e-1 1.27045825245236838258 3.64784832476320460504 "
        "5.76949722146069140550 4.63033784615654529590 1.42343711074968357734",
        "1.05075007164441684324e-9 5.47593808499534494600e-4 1.51986665636164571966e-2 1.48103976427480074590e-1 6.89767334985100004550e-1 "
        "1.67638483018380384940 2.05319162663775882187 1.0",
    ),
    (
        "2.01033439929228813265e-7 2.71155556874348757815e-5 1.24266094738807843860e-3 2.65321895265761230930e-2 2.96560571828504891230e-1 "
        "1.78482653991729133580 5.46378491116411436990 6.65790464350110377720",
        "2.04426310338993978564e-15 1.42151175831644588870e-7 1.84631831751005468180e-5 7.86869131145613259100e-4 1.48753612908506148525e-2 "
        "1.36929880922735805310e-1 5.99832206555887937690e-1 1.0",
    ),
)


def inverse_normal(p: str) -> str:
    """The normal value below which a share ``p`` lies."""

    def ratio(which: int, x: str) -> str:
        def polynomial(coefficients: str) -> str:
            first, *rest = [f"{float(c)!r}::DOUBLE" for c in coefficients.split()]
            for c in rest:
                first = f"({first} * {x} + {c})"
            return first

        return " / ".join(polynomial(c) for c in INVERSE_NORMAL[which])

    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    middle = f"({p} - 0.5) * " + ratio(0, f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))")
    outer = f"CASE WHEN {tail} <= 5 THEN {ratio(1, f'({tail} - 1.6)')} ELSE {ratio(2, f'({tail} - 5)')} END"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {middle} ELSE sign({p} - 0.5) * ({outer}) END"


LAB = "CAST(CASE WHEN u < 3 THEN 5 WHEN u < 8 THEN 4 WHEN u < 15 THEN 1 WHEN u < 25 THEN 0 WHEN u < 55 THEN 3 ELSE 2 END AS INT)"

_dates = "o_orderdate::DATE AS day0" + "".join(
    f", day{i - 1} + CAST(30 + (k * {2 * i + 1}) % 300 AS INT) AS day{i}" for i in range(1, 5)
)
_strings = ", ".join(
    f"CASE WHEN (k + {i}) % 53 = 0 THEN NULL WHEN (k + {i}) % 211 = 0 THEN '31-13-2015' "
    f"ELSE strftime(day{i}, '%d-%m-%Y') END AS date{i}, "
    f"CASE WHEN (k + {i}) % 61 <> 0 THEN {pick(STATUSES, f'((k * {i + 1} + {i}) % 8)')} END AS change_status_date{i}"
    for i in range(5)
)
_bands = ", ".join(
    f"CASE WHEN k % 59 <> 0 THEN CAST(50 + (k * {d + 2} + {BAND_OFFSETS[b]}) % 150 AS DOUBLE) END AS img_{b}_mean_date{d}, "
    f"CASE WHEN k % 59 <> 0 THEN CAST(1 + (k + 5 * {d} + {BAND_OFFSETS[b]}) % 40 AS DOUBLE) END AS img_{b}_std_date{d}"
    for b in BANDS
    for d in range(1, 6)
)

PARCELS = f"""
src AS (SELECT o_orderkey AS k, (o_orderkey * 7919 + 17) % 100 AS u, o_orderdate FROM orders),
lab AS (SELECT *, {LAB} AS lab,
  ((k % 100003) * (k % 100003) * 37 + (k % 100003) * 11) % 100003 AS cx,
  ((k % 100019) * (k % 100019) * 53 + (k % 100019) * 7919) % 100019 AS cy,
  CASE WHEN k % 97 = 0 THEN 'null' WHEN k % 101 = 0 THEN 'empty' WHEN k % 103 = 0 THEN 'bow' ELSE 'star' END AS kind,
  CASE WHEN k % 11 IN (3, 8) THEN 'test' ELSE 'train' END AS split, {_dates} FROM src),
parcels AS (SELECT k AS fid, lab, cx, cy, kind, split,
  CASE WHEN split = 'train' THEN {pick(tuple(CHANGE_TYPES), 'lab')} END AS change_type,
  CASE WHEN kind <> 'null' THEN 'Polygon' END AS geometry_type,
  {pick(URBAN, '((k % 13) % 5)')} AS urban_type, {pick(GEOGRAPHY, '((k % 37) % 7)')} AS geography_type,
  {_strings}, {_bands} FROM lab)"""

_star = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(DIRECTIONS))
_bow = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(BOW_TIE))

VERTICES = f"""
verts AS (
  SELECT fid, i, 8 AS n, CAST(cx + (lab + 1) * (10 + (fid * (2 * i + 3) + 13 * i) % 97) * dx AS DOUBLE) AS x,
         CAST(cy + (lab + 1) * (10 + (fid * (2 * i + 3) + 13 * i) % 97) * dy AS DOUBLE) AS y
  FROM parcels, (VALUES {_star}) d(i, dx, dy) WHERE kind = 'star'
  UNION ALL
  SELECT fid, i, 4, CAST(cx + dx AS DOUBLE), CAST(cy + dy AS DOUBLE)
  FROM parcels, (VALUES {_bow}) d(i, dx, dy) WHERE kind = 'bow'),
edges AS (
  SELECT a.fid, a.i, a.n, o.x AS ox, o.y AS oy, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb,
         a.x - o.x AS x0, a.y - o.y AS y0, b.x - o.x AS x1, b.y - o.y AS y1,
         (a.x - o.x) * (b.y - o.y) - (b.x - o.x) * (a.y - o.y) AS c,
         sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len
  FROM verts a JOIN verts b ON a.fid = b.fid AND b.i = (a.i + 1) % a.n JOIN verts o ON o.fid = a.fid AND o.i = 0),
sums AS (
  SELECT fid, min(ox) AS ox, min(oy) AS oy, sum(c) AS a2, sum((x0 + x1) * c) AS sx, sum((y0 + y1) * c) AS sy,
         sum(len) AS len, sum((x0 + x1) * len) AS lx, sum((y0 + y1) * len) AS ly,
         min(ax) AS minx, max(ax) AS maxx, min(ay) AS miny, max(ay) AS maxy
  FROM edges GROUP BY fid),
geo AS (
  SELECT p.*, CASE WHEN kind = 'empty' THEN 0.0 ELSE abs(a2) / 2 END AS area,
         CASE WHEN kind = 'empty' THEN 0.0 ELSE len END AS perimeter,
         CASE WHEN a2 <> 0 THEN ox + sx / (3 * a2) ELSE ox + lx / (2 * len) END AS centroid_x,
         CASE WHEN a2 <> 0 THEN oy + sy / (3 * a2) ELSE oy + ly / (2 * len) END AS centroid_y,
         minx, miny, maxx, maxy, maxx - minx AS w, maxy - miny AS h
  FROM parcels p LEFT JOIN sums USING (fid))"""

DATED = (
    "\ndated AS (SELECT *, "
    + ", ".join(f"CAST(try_strptime(date{i}, '%d-%m-%Y') AS DATE) AS d{i}" for i in range(5))
    + " FROM parcels),\ngaps AS (SELECT *, "
    + ", ".join(f"CAST(d{i + 1} - d{i} AS INT) AS g{i}" for i in range(4))
    + ", CAST(d4 - d0 AS INT) AS total FROM dated),\n"
    + "speeds AS (SELECT *, "
    + " + ".join(f"CAST(g{i} IS NOT NULL AS INT)" for i in range(4))
    + " AS freq, "
    + "("
    + " + ".join(f"coalesce(g{i}, 0)" for i in range(4))
    + ")::DOUBLE / nullif("
    + " + ".join(f"CAST(g{i} IS NOT NULL AS INT)" for i in range(4))
    + ", 0) AS speed FROM gaps)"
)

PROBABILITIES = f"""
src AS (SELECT o_orderkey AS k, (o_orderkey * 7919 + 17) % 100 AS u FROM orders),
slots AS (SELECT k AS fid, {LAB} AS lab, m.m AS model, f.f AS fold,
  [1 + (k * (c + 2) + 7 * m.m + 3 * f.f) % 13 FOR c IN range(6)] AS w
  FROM src, (VALUES (0), (1), (2)) m(m), (VALUES (0), (1), (2), (3), (4)) f(f)),
probs AS (SELECT fid, lab, model, fold, CAST(i AS INT) AS class, w[i + 1] / list_sum(w)::DOUBLE AS p
  FROM slots, (VALUES (0), (1), (2), (3), (4), (5)) t(i))"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)
