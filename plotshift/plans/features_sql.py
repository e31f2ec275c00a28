"""SQL counterparts of the feature queries."""

from __future__ import annotations

from plotshift.plans.sql_base import DATED, PARCELS, VERTICES, r, with_
from plotshift.vocabulary import BANDS, INDEXES

PI4 = "(4 * pi())"
EDGE_CROSSINGS = """
crossing AS (
  SELECT DISTINCT e.fid FROM edges e JOIN edges f ON e.fid = f.fid AND f.i > e.i + 1 AND NOT (e.i = 0 AND f.i = e.n - 1)
  WHERE greatest(e.ax, e.bx) >= least(f.ax, f.bx) AND greatest(f.ax, f.bx) >= least(e.ax, e.bx)
    AND greatest(e.ay, e.yb) >= least(f.ay, f.yb) AND greatest(f.ay, f.yb) >= least(e.ay, e.yb)
    AND sign((e.bx - e.ax) * (f.ay - e.ay) - (e.yb - e.ay) * (f.ax - e.ax))
      * sign((e.bx - e.ax) * (f.yb - e.ay) - (e.yb - e.ay) * (f.bx - e.ax)) <= 0
    AND sign((f.bx - f.ax) * (e.ay - f.ay) - (f.yb - f.ay) * (e.ax - f.ax))
      * sign((f.bx - f.ax) * (e.yb - f.ay) - (f.yb - f.ay) * (e.bx - f.ax)) <= 0),
validity AS (
  SELECT g.*, CASE WHEN kind <> 'null' THEN kind NOT IN ('empty') AND area > 0 AND c.fid IS NULL END AS is_valid
  FROM geo g LEFT JOIN crossing c ON g.fid = c.fid)"""

# A hull edge is a pair of vertices with every other vertex to its left or between the two.
HULL = """
hull_edges AS (
  SELECT a.fid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS yb
  FROM (SELECT DISTINCT fid, x, y FROM verts) a JOIN (SELECT DISTINCT fid, x, y FROM verts) b
    ON a.fid = b.fid AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (
    SELECT 1 FROM verts v WHERE v.fid = a.fid AND (
      (b.x - a.x) * (v.y - a.y) - (b.y - a.y) * (v.x - a.x) < 0
      OR ((b.x - a.x) * (v.y - a.y) - (b.y - a.y) * (v.x - a.x) = 0
          AND (v.x - a.x) * (v.x - b.x) + (v.y - a.y) * (v.y - b.y) > 0)))),
hulls AS (
  SELECT fid, sum(ax * yb - bx * ay) / 2 AS ha, sum(sqrt((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay))) AS hp
  FROM hull_edges GROUP BY fid),
hulled AS (
  SELECT g.*, coalesce(ha, area) AS hull_area, coalesce(hp, perimeter) AS hull_perimeter
  FROM geo g LEFT JOIN hulls USING (fid))"""


def q(numerator: str, denominator: str) -> str:
    return f"(({numerator}) / nullif({denominator}, 0))"


def _index(name: str, d: int) -> str:
    red, green, blue = (f"img_{b}_mean_date{d}" for b in BANDS)
    a, b = {"NDVI": (red, blue), "SAVI": (red, blue), "NDBI": (red, green), "NDWI": (green, blue)}[name]
    if name == "SAVI":
        return f"(({a} - {b}) / ({a} + {b} + 0.5::DOUBLE + 1e-9) * 1.5::DOUBLE)"
    return f"(({a} - {b}) / ({a} + {b} + 1e-9))"


_dates = range(1, 6)
INDEXED = "\nindexed AS (SELECT *, " + ", ".join(f"{_index(x, d)} AS {x}_date{d}" for d in _dates for x in INDEXES) + " FROM parcels)"


def _sql() -> dict[str, str]:
    out = {}
    base = with_(PARCELS, VERTICES)
    out["flagship_class_summary"] = with_(PARCELS, VERTICES, EDGE_CROSSINGS, DATED) + f"""
      SELECT v.change_type, count(*) AS parcels, {r('sum(area)')} AS total_area, {r('max(perimeter)')} AS max_perimeter,
        {r(f'avg({PI4} * area / (perimeter * perimeter + 1e-9))')} AS mean_compactness, {r('avg(g.g0)')} AS mean_gap
      FROM validity v JOIN gaps g ON v.fid = g.fid WHERE v.split = 'train' AND is_valid GROUP BY v.change_type"""
    out["parcels_clean"] = with_(PARCELS, VERTICES, EDGE_CROSSINGS) + """
      SELECT split, count(*) AS n, count(*) FILTER (kind = 'null') AS missing, count(*) FILTER (kind = 'empty') AS empty,
        count(*) FILTER (kind NOT IN ('null', 'empty') AND NOT is_valid) AS invalid, count(*) FILTER (is_valid) AS valid,
        count(*) FILTER (centroid_x IS NULL OR centroid_y IS NULL) AS no_centroid FROM validity GROUP BY split"""
    core = ["area", "perimeter", "centroid_x", "centroid_y"]
    out["geom_core"] = base + " SELECT fid, " + ", ".join(
        f"{r(c)} AS {c}, {r(f'coalesce({c}, 0)')} AS {c}_or_0" for c in core
    ) + " FROM geo"
    boxes = {
        "minx": "minx", "miny": "miny", "maxx": "maxx", "maxy": "maxy",
        "bounding_width": "w", "bounding_height": "h", "bounding_diagonal": "sqrt(w * w + h * h)",
        "aspect_ratio": q("w", "h"), "aspect_ratio_clamped": "w / greatest(h, 1e-9)",
        "elongation_box": "w / (h + 1e-9)", "elongation_ratio": "h / (w + 1e-9)",
        "bbox_area_ratio": q("area", "w * h"), "diagonal_area_ratio": "sqrt(w * w + h * h) / (area + 1e-9)",
    }
    out["geom_bbox"] = base + " SELECT fid, " + ", ".join(f"{r(e)} AS {c}" for c, e in boxes.items()) + " FROM geo"
    iso = q(f"{PI4} * area", "perimeter * perimeter")
    shape = {
        "elongation_shape": q("perimeter", "sqrt(area)"),
        "elongation_log": f"ln(1 + {q('perimeter', 'sqrt(area)')})",
        "compactness": iso,
        "compactness_eps": f"{PI4} * area / (perimeter * perimeter + 1e-9)",
        "compactness_plain": "area / (perimeter * perimeter + 1e-6)",
        "irregularity": q("perimeter * perimeter", f"{PI4} * area"),
        "compactness_inv": f"1 - {iso}",
        "area_perimeter_ratio": "area / (perimeter + 1e-9)",
    }
    out["geom_shape"] = base + " SELECT fid, " + ", ".join(f"{r(e)} AS {c}" for c, e in shape.items()) + " FROM geo"
    sol, conv = q("area", "hull_area"), q("perimeter", "hull_perimeter")
    hull = {
        "convex_hull_area": "hull_area", "convex_hull_perimeter": "hull_perimeter", "solidity": sol, "convexity": conv,
        "convexity_log": f"ln(1 + {conv})", "solidity_ratio": q(sol, conv),
    }
    out["geom_hull"] = with_(PARCELS, VERTICES, HULL) + " SELECT fid, " + ", ".join(
        f"{r(e)} AS {c}" for c, e in hull.items()
    ) + " FROM hulled"
    m = {
        "m00": "sum(c) / 2", "m10": "sum(c * (x0 + x1)) / 6", "m01": "sum(c * (y0 + y1)) / 6",
        "m20": "sum(c * (x0 * x0 + x0 * x1 + x1 * x1)) / 12", "m02": "sum(c * (y0 * y0 + y0 * y1 + y1 * y1)) / 12",
        "m11": "sum(c * (2 * x0 * y0 + x0 * y1 + x1 * y0 + 2 * x1 * y1)) / 24",
        "m30": "sum(c * (x0 * x0 * x0 + x0 * x0 * x1 + x0 * x1 * x1 + x1 * x1 * x1)) / 20",
        "m03": "sum(c * (y0 * y0 * y0 + y0 * y0 * y1 + y0 * y1 * y1 + y1 * y1 * y1)) / 20",
        "m21": "sum(c * (3 * x0 * x0 * y0 + x0 * x0 * y1 + 2 * x0 * x1 * y0 + 2 * x0 * x1 * y1 + x1 * x1 * y0 + 3 * x1 * x1 * y1)) / 60",
        "m12": "sum(c * (3 * x0 * y0 * y0 + x1 * y0 * y0 + 2 * x0 * y0 * y1 + 2 * x1 * y0 * y1 + x0 * y1 * y1 + 3 * x1 * y1 * y1)) / 60",
    }
    hu_sql = "".join(
        [
            "\nraw AS (SELECT fid, sign(sum(c)) AS s, " + ", ".join(f"{e} AS {k}" for k, e in m.items()) + " FROM edges GROUP BY fid HAVING sum(c) <> 0),",
            "\nabsm AS (SELECT fid, " + ", ".join(f"s * {k} AS {k}" for k in m) + " FROM raw),",
            "\ncen AS (SELECT *, m10 / m00 AS x, m01 / m00 AS y FROM absm),",
            """
            eta AS (SELECT fid, (m20 - x * m10) / (m00 * m00) AS n20, (m11 - x * m01) / (m00 * m00) AS n11,
              (m02 - y * m01) / (m00 * m00) AS n02, (m30 - 3 * x * m20 + 2 * x * x * m10) / pow(m00, 2.5) AS n30,
              (m21 - 2 * x * m11 - y * m20 + 2 * x * x * m01) / pow(m00, 2.5) AS n21,
              (m12 - 2 * y * m11 - x * m02 + 2 * y * y * m10) / pow(m00, 2.5) AS n12,
              (m03 - 3 * y * m02 + 2 * y * y * m01) / pow(m00, 2.5) AS n03 FROM cen),
            hu AS (SELECT fid, n20 + n02 AS h0, pow(n20 - n02, 2) + 4 * n11 * n11 AS h1,
              pow(n30 - 3 * n12, 2) + pow(3 * n21 - n03, 2) AS h2, pow(n30 + n12, 2) + pow(n21 + n03, 2) AS h3,
              (n30 - 3 * n12) * (n30 + n12) * (pow(n30 + n12, 2) - 3 * pow(n21 + n03, 2))
                + (3 * n21 - n03) * (n21 + n03) * (3 * pow(n30 + n12, 2) - pow(n21 + n03, 2)) AS h4,
              (n20 - n02) * (pow(n30 + n12, 2) - pow(n21 + n03, 2)) + 4 * n11 * (n30 + n12) * (n21 + n03) AS h5,
              (3 * n21 - n03) * (n30 + n12) * (pow(n30 + n12, 2) - 3 * pow(n21 + n03, 2))
                - (n30 - 3 * n12) * (n21 + n03) * (3 * pow(n30 + n12, 2) - pow(n21 + n03, 2)) AS h6 FROM eta)""",
        ]
    )
    out["geom_hu"] = with_(PARCELS, VERTICES, hu_sql) + " SELECT p.fid, " + ", ".join(
        f"{r(f'coalesce(h{i}, 0)', 8)} AS hu_moment_{i}, {r(f'sign(coalesce(h{i}, 0)) * ln(1 + abs(coalesce(h{i}, 0)))', 8)} AS hu_moment_{i}_log"
        for i in range(7)
    ) + " FROM parcels p LEFT JOIN hu ON p.fid = hu.fid"
    mx, my = "6378137.0::DOUBLE * radians({0} / 1000)", "6378137.0::DOUBLE * ln(tan(pi() / 4 + radians({0} / 2000) / 2))"
    out["geom_reproject"] = base + " SELECT fid, " + ", ".join(
        f"{r((mx if c[-1] == 'x' else my).format(c), 3)} AS {c}" for c in ("minx", "miny", "maxx", "maxy")
    ) + " FROM geo"
    out["geom_validity"] = with_(PARCELS, VERTICES, EDGE_CROSSINGS) + " SELECT fid, CAST(CAST(is_valid AS INT) AS DOUBLE) AS is_valid FROM validity"
    out["geom_nested"] = """WITH b AS (SELECT o_orderkey AS fid, 5 + o_orderkey % 13 * 10 AS x, 5 + o_orderkey % 7 * 10 AS y, 20 + o_orderkey % 5 * 10 AS w FROM orders)
      SELECT fid, CAST(x + w < 100 AND y + w < 100 AS INT)::DOUBLE AS is_valid, (10000 - w * w + (w - 10) * (w - 10))::DOUBLE AS area,
        (400 + 4 * w + 4 * (w - 10))::DOUBLE AS perimeter FROM b"""
    out["geom_types"] = with_(PARCELS) + (
        " SELECT geometry_type, count(*) AS n FROM parcels WHERE geometry_type IS NOT NULL GROUP BY 1"
    )
    dated = with_(PARCELS, DATED)
    out["dates_parse"] = dated + " SELECT fid, " + ", ".join(f"strftime(d{i}, '%Y-%m-%d') AS date{i}" for i in range(5)) + " FROM dated"
    out["dates_gaps"] = dated + " SELECT fid, " + ", ".join(
        [f"g{i}::DOUBLE AS days_between_{i}_{i + 1}" for i in range(4)] + [f"g{i}::DOUBLE AS delta_days_{i}" for i in range(1, 4)]
    ) + f""", CAST(d4 - d1 AS DOUBLE) AS total_days_from_1, total::DOUBLE AS total_days, freq AS change_frequency,
      {r('speed')} AS change_speed, {r('freq / (total + 1e-9)')} AS change_rate FROM speeds"""
    parts = ", ".join(
        f"CAST(day(d{i}) AS DOUBLE) AS date{i}_day, CAST(month(d{i}) AS DOUBLE) AS date{i}_month, CAST(year(d{i}) AS DOUBLE) AS date{i}_year, "
        f"CAST(month(d{i}) AS DOUBLE) AS month_date{i}, CAST(d{i} - DATE '1970-01-01' AS DOUBLE) * 86400 AS date{i}_epoch"
        for i in range(5)
    )
    out["dates_parts"] = dated + f""" SELECT fid, {parts}, CAST(coalesce(year(d0) BETWEEN 2015 AND 2018, FALSE)
      OR coalesce(year(d4) BETWEEN 2015 AND 2018, FALSE) AS INT) AS high_change_2015_2018 FROM dated"""
    out["change_acceleration"] = dated + (
        f" SELECT fid, {r('coalesce(speed - lag(speed) OVER (ORDER BY fid), 0)')} AS change_acceleration FROM speeds"
    )
    out["change_cumulative"] = dated + f""", rated AS (SELECT fid, freq / (total + 1e-9) AS rate FROM speeds)
      SELECT fid, CASE WHEN rate IS NOT NULL THEN {r('sum(rate) OVER (ORDER BY fid)', 3)} END AS cumulative_change_rate FROM rated"""
    out["event_running_value"] = f"""
      SELECT event_id AS fid, {r('coalesce(value - lag(value) OVER (ORDER BY event_id), 0)', 3)} AS step,
        CASE WHEN value IS NOT NULL THEN {r('sum(value) OVER (ORDER BY event_id)', 3)} END AS running FROM events"""
    steps = " UNION ALL ".join(
        f"SELECT change_status_date{i} AS from_status, change_status_date{i + 1} AS to_status FROM parcels" for i in range(4)
    )
    out["status_transitions"] = with_(PARCELS) + f""" SELECT from_status, to_status, count(*) AS n FROM ({steps})
      WHERE from_status IS NOT NULL AND to_status IS NOT NULL GROUP BY 1, 2"""
    out["status_changes"] = with_(PARCELS) + " SELECT fid, " + " + ".join(
        f"coalesce(CAST(change_status_date{i} <> change_status_date{i + 1} AS INT), 0)" for i in range(4)
    ) + " AS n_changes FROM parcels"
    cols = [f"{r(_index('NDVI', 1))} AS NDVI"]
    for d in _dates:
        for b in BANDS:
            mean, std = f"img_{b}_mean_date{d}", f"img_{b}_std_date{d}"
            cols += [f"{r(mean)} AS spectral_mean_{d}_{b}", f"{r(f'{std} * {std}')} AS spectral_var_{d}_{b}",
                     f"{r(f'{mean} / ({std} + 1e-9)')} AS spectral_ratio_{d}_{b}"]
            if d > 1:
                cols.append(f"{r(f'{mean} - img_{b}_mean_date{d - 1}')} AS spectral_diff_{d}_{b}")
    out["bands_basic"] = with_(PARCELS) + " SELECT fid, " + ", ".join(cols) + " FROM parcels"
    cols = [f"{r(f'{x}_date{d}')} AS {x}_date{d}" for d in _dates for x in INDEXES]
    cols += [f"{r(f'{x}_date{d + 1} - {x}_date{d}')} AS {x}_diff_{d}_{d + 1}" for d in range(1, 5) for x in INDEXES]
    out["bands_indices"] = with_(PARCELS, INDEXED) + " SELECT fid, " + ", ".join(cols) + " FROM indexed"
    long = " UNION ALL ".join(
        f"SELECT fid, '{x}' AS ix, {x}_date{d} AS v FROM indexed" for x in INDEXES for d in _dates
    )
    cols = []
    for x in INDEXES:
        cv = f"(max(s) FILTER (ix = '{x}') / (max(m) FILTER (ix = '{x}') + 1e-9))"
        cols += [f"{r(f'''max(m) FILTER (ix = '{x}')''', 5)} AS {x}_mean", f"{r(f'''max(s) FILTER (ix = '{x}')''', 5)} AS {x}_std",
                 f"{r(f'sign({cv}) * ln(1 + abs({cv}))', 5)} AS {x}_cv_log"]
    out["bands_stats"] = with_(PARCELS, INDEXED) + f""",
      stat AS (SELECT fid, ix, avg(v) AS m, stddev_samp(v) AS s FROM ({long}) GROUP BY 1, 2)
      SELECT fid, {', '.join(cols)} FROM stat GROUP BY fid"""
    return out


SQL = _sql()
