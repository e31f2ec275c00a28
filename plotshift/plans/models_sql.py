"""SQL counterparts of the file-format queries; trained models have none."""

from __future__ import annotations

from plotshift.plans.sql_base import DATED, PARCELS, VERTICES, lit, r, with_
from plotshift.plans.tables_sql import SQL as BLEND
from plotshift.vocabulary import CHANGE_TYPES

_names = " ".join(f"WHEN {c} THEN {lit(n)}" for n, c in CHANGE_TYPES.items())

_binned = " UNION ALL ".join(
    f"SELECT lab, '{name}' AS col, CASE WHEN {c} IS NULL THEN 16 ELSE least(16, greatest(0, ceil({c} / 20.0)::INT - 1)) END AS bin FROM gaps WHERE split = 'train'"
    for name, c in [*((f"days_between_{i}_{i + 1}", f"g{i}") for i in range(4)), *((c, c) for c in ("img_red_mean_date1", "img_blue_std_date5"))]
)

SQL = {
    "boost_histograms": with_(PARCELS, DATED, f"""
      b AS ({_binned}),
      n AS (SELECT col, bin, lab, count(*) AS n FROM b GROUP BY ALL),
      p AS (SELECT lab AS class, count(*) / (SELECT count(*) FROM parcels WHERE split = 'train') AS p FROM parcels WHERE split = 'train' GROUP BY lab),
      cells AS (SELECT p.class, p.p, c.col, b.bin FROM p, (SELECT DISTINCT col FROM b) c, (SELECT unnest(range(17)) AS bin) b)""")
    + f""" SELECT c.class, c.col AS "column", c.bin::INT AS bin,
      {r("coalesce(sum(n.n), 0) * any_value(c.p) - coalesce(sum(n.n) FILTER (WHERE n.lab = c.class), 0)", 3)} AS gradient,
      {r("coalesce(sum(n.n), 0) * 2 * any_value(c.p) * (1 - any_value(c.p))", 3)} AS curvature, coalesce(sum(n.n), 0)::BIGINT AS rows
      FROM cells c LEFT JOIN n ON n.col = c.col AND n.bin = c.bin GROUP BY c.class, c.col, c.bin""",
    "submission_csv": "SELECT fid AS Id, pred AS change_type FROM (" + BLEND["blend_argmax"] + ")",
    "submission_names": with_(PARCELS) + f" SELECT fid AS Id, CASE lab {_names} END AS change_type FROM parcels WHERE split = 'test'",
    "geojson_scan": with_(PARCELS, VERTICES)
    + f" SELECT fid, geometry_type, change_type, urban_type, date0, {r('area')} AS area, {r('perimeter')} AS perimeter FROM geo",
    "geojson_collection": with_(PARCELS, VERTICES)
    + r""" SELECT fid AS parcel, CASE WHEN fid % 5 = 0 AND kind IN ('star', 'bow') THEN 'MultiPolygon' ELSE geometry_type END AS geometry_type,
    '}{"[\' || fid || chr(10) || ']' AS note, change_type, date0,
    CASE kind WHEN 'null' THEN NULL WHEN 'empty' THEN 0.0 ELSE CASE WHEN fid % 5 = 0 THEN 2.0 ELSE 1.0 END END AS outlines, """
    + r("CASE WHEN fid % 5 = 0 THEN 2 ELSE 1 END * area") + " AS area FROM geo",
}
