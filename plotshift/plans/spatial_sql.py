"""SQL counterparts of the neighbour and density queries: brute force over the whole tables."""

from __future__ import annotations

from plotshift.plans.spatial import IMPUTED, SCALED
from plotshift.plans.sql_base import DATED, PARCELS, VERTICES, r, with_
from plotshift.plans.tables_sql import MEASURED


def _sql() -> dict[str, str]:
    out = {}
    cent = with_(PARCELS, VERTICES) + ", pts AS (SELECT fid, split, lab, centroid_x AS x, centroid_y AS y FROM geo WHERE centroid_x IS NOT NULL)"
    best = lambda side: f"""SELECT a.fid AS id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 5) AS d
      FROM pts a JOIN pts b ON b.split = 'train' AND a.split = '{side}' GROUP BY a.fid"""
    for name, side, first in (("nn_self", "train", 2), ("nn_cross", "test", 1)):
        out[name] = cent + f""", near AS ({best(side)})
          SELECT id, {r(f'd[{first}]')} AS nearest_neighbor_dist, {r('list_sum(d) / 5')} AS avg_distance_to_neighbors FROM near"""
    kde = lambda g: f"""
      st AS (SELECT {g} AS g, count(*) AS n, covar_samp(x, x) AS cxx, covar_samp(x, y) AS cxy, covar_samp(y, y) AS cyy FROM pts GROUP BY 1),
      inv AS (SELECT g, n, pow(n, -1.0 / 3) AS h2, cxx * cyy - cxy * cxy AS det, cxx, cxy, cyy FROM st)
      SELECT a.fid AS id, round(ln(sum(exp(-(cyy * (a.x - b.x) * (a.x - b.x) - 2 * cxy * (a.x - b.x) * (a.y - b.y)
        + cxx * (a.y - b.y) * (a.y - b.y)) / (2 * det * h2))) / (min(n) * 2 * pi() * min(h2) * sqrt(min(det)))), 5) AS log_density
      FROM pts a JOIN pts b ON {'a.lab = b.lab' if g != '1' else 'TRUE'} JOIN inv ON {'inv.g = a.lab' if g != '1' else 'TRUE'}
      GROUP BY 1"""
    out["kde_centroid"] = cent + "," + kde("1")
    out["kde_by_class"] = cent + "," + kde("lab")
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in SCALED)
    std = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
    scaled = with_(PARCELS, VERTICES, DATED, MEASURED) + f""",
      med AS (SELECT {med} FROM measured WHERE split = 'train'),
      filled AS (SELECT fid, split, lab, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in SCALED)} FROM measured, med),
      fit AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)} FROM measured m WHERE split = 'train'),
      scaled AS (SELECT fid, split, lab, {', '.join(f'round(({c} - m_{c}) / s_{c}, 9) AS {c}' for c in SCALED)} FROM filled, fit)"""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in SCALED)
    pairs = f"pairs AS (SELECT a.fid AS id, b.fid AS other, b.lab, sqrt({d2}) AS d FROM scaled a JOIN scaled b ON a.split = 'test' AND b.split = 'train')"
    votes = ", ".join(f"round(CASE WHEN z > 0 THEN z{c} / z WHEN w > 0 THEN w{c} / w ELSE CAST(fb = {c} AS DOUBLE) END, 6) AS p{c}" for c in range(6))
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN d > 1e-12 THEN 1 / d END) FILTER (lab = {c}), 0) AS w{c}, (count(*) FILTER (lab = {c} AND d <= 1e-12))::DOUBLE AS z{c}"
        for c in range(6)
    )
    total = "coalesce(sum(CASE WHEN d > 1e-12 THEN 1 / d END), 0) AS w, (count(*) FILTER (d <= 1e-12))::DOUBLE AS z"
    fallback = "fb AS (SELECT lab AS fb FROM parcels WHERE split = 'train' GROUP BY lab ORDER BY count(*) DESC, lab LIMIT 1)"
    out["radius_vote"] = scaled + f""", {pairs.replace("b.split = 'train'", f"b.split = 'train' AND {d2} <= 1")}, {fallback},
      v AS (SELECT id, {total}, {sums} FROM pairs GROUP BY 1)
      SELECT s.fid AS id, {votes.replace('CASE WHEN z > 0', 'CASE WHEN coalesce(z, 0) > 0').replace('WHEN w > 0', 'WHEN coalesce(w, 0) > 0')}
      FROM scaled s CROSS JOIN fb LEFT JOIN v ON s.fid = v.id WHERE s.split = 'test'"""
    top = lambda k: f"top AS (SELECT id, unnest(arg_min(struct_pack(lab := lab, d := d), struct_pack(d := d, other := other), {k}), recursive := true) FROM pairs GROUP BY id)"
    out["knn_distance"] = scaled + f""", {pairs}, {top(5)}, v AS (SELECT id, {total}, {sums} FROM top GROUP BY 1)
      SELECT id, {votes.replace('fb', '0')} FROM v"""
    area = with_(PARCELS, VERTICES) + f""", g AS (SELECT fid, split, lab, coalesce(area, 0) AS area FROM geo),
      pairs AS (SELECT a.fid AS id, b.fid AS other, b.lab, abs(a.area - b.area) AS d FROM g a JOIN g b ON a.split = 'test' AND b.split = 'train'), {top(3)}"""
    out["knn_area"] = area + " SELECT id, " + ", ".join(
        f"round((count(*) FILTER (lab = {c}))::DOUBLE / 3, 6) AS p{c}" for c in range(6)
    ) + " FROM top GROUP BY id"
    out["knn_embeddings"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
      t AS (SELECT a.vec_id AS id, min(list_distance(a.x, b.x), 5) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1)
      SELECT id, round(d[1], 5) AS nearest, round(list_sum(d) / 5, 5) AS mean_distance, CAST(len(d) AS BIGINT) AS n FROM t"""
    present = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INT)" for c in IMPUTED)
    gap2 = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in IMPUTED)
    ctes, joins, cols = [], [], []
    for i, c in enumerate(IMPUTED):
        ctes.append(f"""p{i} AS (SELECT a.fid AS id, b.fid AS other, b.{c} AS v, ({gap2}) / ({present}) AS d FROM sc a JOIN sc b
          ON a.{c} IS NULL AND b.split = 'train' AND b.{c} IS NOT NULL AND ({present}) > 0),
          f{i} AS (SELECT id, list_avg(arg_min(v, struct_pack(d := d, other := other), 5)) AS v FROM p{i} GROUP BY 1),
          a{i} AS (SELECT avg({c}) AS v FROM sc WHERE split = 'train')""")
        joins.append(f"LEFT JOIN f{i} ON s.fid = f{i}.id CROSS JOIN a{i}")
        cols.append(f"{r(f'coalesce(s.{c}, f{i}.v, a{i}.v)', 5)} AS {c}")
    out["fill_knn"] = with_(PARCELS, VERTICES, DATED, MEASURED) + f""",
      fit AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in IMPUTED)} FROM measured WHERE split = 'train'),
      sc AS (SELECT fid, split, {', '.join(f'round(({c} - m_{c}) / s_{c}, 9) AS {c}' for c in IMPUTED)} FROM measured, fit),
      {', '.join(ctes)} SELECT s.fid, {', '.join(cols)} FROM sc s {' '.join(joins)}"""
    return out


SQL = _sql()
