"""SQL counterparts of the queries over fitted and aggregating operators."""

from __future__ import annotations

from plotshift.plans.features_sql import HULL, PI4, q
from plotshift.plans.sql_base import DATED, PARCELS, PROBABILITIES, VERTICES, inverse_normal, lit, r, with_
from plotshift.plans.tables import BLEND_WEIGHTS, MEASURES, NUMBERS
from plotshift.sources.parcels import GEOGRAPHY, STATUSES, URBAN
from plotshift.vocabulary import BANDS, CHANGE_TYPES, STATUS_COLUMNS

TEXT_COLUMNS = ["change_type", "geometry_type", "urban_type", "geography_type", *[f"date{i}" for i in range(5)], *STATUS_COLUMNS]
BAND_COLUMNS = [f"img_{b}_{s}_date{d}" for b in BANDS for d in range(1, 6) for s in ("mean", "std")]

MEASURED = """
measured AS (SELECT g.fid, g.split, g.lab, g.change_type, area, perimeter, w AS bounding_width, h AS bounding_height,
  g0::DOUBLE AS days_between_0_1, g1::DOUBLE AS days_between_1_2, g2::DOUBLE AS days_between_2_3, g3::DOUBLE AS days_between_3_4,
  g.img_red_mean_date1, g.img_green_std_date2 FROM geo g JOIN gaps ON g.fid = gaps.fid)"""


def rows(sources: dict[str, str], table: str) -> str:
    """One aggregate row per column: ``sources[column] = "expr AS name, ..."``."""
    return " UNION ALL ".join(f'SELECT {lit(c)} AS "column", {e} FROM {table}' for c, e in sources.items())


def hot(column: str, levels: list, prefix: str, table: str, missing: bool = False) -> str:
    cols = [f'CAST(coalesce({column} = {lit(v)}, FALSE) AS INT) AS "{prefix}_{v}"' for v in levels]
    if missing:
        cols.append(f'CAST({column} IS NULL AS INT) AS "{prefix}_None"')
    return f"SELECT fid, {', '.join(cols)} FROM {table}"


def has(column: str, members: list[str], names: list[str]) -> str:
    test = " OR ".join(f"list_contains({column}, {lit(m)})" for m in members)
    return f'CAST(coalesce({test}, FALSE) AS INT) AS "{names[0]}"'


def _sql() -> dict[str, str]:
    out = {}
    base, measured = with_(PARCELS), with_(PARCELS, VERTICES, DATED, MEASURED)
    every = TEXT_COLUMNS + BAND_COLUMNS
    nulls = {c: f"count(*) FILTER ({c} IS NULL) AS missing" for c in every}
    nulls |= {"rings": "count(*) FILTER (kind = 'null') AS missing", "fid": "CAST(0 AS BIGINT) AS missing"}
    # An aggregate without GROUP BY gives the single row, also for the constant.
    nulls["fid"] = "count(*) FILTER (fid IS NULL) AS missing"
    out["profile_null_counts"] = base + " " + rows(nulls, "parcels")
    out["profile_nulls"] = base + f""", report AS ({rows(nulls, 'parcels')}), total AS (SELECT count(*) AS n FROM parcels)
      SELECT "column", missing, {r('100 * missing::DOUBLE / n')} AS percentage FROM report, total WHERE missing > 0"""
    out["profile_numbers"] = measured + " " + rows(
        {
            c: f"count(*) FILTER ({c} IS NULL) AS nan, CAST(0 AS BIGINT) * count(*) AS inf, "
            + (f"(count(*) FILTER ({c} <= 0))::DOUBLE AS nonpositive" if c in MEASURES else "CASE WHEN count(*) < 0 THEN 0.0::DOUBLE END AS nonpositive")
            for c in NUMBERS
        },
        "measured",
    )

    def describe(c: str, digits: int) -> str:
        e = {"mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})"}
        e |= {f"q{p}": f"quantile_cont({c}, {p / 100})" for p in (25, 50, 75)}
        return f"count({c}) AS count, " + ", ".join(f"{r(v, digits)} AS {k}" for k, v in e.items())

    out["profile_describe"] = measured + " " + rows({c: describe(c, 6) for c in NUMBERS}, "measured")
    out["describe_lineitem"] = rows({c: describe(c, 4) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}, "lineitem")
    types = {"fid": "bigint", "change_type": "string", "urban_type": "string", "date0": "string", "img_red_mean_date1": "double"}
    out["profile_types"] = base + " " + rows(
        {c: f'{lit(t)} AS "type", count({c}) AS present, count(*) AS "rows"' for c, t in types.items()}, "parcels"
    )
    out["profile_distinct"] = base + " " + " UNION ALL ".join(
        f'SELECT DISTINCT {lit(c)} AS "column", {c} AS value FROM parcels WHERE {c} IS NOT NULL'
        for c in ("change_type", "urban_type", "geography_type", *STATUS_COLUMNS)
    )
    out["value_shares"] = base + f""" SELECT change_type, count(*) AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share
      FROM parcels WHERE change_type IS NOT NULL GROUP BY 1"""
    out["min_max_columns"] = measured + " " + rows({c: f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max" for c in NUMBERS}, "measured")
    weights = """, weights AS (SELECT change_type, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight
      FROM parcels WHERE split = 'train' GROUP BY 1)"""
    out["class_weights"] = base + weights + f" SELECT change_type, n, {r('weight')} AS weight FROM weights"
    out["sample_weights"] = base + weights + f" SELECT fid, {r('weight')} AS weight FROM parcels JOIN weights USING (change_type) WHERE split = 'train'"
    sol, conv = q("area", "hull_area"), q("perimeter", "hull_perimeter")
    shaped = with_(PARCELS, VERTICES, HULL) + f""", shaped AS (SELECT lab, ln(1 + area) AS log_area, ln(1 + perimeter) AS log_perimeter,
      {sol} AS solidity, {conv} AS convexity, {q('perimeter', 'sqrt(area)')} AS elongation,
      {q(f'{PI4} * area', 'perimeter * perimeter')} AS compactness FROM hulled)"""
    box_long = " UNION ALL ".join(
        f'SELECT lab, {lit(c)} AS "column", {c} AS v FROM shaped WHERE {c} IS NOT NULL'
        for c in ("log_area", "log_perimeter", "convexity", "solidity")
    )
    out["box_stats"] = shaped + f""", l AS ({box_long}), qs AS (SELECT lab, "column", quantile_cont(v, 0.25) AS a,
      quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM l GROUP BY 1, 2)
      SELECT lab, "column", {r('min(a)')} AS q25, {r('min(b)')} AS q50, {r('min(c)')} AS q75, count(*) AS n, {r('min(v)')} AS min,
        {r('max(v)')} AS max, {r('min(v) FILTER (v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a))')} AS whisker_low,
        {r('max(v) FILTER (v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a))')} AS whisker_high,
        count(*) FILTER (NOT v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)) AS outliers
      FROM l JOIN qs USING (lab, "column") GROUP BY 1, 2"""
    out["hist_hull_ratio"] = shaped + """, v AS (SELECT round(solidity, 9) AS v FROM shaped WHERE solidity IS NOT NULL),
      lim AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
      SELECT CAST(least(floor((v - lo) * 50 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n FROM v, lim GROUP BY 1"""
    out["hist2d_shape"] = shaped + """, v AS (SELECT lab, round(elongation, 9) AS x, round(compactness, 9) AS y FROM shaped
      WHERE elongation IS NOT NULL AND compactness IS NOT NULL),
      lim AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
      SELECT lab, CAST(least(floor((x - x0) * 20 / (x1 - x0)), 19) AS INT) AS x_bin,
        CAST(least(floor((y - y0) * 20 / (y1 - y0)), 19) AS INT) AS y_bin, count(*) AS n FROM v, lim GROUP BY 1, 2, 3"""
    out["preview_sample"] = base + """ (SELECT fid, urban_type, date0, 'sample' AS part FROM parcels
      ORDER BY md5(fid::VARCHAR || '-42'), fid LIMIT 3) UNION ALL SELECT fid, urban_type, date0, 'head' FROM parcels WHERE fid < 100"""
    inter = base + ", inter AS (SELECT *, urban_type || '_' || geography_type AS x FROM parcels)"
    out["cat_interaction"] = inter + " SELECT fid, x AS urban_geo_interaction FROM inter"
    pairs = [f"{u}_{g}" for u in URBAN if u for g in GEOGRAPHY if g]
    out["cat_onehot_union"] = inter + " " + hot("x", pairs, "urban_geo_interaction", "inter", missing=True)
    out["cat_onehot_train"] = base + " " + hot("geography_type", [g for g in GEOGRAPHY if g], "geography_type", "parcels", missing=True)
    out["cat_dummies_aligned"] = base + " " + hot("urban_type", [u for u in URBAN if u], "urban_type", "parcels")
    # k % 8 reaches every status on date 0.
    out["cat_dummies_filled"] = base + " " + hot("change_status_date0", list(STATUSES), "change_status_date0", "parcels")
    lists = base + """, lists AS (SELECT fid, string_split(coalesce(urban_type, 'Unknown'), ',') AS u,
      string_split(coalesce(geography_type, 'Unknown'), ',') AS g, string_split(geography_type, ',') AS gn, [urban_type] AS uw FROM parcels)"""

    def members(values, split=True):
        found: dict[str, list[str]] = {}
        for v in values:
            for m in (v or "Unknown").split(",") if split else [v] * (v is not None):
                if m not in found.setdefault(m.strip(), []):
                    found[m.strip()].append(m)
        return found

    cols = [has("u", ms, [f"urban_{n}"]) for n, ms in members(URBAN).items()]
    cols += [has("g", ms, [f"geo_{n}"]) for n, ms in members(GEOGRAPHY).items()]
    out["cat_multilabel"] = lists + f" SELECT fid, {', '.join(cols)} FROM lists"
    cols = [has("uw", ms, [f"urban_{n}"]) for n, ms in members(URBAN, split=False).items()]
    cols += [has("gn", ms, [f"geo_{n}"]) for n, ms in members([g for g in GEOGRAPHY if g]).items()]
    out["cat_multilabel_whole"] = lists + f" SELECT fid, {', '.join(cols)} FROM lists"
    freq = lambda c: f"""(SELECT {c}, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM parcels
      WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1)"""
    out["cat_frequency"] = base + f""" SELECT fid, {r('a.share')} AS urban_type_freq, {r('b.share')} AS geography_type_freq
      FROM parcels p LEFT JOIN {freq('urban_type')} a USING (urban_type) LEFT JOIN {freq('geography_type')} b USING (geography_type)"""
    target = lambda src, key, y, digits: f"""
      prior AS (SELECT avg({y}) AS prior FROM {src}),
      cats AS (SELECT {key} AS key, count(*) AS n, avg({y}) AS m FROM {src} GROUP BY 1),
      enc AS (SELECT key, m, prior, 1 / (1 + exp(-(n - 20) / 10.0::DOUBLE)) AS w, n / (n + 10.0::DOUBLE) AS w2 FROM cats, prior)"""
    out["cat_target"] = inter + ", trained AS (SELECT * FROM inter WHERE split = 'train')," + target("trained", "coalesce(x, 'None')", "lab", 6) + f"""
      SELECT fid, {r('coalesce(w * m + (1 - w) * e.prior, p.prior)')} AS te, {r('coalesce(w2 * m + (1 - w2) * e.prior, p.prior)')} AS te_additive
      FROM inter CROSS JOIN prior p LEFT JOIN enc e ON coalesce(x, 'None') = key"""
    out["cat_target_customer"] = "WITH" + target("orders", "o_custkey", "o_totalprice", 2) + f"""
      SELECT o_orderkey AS fid, {r('w * m + (1 - w) * prior', 2)} AS te FROM orders JOIN enc ON o_custkey = key"""
    codes = {s: i for i, s in enumerate(sorted(STATUSES))}
    code = lambda c: "CAST(CASE " + c + " " + " ".join(f"WHEN {lit(s)} THEN {i}" for s, i in codes.items()) + f" END AS DOUBLE) AS {c}"
    out["cat_status_codes"] = base + f" SELECT fid, {', '.join(code(c) for c in STATUS_COLUMNS)} FROM parcels"
    out["label_map"] = base + " SELECT fid, lab AS code FROM parcels WHERE split = 'train'"
    alpha = " ".join(f"WHEN {lit(n)} THEN {i}" for i, n in enumerate(sorted(CHANGE_TYPES)))
    out["label_alpha"] = base + f" SELECT fid, CAST(CASE change_type {alpha} END AS INT) AS label, change_type AS label_name FROM parcels WHERE split = 'train'"
    out["label_onehot"] = base + " SELECT fid, " + ", ".join(f"CAST(lab = {c} AS INT) AS class_{c}" for c in range(6)) + ", lab AS label FROM parcels"
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUMBERS)
    out["fill_median"] = measured + f""", m AS (SELECT {med} FROM measured),
      t AS (SELECT quantile_cont(area, 0.5) AS ta, quantile_cont(days_between_0_1, 0.5) AS tg FROM measured WHERE split = 'train')
      SELECT fid, {', '.join(f"{r(f'coalesce({c}, m_{c})')} AS {c}" for c in NUMBERS)},
      {r('coalesce(area, ta)')} AS area_train, {r('coalesce(days_between_0_1, tg)')} AS gap_train FROM measured, m, t"""
    out["fill_const_inf"] = with_(PARCELS, VERTICES) + f""", v AS (SELECT fid, w, h, CASE WHEN w % 7 = 0 THEN NULL ELSE w END AS a,
      CASE WHEN h % 5 = 0 THEN NULL ELSE h END AS b FROM geo),
      m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM v)
      SELECT fid, {r('coalesce(a, 0)')} AS a, {r('coalesce(b, 0)')} AS b, {r('coalesce(a, ma)')} AS a_median, {r('coalesce(b, mb)')} AS b_median,
      CASE WHEN w % 7 = 0 THEN 1e10 ELSE coalesce(w, 0) END AS a_clamped, CASE WHEN h % 5 = 0 THEN -1e10 ELSE coalesce(h, 0) END AS b_clamped FROM v, m"""
    std = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in NUMBERS)
    out["scale_std"] = measured + f""", m AS (SELECT {std} FROM measured WHERE split = 'train')
      SELECT fid, {', '.join(f"{r(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in NUMBERS)} FROM measured, m"""
    place = lambda c: f"""CASE WHEN {c} IS NULL THEN NULL WHEN {c} <= k_{c}[1] THEN 0.0 WHEN {c} >= k_{c}[1000] THEN 1.0
      WHEN u_{c} > l_{c} THEN (l_{c} + u_{c} - 1) / 1998.0
      ELSE (l_{c} - 1 + ({c} - k_{c}[l_{c}]) / (k_{c}[l_{c} + 1] - k_{c}[l_{c}])) / 999.0 END"""
    pair = ("area", "days_between_0_1")
    knots = ", ".join(f"quantile_cont({c}, [i / 999.0 FOR i IN range(1000)]) AS k_{c}" for c in pair)
    under = ", ".join(f"len(list_filter(k_{c}, lambda k: k < {c})) AS l_{c}, len(list_filter(k_{c}, lambda k: k <= {c})) AS u_{c}" for c in pair)
    out["scale_quantile"] = measured + f""", m AS (SELECT {knots} FROM measured),
      n AS (SELECT fid, {', '.join(pair)}, {', '.join(f'k_{c}' for c in pair)}, {under} FROM measured, m),
      p AS (SELECT fid, {', '.join(f'least(greatest({place(c)}, 1e-7), 1 - 1e-7) AS p_{c}, {c} IS NULL AS z_{c}' for c in pair)} FROM n)
      SELECT fid, {', '.join(f"CASE WHEN NOT z_{c} THEN {r(inverse_normal(f'p_{c}'))} END AS {c}" for c in pair)} FROM p"""
    out["scale_minmax"] = measured + ", m AS (SELECT min(area) a0, max(area) a1, min(perimeter) p0, max(perimeter) p1 FROM measured)" + f"""
      SELECT fid, {r('(area - a0) / (a1 - a0)')} AS norm_area, {r('(perimeter - p0) / (p1 - p0)')} AS norm_perimeter FROM measured, m"""
    out["log_features"] = measured + " SELECT fid, " + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {r(f'ln(1 + greatest({c}, 1e-9))')} END AS {c}" for c in MEASURES
    ) + " FROM measured"

    def anova(columns, table, label):
        long = " UNION ALL ".join(f'SELECT {lit(c)} AS "column", {label} AS y, {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL' for c in columns)
        return f"""l AS ({long}), c AS (SELECT "column", y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY 1, 2),
          g AS (SELECT "column", avg(v) AS gm FROM l GROUP BY 1),
          f AS (SELECT "column", (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f
            FROM c JOIN g USING ("column") GROUP BY 1)"""

    out["select_anova"] = measured + ", trained AS (SELECT * FROM measured WHERE split = 'train'), " + anova(NUMBERS, "trained", "lab") + f"""
      SELECT "column", {r('f', 4)} AS f, CAST(row_number() OVER (ORDER BY f DESC, "column") <= 5 AS INT) AS selected FROM f"""
    out["anova_lineitem"] = "WITH " + anova(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "lineitem", "l_returnflag") + f"""
      SELECT "column", {r('f', 4)} AS f FROM f"""
    train = base + ", trained AS (SELECT * FROM parcels WHERE split = 'train')"
    shuffled = "row_number() OVER (PARTITION BY lab ORDER BY md5(fid::VARCHAR || '-42'), fid)"
    out["folds_stratified"] = train + f" SELECT fid, CAST(({shuffled} - 1) % 5 AS INT) AS fold FROM trained"
    out["folds_in_order"] = train + " SELECT fid, CAST((row_number() OVER (PARTITION BY lab ORDER BY fid) - 1) % 5 AS INT) AS fold FROM trained"
    out["folds_sparse_ids"] = """WITH ids AS (
      SELECT ((l_orderkey * 8 + l_linenumber) * 1000003 % 4294967291 - 2147483645) * 4294967296 AS id, l_returnflag FROM lineitem)
      SELECT id, CAST((row_number() OVER (PARTITION BY l_returnflag ORDER BY id) - 1) % 5 AS INT) AS fold FROM ids"""
    out["folds_lineitem"] = """WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT l_returnflag, CAST(f AS INT) AS fold, CAST(n // 5 + CAST(f < n % 5 AS INT) AS BIGINT) AS n FROM n, (VALUES (0), (1), (2), (3), (4)) t(f)"""
    out["split_stratified"] = train + f""" SELECT fid, {shuffled} <= ceil(count(*) OVER (PARTITION BY lab) * 0.8) AS is_train,
      row_number() OVER (ORDER BY fid) <= ceil(count(*) OVER () * 0.8) AS is_train_tail FROM trained"""
    probs = with_(PROBABILITIES)
    out["fold_average"] = probs + f" SELECT fid, model, class, {r('sum(p) / 5')} AS p FROM probs GROUP BY 1, 2, 3"
    w = " ".join(f"WHEN {m} THEN {v}::DOUBLE" for m, v in enumerate(BLEND_WEIGHTS))
    out["blend_argmax"] = probs + f""", b AS (SELECT fid, class, round(sum(CASE model {w} END * p / 5), 9) AS p FROM probs GROUP BY 1, 2)
      SELECT fid, class AS pred FROM b QUALIFY row_number() OVER (PARTITION BY fid ORDER BY p DESC, class) = 1"""
    best = """, best AS (SELECT fid, lab, model, fold, class AS pred FROM probs
      QUALIFY row_number() OVER (PARTITION BY fid, model, fold ORDER BY round(p, 9) DESC, class) = 1)"""
    out["fold_argmax"] = probs + best + " SELECT fid, model, fold, pred FROM best"
    out["majority_vote"] = probs + best + """, v AS (SELECT fid, pred, count(*) AS n FROM best GROUP BY 1, 2)
      SELECT fid, pred FROM v QUALIFY row_number() OVER (PARTITION BY fid ORDER BY n DESC, pred) = 1"""
    report = best + """, cls AS (
      SELECT {k}, c AS class, count(*) FILTER (lab = c AND pred = c) AS tp, count(*) FILTER (pred = c) AS predicted,
        count(*) FILTER (lab = c) AS support FROM best, (VALUES (0), (1), (2), (3), (4), (5)) t(c) GROUP BY ALL HAVING predicted + support > 0),
      rep AS (SELECT {k}, class, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
        coalesce(2 * tp::DOUBLE / nullif(predicted + support, 0), 0) AS f1, support, tp FROM cls)"""
    out["metrics_report"] = probs + report.format(k="model") + f"""
      SELECT model, class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, support, tp FROM rep"""
    score = """, sc AS (SELECT model, fold, sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1) AS macro_f1,
      sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM rep GROUP BY 1, 2)"""
    out["metrics_scores"] = probs + report.format(k="model, fold") + score + f"""
      SELECT model, fold, {r('accuracy')} AS accuracy, {r('macro_f1')} AS macro_f1, {r('weighted_f1')} AS weighted_f1, n FROM sc"""
    out["cv_summary"] = probs + report.format(k="model, fold") + score + f""", s AS (SELECT model, avg(macro_f1) AS f,
      stddev_pop(macro_f1) AS sd, avg(accuracy) AS a, count(*) AS folds FROM sc GROUP BY 1)
      SELECT model, {r('f')} AS mean_f1, {r('sd')} AS std_f1, {r('a')} AS mean_accuracy, folds,
      CAST(row_number() OVER (ORDER BY round(f, 9) DESC, model) = 1 AS INT) AS best FROM s"""
    return out


SQL = _sql()
