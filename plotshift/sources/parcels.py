"""Parcel table derived from ``orders``: one polygon, five dated statuses, fifteen band statistics pairs per order.

Every rule is integer arithmetic on the order key, so any engine rebuilds the same rows. The key is reduced before
it is squared, which keeps the products inside a BIGINT for keys of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotshift.vocabulary import BANDS, CHANGE_TYPES, GEOMETRY_TYPE

# Fixed values of the fixture.
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
BOW_TIE = ((0, 0), (10, 10), (10, 0), (0, 10))
URBAN = ("Dense Urban", "Sparse Urban,Industrial", "Urban Slum, Industrial", "Rural", None)
GEOGRAPHY = ("Dense Forest,Grass Land", "River", "Desert", "Hills,River", "Coastal", "Farms", None)
STATUSES = (
    "Greenland",
    "Land Cleared",
    "Excavation",
    "Construction Started",
    "Construction Midway",
    "Construction Done",
    "Operational",
    "Prior Construction",
)
#: Orders of one task of the parcel table, and of one part of the long table of probabilities, where each has up to 18
#: groups of some hundred bytes.
ORDERS_AT_ONCE = 1 << 16
BAND_OFFSETS = {"red": 0, "green": 40, "blue": 80}


LABEL = "CAST(CASE WHEN u < 3 THEN 5 WHEN u < 8 THEN 4 WHEN u < 15 THEN 1 WHEN u < 25 THEN 0 WHEN u < 55 THEN 3 ELSE 2 END AS INT)"


def _pick(values: tuple, index: str) -> str:
    items = ", ".join("CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in values)
    return f"get(array({items}), CAST({index} AS INT))"


def _ring(points: list[tuple[str, str]]) -> str:
    closed = points + points[:1]
    pts = ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in closed)
    return f"array(named_struct('hole', false, 'pts', array({pts})))"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores, with at most ``ORDERS_AT_ONCE`` rows to a task.

    Splits of a scan are no measure: all rows of a row group go to one of them, and each row grows to a polygon.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ORDERS_AT_ONCE))
    return df.repartition(parts, key)


def parcels(spark: SparkSession, sf_dir: str, split: str | None = None, geometry: bool = True) -> DataFrame:
    """The parcel view over ``{sf_dir}/orders.parquet``; ``split`` keeps only ``train`` or ``test`` rows.

    ``geometry=False`` leaves out ``rings`` for queries that need none.
    """
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderkey")
    if split is not None:
        orders = orders.where("o_orderkey % 11 IN (3, 8)" if split == "test" else "o_orderkey % 11 NOT IN (3, 8)")
    base = orders.selectExpr(
        "o_orderkey AS fid",
        "if(o_orderkey % 11 IN (3, 8), 'test', 'train') AS split",
        "to_date(o_orderdate) AS day",
        "(o_orderkey * 7919 + 17) % 100 AS u",
        "o_orderkey % 100003 AS kx",
        "o_orderkey % 100019 AS ky",
    ).selectExpr(
        "fid",
        "split",
        "day",
        f"{LABEL} AS lab",
        "(kx * kx * 37 + kx * 11) % 100003 AS cx",
        "(ky * ky * 53 + ky * 7919) % 100019 AS cy",
    )

    star = []
    for i, (dx, dy) in enumerate(DIRECTIONS):
        r = f"(lab + 1) * (10 + (fid * {2 * i + 3} + {13 * i}) % 97)"
        star.append((f"cx + {r} * {dx}", f"cy + {r} * {dy}"))
    bow = [(f"cx + {dx}", f"cy + {dy}") for dx, dy in BOW_TIE]
    rings = (
        f"CASE WHEN fid % 97 = 0 THEN CAST(NULL AS {GEOMETRY_TYPE}) WHEN fid % 101 = 0 THEN CAST(array() AS {GEOMETRY_TYPE}) "
        f"WHEN fid % 103 = 0 THEN {_ring(bow)} ELSE {_ring(star)} END"
    )

    columns = {
        "change_type": f"if(split = 'train', {_pick(tuple(CHANGE_TYPES), 'lab')}, NULL)",
        "geometry_type": "if(fid % 97 <> 0, 'Polygon', NULL)",
        "urban_type": _pick(URBAN, "(fid % 13) % 5"),
        "geography_type": _pick(GEOGRAPHY, "(fid % 37) % 7"),
    }
    day = "day"
    for i in range(5):
        if i:
            day = f"date_add({day}, CAST(30 + (fid * {2 * i + 1}) % 300 AS INT))"
        columns[f"date{i}"] = (
            f"CASE WHEN (fid + {i}) % 53 = 0 THEN NULL WHEN (fid + {i}) % 211 = 0 THEN '31-13-2015' "
            f"ELSE date_format({day}, 'dd-MM-yyyy') END"
        )
        columns[f"change_status_date{i}"] = f"if((fid + {i}) % 61 <> 0, {_pick(STATUSES, f'(fid * {i + 1} + {i}) % 8')}, NULL)"
    for band in BANDS:
        off = BAND_OFFSETS[band]
        for d in range(1, 6):
            mean, std = f"50 + (fid * {d + 2} + {off}) % 150", f"1 + (fid + {5 * d + off}) % 40"
            columns[f"img_{band}_mean_date{d}"] = f"if(fid % 59 <> 0, CAST({mean} AS DOUBLE), NULL)"
            columns[f"img_{band}_std_date{d}"] = f"if(fid % 59 <> 0, CAST({std} AS DOUBLE), NULL)"
    # The polygon leaves a generator, as it would leave a scan: later predicates refer to it instead of repeating its rule.
    polygon = [f"explode(array({rings})) AS rings"] if geometry else []
    return base.selectExpr("fid", "split", "lab", *[f"{e} AS {c}" for c, e in columns.items()], *polygon)


def model_probabilities(spark: SparkSession, sf_dir: str, models: int = 3, folds: int = 5) -> DataFrame:
    """Deterministic long table ``(fid, lab, model, fold, class, p)`` for the ensemble operators, one row per order and slot.

    The orders are dealt by id before they grow to a row per slot and class, in parts of ``ORDERS_AT_ONCE``, so groups of an id find their
    rows in place and fit a task's memory.
    """
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fid"))
    parts = max(spark.sparkContext.defaultParallelism, -(-base.count() // ORDERS_AT_ONCE))
    base = base.repartition(parts, "fid")
    base = base.selectExpr("fid", "(fid * 7919 + 17) % 100 AS u").selectExpr("fid", f"{LABEL} AS lab")
    slots = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(f).alias("fold")) for m in range(models) for f in range(folds)]
    )
    df = base.select("fid", "lab", F.inline(slots))
    raw = [1 + (F.col("fid") * (c + 2) + 7 * F.col("model") + 3 * F.col("fold")) % 13 for c in range(6)]
    df = df.withColumn("_w", F.array(*raw))
    total = sum((F.get("_w", F.lit(c)) for c in range(1, 6)), F.get("_w", F.lit(0)))
    df = df.withColumn("_t", total)
    return df.select("fid", "lab", "model", "fold", F.posexplode("_w").alias("class", "_raw"), "_t").select(
        "fid", "lab", "model", "fold", "class", (F.col("_raw") / F.col("_t")).alias("p")
    )
