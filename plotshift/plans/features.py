"""Registered queries over row-local features: cleaning, geometry, dates, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotshift.operators import bands, dates, shapes
from plotshift.operators.windows import running_total, row_change
from plotshift.operators.profile import status_transitions, value_counts
from plotshift.plans.common import as_doubles, rounded, stored
from plotshift.sources.parcels import parcels, spread


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean parcels, measure shape and first gap, summarise per class."""
    df = parcels(spark, sf_dir).select("fid", "split", "change_type", "rings", "date0", "date1")
    df = shapes.drop_invalid(shapes.drop_missing(df.where("split = 'train'")))
    df = shapes.with_core(df)
    df = dates.parse_dates(df, ("date0", "date1"))
    df = df.withColumns(
        {
            "gap": F.datediff("date1", "date0"),
            "compactness": shapes.G.compactness(F.col("area"), F.col("perimeter"), "isoperimetric_eps"),
        }
    )
    out = df.groupBy("change_type").agg(
        F.count("*").alias("parcels"),
        F.sum("area").alias("total_area"),
        F.max("perimeter").alias("max_perimeter"),
        F.avg("compactness").alias("mean_compactness"),
        F.avg("gap").alias("mean_gap"),
    )
    return rounded(out)


def parcels_clean(spark, sf_dir):
    """Rows kept by each cleaning step, per split."""
    df = shapes.with_validity(parcels(spark, sf_dir).select("fid", "split", "rings"))
    df = shapes.with_core(df)
    missing = F.col("rings").isNull()
    empty = ~missing & (F.size("rings") == 0)
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(missing).alias("missing"),
        F.count_if(empty).alias("empty"),
        F.count_if(~missing & ~empty & ~F.col("is_valid")).alias("invalid"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(F.col("centroid_x").isNull() | F.col("centroid_y").isNull()).alias("no_centroid"),
    )


def geom_core(spark, sf_dir):
    df = shapes.with_core(parcels(spark, sf_dir).select("fid", "rings"))
    zero = {f"{c}_or_0": F.coalesce(c, F.lit(0.0)) for c in ("area", "perimeter", "centroid_x", "centroid_y")}
    return rounded(df.withColumns(zero).drop("rings"))


def geom_bbox(spark, sf_dir):
    return rounded(shapes.with_bounds(parcels(spark, sf_dir).select("fid", "rings")).drop("rings", "area"))


def geom_shape(spark, sf_dir):
    df = shapes.with_shape(shapes.with_core(parcels(spark, sf_dir).select("fid", "rings")))
    return rounded(df.drop("rings", "centroid_x", "centroid_y", "area", "perimeter"))


def geom_hull(spark, sf_dir):
    df = shapes.with_hull(shapes.with_core(parcels(spark, sf_dir).select("fid", "rings")))
    return rounded(df.drop("rings", "centroid_x", "centroid_y", "area", "perimeter"))


def geom_hu(spark, sf_dir):
    return rounded(shapes.with_hu(parcels(spark, sf_dir).select("fid", "rings")).drop("rings"), 8)


def geom_reproject(spark, sf_dir):
    """Parcel coordinates read as 1/1000 degree and measured in Mercator metres."""
    rings = F.transform(
        "rings",
        lambda r: F.struct(
            r["hole"].alias("hole"),
            F.transform(
                r["pts"], lambda p: F.struct((p["x"] / 1000).alias("x"), (p["y"] / 2000).alias("y"))
            ).alias("pts"),
        ),
    )
    df = parcels(spark, sf_dir).select("fid", rings.alias("rings"))
    df = shapes.with_bounds(shapes.reproject(df)).select("fid", "minx", "miny", "maxx", "maxy")
    return rounded(df, 3)


def geom_validity(spark, sf_dir):
    return as_doubles(shapes.with_validity(parcels(spark, sf_dir).select("fid", "rings")).drop("rings"), "is_valid")


def geom_nested(spark, sf_dir):
    """Polygons of two parts, one in the hole of the other, per order: the hole is valid where it stays inside its outline."""
    box = lambda x, y, w: "array(" + ", ".join(
        f"named_struct('x', CAST({a} AS DOUBLE), 'y', CAST({b} AS DOUBLE))"
        for a, b in ((x, y), (f"{x} + {w}", y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + {w}"), (x, f"{y} + {w}"), (x, y))
    ) + ")"
    ring = lambda hole, pts: f"named_struct('hole', {hole}, 'pts', {pts})"
    rings = [ring("false", box("0", "0", "100")), ring("true", box("x", "y", "w")), ring("false", box("x + 5", "y + 5", "w - 10"))]
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey")
    df = orders.selectExpr(
        "o_orderkey AS fid", "5 + o_orderkey % 13 * 10 AS x", "5 + o_orderkey % 7 * 10 AS y", "20 + o_orderkey % 5 * 10 AS w"
    )
    df = df.selectExpr("fid", f"array({', '.join(rings)}) AS rings")
    return as_doubles(shapes.with_validity(shapes.with_core(df)).select("fid", "is_valid", "area", "perimeter"), "is_valid")


def geom_types(spark, sf_dir):
    return value_counts(parcels(spark, sf_dir, geometry=False).select("geometry_type"), "geometry_type")


def dates_parse(spark, sf_dir):
    df = dates.parse_dates(parcels(spark, sf_dir, geometry=False))
    return df.select("fid", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in dates.DATE_COLUMNS])


def dates_gaps(spark, sf_dir):
    df = dates.with_gaps(dates.parse_dates(parcels(spark, sf_dir, geometry=False)))
    df = dates.with_delta_days(dates.with_dynamics(df))
    days = [c for c in df.columns if c.startswith(("days_between", "delta_days", "total_days"))]
    return rounded(
        as_doubles(df, *days).select(
            "fid",
            *[f"days_between_{i}_{i + 1}" for i in range(4)],
            *[f"delta_days_{i}" for i in range(1, 4)],
            "total_days_from_1",
            "total_days",
            "change_frequency",
            "change_speed",
            "change_rate",
        )
    )


def dates_parts(spark, sf_dir):
    df = dates.with_epochs(dates.with_season(dates.parse_dates(parcels(spark, sf_dir, geometry=False))))
    df = dates.with_parts(df)
    parts = [f"date{i}_{p}" for i in range(5) for p in ("day", "month", "year", "epoch")]
    months = [f"month_date{i}" for i in range(5)]
    return as_doubles(df.select("fid", "high_change_2015_2018", *months, *parts), *months, *parts)


def change_acceleration(spark, sf_dir):
    df = stored(dates.with_dynamics(dates.with_gaps(dates.parse_dates(parcels(spark, sf_dir, geometry=False)))), "fid", "change_speed")
    return rounded(row_change(df, "change_speed", "change_acceleration").select("fid", "change_acceleration"))


def change_cumulative(spark, sf_dir):
    df = stored(dates.with_dynamics(dates.with_gaps(dates.parse_dates(parcels(spark, sf_dir, geometry=False)))), "fid", "change_rate")
    return rounded(running_total(df, "change_rate", "cumulative_change_rate").select("fid", "cumulative_change_rate"), 3)


def event_running_value(spark, sf_dir):
    """The two file-order operators on the event table."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("fid"), "value")
    df = running_total(row_change(df, "value", "step"), "value", "running")
    return rounded(df.select("fid", "step", "running"), 3)


def transitions(spark, sf_dir):
    return status_transitions(parcels(spark, sf_dir, geometry=False))


def status_changes(spark, sf_dir):
    from plotshift.operators.profile import with_status_changes

    return with_status_changes(parcels(spark, sf_dir, geometry=False)).select("fid", "n_changes")


def bands_basic(spark, sf_dir):
    df = bands.with_first_ndvi(bands.with_band_columns(parcels(spark, sf_dir, geometry=False)))
    return rounded(df.select("fid", "NDVI", *[c for c in df.columns if c.startswith("spectral_")]))


def bands_indices(spark, sf_dir):
    df = bands.with_indexes(parcels(spark, sf_dir, geometry=False))
    keep = [c for c in df.columns if c.startswith(bands.INDEXES)]
    return rounded(df.select("fid", *keep))


def bands_stats(spark, sf_dir):
    df = bands.with_index_stats(bands.with_indexes(parcels(spark, sf_dir, geometry=False)))
    keep = [f"{x}_{s}" for x in bands.INDEXES for s in ("mean", "std")]
    # The variation coefficient divides by means that may be next to zero; it is compared on a log scale.
    cv = [shapes.G.signed_log(F.col(f"{x}_cv")).alias(f"{x}_cv_log") for x in bands.INDEXES]
    return rounded(df.select("fid", *keep, *cv), 5)


QUERIES = {
    "flagship_class_summary": flagship,
    "parcels_clean": parcels_clean,
    "geom_core": geom_core,
    "geom_bbox": geom_bbox,
    "geom_shape": geom_shape,
    "geom_hull": geom_hull,
    "geom_hu": geom_hu,
    "geom_reproject": geom_reproject,
    "geom_validity": geom_validity,
    "geom_nested": geom_nested,
    "geom_types": geom_types,
    "dates_parse": dates_parse,
    "dates_gaps": dates_gaps,
    "dates_parts": dates_parts,
    "change_acceleration": change_acceleration,
    "change_cumulative": change_cumulative,
    "event_running_value": event_running_value,
    "status_transitions": transitions,
    "status_changes": status_changes,
    "bands_basic": bands_basic,
    "bands_indices": bands_indices,
    "bands_stats": bands_stats,
}
