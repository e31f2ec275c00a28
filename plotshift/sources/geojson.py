"""GeoJSON feature collections as tables: ``fid``, ``geometry_type``, ``rings`` and the requested properties."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotshift.sources import collection
from plotshift.vocabulary import GEOMETRY_TYPE


def _schema(properties: str) -> dict[str, str]:
    # Coordinates stay text here: their depth depends on the geometry type.
    fields = ", ".join(": ".join(p.split(None, 1)) for p in properties.split(",") if p.strip())
    return {
        "type": "STRING",
        "geometry": "STRUCT<type: STRING, coordinates: STRING>",
        "properties": f"STRUCT<{fields}>",
    }


def _tabular(features: DataFrame) -> DataFrame:
    """Polygons and multi-polygons to ``rings``; the first ring of each polygon is its outline, the rest are holes."""
    polygon, multi = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    text = "f.geometry.coordinates"
    parts = f"if(f.geometry.type = 'MultiPolygon', from_json({text}, '{multi}'), array(from_json({text}, '{polygon}')))"
    ring = "named_struct('hole', i > 0, 'pts', transform(r, p -> named_struct('x', get(p, 0), 'y', get(p, 1))))"
    rings = f"flatten(transform({parts}, poly -> transform(poly, (r, i) -> {ring})))"
    return features.selectExpr(
        "fid",
        "f.geometry.type AS geometry_type",
        f"CAST(if(f.geometry IS NULL OR {text} IS NULL, NULL, {rings}) AS {GEOMETRY_TYPE}) AS rings",
        "f.properties.*",
    )


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Feature collections, each one JSON document; ``fid`` is the feature's position in its file.

    ``properties`` lists the columns to read, for example ``"change_type string, date0 string"``. A file of any size is
    read by as many tasks as it has splits, see :mod:`plotshift.sources.collection`.
    """
    fields = _schema(properties)
    features = collection.features(spark, path)
    f = F.from_json("text", f"type STRING, geometry {fields['geometry']}, properties {fields['properties']}")
    return _tabular(features.select("fid", f.alias("f")))


def read_geojson_lines(spark: SparkSession, path: str, properties: str, key: str = "fid") -> DataFrame:
    """One feature per line, split over as many tasks as the files allow; property ``key`` becomes ``fid``."""
    doc = spark.read.schema(", ".join(f"{k} {v}" for k, v in _schema(properties).items())).json(path)
    return _tabular(
        doc.select(
            F.col(f"properties.{key}").cast("long").alias("fid"),
            F.struct("geometry", F.col("properties").dropFields(key).alias("properties")).alias("f"),
        )
    )


def _feature(properties: list[str]) -> Column:
    """A row as a GeoJSON feature: one outline with its holes is a polygon, several outlines are a multi-polygon."""
    ring = lambda r: F.transform(r["pts"], lambda p: F.array(p["x"], p["y"]))
    outlines = F.filter(F.sequence(F.lit(0), F.size("rings") - 1), lambda i: ~F.get("rings", i)["hole"])
    last = lambda i: F.coalesce(F.get(outlines, i + 1), F.size("rings"))
    polygons = F.transform(outlines, lambda at, i: F.transform(F.slice("rings", at + 1, last(i) - at), ring))
    shape = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    several = F.size(F.filter("rings", lambda r: ~r["hole"])) > 1
    geometry = F.when(several, shape("MultiPolygon", polygons)).when(F.col("rings").isNotNull(), shape("Polygon", F.transform("rings", ring)))
    text = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.format_string('{"type": "Feature", "geometry": %s, "properties": %s}', F.coalesce(geometry, F.lit("null")), text)


def write_geojson_lines(df: DataFrame, path: str, properties: list[str]) -> None:
    """One feature per line, the layout :func:`read_geojson_lines` reads."""
    df.select(_feature(properties).alias("value")).write.text(path)


def write_geojson(df: DataFrame, path: str, properties: list[str]) -> None:
    """A feature collection per partition of ``df``, the layout :func:`read_geojson` reads."""
    df.select(_feature(properties).alias("value")).mapInArrow(_collected, "value string").write.text(path)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = lambda *texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
    yield line('{"type": "FeatureCollection", "features": [')
    first = True
    for batch in batches:
        features = batch.column("value").to_pylist()
        yield line(*[text if first and not i else "," + text for i, text in enumerate(features)])
        first = first and not features
    yield line("]}")
