"""Feature collections cut into splits: the same features as one JSON parse of the file, wherever the cuts fall."""

import json
import random

import pytest

from plotshift.sources import collection, geojson

NASTY = ['"}{', "\\", '\\"', "a\\\\", "[{\"type\": \"Feature\"}]", "é}日本{", "\n\t}", "", None]


def _document(rng, n, indent):
    features = []
    for i in range(n):
        ring = [[rng.randint(0, 9) / 2, float(rng.randint(0, 9))] for _ in range(rng.randint(3, 12))]
        kind = rng.choice(["Polygon", "MultiPolygon", None])
        geometry = {"type": kind, "coordinates": [ring] if kind == "Polygon" else [[ring, ring[:3]], [ring]]} if kind else None
        note = rng.choice(NASTY)
        features.append({"type": "Feature", "id": i, "properties": {"note": note, "n": {"x": [{"y": i}]}, "k": i}, "geometry": geometry})
    crs = {"type": "name", "properties": {"name": "urn}", "deep": {"a": [{"type": "Feature"}]}}}
    return {"type": "FeatureCollection", "crs": crs, "bbox": [[0, 1], [2, 3]], "links": [[["{"]], [[1]]], "features": features, "after": [{"type": "Other"}]}


@pytest.mark.parametrize("split,indent", [("128m", None), ("97", None), ("61", 1), ("1009", 2)])
def test_any_split(spark, tmp_path, split, indent):
    rng = random.Random(split)
    docs = [_document(rng, n, indent) for n in (0, 1, 25)]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.geojson").write_text(json.dumps(d, indent=indent, ensure_ascii=bool(indent)) + "\n" * i)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        tasks = collection._records(spark, str(tmp_path)).rdd.getNumPartitions()
        rows = geojson.read_geojson(spark, str(tmp_path), "note string, k long").collect()
        texts = collection.features(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert tasks > 20 or split == "128m"
    want = [(i, f["properties"]["note"], f["properties"]["k"]) for d in docs for i, f in enumerate(d["features"])]
    assert sorted(((r.fid, r.note, r.k) for r in rows), key=str) == sorted(want, key=str)
    whole = [(i, f) for d in docs for i, f in enumerate(d["features"])]
    plain = lambda rows: sorted((i, json.dumps(f, sort_keys=True)) for i, f in rows)
    assert plain((t.fid, json.loads(t.text)) for t in texts) == plain(whole)


def test_one_file_many_tasks_and_round_trip(spark, tmp_path, rings):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 1)]
    df = rings([square], [square, hole], None)
    # fid 3: two outlines, the second with a hole
    more = spark.createDataFrame(
        [(3, [(False, [(float(x), float(y)) for x, y in square]), (False, [(x + 9.0, y + 0.0) for x, y in square]), (True, [(x + 9.0, y + 0.0) for x, y in hole])])],
        df.schema,
    )
    df = df.unionByName(more).selectExpr("fid AS parcel", "rings", "concat('}{\"[\\\\', fid) AS note").coalesce(1)
    geojson.write_geojson(df, str(tmp_path / "c"), ["parcel", "note"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    parsed = json.loads(text)
    assert [(f["geometry"] or {}).get("type") for f in parsed["features"]] == ["Polygon", "Polygon", None, "MultiPolygon"]
    assert [len(p) for p in parsed["features"][3]["geometry"]["coordinates"]] == [1, 2]
    back = geojson.read_geojson(spark, str(tmp_path / "c"), "parcel long, note string").orderBy("parcel")
    assert [tuple(r) for r in back.select("parcel", "rings", "note").collect()] == [tuple(r) for r in df.select("parcel", "rings", "note").orderBy("parcel").collect()]


def test_empty(spark, tmp_path):
    (tmp_path / "e.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert geojson.read_geojson(spark, str(tmp_path), "k long").count() == 0
