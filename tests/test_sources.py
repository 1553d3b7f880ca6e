"""Files in and out."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.operators import validate
from gridwake.sources import tables


def test_inventory_and_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"x" * 2_097_152)
    found = {r.name: (r.present, r.mb) for r in validate.file_inventory(spark, f"file://{tmp_path}", ["a.json", "b.json"]).collect()}
    assert found == {"a.json": (True, 2.0), "b.json": (False, None)}
    assert [r.name for r in validate.missing_files(spark, f"file://{tmp_path}", ["a.json", "b.json"]).collect()] == ["b.json"]


def test_polygons_by_name_priority(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"properties": {"ADMIN": "A", "country": "no"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"other": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"features": features}))
    got = {r.country: len(r.rings) for r in tables.read_countries(spark, f"file://{tmp_path}/c.json").collect()}
    assert got == {"A": 1, "B": 3}


def test_feature_collection_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1.23456789, 2.0, 7)], "lon_bin double, lat_bin double, points int")
    text = tables.feature_collection(d, ["points"])
    assert json.loads(text)["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.234568, 2.0]}
    (tmp_path / "f.json").write_text(text)
    row = tables.read_features(spark, f"file://{tmp_path}/f.json", T.StructType([T.StructField("points", T.IntegerType())]), lines=False).first()
    assert (row.lon, row.lat, row.points) == (1.234568, 2.0, 7)


def test_malformed_rows_are_dropped(spark, tmp_path):
    (tmp_path / "t.csv").write_text("latitude,longitude,density,intensity,intensity_normalized\n1,2,3,0.5,0.1\n1,2\n")
    got = tables.read_categories(spark, {"passenger": f"file://{tmp_path}/t.csv"}).select("category", "density").collect()
    assert [tuple(r) for r in got] == [("passenger", 3)]


def test_metrics_document(spark, tmp_path):
    tables.write_document(spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("m")), f"file://{tmp_path}/m")
    assert spark.read.text(f"file://{tmp_path}/m").first().value == '{"m":{"a":1}}'
