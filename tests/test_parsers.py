import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import annotations as a

ASAP = """<?xml version="1.0"?><ASAP_Annotations><Annotations>
<Annotation Name="Annotation 0" Type="Polygon" PartOfGroup="Tumor" Color="#F00"><Coordinates><Coordinate Order="0" X="100" Y="200"/><Coordinate Order="1" X="300" Y="200"/><Coordinate Order="2" X="300" Y="400"/></Coordinates></Annotation>
<Annotation Name="Annotation 1" Type="Dot" PartOfGroup="None" Color="#0F0"><Coordinates><Coordinate Order="0" X="1.5" Y="2.5"/></Coordinates></Annotation>
</Annotations></ASAP_Annotations>"""


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def first_point(row):
    p = row["geometry"]["rings"][0][0]
    return p["x"], p["y"]


def test_asap(spark, tmp_path):
    path = put(tmp_path, "a.xml", ASAP)
    rows = a.read_asap(spark, path)
    [polygon], [point] = a.polygons(rows).collect(), a.points(rows).collect()
    assert first_point(polygon) == (100, 200) and len(polygon["geometry"]["rings"][0]) == 4 and first_point(point) == (1.5, 2.5)
    assert a.points(a.read_asap(spark, path, name="Annotation 1")).count() == 1
    assert a.read_asap(spark, path, name="1").count() == 0  # matches at the start only
    assert a.read_asap(spark, path, part_of_group="Tum").count() == 1
    assert a.read_asap(spark, path, name="Nonexistent").count() == 0


def feature(geometry, **properties):
    return {"type": "Feature", "geometry": geometry, "properties": properties}


POLYGON = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 0]]]}
OTHER = {"type": "Polygon", "coordinates": [[[5, 5], [6, 5], [6, 6], [5, 5]]]}


def test_geojson_filters(spark, tmp_path):
    path = put(tmp_path, "a.json", {"type": "FeatureCollection", "features": [feature(POLYGON, nested={"property": "value"}), feature({"type": "Point", "coordinates": [3, 4]}, name="nested")]})
    rows = a.read_geojson(spark, path)
    assert a.polygons(rows).count() == 1 and first_point(a.points(rows).first()) == (3, 4)
    assert a.filtered(rows, nested_property="value").count() == 1
    assert a.polygons(a.filtered(rows, name="nested")).count() == 0
    assert a.filtered(rows, unknown=".*").count() == 0
    assert a.filtered(rows, null_as_text=True, unknown=".*").count() == 2


def test_geojson_multi_geometries_explode(spark, tmp_path):
    multi = {"type": "MultiPolygon", "coordinates": [POLYGON["coordinates"], OTHER["coordinates"]]}
    path = put(tmp_path, "m.json", {"features": [feature(multi, k=1), feature({"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]})]})
    rows = a.read_geojson(spark, path)
    assert a.polygons(rows).count() == 2 and a.points(rows).count() == 2


def test_geojson_relations(spark, tmp_path):
    features = [feature(POLYGON, presetID="a1", shared_attr="A"), feature(OTHER, presetID="b2", shared_attr="C"), feature(None, presetID="a1", shared_attr="B", meta={"category": {"value": "Healthy Tissue"}})]
    path = put(tmp_path, "r.json", {"features": features})
    rows = {json.loads(r["properties"])["presetID"]: r for r in a.read_geojson(spark, path).collect()}
    assert json.loads(rows["a1"]["definition"])["shared_attr"] == "B" and rows["b2"]["definition"] is None
    assert len(a.filtered(a.read_geojson(spark, path), meta_category_value="Healthy").collect()) == 1  # under its own name
    assert json.loads(rows["a1"]["properties"])["shared_attr_def"] == "B"
    found = a.filtered(a.read_geojson(spark, path), definition_meta_category_value="Healthy").collect()
    assert len(found) == 1
    wrong = a.read_geojson(spark, path, join_key="none").collect()
    assert len(wrong) == 2 and all(r["definition"] is None for r in wrong)


def test_relation_join_on_columns(spark):
    left = spark.createDataFrame([("a1", "A"), (None, "N"), ("z", "Z")], "k string, v string")
    right = spark.createDataFrame([("a1", "B", 1), ("a1", "C", 2), (None, "D", 3)], "k string, v string, w int")
    out = sorted(map(tuple, a.with_definitions(left, right, "k").select(F.coalesce("k", F.lit("-")), "v", F.coalesce("v_def", F.lit("-")), F.coalesce("w", F.lit(0))).collect()))
    assert out == [("-", "N", "D", 3), ("a1", "A", "B", 1), ("a1", "A", "C", 2), ("z", "Z", "-", 0)]


def test_darwin(spark, tmp_path):
    square = [{"x": 40702.0455, "y": 126600.7015}, {"x": 2, "y": 0}, {"x": 2, "y": 2}]
    annotations = [
        {"id": "1", "name": "Tumor", "polygon": {"paths": [square, [{"x": 0, "y": 0}]]}, "bounding_box": {"x": 0, "y": 0, "w": 1, "h": 1}, "properties": [{"name": "p"}], "slot_names": ["0", "1"]},
        {"id": "2", "name": "Cell", "point": {"x": 300, "y": 400}},
        {"id": "3", "name": "Box", "bounding_box": {"x": 1, "y": 2, "w": 3, "h": 4}},
        {"id": "4", "name": "Bad", "polygon": {"paths": [square[:2]]}, "point": {"x": 1, "y": 1}},
    ]
    rows = a.read_darwin(spark, put(tmp_path, "d.json", {"annotations": annotations}))
    by = {r["id"]: r for r in rows.collect()}
    assert first_point(by["1"]) == (40702.0455, 126600.7015) and len(by["1"]["geometry"]["rings"]) == 1
    assert by["2"]["geometry"]["type"] == "Point" and first_point(by["2"]) == (300, 400)
    assert [tuple(p) for p in by["3"]["geometry"]["rings"][0]] == [(1, 2), (4, 2), (4, 6), (1, 6), (1, 2)]
    assert by["4"]["geometry"] is None
    assert a.filtered(rows, slot_names_1="1").count() == 1 and a.filtered(rows, properties_0_name="p").count() == 1
    assert a.filtered(rows, name="Tum").count() == 1 and a.filtered(rows, slot_names_7=".*").count() == 0
    assert a.read_darwin(spark, put(tmp_path, "e.json", {"version": 2})).count() == 0


def test_empaia(spark, tmp_path):
    items = [{"name": "roi", "type": "polygon", "coordinates": [[0, 0], [4, 0], [4, 4]]}, {"name": "cell", "type": "point", "coordinates": [300, 400]}]
    path = put(tmp_path, "e.json", {"items_count": 2, "items": items})
    rows = a.read_empaia(spark, path)
    assert len(a.polygons(rows).first()["geometry"]["rings"][0]) == 4 and first_point(a.points(rows).first()) == (300, 400)
    assert a.read_empaia(spark, path, name="ro").count() == 1 and a.read_empaia(spark, path, name="x").count() == 0


@pytest.mark.parametrize(("steps", "want"), [(["a", "b", "1"], "20"), (["a", "b", "0"], "10"), (["a", "b", "5"], None), (["a", "x"], None), (["a", "b", "c"], None)])
def test_nested(spark, steps, want):
    df = spark.createDataFrame([('{"a": {"b": [10, 20]}}',), ("{bad",), (None,)], "v string")
    assert [r[0] for r in df.select(a.nested(F.col("v"), steps)).collect()] == [want, None, None]


def test_json_value(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json",), ("null",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(F.to_json(a.json_value(F.col("v")))).collect()]
    assert got == ['{"a":1}', '"not json"', "null", '""', None]


def test_geojson_definitions_as_columns(spark, tmp_path):
    drawn = [feature(POLYGON, presetID="k1", grade=2, empty=None), feature(OTHER, presetID="k2", grade=None), feature(POLYGON)]
    definitions = [feature(None, presetID="k1", empty="filled", grade=7, label="one"), feature(None, presetID="k1", label="again"), feature(None, label="without key")]
    path = put(tmp_path, "d.json", {"features": drawn + definitions})
    order = lambda r: json.dumps(r, sort_keys=True)
    got = [json.loads(r["properties"]) for r in a.read_geojson(spark, path).collect()]
    want = [
        {"presetID": "k1", "grade": 2, "empty": "filled", "grade_def": 7, "label": "one"}, {"presetID": "k1", "grade": 2, "label": "again"},
        {"presetID": "k2", "grade": None}, {"label": "without key"},
    ]
    drop = lambda r: {k: v for k, v in r.items() if k != "empty" or v is not None}
    assert sorted(map(drop, got), key=order) == sorted(want, key=order)
    plain = [json.loads(r["properties"]) for r in a.read_geojson(spark, path, join_key=None).collect()]
    assert sorted(plain, key=order) == sorted((f["properties"] for f in drawn), key=order)
