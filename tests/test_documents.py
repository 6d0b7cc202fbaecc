"""Document sources on small texts."""

import json

import pytest

from swathline.sources import documents


def test_contours(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    polygon = {"geometry": {"type": "Polygon", "coordinates": [square]}}
    line = {"geometry": {"type": "LineString", "coordinates": [*square, [0, 0], [5]]}}
    texts = [(1, json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1, 2]}}, polygon, line]})), (2, json.dumps({"features": []})), (3, "not json"), (4, json.dumps({"a": 1})), (5, None)]
    df = spark.createDataFrame(texts, "id int, body string")
    rows = documents.contours(df).collect()
    assert [(r.lat, r.lon) for r in sorted((r for r in rows if r.id == 1), key=lambda r: r.i)] == [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    assert {r.id: r.error for r in rows if r.id > 1} == {2: "no usable feature", 3: "not an object", 4: "no features", 5: "not an object"}
    assert {r.feature for r in documents.contours(df, all_features=True).collect() if r.id == 1} == {1, 2}


def test_missions(spark):
    text = json.dumps({"default_reach_radius_m": 0.01, "waypoints": [{"id": "a", "x": 1, "y": 2}, [55.5, 37.5], {"latitude": 55.1, "lng": 37.1, "reach_radius_m": 2}]})
    rows = documents.missions(spark.createDataFrame([(1, text)], "id int, body string")).orderBy("i").collect()
    assert [(r.wid, r.latitude, r.longitude, r.x, r.reach_radius_m) for r in rows] == [("a", None, None, 1, 0.05), ("wp_2", 55.5, 37.5, None, 0.05), ("wp_3", 55.1, 37.1, None, 2)]
    assert {(r.lat0, r.lon0) for r in rows} == {(55.5, 37.5)}


def test_files_and_parameters(tmp_path):
    path = tmp_path / "m.json"
    path.write_text("{}")
    assert documents.mission_file(str(path), "default.json") == str(path)
    assert documents.mission_file("missing.json", "default.json") == "default.json"
    with pytest.raises(ValueError):
        documents.mission_file("", "default.txt")
    assert documents.parameters({"a": 1.0, "b": 2.0}, '{"a": 9}', {"a": (0, 5)}) == {"a": 5, "b": 2.0}
