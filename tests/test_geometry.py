from __future__ import annotations

import json
import math
import random

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from rollatlas.operators import geometry as M
from rollatlas.sources import geojson


def feature(code, kind, coordinates, **extra):
    properties = {} if code is None else {"CDSCode": code}
    return {"type": "Feature", "properties": {**properties, **extra}, "geometry": {"type": kind, "coordinates": coordinates}}


RING = [[-13358338.9, 4865942.3], [-13300000, 4865942.3], [-13300000, 4900000.0], [-13358338.9, 4865942.3]]
FEATURES = [
    feature("01", "Polygon", [RING]),
    feature(None, "Polygon", [RING]),
    feature("", "Polygon", [RING]),
    feature("02/x", "MultiPolygon", [[RING], [RING[:3]]]),
    feature("01", "Polygon", [RING[:2]], note="later"),
    feature("03", "Point", [5.5, 6.5]),
    feature("04", "LineString", [[1, 2], [3, 4]]),
    feature("05", "Polygon", []),
    {"type": "Feature", "id": 9, "properties": {"CDSCode": "06"}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}},
    {"type": "Feature", "properties": {"CDSCode": "07"}, "geometry": None},
]


def to_degrees(x, y, r=6378137.0):
    return math.degrees(x / r), math.degrees(2 * math.atan(math.exp(y / r)) - math.pi / 2)


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("geo") / "areas.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    return geojson.read_collections(spark, str(path))


def test_boundaries(collection):
    got = {r["boundary_key"]: r for r in M.boundary_rows(M.parse_features(collection)).collect()}
    assert sorted(got) == ["01", "02_x", "03", "04", "05", "06", "07"]
    assert json.loads(got["01"]["properties"])["note"] == "later"
    assert len(got["01"]["polygons"][0][0]) == 2
    lon, lat = got["01"]["polygons"][0][0][0]
    assert (lon, lat) == pytest.approx((-120.0, 40.0), abs=1e-6)
    assert [len(p[0]) for p in got["02_x"]["polygons"]] == [4, 3]
    assert not got["03"]["reprojected"] and got["03"]["polygons"] == [[[[5.5, 6.5]]]]
    assert got["04"]["polygons"] == [[[[1.0, 2.0], [3.0, 4.0]]]]
    strict = M.boundary_rows(M.parse_features(collection), keep_unsupported=False)
    assert [r["boundary_key"] for r in strict.filter("polygons IS NULL").orderBy("boundary_key").collect()] == ["03", "04", "06", "07"]


def test_extent(collection):
    rows = M.boundary_rows(M.parse_features(collection)).select("boundary_key", M.extent("polygons").alias("b"), M.vertex_count("polygons").alias("n"))
    got = {r["boundary_key"]: r for r in rows.collect()}
    west, south = to_degrees(*RING[0])
    east, north = to_degrees(*RING[2])
    assert tuple(got["02_x"]["b"]) == pytest.approx((south, west, north, east))
    assert tuple(got["03"]["b"]) == (6.5, 5.5, 6.5, 5.5)
    assert got["05"]["b"] is None
    assert got["02_x"]["n"] == 7 and got["05"]["n"] == 0


def test_wrong_documents_stop_the_job(spark):
    for text in ('{"type":"Feature","features":[]}', '{"type":"FeatureCollection"}', "[1]"):
        df = spark.createDataFrame([(0, text)], "ord int, document string")
        with pytest.raises(Exception, match="not a GeoJSON FeatureCollection"):
            geojson.explode_collections(df).collect()
    empty = spark.createDataFrame([(0, '{"type":"FeatureCollection","features":[]}')], "ord int, document string")
    assert geojson.explode_collections(empty).count() == 0


def test_feature_lines(spark, tmp_path, collection):
    body = ",\n".join(json.dumps(f) for f in FEATURES)
    (tmp_path / "areas.geojson").write_text('{ "type": "FeatureCollection",\n"features": [\n' + body + "\n]\n}\n")
    lines = geojson.read_feature_lines(spark, str(tmp_path / "areas.geojson"))
    def keys(features):
        rows = M.boundary_rows(M.parse_features(features)).select("boundary_key", "properties", "polygons")
        return sorted(map(str, rows.collect()))

    assert keys(lines) == keys(collection)


def test_reprojection_by_brute_force(spark):
    rng = random.Random(7)
    points = [[rng.uniform(-2e7, 2e7), rng.uniform(-1.9e7, 1.9e7), float(i)] for i in range(200)]
    text = json.dumps(feature("1", "Polygon", [points]))
    df = spark.createDataFrame([(0, text)], "pos int, feature string")
    got = M.boundary_rows(M.parse_features(df)).collect()[0]["polygons"][0][0]
    assert [tuple(p) for p in got] == [pytest.approx((*to_degrees(x, y), z)) for x, y, z in points]


def test_boxes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, -4.0), (None, None, 3.0, -4.0), (None, None, None, None)], "a double, b double, c double, d double")
    box = M.grow_box(M.point_box("a", "b"), M.point_box("c", "d"))
    got = [r[0] and tuple(r[0]) for r in df.select(box).collect()]
    assert got == [(1.0, -4.0, 3.0, 2.0), (3.0, -4.0, 3.0, -4.0), None]


def cell_of(lat, lon, zoom, pixels=80):
    width = 256 * 2**zoom
    sin = math.sin(math.radians(lat))
    return math.floor((lon + 180) / 360 * width / pixels), math.floor((0.5 - math.log((1 + sin) / (1 - sin)) / (4 * math.pi)) * width / pixels)


def test_clusters_by_brute_force(spark):
    rng = random.Random(3)
    points = [(round(rng.uniform(32, 42), 4), round(rng.uniform(-124, -114), 4)) for _ in range(300)]
    df = spark.createDataFrame(points, "lat double, lon double")
    want: dict = {}
    for zoom in (5, 8):
        for lat, lon in points:
            want.setdefault((zoom, *cell_of(lat, lon, zoom)), []).append((lat, lon))
    got = M.cluster_points(df, [], [5, 8]).collect()
    assert {(r["zoom"], r["cell_x"], r["cell_y"]): r["points"] for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        members = want[r["zoom"], r["cell_x"], r["cell_y"]]
        assert r["lat"] == pytest.approx(sum(m[0] for m in members) / len(members), abs=1e-6)
    again = M.cluster_points(df.repartition(7), [], [5, 8])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_feature_output(spark, tmp_path, collection):
    from rollatlas.plans.build import build_boundaries
    from rollatlas.sources.assets import read_one_key

    build_boundaries(collection, str(tmp_path), buckets=8)
    one = read_one_key(spark, f"{tmp_path}/boundaries", "boundary_key", "02_x")
    assert [r["boundary_id"] for r in one.collect()] == ["02/x"]
    written = spark.read.json(f"{tmp_path}/boundary_features").collect()
    assert len(written) == 7
    kinds = {}
    for r in written:
        f = json.loads(r["feature"])
        g = f["geometry"] or {}
        kinds[r["boundary_key"]] = (f["type"], g.get("type"), g.get("coordinates") or g.get("geometries"))
    assert kinds["03"] == ("Feature", "Point", [5.5, 6.5])
    assert kinds["05"] == ("Feature", "Polygon", None)
    assert kinds["06"] == ("Feature", "GeometryCollection", [{"type": "Point", "coordinates": [1, 2]}])
    assert kinds["07"] == ("Feature", None, None)
    assert len(kinds["02_x"][2]) == 2 and len(kinds["01"][2][0]) == 2



def test_coarse_cells_are_those_of_the_points(spark):
    """Cells rolled up from the finest zoom against cells of each zoom from the points."""
    from rollatlas.functions.coordinates import cell_x, cell_y
    from rollatlas.functions.numbers import SCALE

    pick = random.Random(2)
    points = [(pick.choice("ab"), pick.uniform(-90, 90), pick.uniform(-180, 180)) for _ in range(400)] + [("a", 90.0, 180.0), ("a", -90.0, -180.0)]
    df = spark.createDataFrame(points, "k string, lat double, lon double")
    got = {(r["k"], r["zoom"], r["cell_x"], r["cell_y"]): (r["points"], r["lat"], r["lon"]) for r in M.cluster_points(df, ["k"], [3, 0, 11]).collect()}
    want: dict = {}
    for zoom in (0, 3, 11):
        placed = df.select("*", cell_x(F.col("lon"), zoom, M.CELL_PIXELS).alias("x"), cell_y(F.col("lat"), zoom, M.CELL_PIXELS).alias("y"))
        for r in placed.collect():
            want.setdefault((r["k"], zoom, r["x"], r["y"]), []).append((r["lat"], r["lon"]))
    mean = lambda v: float(sum(round(x * SCALE) for x in v)) / len(v) / SCALE
    assert got.keys() == want.keys()
    for key, (n, lat, lon) in got.items():
        assert n == len(want[key])
        assert abs(lat - mean([p[0] for p in want[key]])) < 1e-9 and abs(lon - mean([p[1] for p in want[key]])) < 1e-9
    assert sum(plan_of(M.cluster_points(df, ["k"], [3, 0, 11])).count(x) for x in ("Scan ExistingRDD",)) == 2
