import numpy as np
from pyspark.sql import functions as F

from codexlake.operators import nearby

SCHEMA = "id string, lat double, lng double, key string, block string"


def points(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, km):
    rows = sorted({r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and np.isfinite(r[1]) and np.isfinite(r[2]) and abs(r[1]) <= 90 and (r[1], r[2]) != (0, 0)})
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            u, v = nearby.unit_vectors(np.array([a[1], b[1]]), np.array([a[2], b[2]]))
            if a[0] != b[0] and 2 * np.arcsin(min(1, np.linalg.norm(u - v) / 2)) * nearby.EARTH_RADIUS_KM <= km:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_match_brute_force_at_poles_and_date_line(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(89.98, 0.02, 80).clip(-90, 90), rng.uniform(-180, 180, 80)))]
    rows += [(f"b{i}", float(x), float(y % 360)) for i, (x, y) in enumerate(zip(rng.normal(10, 0.02, 120), rng.normal(180, 0.02, 120)))]
    got = [tuple(r) for r in nearby.near_pairs(points(spark, rows), 2.0, cell_points=20, sample_points=100).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 2.0)


def test_hot_spot_nulls_repeats_and_bad_values(spark):
    rows = [(f"h{i:03}", 5.0, 5.0) for i in range(60)] + [(f"s{i:03}", i * 0.7, -20.0) for i in range(60)]
    rows += [("h001", 5.0, 5.0), (None, 5.0, 5.0), ("n1", None, 5.0), ("n2", 5.0, float("nan")), ("n3", 91.0, 5.0), ("n4", 0.0, 0.0), ("n5", 5.0, float("inf"))]
    got = [tuple(r) for r in nearby.near_pairs(points(spark, rows), 1.0, cell_points=5).collect()]
    assert len(got) == 60 * 59 // 2 and set(got) == brute(rows, 1.0)


def test_empty_points_and_zones(spark):
    none = points(spark, [])
    zones = spark.createDataFrame([], "zone_id string, outline array<struct<lat: double, lng: double>>")
    assert nearby.near_or_inside(none, zones, 2.0).collect() == []


def inside(lat, lng, outline):
    hit = False
    for (y1, x1), (y2, x2) in zip(outline, [*outline[1:], outline[0]]):
        if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_regions_by_both_paths(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-30, 30, 300), rng.uniform(-180, 180, 300)))]
    shapes = {f"z{k}": [(float(20 * np.sin(t) * (1 + 0.5 * (j % 2))), float(c + 15 * np.cos(t) * (1 + 0.5 * (j % 2)))) for j, t in enumerate(np.linspace(0, 6, 9))] for k, c in enumerate((-185.0, 0.0, 8.0, 179.0))}
    zones = spark.createDataFrame([(k, [{"lat": a, "lng": b} for a, b in v]) for k, v in shapes.items()] + [("flat", [{"lat": 1.0, "lng": 1.0}, {"lat": 2.0, "lng": 2.0}]), (None, None), ("bad", [{"lat": None, "lng": 1.0}, {"lat": 1.0, "lng": 5.0}, {"lat": 9.0, "lng": 5.0}])], "zone_id string, outline array<struct<lat: double, lng: double>>")
    want = {(i, z) for i, a, b in rows for z, shape in shapes.items() if any(inside(a, b + turn, shape) for turn in nearby.HALF_WORLDS)}
    pts = points(spark, [*rows, rows[0]])
    for most in (nearby.BROADCAST_VERTICES, 0):
        got = [tuple(r) for r in nearby.points_in_regions(pts, zones, broadcast_vertices=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_longitudes_above_180_wrap(spark):
    df = nearby.usable_coordinates(points(spark, [("a", 1.0, 190.0)]), "id", F.col("lat"), F.col("lng"))
    assert df.first().lng == -170.0


def test_an_id_at_two_places_gives_each_pair_once(spark):
    rows = [("a", 10.0, 10.0), ("a", 10.001, 10.0), ("b", 10.0005, 10.0), ("b", 50.0, 10.0), ("c", 50.0, 10.0), ("a", 50.0, 10.0), ("d", -10.0, 0.0)]
    got = [tuple(r) for r in nearby.near_pairs(points(spark, rows), 2.0).collect()]
    assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_any_number_of_ids_at_one_place_are_one_place(spark):
    rows = [(f"h{i:04}", 5.0, 5.0) for i in range(500)] + [("x", 5.001, 5.0), ("y", 6.0, 5.0)]
    members = nearby.places(points(spark, [*rows, rows[0]]))
    assert members.count() == 502 and members.select("place_id").distinct().count() == 3
    assert nearby.near_places(members, 1.0).count() == 1


def test_cells_dealt_to_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"h{i:03}", 5 + float(x), 5 + float(y)) for i, (x, y) in enumerate(rng.normal(0, 0.004, (150, 2)))]
    monkeypatch.setattr(nearby, "MAX_CELLS", 2)
    got = [tuple(r) for r in nearby.near_pairs(points(spark, rows), 1.0, cell_points=10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 1.0)


def test_sections_of_slabs_find_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    zones = [(f"z{k}", [(float(10 * np.sin(t) + rng.normal()), float(k + 12 * np.cos(t))) for t in np.linspace(0, 6, 15)]) for k in range(0, 40, 4)]
    names, edges = nearby.edges_of(zones)
    lat, lng = rng.uniform(-12, 12, 500), rng.uniform(-20, 60, 500)
    want = {(i, z) for i in range(500) for z, (_, shape) in enumerate(zones) if inside(lat[i], lng[i], shape)}
    for size in (4_000_000, 50, 1):
        monkeypatch.setattr(nearby, "SECTION_EDGES", size)
        slabs = nearby.Slabs(edges)
        for _ in range(2):
            got = list(zip(*(x.tolist() for x in slabs.holding(lng, lat))))
            assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.undo()
    assert not len(nearby.Slabs(np.zeros((0, 5))).holding(lng, lat)[0])
