import math
import random

import pytest

from placeweave.operators.proximity import EARTH_M, cover_polygon, near_pairs, points_in_regions

SCHEMA = "uid long, lat double, lon double"


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1, h)))


def usable(p):
    return p[0] is not None and None not in p[1:] and all(map(math.isfinite, p[1:])) and abs(p[1]) <= 90 and p[1:] != (0.0, 0.0)


def brute(points, r):
    ps = sorted({p for p in points if usable(p)})
    return {(a[0], b[0]) for i, a in enumerate(ps) for b in ps[i + 1 :] if metres(a, b) <= r}


@pytest.mark.parametrize("lat", [0.0, 47.3, -89.99995, 89.9999, 60.0])
def test_near_pairs_equal_brute_force(spark, lat):
    rng = random.Random(lat)
    points = []
    for i in range(300):
        lon = rng.choice([0.0, 179.9999, 12.5, 359.9999]) + rng.uniform(-4e-4, 4e-4) / max(0.05, math.cos(math.radians(lat)))
        points.append((i, max(-90.0, min(90.0, lat + rng.uniform(-5e-4, 5e-4))), lon + rng.choice([0, 0, 360, -360])))
    found = [tuple(r) for r in near_pairs(spark.createDataFrame(points, SCHEMA), 30.0).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(points, 30.0)


def test_near_pairs_at_the_pole_with_a_large_radius(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(89.0, 90.0), rng.uniform(-180, 540)) for i in range(150)]
    assert {tuple(r) for r in near_pairs(spark.createDataFrame(points, SCHEMA), 40_000.0).collect()} == brute(points, 40_000.0)


def test_near_pairs_of_unusable_rows_ties_and_repeats(spark):
    points = [(1, 10.0, 20.0), (2, 10.0, 20.0), (2, 10.0, 20.0), (3, 10.0, 380.0), (4, 0.0, 0.0), (5, 0.0, 0.0), (6, None, 20.0), (7, float("nan"), 20.0), (8, 95.0, 20.0), (9, 10.0, float("inf")), (None, 10.0, 20.0)]
    df = spark.createDataFrame(points, SCHEMA).selectExpr("*", "'x' AS cell", "1 AS id", "2 AS band")
    assert sorted(map(tuple, near_pairs(df, 30.0).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_a_hot_cell_is_split_without_loss(spark):
    points = [(i, 45.0, 7.0) for i in range(1500)]
    df = spark.createDataFrame(points, SCHEMA)
    assert near_pairs(df, 5.0, hot_share=0.01).count() == 1500 * 1499 // 2


def test_near_pairs_of_nothing(spark):
    assert near_pairs(spark.createDataFrame([], SCHEMA), 30.0).collect() == []


def test_points_in_regions_equal_the_plain_rule(spark):
    rng = random.Random(3)
    rings = {"a": [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [5.0, 4.0], [0.0, 10.0]], "b": [[-170.0, -60.0], [-160.0, -60.0], [-165.0, -50.0]], "c": [[1.0, 1.0], [1.01, 1.0], [1.01, 1.01], [1.0, 1.01], [1.0, 1.0]], "bad": [[0.0, 0.0], [1.0, 1.0]]}
    points = [(i, rng.uniform(-1, 11), rng.uniform(-1, 11)) for i in range(300)] + [(1000 + i, rng.uniform(-61, -49), rng.uniform(-171, -159) + 360) for i in range(200)] + [(2000 + i, rng.uniform(0.99, 1.02), rng.uniform(0.99, 1.02)) for i in range(100)] + [(5000, None, 1.0)]

    def holds(ring, x, y):
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        return sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(closed, closed[1:])) % 2 == 1

    want = {(i, k) for i, lat, lon in points if lat is not None for k, r in rings.items() if len(r) > 2 and holds(r, (lon + 180) % 360 - 180, lat)}
    regions = spark.createDataFrame([*rings.items(), ("none", None)], "region string, ring array<array<double>>")
    got = points_in_regions(spark.createDataFrame(points, SCHEMA), regions, max_level=12, max_cells=64)
    assert {tuple(r) for r in got.collect()} == want and want


def test_a_cover_has_interior_and_border_cells():
    cells = cover_polygon([(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0), (0.0, 0.0)], 10, 200)
    assert any(c[3] for c in cells) and any(not c[3] for c in cells) and len({c[0] for c in cells}) > 1
