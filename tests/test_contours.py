"""Estimated bandwidths, separable densities and closed rings of density levels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from odflow.operators.contours import _crossings, bandwidths, density_levels, density_surface

POINTS = "lon double, lat double"


def frame(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def normal_reference(v):
    q1, q3 = np.quantile(v, [0.25, 0.75])
    sd = np.std(v, ddof=1)
    return round(1.06 * (min(sd, (q3 - q1) / 1.34) if q3 > q1 else sd) * len(v) ** -0.2, 9)


def rings_of(df):
    rows = defaultdict(dict)
    for r in df.collect():
        assert r.vertex not in rows[r.bin, r.ring]
        rows[r.bin, r.ring][r.vertex] = (r.lon, r.lat, r.size)
    out = defaultdict(list)
    for (b, _), at in sorted(rows.items()):
        assert sorted(at) == list(range(len(at))) and {s for _, _, s in at.values()} == {len(at)}
        out[b].append([at[i][:2] for i in range(len(at))])
    return out


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2


@pytest.fixture(scope="module")
def cloud():
    rnd = random.Random(11)
    return [(rnd.gauss(-93, 0.2), rnd.gauss(45, 0.1)) for _ in range(300)] + [(rnd.gauss(-91, 0.1), rnd.gauss(45.5, 0.1)) for _ in range(200)]


def test_bandwidths(spark, cloud):
    b = bandwidths(frame(spark, [*cloud, (None, 1.0), (1.0, None), (float("nan"), 2.0)]), "lon", "lat").first()
    x, y = np.array(cloud).T
    assert b.n == 500
    assert (b.hx, b.hy) == (pytest.approx(normal_reference(x), abs=2e-9), pytest.approx(normal_reference(y), abs=2e-9))
    # The middle half of the longitudes has no spread, so their deviation decides.
    tied = [(0.0, float(i)) for i in range(9)] + [(5.0, 9.0)]
    assert bandwidths(frame(spark, tied), "lon", "lat").first().hx == pytest.approx(normal_reference(np.array(tied)[:, 0]), abs=2e-9)


def test_surface_equals_direct_sums(spark, cloud):
    surface, cx, cy = density_surface(frame(spark, cloud), "lon", "lat", per=2, reach=3)
    got = {(r.gx, r.gy): r.density for r in surface.collect()}
    want = defaultdict(float)
    for x, y in cloud:
        gx, gy = math.floor(x / cx), math.floor(y / cy)
        for dx in range(-6, 7):
            for dy in range(-6, 7):
                want[gx + dx, gy + dy] += math.exp(-(dx * dx + dy * dy) / 8) / (len(cloud) * 2 * math.pi * 4 * cx * cy)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert sum(got.values()) * cx * cy == pytest.approx(1, abs=0.01)


def test_rings_are_closed_and_nest(spark, cloud):
    rings = rings_of(density_levels(frame(spark, cloud), "lon", "lat", bins=8))
    assert sorted(rings) == list(range(1, 8))
    totals = [sum(map(area, rings[b])) for b in range(1, 8)]
    assert all(t > 0 for t in totals) and totals == sorted(totals, reverse=True)
    # Both clouds rise above the lowest level, each within a ring of its own.
    around = [r for r in rings[1] if area(r) > 0]
    assert any(all(x < -92 for x, _ in r) for r in around) and any(all(x > -92 for x, _ in r) for r in around)


def test_hollow_runs_clockwise(spark):
    n = 200
    circle = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings = rings_of(density_levels(frame(spark, circle), "lon", "lat", bins=8, per=4))
    signs = [sorted(area(r) > 0 for r in rings[b]) for b in rings]
    assert [False, True] in signs


def test_pieces_of_any_surface_close(spark):
    # Random heights with ties and with levels met exactly, so every kind of square occurs.
    rnd = random.Random(4)
    nodes = spark.createDataFrame([(x - 5, y - 5, float(rnd.randrange(1, 9))) for x in range(10) for y in range(10) if rnd.random() < 0.9],
                                  "gx bigint, gy bigint, density double")
    rows = _crossings(nodes, 1.0, 8, 1.0, 1.0).collect()
    starts, ends = Counter((r.bin, r.key) for r in rows), Counter((r.bin, r.next) for r in rows)
    assert len(rows) > 200 and set(starts.values()) == {1} and starts == ends


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(None, None)], [(1.0, 2.0)] * 5, [(1.0, float(i)) for i in range(5)]])
def test_no_spread_no_levels(spark, rows):
    assert density_levels(frame(spark, rows), "lon", "lat").count() == 0
