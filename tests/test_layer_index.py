"""The polygon index: its size follows outlines, its lists are bounded, its answers are exact."""

import random

import pytest
from pyspark.sql import functions as F

from odflow.functions.geo import inside_ring
from odflow.operators import locate as L
from odflow.operators.filters import select_zones_in
from odflow.operators.flows import od_flows
from odflow.operators.geometry_layer import layer_from_vertices
from tests.conftest import plan_text


def squares(spark, zones):
    rows = [(z, i, float(x), float(y)) for z, (x0, y0, s) in zones.items()
            for i, (x, y) in enumerate([(x0, y0), (x0 + s, y0), (x0 + s, y0 + s), (x0, y0 + s)])]
    return layer_from_vertices(spark.createDataFrame(rows, "zone_id int, seq int, x double, y double"))


def test_rows_follow_the_outline_not_the_area(spark):
    small = {z: (z % 6, 3 * (z // 6), 1) for z in range(1, 30)}
    rows = {f: L.cell_index(squares(spark, small | {0: (0, 20, f)})).leaves.count() for f in (1, 20, 200)}
    # A polygon of 200 times the extent adds cells along its outline, at every level above the small ones.
    assert rows[20] < 1.5 * rows[1] and rows[200] < 2 * rows[1], rows


def test_leaves_divide_the_square(spark):
    index = L.cell_index(squares(spark, {0: (0, 0, 40)} | {z: (z % 30 + 0.2, z // 30 + 0.2, 0.5) for z in range(1, 60)}))
    leaves = index.leaves.where("_level >= 0")
    area = leaves.select(F.sum(F.pow(F.lit(0.25), F.col("_level")))).first()[0]
    assert area == pytest.approx(1.0, abs=1e-12)
    assert leaves.select("_level", "_gx", "_gy").distinct().count() == leaves.count()
    assert index.directory.count() <= 4 ** L.DIRECTORY


@pytest.mark.parametrize("how", ["first", "all"])
@pytest.mark.parametrize("keep", [False, True])
def test_many_boxes_over_one_place(spark, how, keep):
    rnd = random.Random(4)
    zones = {z: (rnd.uniform(0, 0.3), rnd.uniform(0, 0.3), 1 + z / 1000) for z in range(150)} | {999: (5, 5, 1)}
    layer = squares(spark, zones)
    index = L.cell_index(layer)
    assert index.leaves.agg(F.max(F.size("_cands"))).first()[0] <= L.CANDS and index.rows > 1
    pts = [(i, rnd.uniform(-0.2, 1.6), rnd.uniform(-0.2, 1.6)) for i in range(200)] + [(900, None, 1.0), (901, 5.5, 5.5), (902, 0.6, 0.6)]
    df = spark.createDataFrame(pts, "pid int, lon double, lat double")
    got = sorted((r.pid, r.zone_id if r.zone_id is not None else -1)
                 for r in L.locate(df, layer, "lon", "lat", how=how, keep_unmatched=keep, index=index).collect())
    want = []
    for p, x, y in pts:
        hit = sorted(z for z, (a, b, s) in zones.items() if x is not None and a <= x <= a + s and b <= y <= b + s)
        want += [(p, z) for z in (hit[:1] if how == "first" else hit)] or ([(p, -1)] if keep else [])
    assert got == sorted(want)


def test_long_outlines_are_divided_by_their_edges(spark):
    import math
    rnd = random.Random(8)
    ring = [(1, i, (3 + rnd.uniform(0, 0.5)) * math.cos(2 * math.pi * i / 4000), (3 + rnd.uniform(0, 0.5)) * math.sin(2 * math.pi * i / 4000))
            for i in range(4000)]
    layer = layer_from_vertices(spark.createDataFrame(ring, "zone_id int, seq int, x double, y double"))
    index = L.cell_index(layer)
    most = index.leaves.select(F.explode("_cands").alias("c")).agg(F.max(F.size("c.edges"))).first()[0]
    assert most <= L.EDGES
    pts = spark.createDataFrame([(i, rnd.uniform(-4, 4), rnd.uniform(-4, 4)) for i in range(800)], "pid int, lon double, lat double")
    got = {r.pid for r in L.locate(pts, layer, "lon", "lat", index=index).collect()}
    assert got == {r.pid for r in pts.crossJoin(layer).where(inside_ring("edges", "lon", "lat")).collect()}


def test_index_is_made_once_for_a_content(spark):
    zones = {1: (0, 0, 1), 2: (1, 0, 1)}
    assert L.cell_index(squares(spark, zones)) is L.cell_index(squares(spark, zones))
    assert L.cell_index(squares(spark, zones)) is not L.cell_index(squares(spark, {1: (0, 0, 1), 2: (1, 0, 1.5)}))


def test_empty_layer(spark):
    layer = squares(spark, {1: (0, 0, 1)}).where("zone_id = 7")
    pts = spark.createDataFrame([(1, 0.5, 0.5)], "pid int, lon double, lat double")
    assert L.locate(pts, layer, "lon", "lat").count() == 0
    assert [r.zone_id for r in L.locate(pts, layer, "lon", "lat", keep_unmatched=True).collect()] == [None]


def test_points_of_selected_zones(spark):
    layer = squares(spark, {1: (0, 0, 2), 2: (1, 1, 2), 3: (8, 8, 1)})
    rnd = random.Random(9)
    pts = spark.createDataFrame([(i, rnd.uniform(-1, 10), rnd.uniform(-1, 10)) for i in range(500)], "pid int, lon double, lat double")
    every = {(r.pid, r.zone_id) for r in L.locate(pts, layer, "lon", "lat").collect()}
    for chosen in ([2], [1, 3], [77], []):
        sel = spark.createDataFrame([(z,) for z in chosen], "zone_id int")
        got = {(r.pid, r.zone_id) for r in L.located_in(pts, layer, sel, "lon", "lat").collect()}
        assert got == {x for x in every if x[1] in chosen}


def test_selection_of_any_length_prunes_partitions(spark, tmp_path):
    spark.range(3000).selectExpr("cast(id % 30 as int) AS orig", "id AS dest", "1.0D AS orig_lon", "1.0D AS orig_lat", "2.0D AS dest_lon",
                                 "2.0D AS dest_lat", "1.0D AS w", "1.0D AS m").write.partitionBy("orig").parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    long = spark.range(100_000).selectExpr("cast(id AS int) + 25 AS zone_id")
    assert od_flows(facts, "orig", selection=long).count() == 500
    assert od_flows(facts, "orig", selection=long, exclude_self=True).agg(F.max("dest")).first()[0] is None
    assert od_flows(facts, "both", selection=long.where("zone_id < 27")).where("orig NOT IN (25, 26)").count() == 0
    spark.createDataFrame([(25, "a"), (26, "b")], "zone_id int, name string").write.parquet(str(tmp_path / "sel"))
    picked = spark.read.parquet(str(tmp_path / "sel")).where("name = 'a'")
    plan = plan_text(select_zones_in(facts, picked))
    assert "dynamicpruning" in plan.lower()
