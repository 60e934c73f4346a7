"""Operator behaviour on in-memory edge rows (FIXTURES part C) and plan-shape checks."""

import random
from collections import Counter

from pyspark.sql import functions as F

from odflow.operators.crosstab import add_share, crosstab, small_samples
from odflow.operators.filters import filter_day_parts
from odflow.operators.flows import cap_at_quantile, od_flows
from odflow.operators.geometry_layer import boxes_from_points, layer_from_vertices
from odflow.operators.locate import locate
from odflow.operators.segments import (
    at_nodes, at_sites, attach_segments, band, classify_stops, trip_direction,
)
from odflow.operators.selection import box_heat, individual_trips
from tests.conftest import plan_text

ZT = ("orig int, orig_lat double, orig_lon double, dest int, dest_lat double, dest_lon double, "
      "w double, m double")


def test_od_flows_null_weight_group_dropped(spark):  # C1
    rows = [(1, 0.0, 0.0, 2, 1.0, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 2, 1.0, 1.0, None, 1.0),
            (1, 0.0, 0.0, 3, 2.0, 2.0, 2.0, 1.0)]
    f = od_flows(spark.createDataFrame(rows, ZT), selection=[1]).collect()
    assert [(r.dest, r.N) for r in f] == [(3, 2.0)]


def test_both_is_twice_orig_without_selection(spark):
    rnd = random.Random(3)
    rows = [(a, float(a), float(a), b, float(b), float(b), float(rnd.randint(1, 9)), 1.0)
            for a, b in ((rnd.randint(0, 4), rnd.randint(0, 4)) for _ in range(200))]
    zt = spark.createDataFrame(rows, ZT)
    s_orig = od_flows(zt, "orig").agg(F.sum("N")).first()[0]
    s_both = od_flows(zt, "both").agg(F.sum("N")).first()[0]
    assert abs(s_both - 2 * s_orig) < 1e-9
    capped = od_flows(zt, "both").where(F.col("colN") > F.col("N")).count()
    assert capped == 0


def test_cap_at_quantile(spark):  # C12
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "N double")
    out = {r.N: r.colN for r in cap_at_quantile(df).collect()}
    q = 19.05  # R quantile(1:20, .95), type 7
    assert abs(out[20.0] - q) < 1e-9 and out[19.0] == 19.0 and abs(out[19.05 if 19.05 in out else 20.0] - q) < 1e-9


def test_small_samples_threshold(spark):  # C13
    xt = spark.createDataFrame([("a", 29, 1.0), ("b", 30, 1.0)], "x string, obs long, N double")
    assert [r.x for r in small_samples(xt, "x").collect()] == ["a"]


def test_crosstab_domain_and_share(spark):  # C2 + W1
    rows = [("A", "u", 1.0), ("A", "v", 3.0), ("B", "u", 2.0), ("Z", "u", 5.0), (None, "u", 1.0)]
    t = spark.createDataFrame(rows, "x string, y string, w double").withColumn("m", F.lit(1.0))
    xt = crosstab(t, "x", "y", domains={"x": ["A", "B"]})
    sh = {(r.x, r.y): r.share for r in add_share(xt, "x", "y").collect()}
    assert sh == {("A", "u"): 0.25, ("A", "v"): 0.75, ("B", "u"): 1.0}


def test_day_parts_all_day_wins(spark):  # C11
    df = spark.createDataFrame([("0", "wd"), ("2", "wd"), ("0", "we")], "day_part string, day_type string")
    assert [r.day_part for r in filter_day_parts(df, ["0", "2"], "wd").collect()] == ["0"]


def test_classify_later_rule_wins_and_forms(spark):  # C10
    stops = spark.createDataFrame(
        [(1, 0, 5, 100, "Y", "N1"), (1, 0, 6, 101, "N", "N2"), (1, 0, 7, 102, "Y", "N3"),
         (1, 1, 5, 103, "N", "N4"), (2, 0, 5, 104, "N", "N5")],
        "line_id int, direction_number int, stop_sequence_number int, site_id long, "
        "site_downtown_zone string, node_id string")
    rules = [band(1, 0, 1, 6, "A"), band(1, 0, 6, 9, "B"), at_sites(1, [103], "HUB"),
             at_nodes(2, ["N5"], "NODE")]
    got = {r.site_id: r.segment for r in classify_stops(stops, rules).collect()}
    assert got == {100: "A", 101: "B", 102: "B", 103: "HUB", 104: "NODE"}
    assert "NestedLoop" not in plan_text(classify_stops(stops, rules))


def test_attach_segments_fans_out(spark):  # C9
    seg = spark.createDataFrame([(7, 1, "X"), (7, 1, "Y"), (8, 1, "Z")],
                                "site_id long, line_id int, segment string")
    rides = spark.createDataFrame([(1, 1, 7, 8)], "id int, line_id int, board_site long, alight_site long")
    assert attach_segments(rides, seg).count() == 2


def _rides_and_segments(spark):
    rnd = random.Random(3)
    seg = spark.createDataFrame([(rnd.choice([*range(6), None]), rnd.randint(0, 2), rnd.choice(["A", "B", None]))
                                 for _ in range(150)], "site_id long, line_id int, segment string")
    rides = spark.createDataFrame([(i % 150, rnd.choice([0, 1, 2, 3, None]), rnd.choice([*range(8), None]), rnd.randint(0, 7),
                                    rnd.choice(["NB", None]), "AM") for i in range(200)],
                                  "id int, line_id int, board_site long, alight_site long, dir string, time_period string")
    return rides, seg


def test_repeated_lookup_rows_equal_plain_joins(spark):
    from odflow.operators.segments import on_off, repeat_rows
    rides, seg = _rides_and_segments(spark)
    b = seg.select(F.col("site_id").alias("board_site"), "line_id", F.col("segment").alias("board_segment"))
    a = seg.select(F.col("site_id").alias("alight_site"), "line_id", F.col("segment").alias("alight_segment"))
    want = rides.join(b, ["board_site", "line_id"], "left").join(a, ["alight_site", "line_id"], "left")
    got, short = attach_segments(rides, seg), attach_segments(rides, seg, copies="n")
    assert got.columns == want.columns and short.count() < want.count()
    for x in (got, repeat_rows(short, "n")):
        assert Counter(x.collect()) == Counter(want.collect())
    rows = Counter(on_off(got).collect())
    assert rows == Counter(want.dropna(subset=["board_segment", "alight_segment", "line_id", "time_period", "dir"]).collect()) and rows
    assert Counter(repeat_rows(on_off(short), "n").collect()) == rows


def test_repeated_rows_are_made_in_bounded_parts(spark):
    from odflow.operators.segments import repeat_rows
    sizes = {1: (1, 1), 2: (2, 3), 3: (1, 1023), 4: (512, 2), 5: (1025, 1), 6: (64, 49), 7: (1_100, 1_000)}
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in sizes.items()] + [(8, None, 2)], "id int, a long, b int")
    got = {r.id: r["count"] for r in repeat_rows(df, "a", "b").groupBy("id").count().collect()}
    assert got == {i: a * b for i, (a, b) in sizes.items()}
    huge = spark.createDataFrame([(1, 3_000_000_000)], "id int, n long")
    assert [tuple(r) for r in repeat_rows(huge, "n").limit(3).collect()] == [(1,)] * 3
    # The copies of a row are not all made, and held, by one compiled stage ("*" marks those).
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = [x for x in plan_text(repeat_rows(df, "a", "b")).splitlines() if "Generate" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(steps) == 2 and "*(" in steps[0] and "*(" not in steps[1]


def test_incomplete_rides_are_left_out_before_the_lookup(spark):
    from odflow.operators.segments import on_off
    rides, seg = _rides_and_segments(spark)
    other = rides.withColumns({"board_segment": F.lit("x"), "alight_segment": F.lit("y")})
    assert "LeftOuter" not in plan_text(on_off(attach_segments(rides, seg), other))


def test_trip_direction_cases(spark):
    stops = spark.createDataFrame(
        [(1, 10, 0, 1), (1, 20, 0, 5), (1, 10, 1, 9), (1, 20, 1, 2), (1, 30, 0, 7)],
        "line_id int, site_id long, direction_number int, stop_sequence_number int")
    rides = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 20, 10), (3, 1, 10, 30), (4, 1, 10, 99)],
                                  "event_id int, line_id int, board_site long, alight_site long")
    got = {r.event_id: (r.inferred_dir, r.orig_site) for r in trip_direction(rides, stops).collect()}
    assert got == {1: (0, 10), 2: (1, 10), 3: (0, 10), 4: (None, None)}


def _square_layer(spark, zones):
    rows = []
    for z, (x0, y0, s) in zones.items():
        for i, (x, y) in enumerate([(x0, y0), (x0 + s, y0), (x0 + s, y0 + s), (x0, y0 + s)]):
            rows.append((z, i, float(x), float(y)))
    return layer_from_vertices(spark.createDataFrame(rows, "zone_id int, seq int, x double, y double"))


def test_locate_shared_border_lowest_id(spark):  # C8
    lay = _square_layer(spark, {5: (0, 0, 1), 3: (1, 0, 1)})
    pts = spark.createDataFrame([(1.0, 0.5), (0.5, 0.5), (5.0, 5.0)], "lon double, lat double")
    got = sorted((r.lon, r.zone_id) for r in locate(pts, lay, "lon", "lat", cell=0.5).collect())
    assert got == [(0.5, 5), (1.0, 3)]


def test_locate_matches_brute_force(spark):
    rnd = random.Random(7)
    verts = []
    for z in range(12):
        cx, cy, n = rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.randint(3, 7)
        import math
        angs = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        for i, a in enumerate(angs):
            r = rnd.uniform(0.5, 2.5)
            verts.append((z, i, cx + r * math.cos(a), cy + r * math.sin(a)))
    vdf = spark.createDataFrame(verts, "zone_id int, seq int, x double, y double")
    lay = layer_from_vertices(vdf)
    pts = spark.createDataFrame([(i, rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for i in range(1500)],
                                "pid int, lon double, lat double")
    fast = {r.pid: r.zone_id for r in locate(pts, lay, "lon", "lat").collect()}
    from odflow.functions.geo import inside_ring
    brute = (pts.crossJoin(lay).where(inside_ring("edges", "lon", "lat"))
             .groupBy("pid").agg(F.min("zone_id").alias("z")).collect())
    assert fast == {r.pid: r.z for r in brute}
    plan = plan_text(locate(pts, lay, "lon", "lat", cell=1.0))
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_both_ends_in_box_counted_per_end(spark):  # C6
    lay = _square_layer(spark, {1: (0, 0, 1)})
    trips = spark.createDataFrame([(1, 0.2, 0.2, 0.8, 0.8)],
                                  "id int, o_lon double, o_lat double, d_lon double, d_lat double")
    out = individual_trips(trips, lay, direction="both", keep=["id"], route="id")
    assert sorted(r.role for r in out.collect()) == ["dest", "orig"]


def test_overlapping_boxes_count_once_per_box(spark):  # C7
    clicks = spark.createDataFrame(
        [(b, i, float(x), float(y)) for b, pts in {1: [(0, 0), (2, 0), (2, 2), (0, 2)],
                                                  2: [(1, 1), (3, 1), (3, 3), (1, 3)]}.items()
         for i, (x, y) in enumerate(pts)], "box_id int, seq int, lon double, lat double")
    boxes = boxes_from_points(clicks)
    zones = _square_layer(spark, {9: (10, 10, 5)})
    trips = spark.createDataFrame([(1.5, 1.5, 12.0, 12.0, 2.0, 1.0)],
                                  "o_lon double, o_lat double, d_lon double, d_lat double, w double, m double")
    h = box_heat(trips, boxes, zones).collect()
    assert [(r.dest, r.N) for r in h] == [(9, 4.0)]


def test_full_cells_skip_ring_but_stay_exact(spark):
    from odflow.operators.locate import cell_index
    lay = _square_layer(spark, {1: (0, 0, 4), 2: (4, 0, 4)})
    idx = cell_index(lay, 0.5).leaves.select(F.explode("_cands").alias("z"))
    stats = idx.agg(F.sum(F.col("z.full").cast("int")).alias("full"), F.count("*").alias("n")).first()
    assert stats.full > 0 and stats.full < stats.n
    rnd = random.Random(11)
    pts = spark.createDataFrame([(i, rnd.uniform(-1, 9), rnd.uniform(-1, 5)) for i in range(2000)]
                                + [(5000, 4.0, 2.0), (5001, 0.0, 0.0)], "pid int, lon double, lat double")
    got = {r.pid: r.zone_id for r in locate(pts, lay, "lon", "lat", cell=0.5).collect()}
    want = {r.pid: (1 if 0 <= r.lon <= 4 else 2) for r in pts.collect()
            if 0 <= r.lon <= 8 and 0 <= r.lat <= 4}
    assert got == want


def test_locate_many_vertex_polygons_match_whole_ring_test(spark):
    import math
    from odflow.functions.geo import inside_ring
    rnd = random.Random(5)
    verts = []
    for z in range(6):
        cx, cy, n = rnd.uniform(2, 8), rnd.uniform(2, 8), rnd.randint(40, 90)
        for i in range(n):  # star-shaped, strongly non-convex rings
            a = 2 * math.pi * i / n
            r = 2.5 if i % 2 == 0 else rnd.uniform(0.4, 1.5)
            verts.append((z, i, cx + r * math.cos(a), cy + r * math.sin(a)))
    lay = layer_from_vertices(spark.createDataFrame(verts, "zone_id int, seq int, x double, y double"))
    pts = spark.createDataFrame([(i, rnd.uniform(0, 10), rnd.uniform(0, 10)) for i in range(4000)],
                                "pid int, lon double, lat double")
    for cell in (None, 0.2, 1.3):
        fast = {(r.pid, r.zone_id) for r in locate(pts, lay, "lon", "lat", how="all", cell=cell).collect()}
        brute = {(r.pid, r.zone_id) for r in
                 pts.crossJoin(lay).where(inside_ring("edges", "lon", "lat")).collect()}
        assert fast == brute


def test_locate_never_shuffles_points(spark):
    from odflow.operators.locate import cell_index
    lay = _square_layer(spark, {1: (0, 0, 4), 2: (4, 0, 4)})
    # a hot spot: a third of all points in one cell
    rows = [(i, 0.3, 0.3) for i in range(300)] + [(1000 + i, (i % 80) * 0.1, (i % 40) * 0.1) for i in range(600)]
    pts = spark.createDataFrame(rows, "pid int, lon double, lat double")
    located = locate(pts, lay, "lon", "lat", cell=0.5)
    assert located.count() == located.select("pid").distinct().count()
    plan = plan_text(located)
    assert plan.count("Exchange hashpartitioning") == 0 and "BroadcastHashJoin" in plan


def test_locate_by_shuffle_gives_the_same(spark):
    # A layer the planner will not broadcast: the points meet the index in a sort-merge join.
    lay = _square_layer(spark, {z: (z % 20, z // 20, 1) for z in range(200)})
    pts = spark.createDataFrame([(i, 0.3, 0.3) for i in range(2000)] + [(5000 + i, (i % 190) * 0.1 + 0.05, (i % 90) * 0.1 + 0.03) for i in range(3000)]
                                + [(9000 + i, None, 1.0) for i in range(200)], "pid int, lon double, lat double")
    want = {r.pid: r.zone_id for r in locate(pts, lay, "lon", "lat", keep_unmatched=True).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = locate(pts, lay, "lon", "lat", keep_unmatched=True)
        assert "SortMergeJoin" in plan_text(out)
        assert {r.pid: r.zone_id for r in out.collect()} == want and len(want) == 5200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_huge_and_many_tiny_polygons(spark):
    zones = {0: (0, 0, 40)} | {z: (z % 30 + 0.2, z // 30 + 0.2, 0.5) for z in range(1, 300)}
    lay = _square_layer(spark, zones)
    rnd = random.Random(12)
    pts = spark.createDataFrame([(i, rnd.uniform(-1, 41), rnd.uniform(-1, 41)) for i in range(1500)]
                                + [(2000 + i, rnd.uniform(0, 30), rnd.uniform(0, 10)) for i in range(1500)], "pid int, lon double, lat double")
    got = {(r.pid, r.zone_id) for r in locate(pts, lay, "lon", "lat", how="all").collect()}
    want = {(r.pid, z) for r in pts.collect() for z, (x, y, s) in zones.items() if x <= r.lon <= x + s and y <= r.lat <= y + s}
    assert got == want


def test_parts_holes_and_missing_points(spark):
    ring = lambda z, p, h, pts: [(z, p, h, i, float(x), float(y), f"name {z}") for i, (x, y) in enumerate(pts)]
    rows = (ring(1, 1, False, [(0, 0), (4, 0), (4, 4), (0, 4)]) + ring(1, 2, True, [(1, 1), (2, 1), (2, 2), (1, 2)])
            + ring(2, 1, False, [(5, 0), (6, 0), (6, 1), (5, 1)]) + ring(2, 2, False, [(8, 0), (9, 0), (9, 1), (8, 1)]))
    lay = layer_from_vertices(spark.createDataFrame(rows, "zone_id int, part int, hole boolean, seq int, x double, y double, name string"),
                              part="part", hole="hole", attrs=["name"])
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.5, 0.5), (4, 7.0, 0.5), (5, 8.5, 0.9), (6, float("nan"), 0.5),
                                 (7, None, 0.5), (8, 0.5, float("nan"))], "pid int, lon double, lat double")
    got = {r.pid: (r.zone_id, r.label) for r in locate(pts, lay, "lon", "lat", carry={"name": "label"}).collect()}
    assert got == {1: (1, "name 1"), 3: (2, "name 2"), 5: (2, "name 2")}
    kept = locate(pts, lay, "lon", "lat", keep_unmatched=True)
    assert kept.count() == 8 and kept.where("zone_id IS NULL").count() == 5


def test_missing_weight_in_one_box_removes_the_zone(spark):
    clicks = spark.createDataFrame(
        [(b, i, float(x), float(y)) for b, pts in {1: [(0, 0), (1, 0), (1, 1), (0, 1)], 2: [(2, 0), (3, 0), (3, 1), (2, 1)]}.items()
         for i, (x, y) in enumerate(pts)], "box_id int, seq int, lon double, lat double")
    zones = _square_layer(spark, {9: (10, 10, 5), 8: (20, 20, 5)})
    trips = spark.createDataFrame([(0.5, 0.5, 12.0, 12.0, None, 1.0), (2.5, 0.5, 12.0, 12.0, 2.0, 1.0), (2.5, 0.5, 21.0, 21.0, 3.0, 1.0)],
                                  "o_lon double, o_lat double, d_lon double, d_lat double, w double, m double")
    assert [(r.dest, r.N) for r in box_heat(trips, boxes_from_points(clicks), zones).collect()] == [(8, 3.0)]


def test_small_samples_with_facet_equal_to_x(spark):
    t = spark.createDataFrame([("a", "b", 1, 1.0)], "x string, y string, obs int, N double")
    assert small_samples(t, "x", "y", "x").columns == ["x", "obs"]


def test_pair_counts_equal_fanout_counts(spark):
    from odflow.operators.segments import on_off, pair_counts
    rnd = random.Random(2)
    seg = spark.createDataFrame([(rnd.randint(0, 9), rnd.randint(0, 2), rnd.choice(["A", "B", None]))
                                 for _ in range(40)], "site_id long, line_id int, segment string")
    rides = spark.createDataFrame([(i, rnd.randint(0, 2), rnd.randint(0, 11), rnd.randint(0, 11),
                                    rnd.choice(["NB", None]), "AM") for i in range(500)],
                                  "id int, line_id int, board_site long, alight_site long, dir string, time_period string")
    fan = on_off(attach_segments(rides, seg)).groupBy("line_id", "board_segment", "alight_segment").count()
    want = {(r.line_id, r.board_segment, r.alight_segment): r["count"] for r in fan.collect()}
    got = {(r.line_id, r.board_segment, r.alight_segment): r.N for r in pair_counts(rides, seg).collect()}
    assert got == want and len(got) > 3


def test_classify_seq_sets_and_band_overlap(spark):
    from odflow.operators.segments import at_seqs
    stops = spark.createDataFrame([(4, 0, s, 100 + s, "N") for s in range(1, 11)],
                                  "line_id int, direction_number int, stop_sequence_number int, "
                                  "site_id long, site_downtown_zone string")
    rules = [band(4, 0, 1, 10, "A"), at_seqs(4, 0, [2, 9], "B"), band(4, 0, 9, 9, "C")]
    got = {r.stop_sequence_number: r.segment for r in classify_stops(stops, rules).collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: "A", 5: "A", 6: "A", 7: "A", 8: "A", 9: "C", 10: "A"}
