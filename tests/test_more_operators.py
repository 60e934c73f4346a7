"""Remaining operators of the inventory on small in-memory tables."""

from pyspark.sql import functions as F

from odflow.functions.text import flow_label, percent_text
from odflow.operators.clean import (
    apply_overrides, assign_rules, cols_between, cols_like, direction_of, map_cols,
)
from odflow.operators.codebook import infer_domain, order_by_levels
from odflow.operators.density import smoothed_density
from odflow.operators.filters import filter_in, select_zones
from odflow.operators.flows import intensity, od_heat, with_reverse
from odflow.operators.geometry_layer import boxes_from_points, zone_centroids
from odflow.operators.joins import attach_centroids, attach_route_type, records_in
from odflow.operators.lines import points_to_line, trip_lines
from odflow.operators.locate import zone_at
from odflow.operators.panel import panel_flows
from odflow.operators.segments import segment_flow
from odflow.sources.io import read_stop_sequence


def test_column_pickers_and_map(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "ID int, TRIP_PURPOSE_X string, TRIP_PURPOSE_Y string, Z string")
    assert cols_like(df, "TRIP_PURPOSE_*") == ["TRIP_PURPOSE_X", "TRIP_PURPOSE_Y"]
    assert cols_between(df, "TRIP_PURPOSE_Y", "Z") == ["TRIP_PURPOSE_Y", "Z"]
    assert map_cols(df, ["Z"], F.upper).first().Z == "C"


def test_assign_rules_last_wins(spark):
    df = spark.createDataFrame([(3,), (20,), (50,)], "s int")
    out = assign_rules(df, "k", [(F.col("s") > 10, "M"), (F.col("s") > 40, "L"), (F.col("s") < 5, "S")])
    assert [r.k for r in out.collect()] == ["S", "M", "L"]


def test_direction_of(spark):
    df = spark.createDataFrame([("10 Central Av [NB]",), ("XLINE Southbound",), ("x",)], "d string")
    got = [r.v for r in df.select(direction_of("d", {"XLINE Southbound": "SB"}).alias("v")).collect()]
    assert got == ["NB", "SB", None]


def test_apply_overrides(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "ID int, lat string, w double")
    ov = spark.createDataFrame([(2, "fixed")], "ID int, lat string")
    assert sorted((r.ID, r.lat) for r in apply_overrides(df, ov, "ID", ["lat"]).collect()) == [(1, "a"), (2, "fixed")]


def _unit_square_layer(spark):
    rows = [(4, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    return boxes_from_points(spark.createDataFrame(rows, "box_id int, seq int, lon double, lat double"))


def test_zone_at_and_centroid(spark):
    lay = _unit_square_layer(spark)
    assert [r.zone_id for r in zone_at(spark, 0.5, 0.5, lay).collect()] == [4]
    assert zone_at(spark, 5.0, 5.0, lay).count() == 0
    c = zone_centroids(lay).first()
    assert abs(c.lon - 0.5) < 1e-12 and abs(c.lat - 0.5) < 1e-4


def test_read_stop_sequence_joins(spark):
    seq = spark.createDataFrame([(1, 10, 0, 1), (1, 11, 0, 2)], "line_id int, site_id int, direction_number int, stop_sequence_number int")
    site = spark.createDataFrame([(10, "Y"), (12, "N")], "site_id int, site_downtown_zone string")
    rs = spark.createDataFrame([(10, 1), (10, 1)], "site_id int, line_id int")
    line = spark.createDataFrame([(1, "L1")], "line_id int, name string")
    joined, star = read_stop_sequence(seq, site, rs, line)
    assert joined.count() == 1 and star.count() == 1


def test_intensity_and_heat(spark):
    flows = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0)], "orig int, dest int, N double")
    h = {r.dest: r.intensity for r in od_heat(flows).collect()}
    assert h == {2: 0.5, 3: 0.5}
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "colN double")
    assert [r.intensity for r in intensity(df).orderBy("colN").collect()] == [0.0, 0.5, 1.0]


def test_with_reverse_roles(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2, 1.0, 1.0)], "orig int, orig_lat double, orig_lon double, dest int, dest_lat double, dest_lon double")
    out = sorted((r.role, r.orig, r.dest, r.orig_lat) for r in with_reverse(df, role="role").collect())
    assert out == [("dest", 2, 1, 1.0), ("orig", 1, 2, 0.0)]


def test_filter_in_long_list_same_as_isin(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    vals = list(range(0, 3000, 2))
    assert filter_in(df, {"k": vals}).count() == 1500
    assert filter_in(df, {"k": None}).count() == 3000 and filter_in(df, {"k": []}).count() == 0


def test_select_zones_exclude_keeps_null_dest(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (1, None), (3, 1)], "orig int, dest int")
    assert sorted(str(r.dest) for r in select_zones(df, [1], exclude_self=True).collect()) == ["2", "None"]


def test_panel_flows_all_missing_is_zero_and_unmatched_kept(spark):
    panel = spark.createDataFrame([(1, 99, "0", "wd", None)], "o_zone int, d_zone int, day_part string, day_type string, idx double")
    pts = spark.createDataFrame([(1, 0.5, 0.5)], "zone_id int, cx double, cy double")
    r = panel_flows(panel, pts, ["0"], "wd", selection=[1]).first()
    assert r.N == 0.0 and r.dest_lon is None and r.orig_lon == 0.5


def test_attach_centroids_left(spark):
    df = spark.createDataFrame([(1, 2)], "orig int, dest int")
    pts = spark.createDataFrame([(1, 0.1, 0.2)], "zone_id int, cx double, cy double")
    r = attach_centroids(df, pts).first()
    assert (r.orig_lon, r.orig_lat, r.dest_lon) == (0.1, 0.2, None)


def test_smoothed_density_conserves_mass(spark):
    pts = spark.createDataFrame([(0.005 * i, 0.003 * i, 1) for i in range(50)], "lon double, lat double, route int")
    tot = smoothed_density(pts, "lon", "lat", cell=0.01).agg(F.sum("density")).first()[0]
    assert abs(tot - 50) < 1e-9


def test_segment_flow_levels_keep_rows(spark):
    rides = spark.createDataFrame([(1, "A", "Q", "AM", "NB"), (1, "A", "R", "AM", "NB"), (1, "B", "A", "PM", "SB")],
                                  "line_id int, board_segment string, alight_segment string, time_period string, dir string")
    out = segment_flow(rides, 1, period="AM", direction="Any", levels=["B", "A"]).collect()
    assert sorted((r.board_segment, r.alight_segment, r.N, r.board_ord) for r in out) == \
        [("A", None, 1, 2), ("A", None, 1, 2)]


def test_domain_and_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert [(r.value, r.ord) for r in infer_domain(df, "v").orderBy("ord").collect()] == [("a", 1), ("b", 2)]
    t = spark.createDataFrame([("x", 2), ("y", None), ("z", 1)], "v string, v_ord int")
    assert [r.v for r in order_by_levels(t, ["v"]).collect()] == ["z", "x", "y"]


def test_lines(spark):
    pts = spark.createDataFrame([(1, 2, 0.0, 0.0), (1, 1, 1.0, 1.0), (2, 1, 5.0, 5.0)], "id int, s int, lon double, lat double")
    l1 = {r.id: [(p.lon, p.lat) for p in r.vertices] for r in points_to_line(pts, "lon", "lat", "id", "s").collect()}
    assert l1 == {1: [(1.0, 1.0), (0.0, 0.0)], 2: [(5.0, 5.0)]}
    trips = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0), (2, None, 1.0, 2.0, 3.0)],
                                  "id int, o_lon double, o_lat double, d_lon double, d_lat double")
    assert [(r.vertex, r.lon) for r in trip_lines(trips, ["id"], explode=True).collect()] == [(0, 0.0), (1, 2.0)]


def test_route_type_lookup_and_semi(spark):
    trips = spark.createDataFrame([("4 Market",), ("COAST way",), ("31 Hill",)], "ROUTE_SURVEYED string")
    classes = spark.createDataFrame([(4.0, "Street")], "Route double, RouteType string")
    out = attach_route_type(trips, classes, named=["COAST"], renamed={"31": "Harbour boat"}).collect()
    assert sorted((r.route, r.RouteType) for r in out) == [("31", "Harbour boat"), ("4", "Street"), ("COAST", "COAST")]
    ids = spark.createDataFrame([(1,), (1,)], "ID int")
    assert records_in(spark.createDataFrame([(1,), (2,)], "ID int"), ids, "ID").count() == 1


def test_labels(spark):
    df = spark.createDataFrame([(1, 2, 12.6, 0.1234)], "o int, d int, n double, s double")
    r = df.select(flow_label("o", "d", "n").alias("l"), percent_text("s").alias("p")).first()
    assert (r.l, r.p) == ("1 to 2: 13", "12.3%")


def test_label_of_and_thousands(spark):
    from odflow.functions.text import thousands
    from odflow.operators.codebook import label_of
    df = spark.createDataFrame([("R", 12345.6), ("Z", 7.0)], "c string, v double")
    out = label_of(df, "c", {"R": "Returned"}).select("c_label", thousands("v").alias("t")).collect()
    assert [(r.c_label, r.t) for r in out] == [("Returned", "12,346"), (None, "7")]
