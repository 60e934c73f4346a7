"""Batch with committed stages, mergeable box state, clustered layouts, summaries by month, lists and clusters."""

import os
import random

import pytest
from pyspark.sql import functions as F

from odflow.operators.box_state import box_state, flows_from_state, heat_from_state
from odflow.operators.density import cluster_pyramid
from odflow.operators.filters import options, options_all
from odflow.operators.geometry_layer import layer_from_vertices
from odflow.operators.joins import attach_weights
from odflow.operators.lines import line_vertices, points_to_line
from odflow.operators.panel import panel_flows, read_panel_summary, write_panel_summary
from odflow.operators.segments import band, correct_direction, orient_points
from odflow.operators.selection import box_flows, box_heat
from odflow.plans.batch import Stage, preparation, run_stages
from odflow.sources.clustered import read_box, write_bucketed, write_clustered
from tests.conftest import plan_text


def squares(spark, zones):
    rows = [(z, i, float(x), float(y)) for z, (x0, y0, s) in zones.items()
            for i, (x, y) in enumerate([(x0, y0), (x0 + s, y0), (x0 + s, y0 + s), (x0, y0 + s)])]
    return layer_from_vertices(spark.createDataFrame(rows, "zone_id int, seq int, x double, y double"))


def stages_of(spark, calls, fail=()):
    def stage(name, needs, make):
        def run(t):
            calls.append(name)
            if name in fail:
                raise RuntimeError("killed")
            return make(t)
        return Stage(name, [name], run, needs, "k1")

    return [stage("a", [], lambda t: {"a": spark.range(10)}),
            stage("b", ["a"], lambda t: {"b": t["a"].withColumn("x", F.col("id") * 2)}),
            stage("c", ["a", "b"], lambda t: {"c": t["a"].join(t["b"], "id")})]


def test_batch_skips_committed_stages_after_a_kill(spark, tmp_path):
    root, calls = str(tmp_path / "batch"), []
    with pytest.raises(RuntimeError):
        run_stages(spark, root, stages_of(spark, calls, fail={"c"}))
    assert calls == ["a", "b", "c"]
    calls.clear()
    out = run_stages(spark, root, stages_of(spark, calls))
    assert calls == ["c"] and out["c"].agg(F.sum("x")).first()[0] == 90
    calls.clear()
    run_stages(spark, root, stages_of(spark, calls))
    assert calls == []
    # A changed stage runs again with what depends on it, and nothing else.
    changed = stages_of(spark, calls)
    changed[1] = Stage("b", ["b"], changed[1].make, ["a"], "k2")
    run_stages(spark, root, changed)
    assert calls == ["b", "c"]


def test_table_without_manifest_row_is_not_seen(spark, tmp_path):
    root, calls = str(tmp_path / "batch"), []

    def half(t):
        calls.append("half")
        return {"a": spark.range(3), "b": spark.range(3).select(F.raise_error(F.lit("killed while writing")).alias("x"))}

    with pytest.raises(Exception, match="killed while writing"):
        run_stages(spark, root, [Stage("half", ["a", "b"], half)])
    done = run_stages(spark, root, [Stage("half", ["a", "b"], lambda t: {"a": spark.range(4), "b": spark.range(5)})])
    assert (done["a"].count(), done["b"].count(), calls) == (4, 5, ["half"])


def test_preparation_writes_all_tables(spark, tmp_path):
    raw = spark.createDataFrame([("1", "x", 0.5, 0.5, 1.5, 0.5, 0.6, 0.5, 1.4, 0.5), ("2", "", 0.5, 0.5, None, None, 0.1, 0.1, 0.2, 0.2)],
                                "ID string, t string, o_lon double, o_lat double, d_lon double, d_lat double, "
                                "b_lon double, b_lat double, a_lon double, a_lat double")
    stops = spark.createDataFrame([(1, 0, 5, 7, "N"), (1, 0, 9, 8, "Y")],
                                  "line_id int, direction_number int, stop_sequence_number int, site_id bigint, site_downtown_zone string")
    rides = spark.createDataFrame([(1, 1, 7, 8, "NB", "am")], "ride int, line_id int, board_site bigint, alight_site bigint, dir string, time_period string")
    panel = spark.createDataFrame([(1, 2, 3.0), (9, 2, 1.0)], "o_zone int, d_zone int, idx double")
    t = run_stages(spark, str(tmp_path), preparation(raw, "ID", squares(spark, {1: (0, 0, 1), 2: (1, 0, 1)}), stops, [band(1, 0, 0, 6, "A")],
                                                     [rides], panel, keep=["ID", "t"]))
    assert {(r.ID, r.Type, r.lon, r.ba_lon) for r in t["trip_ends"].collect()} == {
        ("1", "Orig", 0.5, 0.6), ("1", "Dest", 1.5, 1.4), ("2", "Orig", 0.5, 0.1), ("2", "Dest", None, 0.2)}
    assert t["od_lines"].count() == 2 and t["ba_lines"].count() == 4
    assert [(r.board_segment, r.alight_segment) for r in t["rides"].collect()] == [("A", "downtown")]
    assert {(r.ID, r.t, r.orig, r.dest) for r in t["zone_trips"].collect()} == {("1", "x", 1, 2), ("2", None, 1, None)}
    assert {(r.o_zone, r.orig_lon is None) for r in t["panel"].collect()} == {(1, False), (9, True)}


def test_preparation_keeps_identical_rides_once_with_their_number(spark, tmp_path):
    raw = spark.createDataFrame([("1", *[0.5] * 8)], "ID string, " + ", ".join(f"{e}_{c} double" for e in "odba" for c in ("lon", "lat")))
    stops = spark.createDataFrame([(1, 0, s, s % 2, "N") for s in range(40)],
                                  "line_id int, direction_number int, stop_sequence_number int, site_id bigint, site_downtown_zone string")
    rides = spark.createDataFrame([(i, 1, 0, 1, "NB", "am") for i in range(3)],
                                  "ride int, line_id int, board_site bigint, alight_site bigint, dir string, time_period string")
    panel = spark.createDataFrame([], "o_zone int, d_zone int, idx double")
    t = run_stages(spark, str(tmp_path), preparation(raw, "ID", squares(spark, {1: (0, 0, 1)}), stops, [band(1, 0, 0, 29, "A"), band(1, 0, 30, 35, "B")],
                                                     [rides], panel, keep=["ID"]))
    got = {(r.ride, r.board_segment, r.alight_segment): r.copies for r in t["rides"].collect()}
    assert got == {(i, b, a): m * n for i in range(3) for b, m in (("A", 15), ("B", 3)) for a, n in (("A", 15), ("B", 3))}
    assert t["rides"].count() == len(got)


def test_boxes_come_and_go_without_the_others(spark):
    rnd = random.Random(1)
    trips = spark.createDataFrame([(rnd.uniform(0, 4), rnd.uniform(0, 4), rnd.uniform(10, 14), rnd.uniform(10, 14),
                                    None if rnd.random() < 0.02 else float(rnd.randint(1, 9)), 1.0) for _ in range(600)],
                                  "o_lon double, o_lat double, d_lon double, d_lat double, w double, m double")
    zones = squares(spark, {z: (10 + z % 4, 10 + z // 4, 1) for z in range(16)})
    every = {1: (0, 0, 2), 2: (1, 1, 2), 3: (3, 3, 1)}
    one = {b: box_state(trips, squares(spark, {b: s}), zones) for b, s in every.items()}
    state, drawn = None, {}
    for b in every:
        state = one[b] if state is None else state.unionByName(one[b])
        drawn[b] = every[b]
        assert_same(heat_from_state(state, 3), box_heat(trips, squares(spark, drawn), zones, min_n=3))
    left = state.where("box_id <> 2")
    kept = squares(spark, {b: s for b, s in every.items() if b != 2})
    assert_same(heat_from_state(left, 3), box_heat(trips, kept, zones, min_n=3))
    assert_same(flows_from_state(left, 3), box_flows(trips, kept, zones, min_n=3))


def assert_same(a, b):
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(b.columns)).collect())
    assert rows(a) == rows(b)


def test_clustered_table_prunes_files(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(3000)] + [(9000, None, 0.1), (9001, float("nan"), 0.1)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    write_clustered(df, str(tmp_path / "c"), "lon", "lat", tile=0.25)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3002
    got = read_box(spark, str(tmp_path / "c"), "lon", "lat", (-0.1, 0.2, 0.3, 0.45), tile=0.25)
    assert {r.id for r in got.collect()} == {i for i, x, y in rows if x is not None and -0.1 <= x <= 0.2 and 0.3 <= y <= 0.45}
    plan = plan_text(got)
    assert "PartitionFilters: [isnotnull(tile_x" in plan.replace("\n", "")
    read = got.select(F.input_file_name().alias("f")).distinct().count()
    total = sum(f.endswith(".parquet") for _, _, files in os.walk(tmp_path / "c") for f in files)
    assert read <= 4 < total / 10


def test_bucketed_tables_join_without_an_exchange(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    t = write_bucketed(spark.range(1000).selectExpr("id % 300 AS ID", "id AS leg"), "bucketed_t", ["ID"], 4)
    w = write_bucketed(spark.range(200).selectExpr("id AS ID", "id * 2 AS w"), "bucketed_w", ["ID"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_weights(t, w, "ID")
        assert "Exchange" not in plan_text(joined) and "SortMergeJoin" in plan_text(joined)
        assert joined.count() == 1000 and joined.where("w IS NULL").count() == sum(i % 300 >= 200 for i in range(1000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("bucketed_t", "bucketed_w"):
            spark.sql(f"DROP TABLE {name}")


def test_late_month_replaces_its_partition_only(spark, tmp_path):
    rows = [(m, o, d, "weekday", "0", None if o == 3 else float(m + o + d)) for m in (1, 2, 3) for o in (1, 2, 3) for d in (1, 2)]
    panel = spark.createDataFrame(rows, "month int, o_zone int, d_zone int, day_type string, day_part string, idx double")
    path, points = str(tmp_path / "p"), squares(spark, {1: (0, 0, 1), 2: (1, 0, 1)})
    write_panel_summary(panel.where("month <> 2"), path)
    write_panel_summary(panel.where("month = 2").withColumn("idx", F.lit(100.0)), path)
    files = lambda m: sorted(os.listdir(f"{path}/month={m}"))
    before = {m: files(m) for m in (1, 2, 3)}
    write_panel_summary(panel.where("month = 2"), path)
    assert files(1) == before[1] and files(3) == before[3] and files(2) != before[2]
    full = panel_flows(panel, points, ["0"], "weekday")
    assert_same(panel_flows(read_panel_summary(spark, path), points, ["0"], "weekday"), full)
    assert full.where("orig = 3 AND N = 0").count() == 2
    assert_same(panel_flows(read_panel_summary(spark, path, [2]), points, ["0"], "weekday"),
                panel_flows(panel.where("month = 2"), points, ["0"], "weekday"))


def test_lists_of_a_cascade_equal_single_lists(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([tuple(rnd.choice("abc") if rnd.random() < 0.9 else None for _ in range(3)) for _ in range(60)], "x string, y string, z string")
    cascade = [("x", ["a", "b"]), ("y", []), ("z", None)]
    for cascade in ([("x", ["a", "b"]), ("y", ["c"]), ("z", None)], [("x", None), ("y", ["a"]), ("z", ["b"])], [("x", []), ("y", None), ("z", None)]):
        got = {(r.step, r.value) for r in options_all(df, cascade).collect()}
        want = {(k, r.value) for k, (v, _) in enumerate(cascade) for r in options(df, v, dict(cascade[:k])).collect()}
        assert got == want
    with_domain = options_all(df, [("x", None)], {"x": ["c", "a"]})
    assert {(r.value, r.ord) for r in with_domain.collect()} == {("c", 1), ("a", 2)}
    assert plan_text(options_all(df, cascade)).count("Exchange") == 1


def test_clusters_nest(spark):
    rnd = random.Random(5)
    pts = spark.createDataFrame([(rnd.gauss(-93, 0.1), rnd.gauss(45, 0.1), 1) for _ in range(500)] + [(None, 1.0, 1)], "lon double, lat double, route int")
    t = cluster_pyramid(pts, "lon", "lat", (6, 11))
    assert {r.n for r in t.groupBy("zoom").agg(F.sum("n").alias("n")).collect()} == {500}
    children = t.where("parent_gx IS NOT NULL").groupBy((F.col("zoom") - 1).alias("zoom"), F.col("parent_gx").alias("gx"), F.col("parent_gy").alias("gy")) \
        .agg(F.sum("n").alias("m"), (F.sum(F.col("n") * F.col("lon")) / F.sum("n")).alias("x"))
    j = t.where("zoom < 11").join(children, ["zoom", "gx", "gy"], "left")
    assert j.where("n <> m OR m IS NULL OR abs(lon - x) > 1e-9").count() == 0


def test_vertices_of_a_hot_id(spark):
    pts = spark.range(60_000).selectExpr("if(id % 3 = 0, 1, cast(id % 50 AS int)) AS k", "cast(pmod(id * 7919, 60011) AS int) AS s",
                                         "cast(id AS double) AS lon", "0.5D AS lat")
    out = line_vertices(pts, "lon", "lat", "k", "s")
    assert "collect_list" not in plan_text(out)
    arrays = {r.k: [v.lon for v in r.vertices] for r in points_to_line(pts, "lon", "lat", "k", "s").collect()}
    rows = {}
    for r in out.collect():
        rows.setdefault(r.k, {})[r.vertex] = r.lon
    assert {k: [v[i] for i in range(len(v))] for k, v in rows.items()} == arrays


def test_directions_are_corrected_once_per_rule(spark):
    rows = [(1, 7, 0, 5.0, 2.0), (2, 7, 1, 5.0, 2.0), (3, 7, 0, 2.0, 5.0), (4, 8, 0, 5.0, 2.0), (5, 8, 1, 1.0, 2.0), (6, 7, -999, 5.0, 2.0),
            (7, 7, None, None, None), (8, 7, 0, 5.0, 2.0)]
    df = spark.createDataFrame([(*r, 1.0, 2.0, 3.0, 4.0) for r in rows],
                               "ID int, line_id int, inferred_dir int, board_seq double, alight_seq double, o_lon double, o_lat double, d_lon double, d_lat double")
    got = {r.ID: (r.inferred_dir, r.orig_new_lon, r.dest_new_lat) for r in orient_points(correct_direction(df, [7], [5, 8, 6])).collect()}
    assert got == {1: (1, 3.0, 2.0), 2: (0, 1.0, 4.0), 3: (0, 1.0, 4.0), 4: (0, 1.0, 4.0), 5: (0, 1.0, 4.0), 6: (-999, 3.0, 2.0),
                   7: (None, None, None), 8: (0, 1.0, 4.0)}
