"""Properties of SURVEY 5.3 on generated inputs (few examples: each one runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odflow.functions.weights import na_sum
from odflow.operators.crosstab import add_share, crosstab
from odflow.operators.geometry_layer import layer_from_vertices
from odflow.operators.locate import locate

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("uvw"),
                             st.floats(min_value=0.5, max_value=50, allow_nan=False)),
                   min_size=1, max_size=40)


@SETTINGS
@given(rows=rows_st)
def test_shares_sum_to_one_per_x(spark, rows):
    t = spark.createDataFrame(rows, "x string, y string, w double").withColumn("m", F.lit(1.0))
    sh = add_share(crosstab(t, "x", "y"), "x", "y")
    sums = {r.x: r.s for r in sh.groupBy("x").agg(F.sum("share").alias("s")).collect()}
    assert all(abs(v - 1.0) < 1e-9 for v in sums.values())


@SETTINGS
@given(vals=st.lists(st.one_of(st.none(), st.integers(-100, 100)), min_size=1, max_size=30))
def test_na_sum_matches_reference(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = df.agg(na_sum("v").alias("s")).first().s
    want = None if any(v is None for v in vals) else sum(vals)
    assert got == want


@SETTINGS
@given(pts=st.lists(st.tuples(st.floats(-1, 5, allow_nan=False), st.floats(-1, 5, allow_nan=False)),
                    min_size=1, max_size=60))
def test_located_points_never_exceed_points(spark, pts):
    verts = [(z, i, float(x), float(y)) for z, sq in {1: [(0, 0), (2, 0), (2, 2), (0, 2)],
                                                      2: [(2, 0), (4, 0), (3, 3)]}.items()
             for i, (x, y) in enumerate(sq)]
    lay = layer_from_vertices(spark.createDataFrame(verts, "zone_id int, seq int, x double, y double"))
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "pid int, lon double, lat double")
    out = locate(p, lay, "lon", "lat", cell=0.7)
    n = out.count()
    assert n <= len(pts) and n == out.select("pid").distinct().count()
