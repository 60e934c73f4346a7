"""Column helpers and the R-versus-Spark semantics of SURVEY 1.1 (FIXTURES part C)."""

import math

from pyspark.sql import functions as F

from odflow.functions import (
    concat_parts, first_token, great_circle_params, great_circle_vertices, inside_ring,
    na_sum, remap, ring_centroid_mercator, to_number,
)
from odflow.operators.codebook import apply_codebook, collapse_flags
from odflow.operators.filters import exclude_ids


def test_na_sum_propagates_null(spark):  # C1
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, w double")
    got = {r.g: r.N for r in df.groupBy("g").agg(na_sum("w").alias("N")).collect()}
    assert got == {"a": None, "b": 2.0}


def test_first_token_and_tolerant_cast(spark):  # C4
    df = spark.createDataFrame([("10 Central",), ("XLINE x",), ("4 ",), ("",)], "r string")
    got = [r.n for r in df.select(to_number(first_token("r")).alias("n")).collect()]
    assert got == [10.0, None, 4.0, None]


def test_exclude_ids_keeps_null(spark):  # C5
    df = spark.createDataFrame([("12",), ("DM7",), (None,)], "ID string")
    assert sorted(r.ID or "" for r in exclude_ids(df, "ID", "DM").collect()) == ["", "12"]


def test_collapse_flags(spark):  # C3
    rows = [("", "", "x"), ("Yes", "", None), ("Yes", "Yes", None), ("", "", None)]
    df = spark.createDataFrame(rows, "a string, b string, other string")
    out = collapse_flags(df, {"a": "A", "b": "B"}, many="Mixed", out="cat", other_col="other")
    assert [r.cat for r in out.collect()] == ["Other", "A", "Mixed", None]


def test_codebook_out_of_domain_is_null(spark):  # C2
    df = spark.createDataFrame([("Male",), ("Other",), (None,), ("Female",)], "GENDER string")
    out = apply_codebook(df, {"GENDER": ["Female", "Male"]}).collect()
    assert [(r.GENDER, r.GENDER_ord) for r in out] == [("Male", 2), (None, None), (None, None),
                                                       ("Female", 1)]


def test_concat_parts_keeps_empty_slots(spark):
    df = spark.createDataFrame([("1 Main", None, "MN")], "a string, b string, c string")
    assert df.select(concat_parts(["a", "b", "c"]).alias("s")).first().s == "1 Main  MN"


def test_remap_default(spark):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    assert [r.v for r in df.select(remap("c", {"x": 1}, default=-1).alias("v")).collect()] == [1, -1]


SQUARE = [(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 2.0), (0.0, 2.0, 0.0, 0.0)]


def _edges():
    return F.array(*[F.struct(F.lit(a).alias("x1"), F.lit(b).alias("y1"), F.lit(c).alias("x2"),
                              F.lit(d).alias("y2")) for a, b, c, d in SQUARE])


def test_inside_ring_boundary_counts(spark):  # C8 (edge and vertex)
    pts = [(1.0, 1.0, True), (2.0, 1.0, True), (2.0, 2.0, True), (0.0, 0.0, True),
           (3.0, 1.0, False), (1.0, 2.5, False)]
    df = spark.createDataFrame(pts, "x double, y double, want boolean")
    got = df.select(inside_ring(_edges(), "x", "y").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_mercator_centroid_symmetric_square(spark):
    df = spark.range(1).select(ring_centroid_mercator(_edges()).alias("c"))
    c = df.first().c
    assert abs(c.lon - 1.0) < 1e-9 and 0.99 < c.lat < 1.01


def test_great_circle_ends_and_count(spark):
    df = spark.createDataFrame([(-93.0, 45.0, -92.0, 44.0), (-93.0, 45.0, -93.0, 45.0)],
                               "a double, b double, c double, d double")
    out = df.withColumn("p", great_circle_params("a", "b", "c", "d")) \
        .select(great_circle_vertices("p", 50).alias("v")).collect()
    v = out[0].v
    assert len(v) == 52 and (v[0].lon, v[0].lat) == (-93.0, 45.0) and (v[-1].lon, v[-1].lat) == (-92.0, 44.0)
    assert all(-93.0 <= p.lon <= -92.0 and 44.0 <= p.lat <= 45.0 for p in v)
    assert {(p.lon, p.lat) for p in out[1].v} == {(-93.0, 45.0)}
    # n = 1: the single intermediate vertex is the spherical midpoint
    mid = df.limit(1).withColumn("p", great_circle_params("a", "b", "c", "d")) \
        .select(great_circle_vertices("p", 1).alias("v")).first().v[1]
    r = math.radians
    l1, f1, l2, f2 = r(-93.0), r(45.0), r(-92.0), r(44.0)
    bx, by = math.cos(f2) * math.cos(l2 - l1), math.cos(f2) * math.sin(l2 - l1)
    lat = math.atan2(math.sin(f1) + math.sin(f2), math.sqrt((math.cos(f1) + bx) ** 2 + by ** 2))
    lon = l1 + math.atan2(by, math.cos(f1) + bx)
    assert abs(mid.lat - math.degrees(lat)) < 1e-9 and abs(mid.lon - math.degrees(lon)) < 1e-9
