"""Distributed exact quantile equals Spark's percentile (R type 7)."""

import random

from pyspark.sql import functions as F

from odflow.operators import flows as fl
from odflow.operators.quantile import exact_quantile


def test_exact_quantile_matches_percentile(spark):
    rnd = random.Random(9)
    vals = [(rnd.choice([rnd.random() * 100, 5.0, 7.5]),) for _ in range(3000)] + [(None,)] * 5
    df = spark.createDataFrame(vals, "N double")
    for p in (0.0, 0.3, 0.95, 1.0):
        want = df.agg(F.percentile("N", p)).first()[0]
        assert abs(exact_quantile(df, "N", p) - want) < 1e-9
    assert exact_quantile(df.where("N < 0"), "N", 0.5) is None


def test_ties_are_one_row(spark):
    from odflow.operators import quantile
    sizes = []
    real = quantile.materialize

    def spy(df):
        out = real(df)
        sizes.append(max(r["count"] for r in out.groupBy("_pid").count().collect()))
        return out

    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(F.lit(5.0)).alias("N"))
    quantile.materialize = spy
    try:
        assert exact_quantile(df, "N", 0.5) == 5.0
    finally:
        quantile.materialize = real
    assert sizes[0] <= 2001           # distinct values, not the 18,000 ties


def test_quantiles_by_group(spark):
    from odflow.operators.quantile import exact_quantiles
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.choice([1.0, 2.0, rnd.random()])) for _ in range(500)],
                               "g string, N double")
    got = dict(exact_quantiles(df, "N", 0.9, ["g"]).collect())
    want = dict(df.groupBy("g").agg(F.percentile("N", 0.9)).collect())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cap(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "N double")
    out = {r.N: r.colN for r in fl.cap_at_quantile(df).collect()}
    assert abs(out[20.0] - 19.05) < 1e-9 and out[3.0] == 3.0


def test_global_rank_and_interleaved_keys(spark):
    from odflow.operators.lines import trip_ends
    from odflow.operators.quantile import global_rank
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 500), i, float(i), float(-i)) for i in range(400)]
    df = spark.createDataFrame(rows, "ID int, seq int, o_lon double, d_lon double") \
        .withColumn("o_lat", F.lit(1.0)).withColumn("d_lat", F.lit(2.0))
    ranked = global_rank(df, ["ID", "seq"]).collect()
    got = sorted((r.ID, r.seq, r["rank"]) for r in ranked)
    want = [(a, b, i + 1) for i, (a, b) in enumerate(sorted((r[0], r[1]) for r in rows))]
    assert got == want
    ends = trip_ends(df, ["ID", "seq"], key_order=["ID", "seq"]).collect()
    keys = {(r.ID, r.seq, r.Type): r.Key for r in ends}
    first = want[0]
    assert keys[(first[0], first[1], "Orig")] == 1 and keys[(first[0], first[1], "Dest")] == 2
    assert sorted(keys.values()) == list(range(1, 801))
