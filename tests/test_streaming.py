"""The streaming preparation gives the same rows as the batch plan."""

import tempfile

from odflow.operators.geometry_layer import layer_from_edges
from odflow.plans.catalog import TRIP_COLS
from odflow.plans.prepare import zone_trips
from odflow.sources import views as V
from odflow.streaming import zone_trips_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="odflow-stream-")
    cols = TRIP_COLS + ["o_lon", "o_lat", "d_lon", "d_lat"]
    trips = V.trip(spark, SF).select(*cols)
    trips.write.parquet(f"{d}/in")
    layer = layer_from_edges(V.zone_edge(spark, SF))
    q = zone_trips_stream(spark, f"{d}/in", trips.schema, layer, f"{d}/out", f"{d}/ckpt",
                          keep=TRIP_COLS)
    q.awaitTermination()
    got = spark.read.parquet(f"{d}/out")
    want = zone_trips(trips, layer, keep=TRIP_COLS)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_stream_appends_new_files_once(spark):
    d = tempfile.mkdtemp(prefix="odflow-stream2-")
    cols = TRIP_COLS + ["o_lon", "o_lat", "d_lon", "d_lat"]
    trips = V.trip(spark, SF).select(*cols)
    first, second = trips.where("l_linenumber <= 3"), trips.where("l_linenumber > 3")
    first.write.parquet(f"{d}/in/part=1")
    layer = layer_from_edges(V.zone_edge(spark, SF))
    run = lambda: zone_trips_stream(spark, f"{d}/in/part=1", trips.schema, layer,
                                    f"{d}/out", f"{d}/ckpt", keep=TRIP_COLS).awaitTermination()
    run()
    n1 = spark.read.parquet(f"{d}/out").count()
    second.write.mode("append").parquet(f"{d}/in/part=1")
    run()
    run()  # nothing new: no duplicates
    assert n1 == first.count()
    assert spark.read.parquet(f"{d}/out").count() == trips.count()
