import numpy as np
import pytest
from pyspark.sql import functions as F

from lightbox.streaming import ingest
from lightbox.streaming.centroids import GrowingClusters


def test_stream_assigns_each_batch(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)] + [(20, [-1.0, 0.0])]
    spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "in"))
    cents = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "cluster_id long, centroid array<double>")
    source = lambda: ingest.vector_stream(spark, str(tmp_path / "in"), "id long, embedding array<float>", 1)
    start = lambda: ingest.assign_stream(source(), cents, 0.5, str(tmp_path / "out"), str(tmp_path / "ck"))
    start().awaitTermination()
    got = {r["cluster_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 10, 2: 10, None: 1}
    start().awaitTermination()  # nothing new
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21


def test_centroid_sums_merge(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "cluster_id long, embedding array<float>")
    b = spark.createDataFrame([(1, [5.0, 6.0]), (2, [1.0, 1.0]), (None, [9.0, 9.0])], "cluster_id long, embedding array<float>")
    got = {r["cluster_id"]: (r["n"], r["sums"]) for r in ingest.merged_sums(ingest.centroid_sums(a), ingest.centroid_sums(b)).collect()}
    assert got == {1: (3, [9.0, 12.0]), 2: (1, [1.0, 1.0])}


def test_clusters_grow_with_the_stream(spark, tmp_path):
    """Centroids move with what they get, waiting vectors become a cluster when enough have come, or leave; a batch that runs again changes nothing."""
    turn = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    df = lambda rows: spark.createDataFrame(rows, "id long, embedding array<float>")
    grown = GrowingClusters(spark, str(tmp_path / "g"), eps=0.02, least=3, keep=2)
    grown.start(spark.createDataFrame([(1, turn(0.0))], "cluster_id long, embedding array<double>"))
    up = [0.0, 0.0, 1.0]
    grown.step(df([(1, turn(0.19)), (2, up), (3, turn(2.0)), (3, turn(2.0))]), 0)  # 0.19 is within 0.2 of the centroid, which moves to 0.095
    grown.step(df([(4, turn(0.28)), (5, up)]), 1)
    with pytest.raises(ZeroDivisionError):
        old, grown._put = grown._put, lambda *a: 1 // 0
        grown.step(df([(6, up), (7, turn(1.0))]), 2)
    grown._put = old
    grown.step(df([(6, up), (7, turn(1.0))]), 2)
    got = {r["id"]: (r["cluster_id"], r["batch"]) for r in grown.placed().collect()}
    assert got == {1: (1, 0), 4: (1, 1), 2: (2, 2), 5: (2, 2), 6: (2, 2), 3: (None, 2)}
    assert {r["cluster_id"]: r["n"] for r in grown.sums(2).collect()} == {1: 3, 2: 3} and [r["id"] for r in grown.waiting(2).collect()] == [7]
    assert not (tmp_path / "g" / "state--1").exists() and (tmp_path / "g" / "state-1").exists()
