"""Streaming fusion with weights by frame against the batch form, over restarts."""

import random

import pytest

from fusionframe.operators.fusion import fuse_band
from fusionframe.streaming.fusion import fuse_frames

K = (100.0, 100.0, 5.0, 5.0)


def pose(k):
    return [1.0, 0.0, 0.0, 0.03 * k, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.01 * k, 0.0, 0.0, 0.0, 1.0]


def test_frames_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    pixels = [(f, x, y, 2.0 + 0.01 * rng.randrange(20)) for f in range(6) for x in range(12) for y in range(9)] + [(3, 2, 2, 0.0), (4, 2, 3, 9.0)]
    rng.shuffle(pixels)
    parts = [sorted(p for p in pixels if p[0] in fs and (p[0] + p[1]) % 2 in half) for fs, half in (((0, 1), (0, 1)), ((2, 3), (0,)), ((2, 3), (1,)), ((4, 5), (0, 1)))]
    schema = "frame int, px int, py int, d double"
    poses = spark.createDataFrame([(k, pose(k)) for k in range(6)], "frame int, pose array<double>")
    got, so_far = {}, []

    def keep(batch, _):
        for r in batch.collect():
            got[r.ix, r.iy, r.iz] = (r.tsdf, r.weight)

    for k, part in enumerate(parts):  # each a run of its own, from the checkpoint of the one before
        so_far += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = fuse_frames(stream, poses, K, 0.05, 0.15).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        want = {(r.ix, r.iy, r.iz): (r.tsdf, r.weight) for r in fuse_band(spark.createDataFrame(so_far, schema), poses, K, 0.05, 0.15).collect()}
        assert got.keys() == want.keys() and all(got[c][1] == want[c][1] and got[c][0] == pytest.approx(want[c][0], abs=1e-9) for c in want)
    assert max(w for _, w in got.values()) == 6


def test_late_pixels_are_left_out(spark, tmp_path):
    schema, poses = "frame int, px int, py int, d double", spark.createDataFrame([(k, pose(0)) for k in range(9)], "frame int, pose array<double>")
    rows = {}

    def keep(batch, _):
        rows.update({(r.ix, r.iy, r.iz): r.weight for r in batch.collect()})

    for frame in (0, 5, 1, 4):  # frame 1 comes after frame 5 has closed it, frame 4 is within the lag
        spark.createDataFrame([(frame, 5, 5, 2.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = fuse_frames(stream, poses, K, 0.05, 0.15).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
    assert set(rows.values()) == {3}
