"""The streaming leaves equal the batch ones, whatever order points arrive in."""

import numpy as np

from voxmill.schema import POINTS
from voxmill.streaming.voxels import voxel_stream


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(k % 2, k, *map(float, rng.uniform(-0.9, 0.9, 3)), 0.0, 0.0, 1.0, [float(k)], 0) for k in range(300)]
    df = spark.createDataFrame(rows, POINTS)
    for k in range(3):
        df.where(df.point_id % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = voxel_stream(stream, 2, 1).writeStream.format("memory").queryName("leaves").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    seen = lambda t: sorted((r.cloud_id, r.key, r.npt, round(r.px, 9), round(r.features[0], 9)) for r in t.collect())
    assert seen(spark.table("leaves")) == seen(voxel_stream(df, 2, 1))
