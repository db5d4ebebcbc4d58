"""Registered queries against their SQL on the smallest tables, and that the entry works without the text part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from voxmill.jobs import catalog

DATA = Path("/root/testdata/sf0.001")
SOME = ["o2_average_signal", "o6_child_index", "o9_merge_octrees", "j2_search_xyzb", "j7_linear", "g5_avg_pool_222_2", "c3_conv", "c4_deconv_stride2", "e4_iou_per_shape", "e10_scene_iou", "j10_assign_chunks", "r7_sample_surface", "a2_augment", "a6_elastic_distort", "s2_read_points_ply",
        "s1_read_points_npz", "s4_read_lidar", "s6_read_mesh", "s8_read_segmentation_json", "s10_write_points_ply", "u1_preprocess_hook", "u2_read_hook", "r1_remap_scene_labels", "r2_remap_lidar_labels", "r3_shift_shape_parts", "r11_category_filelists", "w1_cumsum", "w1_cumsum_exclusive",
        "w3_range_grid", "a7_resample_with_noise", "a8_take", "a9_assign_batches", "a10_merge_points", "j7_linear_wrapping", "j8_interp", "c1_octree2col", "c2_col2octree", "c3_conv_stride2", "c3_conv_blocks", "c4_deconv", "c5_depthwise_conv", "c6_group_conv", "g12_upsample_linear", "e6_vote", "s3_read_points", "s4_read_lidar_tree", "c3_conv_blocks_stride2", "c3_conv_blocks_deep", "c4_deconv_blocks_stride2", "j1_stored_search_key", "j4_stored_neighbors", "j7_stored_linear", "g4_stored_max_unpool", "g11_stored_upsample"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    for c in cols:
        assert (got[c].astype(str) == want[c].astype(str)).all() if got[c].dtype == object else np.array_equal(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_every_query_has_an_oracle_or_a_reason():
    without = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert without == {"workload_score_scenes", "workload_training_table"}


def test_entry_without_text_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op') for k in e.queries())"
    root = Path(__file__).parent.parent
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
