"""Many small images in one call of a tile helper, and what joins of facts and ROI rows cost."""

import numpy as np
import pyarrow as pa
import pytest

from pixelloom.operators import components as C
from pixelloom.operators.rois import clean_roi_pixels, rasterise, rasterise_pixels
from pixelloom.workload import points, shared

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_groups_stay_whole_whatever_the_batches(rows):
    keys = ["a"] * 4 + [None] * 3 + ["b"] * 2 + ["c"] * 5
    table = pa.table({"k": keys, "v": list(range(len(keys)))})
    seen = []

    def helper(part, number):
        for g in np.unique(number):
            seen.append([part.column("v")[int(i)].as_py() for i in np.flatnonzero(number == g)])
        return part

    out = list(C._grouped(helper, ["k"], rows)(iter(table.to_batches(max_chunksize=2))))
    assert pa.Table.from_batches(out).equals(table)
    assert seen == [[0, 1, 2, 3], [4, 5, 6], [7, 8], [9, 10, 11, 12, 13]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_tiles_share_calls(spark):
    text = plan(shared.predicted_labels(spark, SF))
    assert "MapInArrow" in text and "FlatMapGroups" not in text


def test_pixels_are_not_sorted_for_facts_of_images(spark):
    assert "SortMergeJoin" not in plan(points.labels_at_operating_points(spark, SF))


def test_raw_rois_shrink_before_they_meet_shapes(spark):
    rows = [
        ("a", 1, 1, 0, 0), ("a", 1, 1, 0, 0), ("a", 2, 2, 0, 0), ("a", 3, 3, 9, 0), ("a", 4, 4, 1, 1), ("a", 5, 5, 1, 1),
        ("a", 6, 6, -1, 1), ("a", 7, 7, 1, 8), ("a", 7, 7, 2, 1), ("b", 2, 1, 0, 0), ("b", 1, 2, 0, 0), ("c", 1, 1, 0, 0),
    ]
    pixels = spark.createDataFrame(rows, "session string, roi_id int, ord int, x int, y int")
    shapes = spark.createDataFrame([("a", 3, 3), ("b", 1, 1), ("a", 3, 3)], "session string, height int, width int")
    got = sorted(tuple(r) for r in rasterise_pixels(pixels, shapes).collect())
    assert got == sorted(tuple(r) for r in rasterise(*clean_roi_pixels(pixels, shapes)).collect())
    assert ("a", 1, 2, 5) in got and ("b", 0, 0, 2) in got
