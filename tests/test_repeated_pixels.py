"""Pixels that a mask lists several times, as sessions of one name do, widen no run."""

from grids import shapes
from pixelloom.operators import intensity as I
from pixelloom.operators import patches as P


def test_runs_of_repeated_pixels_leave_gaps(spark):
    mask = spark.createDataFrame([("s", 2, x) for x in (1, 1, 3, 4, 4, 4, 8)], "session string, y int, x int")
    assert sorted((r.y, r.x0, r.x1) for r in I.mask_runs(mask).collect()) == [(2, 1, 1), (2, 3, 4), (2, 8, 8)]
    got = sorted((r.y, r.x) for r in I.dilate(mask, shapes(spark, ("s", 5, 9)), 1).collect())
    want = {(2 + dy, x + dx) for x in (1, 3, 4, 8) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    assert got == sorted(p for p in want if p[1] < 9)


def test_targets_of_repeated_patches(spark):
    cells = [("s", 1, 0, 2, x, 5, 5, 1) for x in (1, 1, 3)]
    patches = spark.createDataFrame(cells, "session string, epoch int, patch int, py int, px int, h int, w int, mask int")
    rows = P.make_targets(patches, "foreground_support", 1).collect()
    assert sorted((r.py, r.px) for r in rows if r.channel == 0) == [(2, 1), (2, 1), (2, 3)]
    assert sorted((r.py, r.px) for r in rows if r.channel == 1) == [(1, 1), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 3)]
