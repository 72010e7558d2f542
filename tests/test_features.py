"""Features of whole images against those along scanlines, and the shuffles they take."""

import math

from test_plan_size import exchanges

from pixelloom.operators import foreground as G
from pixelloom.workload import training

SF = "/root/testdata/sf0.001"
ODD = {(0, 0): math.nan, (2, 3): math.inf, (4, 1): -math.inf, (5, 5): None}


def test_images_equal_scanlines(spark):
    rows = [("a", y, x, ODD.get((y, x), float((y * 7 + x * 13) % 17))) for y in range(7) for x in range(9) if (y + x) % 4 != 3 or (y, x) in ODD]
    rows += [("flat", y, x, 2.0) for y in range(3) for x in range(4)] + [("none", 0, 0, None), ("one", 0, 0, 5.0)]
    rows += [("a", 7, 0, 90.0), ("a", 0, 9, 90.0), ("a", -1, 0, 90.0), ("a", 0, -1, 90.0), ("unlisted", 0, 0, 1.0)]
    rows += [("mostly", 9, 9, 3.0), ("nans", 0, 0, math.nan), ("nans", 0, 1, math.nan), ("nans", 1, 1, 4.0)]
    pixels = spark.createDataFrame(rows, "session string, y int, x int, value double")
    sides = {"a": (7, 9), "flat": (3, 4), "none": (1, 1), "one": (1, 1), "mostly": (20, 20), "nans": (2, 2), "empty": (2, 3)}
    shapes = spark.createDataFrame([(k, *v) for k, v in sides.items()] + [("a", 7, 9)], "session string, height int, width int")

    def found(df):
        return sorted((r.session, r.y, r.x, *["null" if r[f] is None else repr(r[f] + 0.0) for f in G.FEATURES]) for r in df.collect())

    for kernel in (1, 5, 8):
        lines = found(G.pixel_features(pixels, kernel, shapes=shapes))
        assert found(G.pixel_features(pixels, kernel, shapes=shapes, max_side=20)) == lines
        assert len(lines) == sum(h * w for h, w in sides.values())


def test_an_image_is_shuffled_once(spark):
    assert exchanges(training.pixel_features(spark, SF)) < 5


def test_carried_columns(spark):
    pixels = spark.createDataFrame([("a", "s", 0, 1, 2.0, 1)], "session string, split string, y int, x int, value double, mask int")
    shapes = spark.createDataFrame([("a", "s", 1, 2)], "session string, split string, height int, width int")
    got = G.image_features(pixels, shapes, 2, keys=["session", "split"], carried=["mask"])
    assert sorted((r.session, r.split, r.x, r.mask, r.normalised) for r in got.collect()) == [("a", "s", 0, 0.0, 0.0), ("a", "s", 1, 1.0, 1.0)]
