"""regions alone are the same as with their runs, and their runs are not made."""

import random

from pixelloom.operators import proposals as Q


def test_regions_alone(spark):
    rnd = random.Random(4)
    rows = [(f"s{s}", y, x, rnd.choice([0, 20, 90, 200, 255])) for s in range(2) for y in range(12) for x in range(12)]
    rows += [("flat", y, x, 0) for y in range(3) for x in range(3)]
    image = spark.createDataFrame(rows, "session string, y int, x int, value int")
    for options in ({"max_side": 12}, {"tile": 8}):
        want, _ = Q.stable_regions(image, 5, 5, 60, 1.2, **options)
        got, spans = Q.stable_regions(image, 5, 5, 60, 1.2, with_spans=False, **options)
        assert spans is None and got.columns == want.columns and got.count() > 0
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
