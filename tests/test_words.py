"""Words of 64 pixels: drawing and combining ROIs on them equals the same on pixels."""

import random

from pixelloom.operators import curate as U
from pixelloom.operators import shape as H
from pixelloom.operators.rois import clean_roi_pixels, rasterise, rasterise_pixels, roi_words
from pixelloom.operators.words import pack_words, word_pixels


def drawn(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for _ in range(n):
        roi = rnd.randrange(1, 9)
        rows.append((f"s{rnd.randrange(2)}", roi, 20 - roi, rnd.randrange(-3, 12), rnd.randrange(-70, 200)))
    return spark.createDataFrame(rows + rows[:50], "session string, roi_id int, ord int, y int, x int")


def shapes(spark):
    return spark.createDataFrame([("s0", 9, 150), ("s1", 12, 64), ("s1", 12, 64)], "session string, height int, width int")


def test_words_and_back(spark):
    pixels = drawn(spark).select("session", "y", "x")
    got = sorted(map(tuple, word_pixels(pack_words(pixels, ["session"])).select("session", "y", "x").collect()))
    assert got == sorted(map(tuple, pixels.distinct().collect()))


def test_drawing_on_words_equals_pixels(spark):
    pixels = drawn(spark)
    got = sorted(map(tuple, rasterise_pixels(pixels, shapes(spark)).collect()))
    assert got == sorted(map(tuple, rasterise(*clean_roi_pixels(pixels, shapes(spark))).collect()))


def test_raw_rows_are_not_sorted(spark):
    """F30 to F33: the first aggregation sorted every raw row of a task and held them all."""
    rows = drawn(spark)
    plan = roi_words(rows, shapes(spark))._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "Sort " not in plan


def test_order_of_overlapping_candidates(spark):
    rows = [(f"s{s}", r, y, 60 + x) for s in range(2) for r in range(1, 9) for y in range(3) for x in range(r * 3 % 8, r * 3 % 8 + 3)]
    rows += [("s0", 9, 0, -40), ("s0", 10, 0, -40)]
    want = []
    for session in ("s0", "s1"):
        held = set()
        for roi in range(1, 11):
            own = {r[2:] for r in rows if r[:2] == (session, roi)}
            if own and not own & held:
                held |= own
                want += [(session, roi, *p) for p in own]
    pixels = spark.createDataFrame(rows, "session string, roi_id int, y int, x int")
    got = U.take_in_order(pixels)
    assert sorted(map(tuple, got.select("session", "roi_id", "y", "x").collect())) == sorted(want)
    # rounds are stored as words, not as pixels
    stored = [c for c in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in c]
    assert stored and all("bits" in c for c in stored)


def test_perimeter_across_words(spark):
    """words meet, so a label drawn over a word's end has the perimeter it has elsewhere; no pixel row is sorted."""
    rnd = random.Random(3)
    cells = {(rnd.randrange(9), rnd.randrange(12)) for _ in range(70)}
    rows = [(f"s{dx}", 1 + (y > 5), y, x + dx) for dx in (0, 20, 57, 121, -6) for y, x in cells]
    out = H.perimeter(spark.createDataFrame(rows, "session string, label int, y int, x int"))
    found = {(r.session, r.label): round(r.perimeter, 9) for r in out.collect()}
    assert len(found) == 10 and all(v == found["s20", k[1]] for k, v in found.items()) and found["s20", 1] > 0
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("_w#" in line for line in windows)
