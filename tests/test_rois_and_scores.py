import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import frame, grid, labels, shapes
from pixelloom.operators import manifest as M
from pixelloom.operators import rois as R
from pixelloom.operators import scores as S
from pixelloom.operators.spread import bucketed_row_number, group_quantiles, salted_join

RAW = "session string, roi_id int, ord int, xpix array<string>, ypix array<string>"


def test_malformed_records_are_counted(spark):
    raw = spark.createDataFrame(
        [("s", 1, 1, ["1", "2"], ["1", "2"]), ("s", 2, 2, ["bad"], ["3"]), ("s", 3, 3, ["4"], None)], RAW
    )
    out = R.clean_rois(raw, shapes(spark, ("s", 6, 6))).collect()
    assert [r.roi_id for r in out if r.kept] == [1]
    assert sum(r.invalid for r in out) == 2


def test_one_record_can_count_twice_and_empty_ones_do_not(spark):
    raw = spark.createDataFrame([
        ("s", 1, 1, ["1.9", "9", "2"], ["true", "0"]), ("s", 2, 2, [], []), ("s", 3, 3, ["9"], ["9"]),
    ], RAW)
    out = {r.roi_id: r for r in R.clean_rois(raw, shapes(spark, ("s", 6, 6))).collect()}
    assert (out[1].invalid, out[1].xpix, out[1].ypix) == (2, [1], [1])
    assert (out[2].invalid, out[2].kept, out[3].invalid, out[3].kept) == (0, False, 1, False)


def test_fixed_cleaning_is_forgiving_but_not_of_words(spark):
    shape = shapes(spark, ("s", 6, 6))
    raw = spark.createDataFrame([("s", 1, 1, ["1", "9"], ["1", "1"]), ("s", 2, 2, None, ["1"])], RAW)
    assert [r.xpix for r in R.clean_fixed_rois(raw, shape).collect()] == [[1]]
    bad = spark.createDataFrame([("s", 1, 1, ["x"], ["1"])], RAW)
    with pytest.raises(Exception, match="not a number"):
        R.clean_fixed_rois(bad, shape).collect()


def test_later_roi_wins_and_covered_one_vanishes(spark):
    rows = [("s", 7, 1, 0, 0), ("s", 3, 2, 0, 0), ("s", 3, 2, 0, 1), ("s", 9, 3, 5, 5)]
    pixels = spark.createDataFrame(rows, "session string, roi_id int, ord int, y int, x int")
    shape = shapes(spark, ("s", 2, 2))
    clean, facts = R.clean_roi_pixels(pixels, shape)
    drawn = R.rasterise(clean, facts)
    assert sorted((r.y, r.x, r.label) for r in drawn.collect()) == [(0, 0, 2), (0, 1, 2)]
    row = R.roi_summary(pixels, shape).first()
    assert (row.roi_count, row.positive_pixels, row.invalid_roi_entries) == (2, 2, 1)
    assert (row.median_roi_area_px, row.positive_fraction) == (1.5, 0.5)
    assert S.component_count(drawn, "n").first().n == 1


def test_sessions_without_rois_have_zero_summary(spark):
    pixels = spark.createDataFrame([], "session string, roi_id int, ord int, y int, x int")
    row = R.roi_summary(pixels, shapes(spark, ("s", 4, 4))).first()
    assert (row.roi_count, row.median_roi_area_px, row.positive_fraction) == (0, 0.0, 0.0)


def test_scores_of_an_empty_pair_are_zero(spark):
    manifest = spark.createDataFrame([("s", "a", "test")], "session string, animal string, split string")
    none = labels(spark, np.zeros((2, 2)))
    row = S.score_sessions(none, none, manifest).first()
    assert [row[m] for m in S.METRICS] == [0.0] * 5


def test_scores_by_hand(spark):
    pred, true = np.array([[1, 1, 0], [0, 0, 2]]), np.array([[0, 1, 1], [0, 0, 0]])
    manifest = spark.createDataFrame([("s", "a", "test")], "session string, animal string, split string")
    row = S.score_sessions(labels(spark, pred), labels(spark, true), manifest).first()
    assert (row.true_positive_pixels, row.false_positive_pixels, row.false_negative_pixels) == (1, 2, 1)
    assert row.dice == pytest.approx(2 / 5) and row.f2 == pytest.approx(5 / 11)
    assert (row.predicted_components, row.target_components) == (2, 1)
    assert {r.error for r in S.error_map(labels(spark, pred), labels(spark, true)).collect()} == {"TP", "FP", "FN"}


def test_sweep_equals_scoring_each_point(spark):
    rng = np.random.default_rng(2)
    prob, true = rng.random((16, 16)), (rng.random((16, 16)) < 0.4).astype(int)
    manifest = spark.createDataFrame([("s", "a", "test")], "session string, animal string, split string")
    p, t = frame(spark, "probability", prob), labels(spark, true)
    swept = {(r.threshold, r.min_size): r for r in S.sweep(p, t, manifest, [0.3, 0.7], [0, 3], tile=5).collect()}
    from pixelloom.operators.components import probability_to_labels

    for (threshold, size), row in swept.items():
        one = S.score_sessions(probability_to_labels(p, threshold, size), t, manifest).first()
        assert one.dice == pytest.approx(row.dice) and one.predicted_components == row.predicted_components
    # with no size bound, foreground does not grow with the threshold
    area = [swept[t, 0].true_positive_pixels + swept[t, 0].false_positive_pixels for t in (0.3, 0.7)]
    assert area[0] >= area[1]


def test_quantiles_equal_numpy_also_when_one_group_dominates(spark):
    rng = np.random.default_rng(0)
    groups = {
        "big": np.round(rng.lognormal(0, 2, 30000), 3), "one": np.array([4.0]), "two": np.array([1.0, 2.0]),
        "flat": np.full(50, 3.5), "wide": np.array([-1.7e308, 0.0, 1.7e308]), "neg": rng.normal(-5, 1, 999),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    probs = {"a": 0.01, "b": 0.5, "c": 0.997, "d": 1.0, "e": 0.0}
    got = group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs)
    for r in got.collect():
        if r.g == "wide":
            assert (r.e, r.b, r.d) == (-1.7e308, 0.0, 1.7e308)
            continue
        want = np.percentile(groups[r.g], [p * 100 for p in probs.values()])
        np.testing.assert_allclose([r[n] for n in probs], want, rtol=1e-12)


def test_weighted_quantiles_count_rows_several_times(spark):
    df = spark.createDataFrame([("g", 0.0, 7), ("g", 5.0, 1), ("g", 9.0, 2)], "g string, v double, w long")
    row = group_quantiles(df, ["g"], "v", {"m": 0.75}, "w").first()
    assert row.m == pytest.approx(np.percentile([0] * 7 + [5, 9, 9], 75))


def test_bucketed_rank_equals_plain_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 501).alias("v"))
    out = bucketed_row_number(df, ["k"], F.floor(F.col("v") / 50), [F.col("v")], "r").collect()
    for k in range(3):
        rows = sorted((r.v, r.r) for r in out if r.k == k)
        assert [r for _, r in rows] == list(range(1, len(rows) + 1))


def test_salted_join_keeps_every_row_once(spark):
    big = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    small = spark.createDataFrame([(0, "a")], "k long, name string")
    assert salted_join(big, small, ["k"], ["id"]).count() == 1000
    assert salted_join(big, small, ["k"], ["id"], "left_semi").count() == 500
    assert salted_join(big, small, ["k"], ["id"], "left_anti").count() == 500


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 0), (2, 1), (3, 1), (7, 1), (10, 2), (30, 4)])
def test_held_out_count(spark, n, expected):
    assert spark.range(1).select(M.split_count(F.lit(n), 0.15).alias("c")).first().c == expected


def test_splits_partition_the_included_sessions(spark):
    rows = [(f"A{i % 3}-s{i}", f"A{i % 3}", i % 5 != 0) for i in range(60)]
    out = M.assign_splits(spark.createDataFrame(rows, "session string, animal string, included boolean"))
    got = out.collect()
    assert len(got) == 60
    for r in got:
        assert (r.split == "") == (not r.included)
    for a in ("A0", "A1", "A2"):
        splits = [r.split for r in got if r.animal == a and r.included]
        n, nt = len(splits), max(1, round(len(splits) * 0.15))
        assert splits.count("test") == nt and splits.count("val") == max(1, round((n - nt) * 0.15))
    again = M.assign_splits(
        spark.createDataFrame(rows[::-1], "session string, animal string, included boolean").repartition(7)
    )
    assert {r.session: r.split for r in got} == {r.session: r.split for r in again.collect()}
    other = M.assign_splits(spark.createDataFrame(rows, "session string, animal string, included boolean"), seed=8)
    assert {r.session: r.split for r in got} != {r.session: r.split for r in other.collect()}


def test_empty_training_split_is_an_error(spark):
    rows = spark.createDataFrame([("s", True, "val")], "session string, included boolean, split string")
    with pytest.raises(ValueError, match="holds no included"):
        M.require_rows(rows, "train")
    assert M.require_rows(rows, "val").count() == 1
    assert grid(labels(spark, np.ones((1, 1))), "label", (1, 1))[0, 0] == 1


def test_an_roi_across_parts_counts_once(spark):
    from pixelloom.operators.components import pack_rois

    drawn = [("s", y, x, 3) for y in range(1020, 1028) for x in (1023, 1024)] + [("s", 0, 0, 1)]
    parts = pack_rois(spark.createDataFrame(drawn, "session string, y int, x int, label int"))
    assert parts.filter("roi_id = 3").count() == 4
    text = parts.selectExpr("session", "roi_id", "ord", "part", "cast(xpix as array<string>) xpix", "cast(ypix as array<string>) ypix")
    # columns from 1024 on lie outside, in two of the parts
    for width, areas, invalid in ((2000, (1, 16), 0), (1024, (1, 8), 1)):
        shape = shapes(spark, ("s", 2000, width))
        (row,) = R.summarise_records(R.clean_rois(text, shape), shape).collect()
        assert (row.roi_count, row.min_roi_area_px, row.max_roi_area_px, row.invalid_roi_entries) == (2, *areas, invalid)
