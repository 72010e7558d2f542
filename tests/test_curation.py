import numpy as np

from grids import frame, grid, labels
from pixelloom.operators import curate as U


def ids(spark, *values, session="s"):
    return spark.createDataFrame([(session, v) for v in values], "session string, label int")


def got(df):
    return sorted(r.label for r in df.collect())


def drawn():
    a = np.zeros((80, 100), dtype=int)
    a[1:6, 1:7], a[34:42, 56:66], a[60:64, 80:85] = 1, 2, 3
    return a


def state(spark):
    return U.Curation(labels(spark, drawn()), ids(spark, 1), ids(spark, 2))


def test_listing_and_status(spark):
    s = state(spark)
    rows = sorted((r.label, r.pixels, r.fixed) for r in U.roi_listing(s.labels, s.fixed).collect())
    assert rows == [(1, 30, ""), (2, 80, "yes"), (3, 20, "")]
    row = U.status_counts(s).first()
    assert (row.rois, row.selected, row.fixed) == (3, 1, 1)


def test_selection_algebra(spark):
    s = state(spark)
    assert got(U.select_all(s.labels)) == [1, 2, 3]
    assert got(U.invert_selection(s.labels, s.selected)) == [2, 3]
    assert got(U.add_to_selection(s.selected, ids(spark, 1, 2))) == [1, 2]
    assert got(U.toggle_selection(ids(spark, 1, 2), ids(spark, 2, 3))) == [1, 3]
    assert got(U.replace_selection(ids(spark, 1, 2), ids(spark, 3))) == [3]


def test_fixed_marks(spark):
    s = state(spark)
    assert got(U.fix_selected(s.labels, ids(spark, 1, 9), s.fixed)) == [1, 2]
    assert got(U.unfix_selected(ids(spark, 2), s.fixed)) == []
    assert got(U.toggle_fixed(s.labels, ids(spark, 1, 2), s.fixed)) == [1, 2]
    assert got(U.toggle_fixed(s.labels, ids(spark, 2), s.fixed)) == []
    assert got(U.keep_present(ids(spark, 3, 8), s.labels)) == [3]


def test_delete_merge_clear(spark):
    s = state(spark)
    deleted = U.delete_selected(s)
    assert (got(U.label_ids(deleted.labels)), got(deleted.fixed), got(deleted.selected)) == ([1, 2], [1], [])
    merged = U.merge_selected(U.Curation(s.labels, ids(spark, 2, 3), s.fixed))
    sizes = sorted((r.label, r.pixels) for r in U.roi_listing(merged.labels, merged.fixed).collect())
    assert sizes == [(1, 30), (2, 100)] and got(merged.fixed) == [2]
    single = U.merge_selected(s)
    assert got(U.label_ids(single.labels)) == [1, 2, 3] and got(single.selected) == [1]
    cleared = U.clear_unfixed(s)
    assert got(U.label_ids(cleared.labels)) == [1] and got(cleared.fixed) == [1]
    assert cleared.labels.count() == 80
    assert U.clear_unfixed(U.Curation(s.labels, s.selected, s.fixed.limit(0))).labels.count() == 0


def test_untouched_sessions_keep_their_ids(spark):
    gap = np.array([[4, 0, 9]])
    both = labels(spark, gap, "a").unionByName(labels(spark, gap, "b"))
    out = U.delete_selected(U.Curation(both, ids(spark, 9, session="a"), ids(spark, 4, session="b")))
    assert sorted((r.session, r.label) for r in U.label_ids(out.labels).collect()) == [("a", 1), ("b", 4), ("b", 9)]
    assert sorted((r.session, r.label) for r in out.fixed.collect()) == [("b", 4)]


def test_rebuild_then_undo(spark):
    a, prob = np.zeros((8, 8), dtype=int), np.zeros((8, 8))
    a[1:3, 1:3], prob[4:6, 4:6] = 1, 1.0
    before = U.Curation(labels(spark, a), ids(spark).limit(0), ids(spark, 1))
    after = U.Curation(*U.rebuild(frame(spark, "probability", prob), 0.5, 1))
    np.testing.assert_array_equal(grid(after.labels, "label", a.shape), prob)
    assert got(after.fixed) == []
    back = U.undo(U.stack_versions([before, after]), 1)
    np.testing.assert_array_equal(grid(back.labels, "label", a.shape), a)
    assert got(back.fixed) == [1]


def test_hits_round_half_to_even(spark):
    points = spark.createDataFrame(
        [(1, "s", 0.5, 1.5), (2, "s", 1.5, 2.5), (3, "s", -0.6, 0.0), (4, "s", 79.5, 3.0), (5, "s", 2.0, 2.0)],
        "event_id int, session string, yf double, xf double",
    )
    shape = spark.createDataFrame([("s", 80, 100)], "session string, height int, width int")
    hits = U.hit_test(points, labels(spark, drawn()), shape).collect()
    assert sorted((r.event_id, r.y, r.x) for r in hits) == [(2, 2, 2), (5, 2, 2)]


def test_fixed_rois_come_first_and_conflicts_are_dropped_whole(spark):
    schema = "session string, roi_id int, y int, x int"
    fixed = spark.createDataFrame([("s", 5, 0, 0), ("s", 8, 0, 0), ("s", 8, 0, 1)], schema)
    found = spark.createDataFrame([("s", 1, 0, 1), ("s", 1, 3, 3), ("s", 2, 5, 5)], schema)
    rois, table = U.combine_fixed(fixed, found)
    assert sorted({(r.label, r.is_fixed) for r in rois.collect()}) == [(1, True), (2, True), (3, False)]
    assert sorted((r.y, r.x, r.label) for r in table.collect()) == [(0, 0, 2), (0, 1, 2), (5, 5, 3)]


def test_overlapping_candidates_are_taken_in_order(spark):
    rng = np.random.default_rng(6)
    rois = {}
    for k in range(1, 40):
        y, x, h, w = rng.integers(0, 12), rng.integers(0, 12), rng.integers(1, 5), rng.integers(1, 5)
        rois[k] = {(int(a), int(b)) for a in range(y, y + h) for b in range(x, x + w)}
    rows = [("s", k, *p) for k, pixels in rois.items() for p in pixels]
    candidates = spark.createDataFrame(rows, "session string, roi_id int, y int, x int")
    fixed = spark.createDataFrame([("s", 1, 3, 3), ("s", 1, 3, 4)], "session string, roi_id int, y int, x int")
    taken, want = {(3, 3), (3, 4)}, []
    for k in sorted(rois):
        if not rois[k] & taken:
            taken |= rois[k]
            want.append(rois[k])
    out, _ = U.combine_fixed(fixed, candidates, overlapping=True)
    got = {}
    for r in out.filter("not is_fixed").collect():
        got.setdefault(r.label, set()).add((r.y, r.x))
    assert [got[k] for k in sorted(got)] == want


def test_clearing_marks(spark):
    ids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session string, label int")
    only = spark.createDataFrame([("a",)], "session string")
    assert U.clear_fixed(ids).count() == 0 and U.clear_selection(ids).count() == 0
    assert [tuple(r) for r in U.clear_fixed(ids, only).collect()] == [("b", 1)]
