"""Operating points, filters, shape tests and hulls of each image; the log of changes; stored models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import components, frame, grid, labels, shapes
from pixelloom.functions.scalars import column_name
from pixelloom.operators import curate as U
from pixelloom.operators import hull
from pixelloom.operators import intensity as I
from pixelloom.operators import proposals as Q
from pixelloom.operators import shape as H
from pixelloom.operators.components import labels_at_points, probability_to_labels
from pixelloom.operators.foreground import FEATURES, ForegroundModel
from pixelloom.operators.history import ChangeLog
from pixelloom.operators.parameters import default_parameters
from pixelloom.plans.segmentation import prepare


def images(spark, n=4, side=20, seed=1, name="value"):
    rng = np.random.default_rng(seed)
    arrays = {f"s{k}": np.round(rng.random((side, side)) * 100) / 100 for k in range(n)}
    out = None
    for session, array in arrays.items():
        rows = frame(spark, name, array, session)
        out = rows if out is None else out.unionByName(rows)
    return arrays, out.repartition(6)


# --------------------------------------------------------------- operating points
@pytest.mark.parametrize("options", [{"max_side": 20}, {"tile": 7}])
def test_points_equal_single_labellings(spark, options):
    _, prob = images(spark, name="probability")
    given = {"s0": (0.3, 2, None), "s1": (0.6, None, 5), "s2": (0.5, 3, 4)}
    points = spark.createDataFrame([(s, *p) for s, p in given.items()], "session string, threshold double, min_size int, max_size int")
    got = sorted(map(tuple, labels_at_points(prob, points, **options).collect()))
    want = []
    for session, (threshold, least, most) in given.items():
        want += map(tuple, probability_to_labels(prob.filter(F.col("session") == session), threshold, least, most, **options).collect())
    assert got == sorted(want) and {r[0] for r in got} == set(given)


# ------------------------------------------------------------ parameters by image
OWN = {"s0": (3, 2.0, 50.0), "s1": (7, 40.0, 75.0), "s2": (4, 90.0, 90.0)}


def test_preparation_equals_single_preparations(spark):
    _, dense = images(spark, 3, 16)
    rows = shapes(spark, *[(s, 16, 16) for s in OWN])
    table = spark.createDataFrame([(s, *p) for s, p in OWN.items()], "session string, tophat_kernel int, clahe_clip double, mser_threshold double")
    got = sorted(map(tuple, prepare(dense, rows, table).select("session", "y", "x", "value").collect()))
    want = []
    for session, (kernel, clip, cut) in OWN.items():
        one = rows.filter(F.col("session") == session)
        part = prepare(dense.filter(F.col("session") == session), one, {"tophat kernel": kernel, "clahe clip": clip, "MSER threshold": cut})
        want += map(tuple, part.select("session", "y", "x", "value").collect())
    assert got == sorted(want)


def test_no_parameters_no_pixels(spark):
    _, dense = images(spark, 1, 5)
    none = spark.createDataFrame([], "session string, kernel int")
    assert I.top_hat(dense, none).count() == 0


@pytest.mark.parametrize("options", [{"max_side": 16}, {"tile": 8}])
def test_stable_regions_equal_single_runs(spark, options):
    rng = np.random.default_rng(4)
    given = {"s0": (2, 5, 30, 3.0), "s1": (6, 8, 100, 1.5)}
    arrays = {s: rng.integers(0, 12, (16, 16)) * 20 for s in given}
    image = frame(spark, "value", arrays["s0"], "s0", kind="int").unionByName(frame(spark, "value", arrays["s1"], "s1", kind="int"))
    names = [column_name(n) for n in ("MSER delta", "MSER min area", "MSER max area", "MSER max variation")]
    table = spark.createDataFrame([(s, *p) for s, p in given.items()], f"session string, {names[0]} int, {names[1]} int, {names[2]} int, {names[3]} double")
    got, _ = Q.stable_regions(image, params=table, **options)
    want = []
    for session, p in given.items():
        part, _ = Q.stable_regions(image.filter(F.col("session") == session), *p, **options)
        want += map(tuple, part.select("session", "region", "polarity", "level", "root", "area", "variation").collect())
    assert sorted(map(tuple, got.select("session", "region", "polarity", "level", "root", "area", "variation").collect())) == sorted(want)
    assert len({w[0] for w in want}) == 2


def test_shape_candidates_equal_all_measures_at_once(spark):
    rng = np.random.default_rng(8)
    drawn = [components(rng.random((24, 24)) < 0.5) for _ in range(2)]
    rows = labels(spark, drawn[0], "s0").unionByName(labels(spark, drawn[1], "s1"))
    loose = {**default_parameters(), "area min": 4, "eccentricity min": 0.5, "thinness max": 1.5, "solidity min": 0.5}
    tight = {**loose, "area min": 8, "solidity min": 0.75}
    metrics = H.shape_metrics(rows)

    def plain(params, session=None):
        found = metrics.filter(H.keeps_shape(params))
        return {tuple(r) for r in (found if session is None else found.filter(F.col("session") == session)).select("session", "label").collect()}

    assert {tuple(r) for r in H.shape_candidates(rows, loose).collect()} == plain(loose)
    names = list(loose)
    table = spark.createDataFrame([("s0", *map(float, loose.values())), ("s1", *map(float, tight.values()))], ["session", *map(column_name, names)])
    got = {tuple(r) for r in H.shape_candidates(rows, table).collect()}
    assert got == plain(loose, "s0") | plain(tight, "s1") and len(plain(loose, "s1")) > len(plain(tight, "s1"))


# ------------------------------------------------------------------------- hulls
def test_hull_of_a_tall_region_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("s", 1, int(y), int(x)) for y in range(300) for x in {int(50 + 40 * np.sin(y / 60)), int(60 + rng.integers(0, 30))}]
    rows += [("s", 2, y, 7) for y in range(5)] + [("t", 1, 3, 4), ("s", 3, 400, 2), ("s", 3, 90, 9)]
    df = spark.createDataFrame(rows, "session string, label int, y int, x int").repartition(4)
    whole = sorted(map(tuple, hull.convex_hulls(df).collect()))
    monkeypatch.setattr(hull, "ROWS", 16)
    monkeypatch.setattr(hull, "CELLS", 50)
    assert sorted(map(tuple, hull.convex_hulls(df).collect())) == whole
    assert {r[:2]: r[2] for r in whole} == {("s", 1): len({r for r in rows if r[:2] == ("s", 1)}), ("s", 2): 5, ("s", 3): 2, ("t", 1): 1}
    assert {r[:2]: r[3] for r in whole}[("s", 2)] == 5 and hull.convex_hulls(df.limit(0)).count() == 0


def test_corners_equal_a_plain_chain():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        region, y = np.sort(rng.integers(0, 4, n)), rng.integers(0, 20, n).astype(float)
        v = rng.integers(0, 12, n).astype(float)
        got = list(zip(*hull.upper_hulls(region, y, v)))
        want = []
        for r in range(4):
            best = {}
            for a, b in zip(y[region == r], v[region == r]):
                best[a] = max(best.get(a, -1), b)
            chain = []
            for p in sorted(best.items()):
                while len(chain) > 1 and (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= (p[1] - chain[-2][1]) * (chain[-1][0] - chain[-2][0]):
                    chain.pop()
                chain.append(p)
            want += [(r, *p) for p in chain]
        assert got == want


# ---------------------------------------------------------------- log of changes
def ids(spark, *values):
    return spark.createDataFrame([("s", v) for v in values], "session string, label int")


def test_log_of_changes(spark, tmp_path):
    a = np.zeros((12, 12), dtype=int)
    for k in range(6):
        a[k * 2, 1 : 3 + k] = k + 1
    start = U.Curation(labels(spark, a), ids(spark, 1, 3), ids(spark, 2))
    log = ChangeLog.create(spark, str(tmp_path / "log"), start, depth=3)

    def now():
        s = ChangeLog(spark, str(tmp_path / "log"), depth=3).state()  # as another session would see it
        return grid(s.labels, "label", a.shape).tolist(), sorted(r.label for r in s.selected.collect()), sorted(r.label for r in s.fixed.collect())

    assert now() == (a.tolist(), [1, 3], [2]) and not log.undo()
    seen = [now()]

    def pick(*values):
        return lambda s: U.Curation(s.labels, ids(spark, *values), s.fixed)

    for change in (U.merge_selected, pick(2), U.delete_selected, pick(1, 2), U.merge_selected, pick(1), U.delete_selected):
        log.edit(change)
        seen.append(now())
    assert seen[1] != seen[0] and seen[3][0] != seen[2][0]
    # three edits can be undone, then a new one takes the place of what was undone
    for back in (6, 5, 4):
        assert log.undo() and now() == seen[back]
    assert not log.undo()
    log.edit(pick(3))
    assert now() == (seen[4][0], [3], seen[4][2]) and log.undo() and now() == seen[4]


def test_an_edit_that_fails_changes_nothing(spark, tmp_path):
    start = U.Curation(labels(spark, np.eye(4, dtype=int)), ids(spark, 1), ids(spark))
    log = ChangeLog.create(spark, str(tmp_path / "log"), start)

    def broken(s):
        bad = s.selected.withColumn("label", F.raise_error(F.lit("stop")).cast("int"))
        return U.Curation(s.labels.filter("y > 1"), bad, s.fixed)

    with pytest.raises(Exception, match="stop"):
        log.edit(broken)
    assert grid(log.state().labels, "label", (4, 4)).tolist() == np.eye(4).tolist()
    log.edit(lambda s: U.Curation(s.labels.filter("y > 2"), s.selected, s.fixed))
    assert grid(log.state().labels, "label", (4, 4)).sum() == 1


def test_stored_model(spark, tmp_path):
    model = ForegroundModel([0.5, -1.0, 2.0, 0.25, 3.0], -0.75, 0.01, 0.8)
    model.store(spark, str(tmp_path / "model"))
    back = ForegroundModel.load(spark, str(tmp_path / "model"))
    assert (back.weights, back.intercept, back.strength, back.dice) == (model.weights, model.intercept, model.strength, model.dice)
    spark.createDataFrame([("weight", FEATURES[0], 1.0)], "part string, name string, value double").write.parquet(str(tmp_path / "half"))
    with pytest.raises(ValueError, match="no weights"):
        ForegroundModel.load(spark, str(tmp_path / "half"))
