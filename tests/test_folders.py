"""Whole routes on folders of session files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.plans.dataset import manifest_from_folder
from pixelloom.plans.folders import evaluate_folder, predict_folder
from pixelloom.sources.sessions import read_sessions


def make_model():
    def load():
        return lambda batch: batch

    return load


plain_model = make_model()  # a local function, which goes to the workers by value


def blob(k):
    """A bright square and a speck on a dark image; the curated ROI covers part of the square."""
    image = np.zeros((20, 24), np.float32)
    image[3:9, 4 + k : 10 + k] = 10
    image[15, 20] = 9
    ys, xs = np.mgrid[3:9, 4 + k : 8 + k]
    return image, {7: {"xpix": xs.ravel(), "ypix": ys.ravel()}}


@pytest.fixture
def root(tmp_path):
    for k in range(6):
        folder = tmp_path / "in" / f"A{k}-day" / "processed_data"
        folder.mkdir(parents=True)
        image, rois = blob(k)
        np.save(folder / "rec_ref_mat_ch2.npy", image)
        np.save(folder / "rec_ROI_dict.npy", np.array(rois, dtype=object), allow_pickle=True)
    bad = tmp_path / "in" / "B-day" / "processed_data"
    bad.mkdir(parents=True)
    (bad / "ref_mat_ch2.npy").write_bytes(b"no array")
    return tmp_path


def test_predict_folder(spark, root):
    out = predict_folder(spark, str(root / "in"), plain_model, str(root / "out"), threshold=0.5, min_size=4)
    assert [r.session for r in out.unreadable.collect()] == ["B-day"]
    assert sorted(p.name for p in (root / "out").iterdir()) == [f"A{k}-day" for k in range(6)]
    for k in range(6):
        stored = np.load(root / "out" / f"A{k}-day" / "processed_data" / "rec_ROI_dict.npy", allow_pickle=True).item()
        ys, xs = np.mgrid[3:9, 4 + k : 10 + k]
        assert list(stored) == [1]
        assert stored[1]["xpix"].tolist() == xs.ravel().tolist() and stored[1]["ypix"].tolist() == ys.ravel().tolist()
    advice = {r.session: r.area_min for r in out.prediction.parameters.collect()}
    assert advice == {f"A{k}-day": 10 for k in range(6)}


def test_predict_folder_at_points(spark, root):
    points = spark.createDataFrame([("A0-day", 0.5, 1, None, False), ("A1-day", 0.95, 1, None, True), ("A2-day", 0.5, 1, 5, False)],
                                   "session string, threshold double, min_size int, max_size int, tta boolean")
    predict_folder(spark, str(root / "in"), plain_model, str(root / "out"), points=points)
    counts = {}
    for k in range(3):
        stored = np.load(root / "out" / f"A{k}-day" / "processed_data" / "rec_ROI_dict.npy", allow_pickle=True).item()
        counts[k] = sorted(len(r["xpix"]) for r in stored.values())
    assert counts == {0: [1, 36], 1: [36], 2: [1]} and not (root / "out" / "A3-day").exists()


def test_evaluate_folder(spark, root):
    manifest = manifest_from_folder(spark, str(root / "in"), splits=False, trusted=True).withColumn("split", F.lit("test"))
    rows = {r.session: r for r in evaluate_folder(spark, str(root / "in"), manifest, plain_model, trusted=True, threshold=0.5, min_size=4).collect()}
    assert set(rows) == {f"A{k}-day" for k in range(6)}
    for r in rows.values():
        assert (r.true_positive_pixels, r.false_positive_pixels, r.false_negative_pixels, r.predicted_components, r.target_components) == (24, 12, 0, 1, 1)
        assert r.dice == pytest.approx(48 / 60)
    with pytest.raises(ValueError, match="trusted"):
        evaluate_folder(spark, str(root / "in"), manifest, plain_model)
    assert read_sessions(spark, str(root / "in"), "sessions").count() == 7
