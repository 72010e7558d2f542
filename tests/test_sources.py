import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import labels, shapes
from pixelloom.operators.components import explode_rois, pack_rois
from pixelloom.plans.dataset import manifest_from_folder
from pixelloom.schemas import MANIFEST_COLUMNS
from pixelloom.session import StoredTable
from pixelloom.sources import files as D
from pixelloom.sources import tables as T


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("data set")
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    rois = {3: {"xpix": [1, 2], "ypix": [1, 1]}, 1: {"xpix": [2, 99], "ypix": [1, 1]}, 2: {"xpix": ["no"], "ypix": [0]}}

    def session(name, *arrays, folder=True):
        place = base / name / "processed_data"
        (place if folder else place.parent).mkdir(parents=True)
        for file in arrays:
            np.save(place / file, rois if file.endswith("_ROI_dict.npy") else image)

    session("A1-day1", "ref_mat_ch2.npy", "zz_ref_mat_ch2.npy", "zz_ROI_dict.npy", "A1-day1_ROI_dict.npy")
    session("A1-day2", "old_ref_mat_ch2.npy", "aa_ROI_dict.npy", "old_ROI_dict.npy")
    session("A2-none", folder=False)
    session("A2-empty")
    session("A2-norois", "ref_mat_ch2.npy")
    session("A2-1100", "ref_mat_ch2.npy", "x_ROI_dict.npy", "mean_1100_map.npy")
    return str(base)


def test_manifest_from_a_folder(spark, root):
    manifest = manifest_from_folder(spark, root, trusted=True)
    assert manifest.columns[:3] == MANIFEST_COLUMNS[:3] and set(manifest.columns) == set(MANIFEST_COLUMNS)
    rows = {r.session: r for r in manifest.collect()}
    assert {k: r.exclusion_reason for k, r in rows.items()} == {
        "A1-day1": "", "A1-day2": "", "A2-none": "no processed_data", "A2-empty": "no channel-2 reference",
        "A2-norois": "no ROI dict", "A2-1100": "contains 1100 reference",
    }
    one, two = rows["A1-day1"], rows["A1-day2"]
    assert one.image_path.endswith("/ref_mat_ch2.npy") and one.roi_path.endswith("/A1-day1_ROI_dict.npy")
    assert two.image_path.endswith("old_ref_mat_ch2.npy") and two.roi_path.endswith("old_ROI_dict.npy")
    assert (one.height, one.width, one.roi_count, one.positive_pixels, one.invalid_roi_entries) == (6, 8, 2, 2, 2)
    assert (one.animal, one.median_roi_area_px, one.min_roi_area_px, one.max_roi_area_px) == ("A1", 1.5, 1, 2)
    assert {one.split, two.split} == {"test", "train"} and rows["A2-none"].split == ""
    assert rows["A2-none"].roi_count == 0 and rows["A2-none"].height is None


def test_manifest_file_round_trip(spark, root, tmp_path):
    manifest = StoredTable(manifest_from_folder(spark, root, trusted=True)).df
    path = str(tmp_path / "manifest")
    T.write_manifest(manifest, path)
    back = T.read_manifest(spark, path)
    assert back.columns == MANIFEST_COLUMNS
    want = {r.session: (r.roi_count, r.included, r.split) for r in manifest.collect()}
    assert {r.session: (r.roi_count, r.included, r.split) for r in back.collect()} == want
    assert T.read_manifest(spark, path, included_only=True).count() == 2
    assert T.read_manifest(spark, path, split="test").count() == 1
    assert T.read_manifest(spark, path).filter("not included").first().height == 0


def test_bad_arrays_are_set_aside(spark, tmp_path):
    for name, array in (("a", np.ones((2, 3))), ("b", np.ones((1, 2, 3))), ("c", np.ones((2, 2, 2)))):
        folder = tmp_path / name / "processed_data"
        folder.mkdir(parents=True)
        np.save(folder / "ref_mat_ch2.npy", array)
    broken = tmp_path / "d" / "processed_data"
    broken.mkdir(parents=True)
    (broken / "ref_mat_ch2.npy").write_bytes(b"not an array")
    files = D.scan_files(spark, str(tmp_path))
    good, bad = D.decode_images(D.read_contents(spark, str(tmp_path), files))
    assert sorted((r.session, r.height, r.width, len(r.pixels)) for r in good.collect()) == [("a", 2, 3, 6), ("b", 2, 3, 6)]
    assert sorted(r.session for r in bad.collect()) == ["c", "d"]


def test_roi_files_need_trust(spark, root):
    with pytest.raises(ValueError, match="trusted"):
        D.decode_rois(D.scan_files(spark, root))


def test_scan_does_not_read_contents(spark, root):
    plan = D.scan_files(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_roi_table_round_trip(spark, tmp_path):
    drawn = np.zeros((6, 8), dtype=int)
    drawn[1:3, 2:5], drawn[4, 6:8] = 1, 2
    path = str(tmp_path / "round trip rois")
    packed = pack_rois(labels(spark, drawn))
    D.write_rois(packed, path)
    back = D.read_rois(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(
        tuple(r) for r in packed.select(*back.columns).collect()
    )
    assert explode_rois(back).count() == (drawn > 0).sum()
    assert shapes(spark, ("s", 6, 8)).count() == 1


def test_scores_and_histories_have_sorted_columns(spark, tmp_path):
    scores = spark.createDataFrame([("s", 0.5, "a")], "session string, dice double, animal string")
    T.write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).columns == ["animal", "dice", "session"]
    a = spark.createDataFrame([(1, 0.5)], "epoch int, train_loss double")
    b = spark.createDataFrame([(2, 0.25)], "epoch int, dice_loss double")
    T.write_history([a, b], str(tmp_path / "history"))
    T.write_history([a, b], str(tmp_path / "history"))
    back = T.read_history(spark, str(tmp_path / "history"))
    assert back.columns == ["dice_loss", "epoch", "train_loss"]
    assert sorted(map(tuple, back.collect()), key=str) == [(0.25, 2, None), (None, 1, 0.5)]
    assert back.agg(F.count("*").alias("n")).first().n == 2
