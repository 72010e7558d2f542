"""The session folder source and the ROI file sink: what is opened, what is written, what a failure leaves."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators.components import explode_rois
from pixelloom.sources import sessions as S

ROIS = {3: {"xpix": [1, 2], "ypix": [1, 1]}, 1: {"xpix": [2, 99], "ypix": [1, 1]}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("session folders")
    for k in range(12):
        folder = base / f"A{k % 3}-day{k}" / "processed_data"
        folder.mkdir(parents=True)
        np.save(folder / "ref_mat_ch2.npy", np.arange(48 + 8 * k, dtype=np.uint8).reshape(6 + k, 8))
        np.save(folder / "day_ROI_dict.npy", np.array(ROIS, dtype=object), allow_pickle=True)
    (base / "B-none").mkdir()
    bad = base / "B-bad" / "processed_data"
    bad.mkdir(parents=True)
    (bad / "ref_mat_ch2.npy").write_bytes(b"not an array")
    np.save(bad / "x_ref_mat_ch2.npy", np.ones((2, 2, 2)))
    (base / "loose.npy").write_bytes(b"")
    return str(base)


def test_listing(spark, root):
    got = {r.session: r.has_processed for r in S.read_sessions(spark, root, "sessions").collect()}
    assert got == {**{f"A{k % 3}-day{k}": True for k in range(12)}, "B-none": False, "B-bad": True}
    files = S.read_sessions(spark, root, "files").collect()
    assert len(files) == 26 and all(os.path.getsize(r.path) == r.length for r in files)


def test_shapes_and_images(spark, root):
    shapes = {r.path: r for r in S.read_sessions(spark, root, "shapes").collect()}
    images = {r.path: r for r in S.read_sessions(spark, root, "images").collect()}
    assert set(shapes) == set(images) and len(shapes) == 14
    for path, image in images.items():
        assert (shapes[path].height, shapes[path].width) == (image.height, image.width)
        assert (shapes[path].error is None) == (image.error is None) == ("B-bad" not in path)
        assert len(image.pixels) == image.height * image.width


class Counting:
    """A file system that notes what is looked into and how many bytes are read."""

    def __init__(self, system):
        self.system, self.listed, self.bytes = system, [], 0

    def get_file_info(self, what):
        if not isinstance(what, str):
            self.listed.append(what.base_dir)
        return self.system.get_file_info(what)

    def open_input_file(self, path):
        outer, file = self, self.system.open_input_file(path)

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def read_at(self, n, at):
                data = file.read_at(n, at)
                outer.bytes += len(data)
                return data

            def read(self):
                data = file.read()
                outer.bytes += len(data)
                return data

        return File()


def test_what_is_opened(root, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    made = []

    def counted(path):
        made.append(Counting(S.arrow_fs.LocalFileSystem()))
        return made[-1], path

    monkeypatch.setattr(S, "opened", counted)
    whole = S.SessionReader({"path": root, "table": "shapes", "partitions": "1"})
    rows = list(whole.read(whole.partitions()[0]))
    assert len(rows) == 14 and made[-1].bytes <= 14 * S.HEAD
    some = S.SessionReader({"path": root, "table": "images", "partitions": "4"})
    left = list(some.pushFilters([In(("session",), ("A0-day0", "A1-day1", "gone")), EqualTo(("session",), "A0-day0"), GreaterThan(("height",), 2)]))
    assert left == [GreaterThan(("height",), 2)]
    made.clear()
    rows = [r for share in some.partitions() for r in some.read(share)]
    assert [r[0] for r in rows] == ["A0-day0"]
    assert [d for m in made for d in m.listed] == [f"{root}/A0-day0/processed_data"]
    assert sum(m.bytes for m in made) == os.path.getsize(f"{root}/A0-day0/processed_data/ref_mat_ch2.npy")


def test_filters_reach_the_source(spark, root):
    df = S.read_sessions(spark, root, "images").filter("session = 'A2-day2' and height > 3")
    assert [r.session for r in df.collect()] == ["A2-day2"]
    assert S.read_sessions(spark, root, "files").filter(F.col("session").isin("A0-day3", "A1-day4")).count() == 4


def test_roi_files_need_trust(spark, root):
    with pytest.raises(Exception, match="trusted"):
        S.read_sessions(spark, root, "rois").collect()
    rows = S.read_sessions(spark, root, "rois", trusted=True).filter("session = 'A0-day0'").orderBy("ord").collect()
    assert [(r.roi_id, r.ord, r.xpix, r.ypix) for r in rows] == [(3, 1, ["1", "2"], ["1", "1"]), (1, 2, ["2", "99"], ["1", "1"])]


PACKED = "session string, roi_id int, ord int, part int, xpix array<bigint>, ypix array<bigint>"


def test_round_trip_of_roi_files(spark, tmp_path):
    rows = [(f"s{k}", i, i, part, [k, i + part], [1, 2]) for k in range(30) for i in range(1, 4) for part in (0, 1)]
    images = spark.createDataFrame([(f"s{k}", "day_ref_mat_ch2.npy" if k % 2 else "ref_mat_ch2.npy") for k in range(31)], "session string, name string")
    out = f"{tmp_path}/out put"
    S.write_roi_files(spark.createDataFrame(rows, PACKED).repartition(7), images, out)
    assert sorted(os.listdir(out)) == sorted(f"s{k}" for k in range(31))
    assert os.listdir(f"{out}/s3/processed_data") == ["day_ROI_dict.npy"] and os.listdir(f"{out}/s4/processed_data") == ["ref_mat_ch2.npy_ROI_dict.npy"]
    back = S.read_sessions(spark, out, "rois", trusted=True).withColumn("part", F.lit(0))
    back = back.withColumn("xpix", F.col("xpix").cast("array<bigint>")).withColumn("ypix", F.col("ypix").cast("array<bigint>"))
    got = sorted((r.session, r.roi_id, r.x, r.y) for r in explode_rois(back).collect())
    assert got == sorted((s, i, x, y) for s, i, _, _, xs, ys in rows for x, y in zip(xs, ys))
    assert np.load(f"{out}/s30/processed_data/ref_mat_ch2.npy_ROI_dict.npy", allow_pickle=True).item() == {}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = [(f"s{k}", 1, 1, 0, [k], [1]) for k in range(20)]
    images = spark.createDataFrame([(f"s{k}", "ref_mat_ch2.npy") for k in range(20)], "session string, name string")
    broken = F.when(F.col("session") == "s7", F.raise_error(F.lit("stop"))).otherwise(F.lit(1)).cast("int")
    out = f"{tmp_path}/failed"
    with pytest.raises(Exception, match="stop"):
        S.write_roi_files(spark.createDataFrame(rows, PACKED).withColumn("ord", broken), images, out)
    assert not [f for _, _, files in os.walk(out) for f in files]
