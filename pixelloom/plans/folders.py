"""From session folders to ROI files, and from session folders to scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.manifest import pair_files, reference_images, select_rows
from pixelloom.operators.rois import clean_rois, rasterise, record_pixels, whole_rois
from pixelloom.operators.scores import score_sessions
from pixelloom.plans.prediction import Prediction, predict_images
from pixelloom.session import StoredTable
from pixelloom.sources.sessions import read_files, read_sessions, write_roi_files


@dataclass(frozen=True)
class FolderPrediction:
    """What was predicted, and the images that could not be read ``(session, path, error)``."""

    prediction: Prediction
    unreadable: DataFrame


def _images(files: DataFrame, named: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Images ``(session, name, height, width, pixels)`` of ``named(session, name)``, and those that fail."""
    found = StoredTable(read_files(files.join(named, ["session", "name"], "left_semi"), root, "images")).df
    good = found.filter("error is null").select("session", "name", "height", "width", "pixels")
    return good, found.filter("error is not null").select("session", "path", "error")


def predict_folder(
    spark: SparkSession, root: str, load: Callable, out: str | None = None, points: DataFrame | None = None, **options
) -> FolderPrediction:
    """Predict the reference image of every session under ``root`` and write the ROI files.

    The files go next to the images, or under ``out`` in folders of the same names, by their default
    name. ``points`` or ``options`` are as in ``predict_images``. An unreadable image gets no file.
    """
    files = StoredTable(read_sessions(spark, root)).df
    named = reference_images(files).select("session", F.col("image_name").alias("name"))
    images, unreadable = _images(files, named, root)
    found = predict_images(images.drop("name"), load, points=points, **options)
    write_roi_files(StoredTable(found.rois).df, images.join(found.points.select("session"), "session", "left_semi").select("session", "name"), out or root)
    return FolderPrediction(found, unreadable)


def evaluate_folder(
    spark: SparkSession, root: str, manifest: DataFrame, load: Callable, split: str = "test", trusted: bool = False, **options
) -> DataFrame:
    """Scores of every included session of a split, from its image and its curated ROI file.

    Only the files of these sessions are opened. ``options`` are as in ``predict_images``.
    """
    rows = select_rows(manifest, included_only=True, split=split)
    wanted = rows.select("session")
    files = StoredTable(read_sessions(spark, root).join(wanted, "session", "left_semi")).df
    pairs = StoredTable(pair_files(files)).df
    images, _ = _images(files, pairs.select("session", F.col("image_name").alias("name")), root)
    predicted = StoredTable(predict_images(images.drop("name"), load, **options).labels).df
    curated = read_files(
        files.join(pairs.select("session", F.col("roi_name").alias("name")), ["session", "name"], "left_semi"), root, "rois", trusted
    )
    cleaned = StoredTable(clean_rois(curated, images.select("session", "height", "width"))).df
    target = rasterise(record_pixels(cleaned), whole_rois(cleaned))
    return score_sessions(predicted, target, rows)
