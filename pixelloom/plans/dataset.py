"""The dataset table, from a folder of sessions to a split manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.manifest import (
    assign_splits, build_manifest, exclusion_reasons, pair_files,
)
from pixelloom.operators.rois import clean_rois, summarise_records
from pixelloom.session import StoredTable
from pixelloom.sources.sessions import read_files, read_sessions


def manifest_from_folder(
    spark: SparkSession, root: str, val_fraction: float = 0.15, test_fraction: float = 0.15,
    seed: int = 7, splits: bool = True, trusted: bool = False,
) -> DataFrame:
    """One row per session folder. Excluded sessions are listed but never decoded."""
    sessions = read_sessions(spark, root, "sessions")
    files = StoredTable(read_sessions(spark, root)).df
    used = exclusion_reasons(sessions, files).filter("included").select("session")
    pairs = StoredTable(pair_files(files).join(used, "session", "left_semi")).df

    def wanted(name: str) -> DataFrame:
        return files.join(pairs.select("session", F.col(name).alias("name")), ["session", "name"], "left_semi")

    shapes = read_files(wanted("image_name"), root, "shapes").filter("error is null")
    shapes = StoredTable(shapes.select("session", "height", "width")).df
    cleaned = StoredTable(clean_rois(read_files(wanted("roi_name"), root, "rois", trusted), shapes)).df
    manifest = build_manifest(sessions, files, shapes, summarise_records(cleaned, shapes))
    return assign_splits(manifest, val_fraction, test_fraction, seed) if splits else manifest
