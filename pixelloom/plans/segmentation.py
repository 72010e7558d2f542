"""Model-free segmentation, from raw pixels to numbered ROIs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.scalars import column_name
from pixelloom.operators.components import TILE
from pixelloom.operators.curate import combine_fixed
from pixelloom.operators.intensity import enhance_contrast, median3, threshold_to_zero
from pixelloom.operators.parameters import default_parameters
from pixelloom.operators.proposals import candidate_labels, run_statistics
from pixelloom.operators.shape import shape_candidates
from pixelloom.operators.spread import salted_join
from pixelloom.session import StoredTable


@dataclass(frozen=True)
class Segmentation:
    rois: DataFrame
    labels: DataFrame
    stats: DataFrame


def prepare(
    dense: DataFrame, shapes: DataFrame, params: Mapping[str, float] | DataFrame | None = None
) -> DataFrame:
    """Median, contrast enhancement and brightness cut; parameters are one set, or a table of each image's own."""
    if isinstance(params, DataFrame):
        kernel = params.select("session", F.col(column_name("tophat kernel")).alias("kernel"))
        clip = params.select("session", F.col(column_name("clahe clip")).alias("clip"))
        cut = params.select("session", F.col(column_name("MSER threshold")).cast("double").alias("percentile"))
    else:
        own = {**default_parameters(), **(params or {})}
        kernel, clip, cut = int(own["tophat kernel"]), float(own["clahe clip"]), float(own["MSER threshold"])
    prepared = StoredTable(enhance_contrast(median3(dense), shapes, kernel, clip)).df
    return threshold_to_zero(prepared, cut)


def propose_rois(
    dense: DataFrame, shapes: DataFrame, params: Mapping[str, float] | DataFrame | None = None,
    fixed_rois: DataFrame | None = None, tile: int = TILE, max_side: int | None = None,
) -> Segmentation:
    """Median, contrast enhancement, brightness cut, stable regions, shape filter, and
    fixed ROIs kept ahead of everything found.

    ``params`` is one set for all images, or a table with a row of parameters for each, as
    ``recommend`` gives; images without a row are left out. ``clip-percentile`` is accepted but
    has no effect: contrast is always scaled between percentiles 1 and 99. Tables that later steps
    read several times are stored once.
    """
    if isinstance(params, DataFrame):
        params = StoredTable(params).df
        shapes = shapes.join(params.select("session"), "session", "left_semi")
    else:
        params = {**default_parameters(), **(params or {})}
    regions, drawn = candidate_labels(StoredTable(prepare(dense, shapes, params)).df, params, tile, max_side)
    regions = StoredTable(regions).df
    drawn = StoredTable(drawn).df
    good = StoredTable(shape_candidates(drawn, params)).df
    candidates = StoredTable(salted_join(drawn, good, ["session", "label"], ["y"], "inner", salts=8).withColumnRenamed(
        "label", "roi_id"
    )).df
    fixed_rois = candidates.limit(0) if fixed_rois is None else StoredTable(fixed_rois).df
    rois, labels = combine_fixed(fixed_rois, candidates)
    kept = rois.select("session", "label", "is_fixed").distinct()
    stats = run_statistics(shapes, regions, good, kept, kept.filter(F.col("is_fixed")))
    return Segmentation(rois, labels, stats)
