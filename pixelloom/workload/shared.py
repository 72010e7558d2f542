"""Frames used by several registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.components import probability_to_labels
from pixelloom.operators.rois import rasterise_pixels
from pixelloom.workload import views

MIN_SIZE = 4
THRESHOLD = 0.25


def predicted_labels(spark: SparkSession, sf: str) -> DataFrame:
    return probability_to_labels(
        views.pixels(spark, sf), THRESHOLD, MIN_SIZE, max_side=views.SIDE
    )


def target_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Targets drawn from the raw ROI pixels."""
    return rasterise_pixels(views.roi_pixels(spark, sf), views.sessions(spark, sf))


def target_mask(spark: SparkSession, sf: str) -> DataFrame:
    return views.pixels(spark, sf).filter("target = 1").select("session", "y", "x")


def target_mask_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The target flags as a label table: label 1 + y div 8 stands for a curated ROI."""
    return target_mask(spark, sf).withColumn("label", (F.col("y") / 8).cast("int") + 1)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Session rows with a fixed split and ROI counts standing in for a full manifest."""
    key = F.substring("session", 5, 10).cast("int")
    return views.sessions(spark, sf).withColumn(
        "split", F.when(~F.col("included"), "").when(key % 5 == 1, "test")
        .when(key % 5 == 2, "val").when(key % 5 == 3, "").otherwise("train")
    ).withColumn(
        "exclusion_reason", F.when(F.col("included"), "").when(key % 20 == 0, "no ROI dict").otherwise("")
    ).withColumn("roi_count", (key % 7).cast("bigint")).withColumn(
        "positive_pixels", (key * 3).cast("bigint")
    )


MANIFEST_SQL = """
    select *, cast(case when not included then '' when k % 5 = 1 then 'test' when k % 5 = 2 then 'val'
                        when k % 5 = 3 then '' else 'train' end as varchar) as split,
           case when included then '' when k % 20 = 0 then 'no ROI dict' else '' end as exclusion_reason,
           cast(k % 7 as bigint) as roi_count, cast(k * 3 as bigint) as positive_pixels
    from (select *, cast(substr(session, 5, 10) as int) as k from fx_sessions)"""
