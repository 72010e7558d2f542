"""The model-free route holds every target ROI fixed, with all its pixels."""

from pyspark.sql import functions as F

from pixelloom.workload import regions, shared

SF = "/root/testdata/sf0.001"


def test_all_targets_are_fixed(spark):
    found = regions.propose_rois_query(spark, SF).collect()
    targets = shared.target_labels(spark, SF).groupBy("session", "label").agg(F.count("*").alias("area")).collect()
    assert sorted((r.session, r.label, r.area) for r in found if r.is_fixed) == sorted(map(tuple, targets))
    assert any(not r.is_fixed for r in found)
