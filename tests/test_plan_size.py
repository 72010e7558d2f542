"""What several steps read is stored once, so the plan that the driver holds stays small."""

from pixelloom.workload import regions

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_own_parameters(spark):
    assert exchanges(regions.own_parameters(spark, SF)) < 60


def test_proposals(spark):
    assert exchanges(regions.propose_rois_query(spark, SF)) < 60
