"""Components are counted in the prediction and in the drawn target, as the reference's counts are."""

import __spark_entry__ as entry
from pixelloom.operators import scores as S

SF = "/root/testdata/sf0.001"
LABELS = "session string, y int, x int, label int"


def test_both_sides_are_counted(spark):
    pred = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 2, 2, 5), ("b", 0, 0, 3), ("c", 0, 0, 0)], LABELS)
    target = spark.createDataFrame([("a", 0, 0, 1), ("a", 5, 5, 0), ("d", 1, 1, 2), ("d", 1, 2, 4)], LABELS)
    assert sorted(map(tuple, S.component_counts(pred, target).collect())) == [("a", 2, 1), ("b", 1, 0), ("d", 0, 2)]


def test_query_counts_the_prediction(spark):
    found = entry.queries()["component_counts"](spark, SF)
    assert found.columns == ["session", "predicted_components", "target_components"]
    assert all(r.predicted_components > 1 and r.target_components > 1 for r in found.collect())
