"""Joins of tables that grow with the data send nothing whole through the driver."""

from pyspark.sql import functions as F

from pixelloom.operators.spread import bucketed_row_number, group_quantiles, salted_join


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    done = df.repartition(1)
    done.collect()
    return done._jdf.queryExecution().executedPlan().toString()


def test_repetitive_rows_are_not_broadcast(spark):
    big = spark.range(2000).select(F.concat(F.lit("A0-s"), F.col("id") % 50).alias("session"), (F.col("id") % 32).alias("y"))
    facts = big.groupBy("session").agg(F.count("*").alias("n"))
    joined = salted_join(big, facts, ["session"], ["y"], "inner")
    assert joined.count() == 2000
    numbered = bucketed_row_number(big, ["session"], F.col("y"), [F.col("y")], "place")
    cuts = group_quantiles(big, ["session"], "y", {"mid": 0.5})
    for df in (joined, numbered, cuts):
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
