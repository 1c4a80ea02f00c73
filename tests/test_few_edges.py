"""What is left of a graph is united by one step, with the components of the rounds."""

import random

from pyspark.sql import functions as F

from locusloom.plans.graph import components


def test_small_graphs_take_no_rounds(spark):
    random.seed(3)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    rows = lambda **few: sorted(map(tuple, components(df, **few).collect()))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for group, few in (("united", {}), ("rounds", {"few": 0}), ("both", {"few": 60})):
        spark.sparkContext.setJobGroup(group, group)
        jobs.append((rows(**few), len(tracker.getJobIdsForGroup(group))))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0][0] == jobs[1][0] == jobs[2][0]
    assert jobs[0][1] <= 10 < jobs[1][1]


def test_ends_that_cannot_be_null(spark):
    # Hashes are never null, and their schema says so, as those of E3_resolve_equivalents.
    df = spark.range(6).select(F.xxhash64(F.lit("x"), F.col("id")).alias("a"), F.xxhash64(F.lit("x"), F.col("id") + 1).alias("b"))
    assert not df.schema["a"].nullable
    ends = {r["a"] for r in df.collect()} | {r["b"] for r in df.collect()}
    assert sorted(map(tuple, components(df).collect())) == sorted((node, min(ends)) for node in ends)
    assert components(df.limit(0)).collect() == []
