"""Groups of areas by windows over records, against the steps of joins, and how often they deal rows."""

import random

import pytest

import __spark_entry__ as entry
from locusloom.operators import areas as ops

SCHEMA = "record_id bigint, id bigint, gene_id bigint, core_start bigint, core_end bigint, start bigint, end bigint"


@pytest.fixture(scope="module")
def defined(spark):
    """Areas with and without shared genes on crowded records, so that free areas lie in several groups, some of equal spans."""
    random.seed(5)
    rows = []
    for record in range(12):
        for k in range(14):
            low = random.randrange(0, 500, 10)
            size, side = random.choice([10, 30, 120]), random.choice([0, 10, 20])
            genes = random.sample(range(9), random.choice([1, 1, 2])) if k % 3 else [100 + k]
            rows += [(record, record << 32 | k + 1, record * 1000 + g, low, low + size, max(0, low - side), low + size + side) for g in genes]
        rows.append((record, record << 32 | 99, None, 900, 910, 890, 920))
    return spark.createDataFrame(rows, SCHEMA)


def test_members_are_the_groups_of_joins(spark, defined):
    areas = defined.drop("gene_id").distinct()
    defining = defined.where("gene_id is not null").select("id", "record_id", "gene_id")
    pairs = lambda df: sorted(df.select("group_id", "area").distinct().collect())
    members, hybrid = ops.hybrid_members(defined, 50), ops.hybrid_groups(areas, defining, 50)
    found = members.where("hybrid is not null").selectExpr("hybrid as group_id", "id as area")
    assert pairs(found) == pairs(hybrid)
    assert max(n for _, n in hybrid.groupBy("area").count().collect()) > 1
    interleaved = ops.interleaved_groups(areas, hybrid, 50)
    assert sorted(ops.distinct_members(ops.strong_members(members), "interleaved").collect()) == pairs(interleaved)
    strong = interleaved.unionByName(hybrid.join(interleaved.select("area"), "area", "left_anti"))
    neighbouring = ops.neighbouring_groups(areas, strong, 50)
    assert sorted(ops.distinct_members(ops.neighbour_members(members), "neighbouring").collect()) == pairs(neighbouring)
    rows = lambda df: sorted(map(str, df.select("record_id", "kind", "start", "end", "areas").collect()))
    assert rows(ops.candidate_rows(members)) == rows(ops.candidates(areas, defining, 50))


@pytest.mark.parametrize("name", ["F16_hybrid_groups", "F17_interleaved_groups", "F18_neighbouring_groups", "F19_candidates"])
def test_groups_deal_rows_once_after_they_are_stored(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 1
