"""Tables of rules beside many rows: no step deals the rows by the few names that the rules have."""

import pytest

import __spark_entry__ as entry
from locusloom.operators import predict


@pytest.mark.parametrize("name, dealt", [("J2_common_classes", "area_id"), ("J5_merge_reactions", "group_id"), ("J6_area_products", "area_id"), ("I1_classify_domains", "-")])
def test_rows_are_dealt_by_owner_only(spark, name, dealt):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    of_rows = [line for line in exchanged if not any(f"hashpartitioning({c}" in line for c in ("name#", "profile#")) or "class#" in line or "substrate#" in line]
    assert all(f"hashpartitioning({dealt}#" in line or "class#" in line or "substrate#" in line for line in of_rows)
    assert "SortMergeJoin" not in plan


def test_owners_with_an_unnamed_or_a_foreign_row_have_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, None), (3, "a"), (3, "c"), (None, "a")], "group_id bigint, profile string")
    reactions = spark.createDataFrame([("a", "s", "p"), ("a", "s", "q"), ("a", "s", "p"), ("b", "s", "p")], "profile string, substrate string, product string")
    assert [tuple(r) for r in predict.merge_reactions(rows, reactions).collect()] == [(1, "s", "p")]


def test_windows_of_promoters_are_not_made_distinct(spark):
    anchors = spark.createDataFrame([(1, a) for a in (1, 1, 2, 7, 20)] + [(2, 1), (2, 3)], "record_id bigint, anchor int")
    counts = spark.createDataFrame([(1, 20), (2, 3)], "record_id bigint, n int")
    for reach, least in ((15, 4), (3, 1), (1, 1)):
        found = predict.promoter_sets(anchors, counts, reach, least)
        slow = {(r, a, max(1, a - m), min(n, a + p)) for r, a in anchors.collect() for n in [dict(counts.collect())[r]] for m in range(reach + 1) for p in range(reach + 1) if m + p >= 3}
        assert sorted(map(tuple, found.collect())) == sorted(x for x in slow if x[3] - x[2] + 1 >= least)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "Aggregate" not in plan[: plan.index("Join")]
