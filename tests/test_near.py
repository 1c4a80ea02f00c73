"""Rows near each other on lines and circles, and rules over them, against plain loops."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from locusloom.operators.joins import areas_by_gene, nearest_with_profile, neighbours
from locusloom.operators.rules import Rule, Rules, evaluate_rules, gene, min_score, minimum, profile, repeatable
from locusloom.plans.intervals import near_join
from locusloom.plans.nearness import near_counts

ROWS = "record_id long, gene_id long, start long, end long"


def apart(a, b, ring):
    """Bases between two half-open spans, walked over if the record is a circle; None on different records."""
    if ring is None:
        return max(0, b[2] - a[3], a[2] - b[3])
    cells = lambda x: {k % ring for k in range(x[2], max(x[3], x[2] + 1))}
    first, second = cells(a), cells(b)
    if first & second:
        return 0
    return min(min((y - x - 1) % ring, (x - y - 1) % ring) for x in first for y in second)


def genome(seed, rings=(None, 90, 61, None)):
    rng = random.Random(seed)
    rows = []
    for record, ring in enumerate(rings):
        for k in range(14):
            start = rng.randrange(ring or 120)
            rows.append((record, 100 * record + k, start, start + rng.choice([1, 2, 5, 9, 30])))
    return rows, dict(enumerate(rings))


def lengths_of(spark, rings):
    return spark.createDataFrame([(k, ring or 500, ring is not None) for k, ring in rings.items()], "record_id long, length long, circular boolean")


@pytest.mark.parametrize(("seed", "reach", "width"), [(2, 30, 30), (3, 200, 11)])
def test_pairs_on_lines_and_circles(spark, seed, reach, width):
    rows, rings = genome(seed)
    frame = spark.createDataFrame(rows, ROWS)
    found = near_join(frame, frame, reach, width, lengths_of(spark, rings)).select("l.gene_id", "r.gene_id", "distance").collect()
    expected = [(a[1], b[1], apart(a, b, rings[a[0]])) for a in rows for b in rows if a[0] == b[0] and apart(a, b, rings[a[0]]) < reach]
    assert sorted(map(tuple, found)) == sorted(expected)
    once = neighbours(frame, reach, lengths_of(spark, rings)).collect()
    assert sorted((r.a, r.b, r.distance) for r in once) == sorted(x for x in expected if x[0] < x[1])


def test_nearest_is_minus_one_without_and_goes_over_the_origin(spark):
    rows, rings = genome(5)
    frame, hits = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(r[0], r[1], "p") for r in rows if r[1] % 7 == 0], "record_id long, gene_id long, profile string")
    found = {r.gene_id: r.distance for r in nearest_with_profile(frame, hits, ["p"], 12, lengths_of(spark, rings)).collect()}
    for a in rows:
        near = [apart(a, b, rings[a[0]]) for b in rows if a[0] == b[0] and b[1] % 7 == 0]
        near = [d for d in near if d < 12]
        assert found[a[1]] == min(near, default=-1)
    assert -1 in found.values() and len(found) == len(rows)


def test_named_areas_wrap_clamp_and_cover(spark):
    features = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 50, 60), (1, 3, 95, 104), (2, 4, 5, 10), (2, 5, 90, 99)], ROWS)
    lengths = spark.createDataFrame([(1, 100, True), (2, 100, False)], "record_id long, length long, circular boolean")
    names = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 9)], "gene_id long")
    found = {r.gene_id: (r.start, r.end) for r in areas_by_gene(features, names, lengths, 20).collect()}
    assert found == {1: (85, 130), 2: (30, 80), 3: (75, 124), 4: (0, 30), 5: (70, 100), 9: (None, None)}
    assert {r.gene_id: (r.start, r.end) for r in areas_by_gene(features, names, lengths, 48).collect()}[1] == (0, 100)


@pytest.mark.parametrize("seed", [6])
def test_counts_near_equal_loops(spark, seed):
    rows, rings = genome(seed)
    flagged = [(*r, int(r[1] % 2 == 0), int(r[1] % 3 == 0)) for r in rows]
    frame = spark.createDataFrame(flagged, ROWS + ", even int, third int")
    facts = {"n_even": ("even", 6), "n_third": ("third", 6), "n_far": ("even", 25)}
    for lengths, ring_of in ((lengths_of(spark, rings), rings), (None, dict.fromkeys(rings))):
        found = {r.gene_id: (r.n_even, r.n_third, r.n_far) for r in near_counts(frame, facts, lengths).collect()}
        for a in flagged:
            near = [(apart(a, b, ring_of[a[0]]), b) for b in flagged if a[0] == b[0] and a[1] != b[1]]
            assert found[a[1]] == (sum(b[4] for d, b in near if d < 6), sum(b[5] for d, b in near if d < 6), sum(b[4] for d, b in near if d < 25))
        assert len(found) == len(rows)


CONDITIONS = {
    "and": profile("A") & (profile("B") | ~profile("C")),
    "min": minimum(3, ["A", "B", "D"]),
    "rep": repeatable(4, ["A", "C"]),
    "gene": gene(profile("A") & profile("B")) & profile("C"),
    "score": min_score("B", 50) | (profile("D") & ~profile("A")),
}


def judged(condition, own, near):
    """Met, matches and wanted profiles of the conditions above, written out for the profiles of a gene and of those near it."""
    has = lambda p: p in own or any(p in n for n in near)
    lacks = lambda *names: {p for p in names if p not in own}
    if condition == "and":
        return has("A") and (has("B") or not has("C")), {p for p in "ABC" if p in own}, lacks("A", "B", "C")
    if condition == "min":
        met = sum(map(has, "ABD")) >= 3
        return met, {p for p in "ABD" if p in own}, set("ABD") if met and sum(p in own for p in "ABD") < 3 else set()
    if condition == "rep":
        met = sum(p in g for g in [own, *near] for p in "AC") >= 4
        return met, {p for p in "AC" if p in own}, set("AC") if met else set()
    if condition == "gene":
        both = lambda g: "A" in g and "B" in g
        return (both(own) or any(map(both, near))) and has("C"), ({"A", "B"} if both(own) else set()) | ({"C"} & set(own)), lacks("C")
    enough = lambda g: g.get("B", -1) >= 50
    met = enough(own) or any(map(enough, near)) or (has("D") and not has("A"))
    return met, ({"B"} if enough(own) else set()) | {p for p in "AD" if p in own}, lacks("D", "A")


@pytest.mark.parametrize("seed", [8, 9])
def test_rules_equal_loops_on_lines_and_circles(spark, seed):
    rows, rings = genome(seed)
    rng = random.Random(seed)
    hits = [(r[0], r[1], p, float(rng.randrange(100))) for r in rows for p in "ABCD" for _ in range(2) if rng.random() < 0.25]
    own = {r[1]: {} for r in rows}
    for _, gene_id, p, score in hits:
        own[gene_id][p] = max(score, own[gene_id].get(p, 0))
    cutoffs = {"and": 9, "min": 9, "rep": 14, "gene": 5, "score": 14}
    rules = Rules(tuple(Rule(name, condition, cutoffs[name], 10) for name, condition in CONDITIONS.items()))
    frame = spark.createDataFrame(rows, ROWS)
    found = evaluate_rules(frame, spark.createDataFrame(hits, "record_id long, gene_id long, profile string, score double"), rules, lengths_of(spark, rings)).collect()
    expected = {}
    for a in rows:
        if not own[a[1]]:
            continue
        for name in CONDITIONS:
            near = [b for b in rows if b[0] == a[0] and b[1] != a[1] and own[b[1]] and apart(a, b, rings[a[0]]) < cutoffs[name]]
            met, matches, wanted = judged(name, own[a[1]], [own[b[1]] for b in near])
            if met and matches:
                expected.setdefault((a[1], name), set()).update(matches)
                for b in near:
                    if shared := wanted & set(own[b[1]]):
                        expected.setdefault((b[1], name), set()).update(shared)
    assert {(r.gene_id, r.rule): set(r.matches) for r in found} == expected


def test_one_user_of_fifty_thousand_events_a_day(spark):
    """Everything is near everything, which pairs or arrays of neighbours would not survive."""
    n = 50_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("record_id"), F.col("id").alias("gene_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.when(F.col("id") == 7, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("profile"), F.lit(1.0).alias("score"))
    rules = Rules((Rule("all", profile("even") & profile("rare"), 86_400, 10), Rule("many", repeatable(n - 1, ["even", "odd"]), 86_400, 10), Rule("none", minimum(2, ["even", "absent"]), 86_400, 10)))
    began = time.time()
    found = {(r.rule, r.n): r.k for r in evaluate_rules(rows, rows, rules).groupBy("rule", F.size("matches").alias("n")).agg(F.count("*").alias("k")).collect()}
    assert found == {("all", 1): n // 2 + 1, ("many", 1): n - 1}
    assert time.time() - began < 120


def test_no_rules_give_no_rows(spark):
    rows = spark.createDataFrame([(1, 1, 0, 9, "A", 1.0)], ROWS + ", profile string, score double")
    assert evaluate_rules(rows, rows, Rules()).count() == 0
