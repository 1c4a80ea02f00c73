"""Site checks, kernel scores and component similarity against plain Python."""

from __future__ import annotations

import math
import random

import pytest

from locusloom.operators import compare, kernels, sites


def test_every_site_check_says_each_of_its_labels(spark):
    rows, expected = [], {}
    for k, (site, profile, scaffold, residues, target, labels, other, failed) in enumerate(sites.CHECKS):
        cases = [(True, letters, label) for letters, label in labels.items()] + [(True, "-" * len(target), other), (False, next(iter(labels)), failed or next(iter(labels.values()))), (None, "", failed or other)]
        for j, (holds, letters, label) in enumerate(cases):
            hit_start = j % 2
            at = ["G" if r != "G" else "A" for r in ["A"] * 420]
            for p, r in zip(target, letters, strict=False):
                at[p - hit_start - 1] = r
            for p, r in zip(scaffold, residues, strict=True):
                at[p - 1] = r if holds else "Q"
            for p, r in zip(target, letters, strict=False):
                if not holds:
                    at[p - hit_start - 1] = r
            if holds and any(at[p - hit_start - 1] != r for p, r in zip(target, letters, strict=False)):
                continue  # the scaffold takes the target's place at this shift
            if holds is None:
                at = at[:3]
            query = "".join(("x" + c) if (i + j) % 5 == 0 else c for i, c in enumerate(at))
            reference = "".join(".p" if (i + j) % 5 == 0 else "p" for i in range(len(at)))
            rows.append((1000 * k + j, profile, query, reference, hit_start))
            expected[1000 * k + j, site] = label.replace("{scaffold}", str(bool(holds)))
    rows.append((-1, "p450", None, "ppp", 0))
    found = {(r["domain_id"], r["site"]): r["label"] for r in sites.site_checks(spark.createDataFrame(rows, "domain_id long, profile string, query string, reference string, hit_start int")).collect()}
    assert expected.items() <= found.items() and len({label for label in expected.values()}) > 25
    assert found[-1, "asp_p450_oxy"] == "active site cysteine inconclusive"


def test_kernel_scores_in_one_block_and_in_many(spark):
    rng = random.Random(2)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    rows = [(k, vector()) for k in range(60)] + [(100, None), (101, [1.0]), (102, [math.nan, 0.0, 0.0, 0.0, 0.0]), (103, [None, 0.0, 0.0, 0.0, 0.0])]
    support = [(rng.uniform(-1, 1), vector()) for _ in range(23)]
    kernel = kernels.Kernel(0.7, -0.1, vector(), [0.5, 2.0, 1.0, 0.0, 3.0])
    frames = spark.createDataFrame(rows, "row_id long, features array<double>"), spark.createDataFrame(support, "weight double, vector array<double>")
    scale = [s or 1.0 for s in kernel.scale]
    for block in (4096, 10):
        found = {r["row_id"]: r for r in kernels.kernel_scores(*frames, kernel, block).collect()}
        for k, x in rows[:60]:
            z = [(a - m) / s for a, m, s in zip(x, kernel.mean, scale, strict=True)]
            score = sum(w * math.exp(-0.7 * sum((a - b) ** 2 for a, b in zip(z, v, strict=True))) for w, v in support) - 0.1
            assert found[k]["score"] == pytest.approx(score) and found[k]["points"] == (10 if score > 0 else 0)
        assert all(found[k]["score"] is None and found[k]["points"] == 0 for k in range(100, 104)) and len(found) == 64
    assert {r["score"] for r in kernels.kernel_scores(frames[0].where("row_id < 60"), frames[1].limit(0), kernel).collect()} == {-0.1}


def test_component_similarity_of_empty_sides_and_modes(spark):
    kinds = "key long, kind string, value string, n long"
    query = spark.createDataFrame([(1, "nrps", "C|A", 2), (1, "pks", "KS|AT", 1), (1, "profile", "p", 3), (1, "function", "f", 2), (2, "function", "f", 1)], kinds).withColumnRenamed("key", "region")
    reference = spark.createDataFrame([(7, "nrps", "C|A", 1), (7, "generic", "CAL", 3), (7, "profile", "p", 1), (7, "profile", "q", 3), (8, "function", "f", 4)], kinds).withColumnRenamed("key", "ref_area")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 7), (3, 7)], "region long, ref_area long")
    found = {m: {(r.region, r.ref_area): r for r in compare.component_similarity(pairs, query, reference, m).collect()} for m in ("reference_in_query", "query_in_reference", "best")}
    one = found["reference_in_query"][1, 7]
    # one of one nrps module of four in all, an empty pks side, three generic ones that the query lacks at all; one of four profiles; no functions in the reference
    assert (one.modules, one.profiles, one.functions) == (pytest.approx(1 * 1 / 4 + 1.0 * 0 + 0.0 * 3 / 4), 0.25, 1.0) and one.component_score == pytest.approx((0.25 + 0.25 + 1.0) / 3)
    two = found["query_in_reference"][1, 7]
    assert (two.modules, two.profiles, two.functions) == (pytest.approx(0.5 * 2 / 3), pytest.approx(1 / 3), 0.0)
    assert found["best"][1, 7].modules == pytest.approx((0.5 * 1 + 1.0 * 0 + 1.0 * 0) / 3)
    assert [found[m][1, 8].component_score is None for m in ("reference_in_query", "query_in_reference", "best")] == [True, False, True]
    assert found["query_in_reference"][1, 9].component_score == 0.0 and found["best"][1, 9].component_score is None
    assert found["best"][3, 7].component_score == pytest.approx((1.0 + 1.0) / 2) and found["best"][2, 7].modules is None


def test_residues_are_split_only_as_far_as_positions_need(spark):
    """Gaps of the reference, positions outside it and empty lists as before; the texts are cut before they are split."""
    from pyspark.sql import functions as F

    from locusloom.operators import sites

    rows = [(1, "abcdefgh", "A..DEFGH", [1, 2, 6]), (2, "abcdefgh", "A..DEFGH", [7]), (3, "abc", "ABCDEF", [4]), (4, "abc", "ABC", []), (5, "abc", "ABC", [0, 1]), (6, "...", "...", [1]), (7, "", "A", [1]), (8, None, "A", [1]), (9, "x" * 50, "." * 48 + "QQ", [2, 1]), (10, "abc", "ABC", [-1])]
    frame = spark.createDataFrame(rows, "k int, q string, r string, p array<int>").select("k", sites.residues_at(F.col("q"), F.col("r"), F.col("p")).alias("found"))
    assert [r["found"] for r in sorted(frame.collect())] == ["adh", None, None, "", None, None, None, None, "xx", None]
    longest = max(spark.createDataFrame([(1, "A" * 100_000, "C" * 100_000, [3])], "k int, q string, r string, p array<int>").select(sites.residues_at(F.col("q"), F.col("r"), F.col("p"))).collect())
    assert longest[0] == "A" and "left(" in frame._jdf.queryExecution().analyzed().expressions().mkString()


def test_site_texts_are_not_sought_letter_by_letter(spark):
    """The aligned texts of the query take letters from an array, not by substrings of the whole text."""
    from locusloom.queries import QUERIES

    plan = QUERIES["H13_site_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "substr(seq" not in plan and "element_at(letters" in plan
