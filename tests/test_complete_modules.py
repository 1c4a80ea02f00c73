"""Complete modules by one walk over Arrow batches: the rows of segmentation, properties and tuples."""

import random

import pytest

from locusloom.operators import assembly as ops
from locusloom.operators import compare
from locusloom.queries import QUERIES

KINDS = "record_id bigint, gene_id bigint, start bigint, end bigint, profile string, subtype string, ord bigint"


@pytest.fixture(scope="module")
def domains(spark):
    random.seed(5)
    names = [n for some in ops.DOMAIN_CLASSES.values() for n in some]
    likely = ("PKS_KS", "PKS_AT", "PKS_KR", "ACP", "PKS_PP", "PCP", "AMP-binding", "Condensation_LCL", "LPG_synthase_C", "Beta_elim_lyase", "Trans-AT_docking", "Thioesterase", "PKS_Docking_Nterm")
    rows = []
    for gene in range(160):
        for _ in range(300 if gene == 7 else random.randrange(1, 14)):
            start = random.randrange(40)
            name = "PKS_Docking_Nterm" if gene % 20 == 3 else random.choice(likely if random.random() < 0.85 else names)
            rows.append((None if gene == 11 else gene // 9, None if gene == 12 else gene, start, start + random.randrange(3), name, random.choice((None, "Trans-AT-KS", "Iterative-KS")), random.randrange(3)))
        if gene % 5 == 0:  # a second carrier, and the two domains that allow it
            rows += [(gene // 9, gene, 100 + k, 101 + k, name, "Trans-AT-KS", k) for k, name in enumerate(("PKS_KS", "Trans-AT_docking", "ACP", "PCP", "LPG_synthase_C", "Beta_elim_lyase"))]
    random.shuffle(rows)
    return spark.createDataFrame(rows, KINDS).cache()


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_one_walk_gives_the_tuples_of_complete_modules(spark, domains, most):
    rows = lambda df: sorted(map(tuple, df.select("record_id", "gene_id", "kind", "value").collect()))
    segmented = ops.segment_modules(domains)
    wanted = rows(compare.module_tuples(segmented, ops.module_properties(segmented)))
    assert {kind for _, _, kind, _ in wanted} == {"nrps", "pks", "generic"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        assert rows(ops.complete_modules(domains)) == wanted
        assert rows(ops.complete_modules(domains.where("profile = 'PKS_Docking_Nterm'"))) == []
        assert rows(ops.complete_modules(domains.limit(0))) == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_modes_that_meet_once_are_those_alone(spark):
    parts = spark.createDataFrame([(1, "pks", "a", 2), (1, "function", "f", 1), (2, "pks", "a", 1), (2, "nrps", "b", 3), (2, "profile", "p", 1), (3, "generic", "a", 1)], "region bigint, kind string, value string, n bigint")
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4)], "region bigint, ref_area bigint")
    reference, modes = parts.withColumnRenamed("region", "ref_area"), ("best", "query_in_reference", "reference_in_query")
    found = compare.similarity_by_modes(pairs, parts, reference, modes)
    columns = [c for c in found.columns if c != "mode"]
    for mode in modes:
        alone = compare.component_similarity(pairs, parts, reference, mode)
        assert sorted(map(str, found.where(f"mode = '{mode}'").select(columns).collect())) == sorted(map(str, alone.select(columns).collect()))


def test_domains_are_read_and_walked_once(spark):
    plan = QUERIES["G10_module_tuples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Before, segments were made once for tuples and once for properties.
    assert plan.count("l_linenumber#") and len([x for x in plan.splitlines() if "Relation [" in x and "l_linenumber#" in x]) == 1
