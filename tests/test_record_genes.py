"""Modules of genes dealt by record: the rows of the joins, by one shuffle and without stored rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locusloom.operators import assembly as ops
from locusloom.queries import QUERIES
from locusloom.queries import assembly as queries

FOLDER = "/root/testdata/sf0.001"
DOMAINS = "record_id bigint, gene_id bigint, start bigint, end bigint, profile string, subtype string, ord bigint"
LINES = "record_id bigint, region bigint, gene_id bigint, start bigint, strand int"
NAMES = "PKS_KS PKS_KS PKS_KS PKS_AT ACP ACP PKS_PP PKS_KR PKS_KR Trans-AT_docking AMP-binding Condensation_LCL PCP Thioesterase ECH PKS_Docking_Nterm LPG_synthase_C Beta_elim_lyase Interface CAL_domain SAT".split()
PIECES = [["PKS_KS", "Trans-AT_docking"], ["PKS_KS", "PKS_DH"], ["ACP", "PKS_KR"], ["ACP"], ["PKS_AT", "ACP"], ["PKS_KS"], ["ACP", "Thioesterase", "PKS_KR"], ["Condensation_LCL"], ["AMP-binding", "PCP"], ["PKS_KR"]]


def _tables(spark):
    random.seed(7)
    domains, lines = [], []
    for gene in range(2400):
        record = gene // 400
        names = [n for _ in range(random.choice((0, 1, 1, 2))) for n in random.choice(PIECES)] if gene % 3 else [random.choice(NAMES) for _ in range(random.randrange(6))]
        for k, name in enumerate(names):
            domains.append((record, gene, k // 2, 9, name, random.choice(("Trans-AT-KS", "Trans-AT-KS", "Iterative-KS", None)), gene * 10 + k))
        if gene % 11:
            lines.append((record, gene // 100, gene, random.randrange(500), random.choice((1, 1, -1)) if gene % 200 < 100 else random.choice((-1, -1, 1))))
    return {"domains": spark.createDataFrame(domains, DOMAINS), "lines": spark.createDataFrame(lines, LINES)}


def test_dealt_genes_give_the_modules_of_joins(spark, monkeypatch):
    tables = _tables(spark)
    assert ops.plain_lines(tables["domains"], tables["lines"])
    genes = ops.record_genes(tables["domains"], tables["lines"]).cache()
    joined = ops.join_modules(ops.segment_modules(tables["domains"]), tables["lines"]).cache()
    assert {(r["part"], r["n"] > 2) for r in joined.groupBy("part").agg(F.count("*").alias("n")).collect()} == {(0, True), (1, True), (2, True)}
    assert genes.where("heads and tails").count() and genes.where("heads and strand = -1").count() and genes.where("tail_kr and high = 1").count()
    listed = joined.groupBy("record_id", "owner", "module").agg(F.sort_array(F.collect_list(F.struct("part", "start", "end", "ord", "profile"))).alias("d"))
    wanted = listed.select("record_id", "owner", "module", F.transform("d", lambda d: d["profile"]).alias("profiles"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(ops.owned_modules(genes)) == rows(wanted)

    monkeypatch.setattr(queries, "table", lambda spark, folder, name: tables[name])
    flagged = queries.line_genes(spark, "").cache()
    found = queries._flagged(ops.ends_of(genes))
    assert rows(found.select(*flagged.columns)) == rows(flagged)
    assert all(flagged.where(flag).count() > 10 for flag in ("opens", "closes", "chained", "ends"))
    keys = ["record_id", "region"]
    assert rows(ops.colinear_places(flagged, keys).select(*keys, "gene_id", "place")) == rows(ops.colinear_groups(flagged, keys).select(*keys, "gene_id", "place"))


def test_odd_genes_and_large_records_take_joins(spark):
    domains = spark.createDataFrame([(1, 4, 0, 9, "ACP", None, 1), (1, 4, 9, 12, "ACP", None, 2)], DOMAINS)
    lines = spark.createDataFrame([(1, 1, 4, 0, 1), (1, 1, 5, 9, 1)], LINES)
    more = lambda df, row: df.unionByName(spark.createDataFrame([row], df.schema))
    assert ops.plain_lines(domains, lines, 2) and not ops.plain_lines(domains, lines, 1)
    assert not ops.plain_lines(more(domains, (1, None, 0, 9, "ACP", None, 3)), lines)
    for row in ((1, 1, 4, 3, 1), (1, None, 6, 3, 1), (None, 1, 6, 3, 1), (1, 1, 6, 3, None)):
        assert not ops.plain_lines(domains, more(lines, row))


@pytest.mark.parametrize("name", ["I11_colinear_groups", "I16_structures"])
def test_queries_store_nothing(spark, monkeypatch, name):
    size = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    found = sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
    assert size() == before
    monkeypatch.setattr(queries, "_dealt", lambda *_: None)
    assert found and found == sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
