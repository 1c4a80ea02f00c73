"""Regions by running windows over records: the rows of the joins, without stored rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from locusloom.operators import areas as ops
from locusloom.operators import scans
from locusloom.operators.rules import Rule, Rules, profile
from locusloom.queries import QUERIES, areas, reports, sites
from locusloom.queries import scans as scan_queries
from locusloom.sources import reference_sets

FOLDER = "/root/testdata/sf0.001"
NAMES = ("A12_area_json", "F20_regions", "F21_region_summary", "F23_pack_lanes")
RULES = Rules((Rule("x", profile("x"), 40, 25, "first"), Rule("y", profile("y"), 10, 60, "second"), Rule("z", profile("z"), 25, 0, "first")))
KINDS = "record_id bigint, gene_id bigint, rule string, start bigint, end bigint"


def _genes(spark, n=900):
    random.seed(11)
    rows = []
    for k in range(n):
        start = random.choice((0, 30, random.randrange(6000)))
        rows.append((random.choice((None, 1, 2, 3)), k, random.choice("xyz"), start, start + random.choice((1, 3, 40, 400))))
    return spark.createDataFrame(rows, KINDS)


def test_windows_give_the_rows_of_joins(spark):
    genes = _genes(spark)
    lengths = genes.groupBy("record_id").agg((F.max("end") + 70).alias("length"))
    numbered = ops.numbered(ops.expand(ops.chain_cores(genes, RULES), lengths)).cache()
    marked = ops.record_regions(genes, RULES, 70).cache()
    assert ops.plain_records(genes, RULES)
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    columns = ("record_id", "area_id", "product", "category")
    assert rows(marked.where("area_id is not null"), *columns, "area_start", "area_end") == rows(numbered, *columns, "start", "end")
    summary = ops.region_summary(ops.regions(numbered), numbered, lengths, 500)
    assert rows(ops.region_summary_of(marked), *summary.columns) == rows(summary, *summary.columns)
    assert summary.where("n_areas > 3").count() > 0
    held = ops.range_join(ops.regions(numbered), genes, ["record_id"], 500, how="contain").select("record_id", "l.region", "r.gene_id")
    assert rows(marked, *held.columns) == rows(held, *held.columns)


@pytest.mark.parametrize("row", [(1, 5, "w", 4, 9), (1, 5, None, 4, 9), (1, 5, "x", 4, 4), (1, 5, "x", -3, 9), (1, 5, "x", None, 9)])
def test_odd_genes_and_large_records_take_joins(spark, row):
    genes = spark.createDataFrame([(1, 4, "x", 2, 8), (2, 6, "y", 2, 8)], KINDS)
    assert ops.plain_records(genes, RULES) and not ops.plain_records(genes.unionByName(spark.createDataFrame([row], KINDS)), RULES)
    assert not ops.plain_records(genes.unionByName(genes), RULES, 1)


@pytest.mark.parametrize("name", NAMES)
def test_queries_store_no_areas(spark, monkeypatch, name):
    size = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    found = sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
    stored = size() - before
    monkeypatch.setattr(areas, "plain_regions", lambda *_: None)
    monkeypatch.setattr(reports, "plain_regions", lambda *_: None)
    joined = QUERIES[name](spark, FOLDER)
    assert found and found == sorted(map(tuple, joined.collect()))
    # Before, areas were checkpointed several times, and the objects written as they are.
    assert stored < (500_000 if name == "A12_area_json" else 1)


def test_extracts_are_not_a_folder_for_each_record(spark):
    held = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(held.glob("report-*"))
    rows = QUERIES["A13_region_features"](spark, FOLDER)
    [new] = set(held.glob("report-*")) - before
    assert not [p for p in new.iterdir() if p.is_dir()]
    assert rows.select("record_id").distinct().count() > len(list(new.glob("*.parquet")))
    assert dict(rows.dtypes) == {"record_id": "bigint", "region": "string", "gene_id": "bigint", "start": "bigint", "end": "bigint"}


def test_gaps_of_dealt_regions_are_those_of_joins(spark):
    genes = _genes(spark)
    marked = ops.record_regions(genes, RULES, 70).cache()
    spans = marked.groupBy("record_id", F.col("region").alias("area_id")).agg(F.min("area_start").alias("start"), F.max("area_end").alias("end"))
    inside = marked.select("record_id", F.col("region").alias("area_id"), "gene_id", "start", "end")
    rows = lambda df: sorted(map(tuple, df.select("record_id", "area_id", "start", "end").collect()))
    for least, padding in ((0, 0), (15, 20), (1, 90)):
        assert rows(scans.intergenic_of(marked, least, padding)) == rows(scans.intergenic(inside, spans, least, padding)) != []


@pytest.mark.parametrize(("name", "module"), [("H2_intergenic", scan_queries), ("A15_cluster_reference", sites)])
def test_gaps_and_clusters_store_nothing(spark, monkeypatch, name, module):
    size = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    before = size()
    found = sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
    assert size() == before
    monkeypatch.setattr(module, "plain_regions", lambda *_: None)
    assert found and found == sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))


def test_clusters_of_dealt_regions(spark):
    genes = _genes(spark).withColumns({"locus_tag": F.expr("if(gene_id % 5 > 0, concat('g ', gene_id), null)"), "protein_id": F.expr("if(gene_id % 7 > 0, concat('p', gene_id), null)")})
    marked = ops.record_regions(genes, RULES, 70).cache()
    spans = marked.groupBy("record_id", "region").agg(F.min("area_start").alias("start"), F.max("area_end").alias("end"))
    key = F.concat_ws(":", F.col("record_id").cast("string"), F.col("region").cast("string"))
    regions = spans.select(key.alias("region"), "start", "end", F.lit("a").alias("accession"), F.lit("d").alias("description"), F.lit("x").alias("products"), (F.col("start") < 90).alias("at_edge"))
    members = marked.select(key.alias("region"), "start", "end", F.lit(1).alias("strand"), "locus_tag", F.lit("n").alias("annotation"), "protein_id", F.lit("M").alias("translation"))
    expected = reference_sets.build_cluster_reference(regions, members)[0].select("region", "cluster", "tags", "proteins")
    found = reference_sets.clusters_of(marked, 90).select(key.alias("region"), "cluster", "tags", "proteins")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) != []
