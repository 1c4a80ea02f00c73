"""Readers and writers on small literal files."""

import json

import pytest

from locusloom.sources import readers, writers


def test_fasta_round_trip(spark, tmp_path):
    file = tmp_path / "a.fasta"
    file.write_text(">first one\nACGT\nAC\n>second\nTTTT\n")
    rows = {r["name"]: r["seq"] for r in readers.read_fasta(spark, str(file)).collect()}
    assert rows == {"first_one": "ACGTAC", "second": "TTTT"}
    writers.write_sequences(readers.read_fasta(spark, str(file)), str(tmp_path / "out"), 2)
    assert {r["name"]: r["seq"] for r in readers.read_fasta(spark, str(tmp_path / "out")).collect()} == rows
    (tmp_path / "b.fasta").write_text(">first\n>second\nAC\n")
    with pytest.raises(Exception, match="FASTA"):
        readers.read_fasta(spark, str(tmp_path / "b.fasta")).collect()


def test_gff_joins_parts(spark, tmp_path):
    file = tmp_path / "a.gff"
    line = "r1\tx\tCDS\t{}\t{}\t.\t{}\t0\tParent={};note={};product=p\n"
    file.write_text("##gff-version 3\n" + line.format(21, 30, "-", "g1", "b") + line.format(1, 10, "-", "g1", "a") + line.format(50, 60, "+", "g2", "c"))
    rows = {r["parent"]: r for r in readers.read_gff(spark, str(file)).collect()}
    assert [(p["start"], p["end"]) for p in rows["g1"]["parts"]] == [(20, 30), (0, 10)]
    assert rows["g1"]["attributes"] == {"Parent": "g1", "product": "p"} and (rows["g1"]["start"], rows["g1"]["end"]) == (0, 30)
    assert rows["g2"]["attributes"]["note"] == "c"
    features = readers.read_gff(spark, str(file))
    readers.check_annotations(features, spark.createDataFrame([("other",)], "name string"))
    with pytest.raises(ValueError, match="share no id"):
        readers.check_annotations(features, spark.createDataFrame([("x",), ("y",)], "name string"))


def test_tables_of_hits_and_references(spark, tmp_path):
    (tmp_path / "hits").write_text("q1\tacc|g1\t80.0\t50\t0\t0\t1\t50\t1\t50\t1e-10\t99.5\n")
    row = readers.read_hits(spark, str(tmp_path / "hits"), spark.createDataFrame([("q1", 200)], "query string, query_length int")).first()
    assert (row["accession"], row["ref_gene"], row["coverage"]) == ("acc", "g1", 25.0)
    (tmp_path / "clusters").write_text("acc\tdesc\tc1\ttype\ta;b\tp1;p2;\n")
    row = readers.read_reference_clusters(spark, str(tmp_path / "clusters")).first()
    assert row["tags"] == ["a", "b"] and row["proteins"] == ["p1", "p2"]
    (tmp_path / "proteins").write_text(">acc|c1|1-9|+|tag|an|notation|nm\nMK\n>acc|c1|1-9|+|linearisedA|t2|x|n2\nMK\n")
    rows = {r["ref_gene"]: r["annotation"] for r in readers.read_reference_proteins(spark, str(tmp_path / "proteins")).collect()}
    assert rows == {"acc_tag": "an|notation", "acc_t2": "x"}
    (tmp_path / "terms").write_text("!comment\nPfam:PF1 name > GO:some term ; GO:0001\n")
    assert tuple(readers.read_ontology(spark, str(tmp_path / "terms")).first()) == ("PF1", "some term", "GO:0001")
    (tmp_path / "groups").write_text("a,b\nc, d\n")
    profiles = spark.createDataFrame([(x,) for x in "abcd"], "profile string")
    assert readers.read_equivalence_groups(spark, str(tmp_path / "groups"), profiles).groupBy("group_id").count().count() == 2
    with pytest.raises(Exception, match="unknown profile"):
        readers.read_equivalence_groups(spark, str(tmp_path / "groups"), profiles.where("profile <> 'd'")).collect()


def test_matrices_profiles_and_sideloaded(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"m1": {"pwm": {"A": [0.1, 0.2], "C": [0.3, 0.4]}, "max_score": 5.0}}))
    rows = readers.read_matrices(spark, str(tmp_path / "m.json")).collect()
    assert len(rows) == 4 and rows[0]["min_score"] == 0.0
    (tmp_path / "p.hmm").write_text("NAME  p1\nACC   PF1.2\nLENG  30\nNSEQ  7\nTC    21.5 20;\n//\nNAME  p2\nLENG  9\nTC    3 3\n//\n")
    rows = {r["profile"]: (r["length"], r["n_seeds"], r["cutoff"]) for r in readers.read_profiles(spark, str(tmp_path / "p.hmm")).collect()}
    assert rows == {"p1": (30, 7, 21.5), "p2": (9, None, 3.0)}
    (tmp_path / "s.json").write_text(json.dumps({"tool": {"name": "t"}, "records": [{"name": "r", "subregions": [{"start": 1, "end": 5, "label": "l"}]}, {"name": "no", "protoclusters": [{"start": 1, "end": 2, "product": "p"}]}]}))
    records = spark.createDataFrame([(1, "new", "r")], "record_id int, name string, original_id string")
    assert [tuple(r) for r in readers.read_sideloaded(spark, str(tmp_path / "s.json"), records).collect()] == [(1, "t", "sub", "l", 1, 5)]
    (tmp_path / "old.json").write_text('{"schema_version": 1, "x": 2}\n{"schema_version": 3, "x": 4}\n')
    assert [r["x"] for r in readers.read_results(spark, str(tmp_path / "old.json"), "x int", [3]).collect()] == [4]


def test_areas_are_nested_and_rebased(spark, tmp_path):
    regions = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 200, 300)], "record_id int, region int, start int, end int")
    areas = spark.createDataFrame([(1, 1, 7, "b", 50, 90), (1, 1, 5, "a", 0, 40)], "record_id int, region int, area_id int, product string, start int, end int")
    candidates = spark.createDataFrame([(1, 1, "single", 50, 90, [7])], "record_id int, region int, kind string, start int, end int, area_ids array<int>")
    row = writers.area_json(regions, areas, candidates).first()
    assert [a["product"] for a in row["regions"][0]["areas"]] == ["a", "b"] and row["regions"][0]["candidates"][0]["areas"] == [1]
    assert row["regions"][1]["areas"] == [] and row["regions"][1]["candidates"] == [] and row["regions"][0]["subregions"] == []
    subregions = spark.createDataFrame([(1, 2, "x", 210, 220), (1, 2, "y", 205, 208)], "record_id int, region int, label string, start int, end int")
    row = writers.area_json(regions, areas, candidates, subregions).first()
    assert [s["label"] for s in row["regions"][1]["subregions"]] == ["y", "x"]
    features = spark.createDataFrame([(1, 210, 250), (1, 90, 110)], "record_id int, start int, end int")
    assert [(r["region"], r["start"], r["end"]) for r in writers.region_features(features, regions).collect()] == [(2, 10, 50)]


def test_extracts_go_over_the_origin(spark):
    regions = spark.createDataFrame([(1, 1, 900, 1100), (2, 1, 900, 1000)], "record_id int, region int, start bigint, end bigint")
    lengths = spark.createDataFrame([(1, 1000, True), (2, 1000, False)], "record_id int, length bigint, circular boolean")
    features = spark.createDataFrame([(r, g, s, e) for r in (1, 2) for g, s, e in (("a", 910, 920), ("b", 990, 1005), ("c", 50, 60), ("d", 95, 105), ("e", 500, 510))], "record_id int, gene_id string, start bigint, end bigint")
    found = {(r["record_id"], r["gene_id"], r["start"], r["end"]) for r in writers.region_features(features, regions, lengths).collect()}
    assert found == {(1, "a", 10, 20), (1, "b", 90, 105), (1, "c", 150, 160), (2, "a", 10, 20)}


def test_report_holds_genes_of_ranked_references(spark, tmp_path):
    ranking = spark.createDataFrame([(1, 7, 1), (2, 8, 1)], "region int, ref_area int, rank int")
    pairs = spark.createDataFrame([(1, 7, "q", "s"), (1, 8, "q", "t")], "region int, ref_area int, query string, subject string")
    query = spark.createDataFrame([(1, "q"), (3, "z")], "region int, gene string")
    subject = spark.createDataFrame([(7, "s"), (9, "u")], "ref_area int, gene string")
    writers.write_hit_report(ranking, pairs, str(tmp_path / "r"), query, subject)
    read = lambda name: sorted(map(tuple, spark.read.csv(str(tmp_path / "r" / name), header=True, inferSchema=True).select("region", *{"pairs": ["query", "subject"], "ranking": ["ref_area"]}.get(name, ["gene"])).collect()))
    assert (read("pairs"), read("query_genes"), read("subject_genes"), read("ranking")) == ([(1, "q", "s")], [(1, "q")], [(1, "s")], [(1, 7), (2, 8)])
