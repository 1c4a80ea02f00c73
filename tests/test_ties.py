"""Rows that tie in every column of an order, and modules whose parts tell more apart than together."""

from locusloom.operators import assembly, hits, sites

DOMAINS = "record_id bigint, gene_id bigint, start bigint, end bigint, profile string, subtype string, ord bigint"
LINES = "record_id bigint, region bigint, gene_id bigint, start bigint, strand int"


def joined(spark, genes):
    rows = [(1, g, k * 10, k * 10 + 8, *(d.split(":") + [None])[:2], g * 100 + k) for g, names in genes.items() for k, d in enumerate(names)]
    lines = spark.createDataFrame([(1, 1, g, g * 1000, 1) for g in genes], LINES)
    return assembly.join_modules(assembly.segment_modules(spark.createDataFrame(rows, DOMAINS)), lines)


def test_areas_alike_in_span_and_id_all_stay(spark):
    rows = [(1, 7, 0, 10, "A"), (1, 7, 0, 10, "A"), (1, 8, 0, 10, "A"), (1, 9, 2, 8, "A"), (1, 9, 2, 8, "A"), (1, 5, None, 8, "A"), (1, 6, 5, 12, "A")]
    frame = spark.createDataFrame(rows, "record_id bigint, area_id int, start bigint, end bigint, label string")
    assert sorted(r["area_id"] for r in hits.drop_contained(frame).collect()) == [5, 6, 7, 7]
    more = frame.selectExpr("*", "monotonically_increasing_id() as row")
    assert sorted(r["area_id"] for r in hits.drop_contained(more).collect()) == [5, 6, 7, 7]


def test_hits_that_share_an_id_have_their_own_motifs_once(spark):
    table = spark.createDataFrame([(1, "A", 5.0), (1, "A", 6.0), (1, "B", 9.0), (2, "A", 7.0)], "hit_id bigint, profile string, score double")
    found = spark.createDataFrame([(1, "A", "m", "CDE"), (1, "A", "m", "CDE"), (1, "B", "m", "KKK"), (2, "A", "m", "CDE")], "hit_id bigint, profile string, motif string, residues string")
    motifs = spark.createDataFrame([("A", "m", "C.E", 0, 0, 1, "trp"), ("B", "m", "K.K", 0, 0, 1, "phe")], "profile string, motif string, pattern string, least int, most int, preference int, substrate string")
    profiles = spark.createDataFrame([("A", [1.0], 0.5, 0.1), ("B", [1.0], 0.5, 0.1)], "profile string, cutoffs array<double>, step double, penalty double")
    rows = sites.match_motifs(table, found, motifs, profiles).collect()
    assert sorted((r["hit_id"], r["substrate"]) for r in rows) == [(1, "phe"), (1, "trp"), (1, "trp"), (2, "trp")]


def test_a_ketoreductase_behind_a_terminated_joined_module_leaves_it_terminating(spark):
    rows = joined(spark, {1: ["PKS_KS:Trans-AT-KS", "PKS_DH"], 2: ["ACP", "Thioesterase", "PKS_KR"]})
    assert {(r["gene_id"], r["profile"], r["owner"], r["module"], r["part"]) for r in rows.collect()} >= {(2, "PKS_KR", 1, 0, 2), (2, "ACP", 1, 0, 1)}
    [module] = assembly.module_properties(rows, ["record_id", "owner", "module"]).collect()
    assert module["terminating"] and module["complete"] and module["trans_at"] and module["n_domains"] == 5


def test_a_second_carrier_needs_what_follows_it_in_the_joined_parts(spark):
    # Behind the carrier of gene 2 the two enzymes are a module of their own, so it has no leave to stand behind another carrier.
    rows = joined(spark, {1: ["PKS_KS", "ACP"], 2: ["Trans-AT_docking", "ACP", "LPG_synthase_C", "Beta_elim_lyase"]})
    assert all(not r["later"] and r["owner"] == r["gene_id"] for r in rows.collect())
