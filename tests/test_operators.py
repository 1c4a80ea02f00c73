"""Single operators on small tables with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locusloom.operators import areas, assembly, clean, compare, hits, sites
from locusloom.operators.rules import Rule, Rules, profile
from locusloom.plans.checkpoints import shared_folder
from locusloom.plans.graph import greedy_pairs
from locusloom.plans.intervals import close_circles, islands
from locusloom.plans.ordering import with_adjacent
from locusloom.sources import readers, reference_sets, writers


def ids(spark, names):
    rows = clean.normalise_ids(spark.createDataFrame(list(enumerate(names)), "idx bigint, name string")).orderBy("idx").collect()
    return [r["new_id"] for r in rows]


def test_ids_are_unique_and_short(spark):
    assert ids(spark, ["a", "a", "a_1", "a", "a_0", None]) == ["a", "a_2", "a_1", "a_3", "a_0", ""]
    long = ["ABCDEFGH00000001.1", "ABCDEFGH00000001.2", "scaffold7 of some assembly", "scaffold7 of some assembly two", "scaffold7 of some assembly six", "no number at all here"]
    found = ids(spark, long)
    assert found[0] == "ABCDEFGH00000001" and found[1] == "c00002_ABCDEFG.."
    assert found[2].startswith("scaffold7ofsomea") is False and len(set(found)) == 6 and all(len(x) <= 16 for x in found)
    assert found[5] == "c00006_nonumbe.."
    many = [random.Random(k).choice(["x", "x_1", "x=", "contig9 in a very long name", "contig9 in a very long one", f"u{k}"]) for k in range(300)]
    assert len(set(ids(spark, many))) == 300
    assert ids(spark, ["my-assembly-contig1234567"]) == ["c1234567_my-asse.."]


def test_consensus_marks_similar_residues_only(spark):
    text = lambda a, b: spark.range(1).select(compare.consensus_string(F.lit(a), F.lit(b)).alias("c")).first()["c"]
    assert text("AF", "TL") == "  " and text("ASTKWE", "SSSRYE") == "+S+++E" and text("", "A") == ""


def test_hits_without_score_or_length_come_last(spark):
    rows = [(1, 1, "p", 0, 30, 0.0, 0.0, 1), (1, 1, "p", 0, 30, 5.0, 0.0, 2), (1, 1, "p", 100, 100, 5.0, 0.0, 3), (1, 2, "p", 0, 10, 0.0, 0.0, 4)]
    frame = spark.createDataFrame(rows, "record_id int, gene_id int, profile string, start int, end int, score double, evalue double, ord int")
    kept = hits.greedy_non_overlapping(frame, spark.createDataFrame([("p", 30, 10.0)], "profile string, length int, cutoff double"))
    assert sorted(r["ord"] for r in kept.collect()) == [2, 3, 4]


def test_contained_areas_and_repeated_passes(spark):
    random.seed(2)
    rows = [(1, k, random.choice("ab"), s, s + random.randint(1, 30)) for k in range(200) for s in [random.randint(0, 300)]] + [(None, 900, "a", 0, 5), (1, 901, None, 0, 500)]
    frame = spark.createDataFrame(rows, "record_id int, area_id int, label string, start int, end int")
    inside = lambda x, o: x[0] is not None and x[2] is not None and x[0] == o[0] and x[2] == o[2] and o[3] <= x[3] and x[4] <= o[4] and ((o[4] - o[3], -o[1]) > (x[4] - x[3], -x[1]))
    expected = sorted(x[1] for x in rows if not any(inside(x, o) for o in rows))
    assert sorted(r["area_id"] for r in hits.drop_contained(frame).collect()) == expected


def test_greedy_pairs_equal_one_by_one(spark):
    random.seed(3)
    rows = [(random.randint(0, 2), random.randint(0, 25), random.randint(0, 25), k) for k in range(400)] + [(1, None, 3, 500)]
    random.shuffle(rows)
    expected, used = [], set()
    for key, a, b, k in sorted((r for r in rows if r[1] is not None), key=lambda r: r[3]):
        if not {(key, "a", a), (key, "b", b)} & used:
            used |= {(key, "a", a), (key, "b", b)}
            expected.append(k)
    frame = spark.createDataFrame(rows, "key int, a int, b int, k int")
    assert sorted(r["k"] for r in greedy_pairs(frame, ["key"], "a", "b", "k").collect()) == expected
    assert greedy_pairs(frame.limit(0), ["key"], "a", "b", "k").count() == 0


@pytest.mark.parametrize("small", [3, 1000])
def test_rows_know_their_neighbours(spark, monkeypatch, small):
    monkeypatch.setattr("locusloom.plans.ordering.SMALL", small)
    rows = [(k % 2, (k * 37) % 100, k) for k in range(60)]
    found = with_adjacent(spark.createDataFrame(rows, "key int, at int, id int"), ["key"], ["at", "id"], ["id"]).collect()
    for key in (0, 1):
        order = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        near = {r["id"]: (r["before"] and r["before"]["id"], r["after"] and r["after"]["id"]) for r in found if r["key"] == key}
        assert all(near[x] == (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, x in enumerate(order))


def test_areas_go_over_the_origin(spark):
    genes = spark.createDataFrame([(1, 1, "a", 5, 20), (1, 2, "a", 950, 990), (1, 3, "a", 400, 420), (2, 4, "a", 5, 20), (2, 5, "a", 950, 990)], "record_id int, gene_id bigint, rule string, start bigint, end bigint")
    lengths = spark.createDataFrame([(1, 1000, True), (2, 1000, False)], "record_id int, length bigint, circular boolean")
    rules = Rules((Rule("a", profile("a"), 50, 30),))
    cores = areas.chain_cores(genes, rules, lengths=lengths)
    found = {tuple(r) for r in cores.select("record_id", "core_start", "core_end", "n_genes").collect()}
    assert found == {(1, 950, 1020, 2), (1, 400, 420, 1), (2, 5, 20, 1), (2, 950, 990, 1)}
    wide = {tuple(r) for r in areas.expand(cores, lengths).select("record_id", "start", "end").collect()}
    assert wide == {(1, 920, 1050), (1, 370, 450), (2, 0, 50), (2, 920, 1000)}
    all_round = areas.expand(cores.withColumn("neighbourhood", F.lit(600)), lengths).where("record_id = 1").select("start", "end").collect()
    assert {tuple(r) for r in all_round} == {(0, 1000), (485, 1484)}  # meets in the middle of what the core over the origin leaves free
    extenders = spark.createDataFrame([(1, 9, "a", 60, 70), (1, 10, "a", 900, 930)], "record_id int, gene_id bigint, rule string, start bigint, end bigint")
    grown = {tuple(r) for r in areas.extend_cores(cores, extenders, 500, lengths).where("record_id = 1").select("core_start", "core_end").collect()}
    assert grown == {(900, 1070), (400, 420)}
    spans = spark.createDataFrame([(1, 0, 80), (1, 60, 90), (1, 300, 400), (1, 920, 1010), (2, 0, 80), (2, 920, 1010)], "record_id int, start bigint, end bigint")
    regions = [tuple(r) for r in areas.regions(spans, lengths=lengths).orderBy("record_id", "region").collect()]
    assert regions == [(1, 1, 920, 1090, 3), (1, 2, 300, 400, 1), (2, 1, 0, 80, 1), (2, 2, 920, 1010, 1)]
    lone = islands(spans.where("start = 300"), ["record_id"])
    assert close_circles(lone, ["record_id"], lengths, 10_000).collect()[0]["start"] == 300


DOMAINS = "record_id bigint, gene_id bigint, start bigint, end bigint, profile string, subtype string, ord bigint"


def domains(spark, genes):
    rows = [(1, g, k * 10, k * 10 + 8, *(d.split(":") + [None])[:2], g * 100 + k) for g, names in genes.items() for k, d in enumerate(names)]
    return spark.createDataFrame(rows, DOMAINS)


def test_modules_begin_where_a_part_does_not_fit(spark):
    genes = {
        1: ["PKS_KS", "PKS_AT", "PKS_KR", "ACP", "PKS_KS", "PKS_AT", "ACP", "Thioesterase"],
        2: ["AMP-binding", "PCP", "AMP-binding", "PCP", "PKS_Docking_Nterm"],
        3: ["PKS_KS:Trans-AT-KS", "ACP", "PKS_KR", "PKS_DH"],
        4: ["Condensation_LCL", "PKS_AT", "ACP"],
        5: ["PKS_KS", "ACP", "PCP", "LPG_synthase_C", "Beta_elim_lyase", "ECH", "TD", "ECH"],
        6: ["CAL_domain", "ACP", "Epimerization", "TIGR01720", "cMT"],
    }
    found = {}
    rows = assembly.segment_modules(domains(spark, genes))
    for r in sorted(rows.collect(), key=lambda r: (r["gene_id"], r["ord"])):
        found.setdefault(r["gene_id"], []).append(r["module"])
    assert found == {1: [0, 0, 0, 0, 1, 1, 1, 1], 2: [0, 0, 1, 1], 3: [0, 0, 0, 1], 4: [0, 1, 1], 5: [0, 0, 0, 0, 0, 0, 0, 1], 6: [0, 0, 0, 0, 1]}
    facts = {(r["gene_id"], r["module"]): r for r in assembly.module_properties(rows).collect()}
    assert [facts[1, k]["complete"] for k in (0, 1)] == [True, True] and facts[1, 1]["terminating"] and not facts[1, 0]["terminating"]
    assert [facts[2, k]["complete"] for k in (0, 1)] == [True, False] and facts[2, 0]["starter"] and not facts[2, 1]["starter"] and facts[2, 0]["kind"] == "nrps"
    assert facts[3, 0]["trans_at"] and facts[3, 0]["complete"] and facts[6, 0]["starter"] and facts[5, 1]["kind"] == "unknown"
    with pytest.raises(Exception, match="could not classify"):
        assembly.segment_modules(domains(spark, {1: ["nonsense"]})).collect()


def test_modules_on_two_genes_are_joined(spark):
    parts = domains(spark, {1: ["PKS_KS", "PKS_AT"], 2: ["PKS_KR", "ACP", "PKS_KS", "PKS_AT", "ACP"], 3: ["ACP"], 4: ["Condensation_LCL", "AMP-binding"], 5: ["ACP", "PKS_KS"], 6: ["PCP"], 7: ["Condensation_LCL", "AMP-binding"]})
    genes = spark.createDataFrame([(1, 1, g, g * 100, -1 if g >= 6 else 1) for g in range(1, 8)], "record_id bigint, region bigint, gene_id bigint, start bigint, strand int")
    joined = assembly.join_modules(assembly.segment_modules(parts), genes)
    later = {(r["gene_id"], r["owner"], r["module"]) for r in joined.where("later").collect()}
    assert later == {(1, 1, 0), (2, 1, 0), (4, 4, 0), (5, 4, 0), (6, 7, 0), (7, 7, 0)}
    facts = {(r["owner"], r["module"]): r["complete"] for r in assembly.module_properties(joined, ["record_id", "owner", "module"]).collect()}
    assert facts[1, 0] and facts[4, 0] and facts[7, 0] and not facts[3, 0] and not facts[5, 1]


def test_monomers_follow_reductions(spark):
    made = lambda base, names, pks=True, trans=False: spark.range(1).select(assembly.monomer(F.lit(base), F.array(*[F.lit(n) for n in names]), F.lit(pks), F.lit(trans)).alias("m")).first()["m"]
    assert made("mal", ["PKS_KS", "PKS_AT", "PKS_KR"]) == "ohmal" and made("mmal", ["PKS_KR", "PKS_DH", "PKS_ER"]) == "Me-redmal"
    assert made("emal", ["PKS_DH"]) == "emal" and made("", ["PKS_KS"], trans=True) == "mal" and made("", ["PCP"], False) == ""
    assert made("ala", ["nMT", "oMT", "Epimerization"], False) == "D-NMe-OMe-ala"


def test_predictions_are_combined_by_quality(spark):
    def combined(matches, single, small, large, uncertain=False):
        kind = "array<struct<substrates:array<string>,code:double,long_code:double>>"
        array = lambda x: F.lit(None).cast("array<string>") if x is None else F.array(*[F.lit(v) for v in x])
        found = F.array(*[F.struct(array(s).alias("substrates"), F.lit(c).alias("code"), F.lit(h).alias("long_code")) for s, c, h in matches]).cast(kind)
        return spark.range(1).select(assembly.combine_predictions(found, array(single), [array(small), array(large)], F.lit(uncertain)).alias("c")).first()["c"]

    assert combined([(["ala"], 1.0, 0.5), (["gly"], 1.0, 0.9)], ["val"], None, None) == ["gly"]
    assert combined([(["ala"], 0.9, 0.5)], ["val"], ["ala"], None) == [] and combined([(["ala", "val"], 0.9, 0.5)], ["val"], None, None) == ["val"]
    assert combined([(["ala", "gly"], 0.8, 0.5)], None, None, ["gly", "ser"]) == ["gly"] and combined([(["ala"], 0.8, 0.5)], ["val"], None, None) == ["val"]
    assert combined([(["ala"], 0.7, 0.5)], None, ["ser"], ["gly"]) == ["ser"] and combined([], None, None, None) == []
    assert combined([(["ala"], 0.7, 0.5)], ["val"], ["ser"], None, True) == [] and combined([(["ala"], 0.8, 0.5)], ["val"], None, None, True) == ["ala"]


def test_orders_equal_all_permutations(spark):
    random.seed(5)
    letters, units = "AVKRDEGS", []
    for area in range(6):
        for k in range(random.randint(1, 5)):
            pair = lambda: random.choice([None, "".join(random.choices(letters, k=2))])
            role = "start" if k == 2 and area % 2 else "end" if k == 3 and area % 3 else None
            units.append((area, k, random.randint(0, 50) * 10 + k, role, pair(), pair(), k + 1))

    def score(path):
        total = 0
        for x, y in zip(path, path[1:], strict=False):
            total += x[6] == y[1]
            if x[4] and y[5]:
                for a, b in zip(x[4], y[5], strict=True):
                    kinds = [{"A": "h", "V": "h", "K": "+", "R": "+", "D": "-", "E": "-"}.get(c, "?") for c in (a, b)]
                    total += 1 if kinds in (["h", "h"], ["+", "-"], ["-", "+"]) else -1 if kinds in (["+", "+"], ["-", "-"]) else 0
        return total

    found = {r["area_id"]: (r["order"], r["score"]) for r in assembly.best_order(spark.createDataFrame(units, "area_id bigint, unit bigint, start bigint, role string, tail string, head string, follower bigint")).collect()}
    for area in range(6):
        own = [u for u in units if u[0] == area]
        head, last, free = ([u for u in own if u[3] == r] for r in ("start", "end", None))
        best = min(([*head, *p, *last] for p in itertools.permutations(free)), key=lambda p: (-score(p), [(u[2], u[1]) for u in p]))
        assert found[area] == ([u[1] for u in best], score(best)), area
    crowd = spark.createDataFrame([(1, k, k, None, None, None, None) for k in range(12)], "area_id bigint, unit bigint, start bigint, role string, tail string, head string, follower bigint")
    assert assembly.best_order(crowd).count() == 0


def test_ends_and_colinear_chains(spark):
    rows = [(1, 1, True, False, False), (1, 2, False, True, False), (2, 3, True, False, False), (2, 4, True, False, True), (3, 5, False, False, True), (3, 6, False, True, True), (4, 7, False, True, False), (4, 8, False, True, False)]
    frame = spark.createDataFrame(rows, "record_id int, gene_id int, opens boolean, closes boolean, classic boolean")
    assert sorted(map(tuple, assembly.find_ends(frame).collect())) == [(1, 1, 2), (2, None, None), (3, 5, 6), (4, None, None)]
    genes = [(1, 1, 10, -1, False, False), (1, 2, 20, -1, True, False), (1, 3, 30, -1, False, True), (2, 4, 10, 1, False, False), (2, 5, 20, 1, True, False)]
    placed = assembly.colinear_groups(spark.createDataFrame(genes, "record_id int, gene_id int, start int, strand int, chained boolean, ends boolean"))
    assert [r["gene_id"] for r in placed.orderBy("record_id", "place").collect()] == [2, 1, 3, 4, 5]


def test_structures_are_strung_together(spark):
    rows = [(1, 1, "ala", "ala"), (1, 2, "ohmal", "mal"), (2, 1, "new", "ala"), (2, 2, "what", "what")]
    codes = spark.createDataFrame([("ala", "NC(C)C(=O)O"), ("ohmal", "CC(O)")], "name string, code string")
    found = {r["area_id"]: r["structure"] for r in assembly.structure_string(spark.createDataFrame(rows, "area_id int, place int, monomer string, substrate string"), codes).collect()}
    assert found == {1: "NC(C)C(=O)CC(O)C(=O)O", 2: "NC(C)C(=O)"}


def test_sites_motifs_and_the_hit_that_counts(spark):
    aligned = spark.createDataFrame([(1, "K", "ABCDEFG", "AB.DEFG", 0), (2, "K", "ABXDEFG", "ABCDEFG", 2), (3, "K", "AB", "AB", 0), (4, "L", "ABC", "ABC", 0)], "domain_id int, profile string, query string, reference string, hit_start int")
    table = spark.createDataFrame([("s", "K", [3], "D", [4], {"E": "yes"}, "no"), ("t", "L", [], "", [1], {"A": "is A"}, None)], "site string, profile string, scaffold array<int>, expected string, target array<int>, labels map<string,string>, other string")
    assert sorted((r["domain_id"], r["site"], r["residues"], r["label"]) for r in sites.active_sites(aligned, table).collect()) == [(1, "s", "E", "yes"), (4, "t", "A", "is A")]
    general = spark.createDataFrame([(1, 1, "g", 5.0, True, 1), (1, 1, "h", 5.0, False, 2), (1, 2, "h", 1.0, False, 3), (1, 3, "g", 1.0, True, 4)], "record_id int, gene_id int, profile string, score double, conventional boolean, ord int")
    specific = spark.createDataFrame([(1, 1, "x", 2.0, 1), (1, 1, "y", 1.0, 2), (1, 2, "x", 9.0, 3), (1, 3, "x", 2.0, 4), (1, 3, "y", 2.0, 5)], "record_id int, gene_id int, profile string, confidence double, ord int")
    assert sorted(tuple(r) for r in sites.choose_hit(general, specific).collect()) == [(1, 1, "x", True), (1, 2, "h", False), (1, 3, "g", False)]


def test_classifier_separates_what_is_separable(spark):
    random.seed(6)
    rows = [(k, k % 2 * 3 + random.random(), random.random(), float(k % 2)) for k in range(200)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, label double")
    model = sites.fit_classifier(frame, ["a", "b"])
    assert all(r["score"] == 10 * (r["id"] % 2) for r in sites.classifier_score(frame.drop("label"), model).collect())


def test_reports_and_reference_sets_are_read_again(spark, tmp_path):
    ranking = spark.createDataFrame([(1, 7, 1), (2, 8, 1)], "region int, ref_area int, rank int")
    pairs = spark.createDataFrame([(1, 7, "q", "s"), (2, 8, "r", "t")], "region int, ref_area int, query_id string, ref_gene string")
    writers.write_hit_report(ranking, pairs, str(tmp_path / "report"))
    read = lambda name: sorted(tuple(r) for r in spark.read.csv(f"{tmp_path}/report/{name}", header=True, inferSchema=True).select(*(ranking if name == "ranking" else pairs).columns).collect())
    assert read("ranking") == [(1, 7, 1), (2, 8, 1)] and read("pairs") == [(1, 7, "q", "s"), (2, 8, "r", "t")]
    regions = spark.createDataFrame([("acc", "d", 1, 10, 400, "a-b", False), ("acc", "d", 2, 0, 90, "c", True), ("acc", "d", 3, 0, 600_001, "c", False)], "accession string, description string, region int, start int, end int, products string, at_edge boolean")
    genes = spark.createDataFrame([(1, 20, 50, 1, "t 1", "note|x", "p1", "MK"), (1, 60, 90, -1, None, None, None, "ML"), (2, 5, 9, 1, "t", "n", "p", "M"), (3, 5, 9, 1, "t", "n", "p", "M")], "region int, start int, end int, strand int, locus_tag string, annotation string, protein_id string, translation string")
    reference_sets.write_cluster_reference(*reference_sets.build_cluster_reference(regions, genes), str(tmp_path / "set"))
    row = readers.read_reference_clusters(spark, f"{tmp_path}/set/clusters").collect()
    assert len(row) == 1 and row[0]["cluster"] == "c10-400" and row[0]["tags"] == ["t_1", "no_locus_tag"] and row[0]["proteins"] == ["p1", "no_accession"]
    assert sum(line.startswith(">acc|c10-400|") for line in (r["value"] for r in spark.read.text(f"{tmp_path}/set/proteins").collect())) == 2


def test_cores_of_several_genes_are_named_so(spark):
    motifs = spark.createDataFrame([("x", "g", "lan", "[a'b]", 2), ("x", "g", "lan", "cc", 1), ("x", "h", "lan", "ab", 3), ("y", "i", "las", "ab", 1)], "accession string, gene string, kind string, core string, ord int")
    found = [tuple(r) for r in reference_sets.build_core_reference(motifs).orderBy("entry").collect()]
    assert found == [(1, "x", "g (core 1)", "lan", "CC"), (2, "x", "multiple genes", "lan", "AB"), (3, "y", "i", "las", "AB")]


def test_a_cluster_has_to_name_its_shared_folder(spark, monkeypatch):
    assert shared_folder(spark).startswith("file:")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(type("Cluster", (), {"sparkContext": type("C", (), {"getCheckpointDir": lambda s: None, "master": "yarn"})(), "conf": {}})())


def test_consensus_compares_letters_of_a_batch_at_once(spark, monkeypatch):
    """Letters outside ASCII are compared as one; nulls stay; no array of letters is made per text."""
    import pyarrow as pa

    pairs = [("ÄS", "ÄT"), ("Ä𝒞A", "ä𝒞S"), ("ACD", "AC"), (None, "A"), ("A", None), (None, None), (None, ""), ("", "A"), ("D", "E")]
    expected = ["Ä+", " 𝒞+", "AC", None, None, "", "", "", "+"]
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", compare.consensus_string(F.col("a"), F.col("b")).alias("c"))
    assert [r["c"] for r in sorted(frame.collect())] == expected
    monkeypatch.setattr(compare, "_AT_ONCE", 2)
    assert compare._consensus(*(pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))).to_pylist() == expected
    assert "zip_with" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_locations_are_walked_and_written_once(spark):
    """Exons are carried along instead of summed anew for each; what is written is read back without being written again; signs and open ends are read."""
    from locusloom.functions import locations as loc
    from locusloom.queries import QUERIES

    text = lambda x: spark.range(1).select(loc.parse_location(F.lit(x)).alias("p")).first()["p"]
    assert [tuple(p) for p in text("join{[<1:6](-), [7:>9](+), [10:11]}")] == [(1, 6, -1), (7, 9, 1), (10, 11, 0)]
    parts = lambda *some: F.array(*[loc.part(F.lit(a), F.lit(b), F.lit(s)) for a, b, s in some])
    frame = spark.range(1).select(loc.protein_to_dna(parts((90, 100, -1), (50, 70, -1), (0, 30, -1)), F.lit(2), F.lit(11)).alias("p"), loc.drop_redundant_exons(parts((0, 9, 1), (0, 9, 1), (2, 5, 1), (8, 12, 1))).alias("kept"))
    row = frame.first()
    assert [tuple(p) for p in row["p"]] == [(90, 94, -1), (50, 70, -1), (27, 30, -1)] and [tuple(p) for p in row["kept"]] == [(0, 9, 1), (8, 12, 1)]
    assert "slice" not in frame._jdf.queryExecution().analyzed().toString()
    plan = QUERIES["C10_location_strings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("join{") == 1
