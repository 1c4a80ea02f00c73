"""Queries that read whole tables and texts, against small loops."""

import random
import re

import pytest

import __spark_entry__ as entry
from locusloom.operators import compare, scans
from locusloom.tables import table

RESIDUES = set("ACDEFGHIKLMNPQRSTVWY")


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Folder and texts, most of whose content lies behind the first 400 characters."""
    random.seed(7)
    words = ["".join(random.choices("abcdefghiklmnpqrstvwyc", k=random.randint(2, 9))) for _ in range(300)]
    found = {k: "x" * 450 * (k % 2) + " ".join(random.choices(words, k=random.choice([0, 1, 40, 900]))) + "t r"[:k % 4] for k in range(60)}
    folder = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(list(found.items()), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), found


def protein(text):
    return "".join(c for c in text.upper() if c in RESIDUES)


def run(spark, name, folder, key="record_id"):
    rows = entry.queries()[name](spark, folder).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_peptides_are_read_to_their_end(spark, texts):
    folder, found = texts
    sites, features, scores, masses = (run(spark, n, folder) for n in ("H17_cleavage_site", "H18_peptide_features", "H19_heuristic_score", "H20_peptide_mass"))
    for k, text in found.items():
        p = protein(text)
        site = None
        for regex, offset in (("G[AG]", 0), ("T.R", 2)):
            ends = [m.end(1) for m in re.finditer(f"(?=({regex}))", p)]
            if site is None and ends and len(p) - (ends[-1] + offset) >= 10:
                site = ends[-1] + offset
        assert sites[k]["site"] == site
        cs = [i for i, c in enumerate(p) if c == "C"]
        facing = sum(any(p[i + d : i + d + 1] == "C" for d in range(2, 6)) for i in cs)
        assert (features[k]["length"], features[k]["n_charged"], features[k]["n_facing_cys"]) == (len(p), sum(c in "DEKR" for c in p), facing)
        assert scores[k]["score"] == 3 * (20 <= len(p) <= 90) + 5 * ("CC" in p) + 2 * bool(re.search("S.C", p)) - p.startswith("T")
        assert abs(masses[k]["mass"] - scans.WATER - sum(scans.MASSES[c] for c in p)) < 0.01
        assert len([x for x in masses[k]["others"].split(",") if x]) == p.count("S")


def test_alignments_and_consensus_are_read_to_their_end(spark, texts):
    folder, found = texts
    trimmed = run(spark, "H16_trim_alignment", folder, "alignment_id")
    for alignment in range(40):
        rows = [("--" + protein(t)) if k % 3 == 0 else (protein(t) + "----") for k, t in found.items() if k % 40 == alignment]
        good = []
        for column in range(max(map(len, rows))):
            letters = [r[column] for r in rows if column < len(r)]
            n, letter = max((letters.count(c), c) for c in letters)
            good += [column] * (letter != "-" and n >= 0.2 * len(rows))
        assert (alignment in trimmed) == bool(good)
        assert not good or (trimmed[alignment]["first"], trimmed[alignment]["last"]) == (good[0], good[-1])
    alike = {a + b for a in compare.SIMILAR for b in compare.SIMILAR[a]}
    marked = run(spark, "G18_consensus_string", folder)
    for k, text in found.items():
        t = re.sub("[^A-Z]", "", text.upper())
        assert marked[k]["consensus"] == "".join(a if a == b else "+" if a + b in alike else " " for a, b in zip(t, t[7:], strict=False))


def test_links_through_every_reference_area(spark, tmp_path):
    random.seed(8)
    rows = [(random.randint(1, 300), random.randint(1, 900), random.randint(1, 40), 1) for _ in range(500)]
    columns = "cast(o as bigint) l_orderkey, cast(p as bigint) l_partkey, cast(s as bigint) l_suppkey, n l_linenumber, 5.0D l_quantity, 0.02D l_tax, 100.0D l_extendedprice"
    spark.createDataFrame(rows, "o int, p int, s int, n int").selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {((s % 20, 0, o), (s % 20, 1, p)) for o, p, s, _ in rows}
    group = {x: x for e in edges for x in e}
    for _ in rows:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    found = entry.queries()["G6_linked_groups"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((x[0], x[2], g[2]) for x, g in group.items() if x[1] == 0)
    assert any(r["query_id"] != r["group_id"] for r in found)


def test_polymers_hold_every_gene(spark):
    folder = "/root/testdata/sf0.001"
    rows = table(spark, folder, "genes").select("record_id", "gene_id", "start", "strand", "profile").collect()
    expected = []
    for record in {r["record_id"] for r in rows}:
        own = [r for r in rows if r["record_id"] == record]
        back = sum(r["strand"] for r in own) < 0
        own.sort(key=lambda r: (-r["start"] if back else r["start"], r["gene_id"]))
        expected += [(record, k, f"({r['profile'].lower()} - {r['profile']})") for k, r in enumerate(own, 1)]
    found = entry.queries()["I14_polymer"](spark, folder).collect()
    assert max(x[1] for x in expected) > 40
    assert sorted((r["record_id"], r["place"], r["text"]) for r in found) == sorted(expected)


def test_residues_are_mapped_on_all_kinds_of_exons(spark):
    folder = "/root/testdata/sf0.001"
    expected = []
    for r in table(spark, folder, "genes").select("record_id", "gene_id", "start").collect():
        exons = {0: [(0, 50), (300, 350), (200, 250)], 1: [(0, 120), (200, 250)]}.get(r["gene_id"] % 4, [(0, 50), (100, 150), (200, 250)])
        bases = [x for a, b in exons for x in range(a, b)][30:75]
        spans = [[x for x in bases if a <= x < b] for a, b in exons]
        expected.append((r["record_id"], r["gene_id"], ",".join(f"{r['start'] + x[0]}-{r['start'] + x[-1] + 1}" for x in spans if x)))
    found = entry.queries()["C8_protein_to_dna"](spark, folder).collect()
    assert {r["feature_id"] % 4 for r in found} == {0, 1, 2, 3}
    assert sorted((r["record_id"], r["feature_id"], r["spans"]) for r in found) == sorted(expected)
