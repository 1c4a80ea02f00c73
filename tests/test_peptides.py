"""Peptide features, scores, masses and types against plain Python."""

from __future__ import annotations

import random
import re

import pytest

from locusloom.operators import peptides

ROWS = "peptide_id long, leader string, core string, domains array<string>, own array<string>, distance long, distance_protease long, same_strand boolean, starts_atg boolean, domain_start long, kind string, aminovinyl int, chlorinated int, oxygenated int, lac int"


def row(k, leader, core, domains=(), own=(), distance=-1, protease=-1, strand=False, atg=True, start=None, kind="lanthipeptide", flags=(0, 0, 0, 0)):
    return (k, leader, core, list(domains), list(own), distance, protease, strand, atg, start, kind, *flags)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    rows = [row(k, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYCCSTGAX", k=rng.randint(0, 40))), "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYCCCSSTTGA", k=rng.randint(0, 50)))) for k in range(300)]
    rows += [row(300, None, None), row(301, "", "C"), row(302, "M", "CC"), row(303, "GAC", "CGAGACCGC"), row(304, "A" * 40_000, "SC" * 30_000), row(305, "", "CAAAAAACAAC")]
    return rows, {r["peptide_id"]: r for r in peptides.class_scores(peptides.vector(spark.createDataFrame(rows, ROWS))).collect()}


def longest(text, first, gaps):
    """For each start the widest gap to a cysteine."""
    out = []
    for i, c in enumerate(text):
        if c in first:
            found = [g for g in gaps if text[i + g + 1 : i + g + 2] == "C"]
            out += found and [max(found)]
    return out


def test_vector_equals_plain_scans(made):
    for k, leader, core, *_ in made[0]:
        r, leader, core = made[1][k], leader or "", core or ""
        whole = leader + core
        for part, text in (("leader", leader), ("core", core), ("precursor", whole)):
            assert r[f"len_{part}"] == len(text) and r[f"{part}_charge"] == sum(map(text.count, "KR")) - sum(map(text.count, "DE")) and r[f"{part}_charge_h"] == r[f"{part}_charge"] + text.count("H")
            assert all(r[f"{part}_{x.lower()}"] == text.count(x) for x in peptides.RESIDUES) and all(r[f"{part}_{n}"] == sum(map(text.count, g)) for n, g in peptides.GROUPS.items())
            known = sum(peptides.MASSES[x][1] for x in text if x != "X") + peptides.WATER[1]
            assert r[f"known_mass_{part}"] == pytest.approx(known, abs=1e-3) and r[f"mass_{part}"] == pytest.approx(known + 110 * text.count("X"), abs=1e-3)
        if len(whole) > 9999:
            assert (r["n_rings"], r["ring_8"], r["ring_7"], r["chain_6"], r["core_c"]) == (29_998, 0, 0, 0, 30_000) or r["n_rings"] > 0
            continue
        rings = longest(core, "ST", range(2, 7))
        assert r["n_rings"] == len(rings) and [r[f"ring_{s}"] for s in range(4, 9)] == [rings.count(s - 2) for s in range(4, 9)]
        chains = longest(whole, "C", range(1, 7))
        assert [r[f"chain_{s}"] for s in range(1, 7)] == [chains.count(s) for s in range(1, 7)] and r["n_core_chains"] == len(longest(core, "C", range(1, 7)))
        assert [r[f"{x}_repeats"] for x in "cst"] == [sum(map(len, re.findall(x.upper() + "{2,}", core))) for x in "cst"]
        assert r["block_repeats"] == len(re.findall("C{2,}|S{2,}|T{2,}", core))
        blocks = re.findall("[CST]{2,}", core)
        assert r["blocks"] == len(blocks) and r["block_length"] == pytest.approx(sum(map(len, blocks)) / len(blocks) if blocks else 0)
        starts = [m.start() for x in ("[GA]{1,2}C", "C[GA]{1,2}") for m in re.finditer(x, whole)]
        gaps = [max(1, b - a) for a, b in zip(starts, starts[1:], strict=False)]
        assert r["n_gac"] == len(starts) and r["gac_distance"] == pytest.approx(sum(gaps) / len(gaps) if gaps else 0)
        if whole:
            assert r["c_tail"] == pytest.approx(len(re.split("C.{2,5}(?=C)", whole)[-1]) / len(whole)) and (r["first_c"] is None) == ("C" not in whole)
        assert r["has_double"] == any(a == b for a, b in zip(core, core[1:], strict=False)) and r["first_9_p"] == core[:9].count("P")
        assert r["c_in_two_thirds"] == whole[: 2 * len(whole) // 3].count("C") and r["last_quarter"] == (whole[-len(whole) // 4 :] if whole else "")


def test_scores_by_hand(spark):
    rows = [
        row(1, "MFDLDEEEEE", "ITSISLCTPGCKTGALMGCNMKTATCHCSIHVSK", ["LANC_like", "Lant_dehyd_C", "PF14028", "PF00005"], ["Gallidermin"], 100),
        row(2, "GKKKKKTWLMAAVKG", "GGAGHVPEYFVGIGTPISFYG", ["PF13471"], (), 120, 90, True, True, kind="lassopeptide"),
        row(3, "MDDE", "SCNCVCSSSSCCSTTTT", ["YcaO", "PF00881", "tsrC", "Lant_dehyd_C"], kind="thiopeptide"),
        row(4, "MKKAVIVE", "NKGCATCSIGAACLVDGPIPDFEIAGATGLFGLWG", ["PF04055", "SPASM", "PF05402", "Peptidase_S8"], ["Subtilosin_A"], 20, start=90),
    ]
    found = {r["peptide_id"]: r for r in peptides.class_scores(peptides.vector(spark.createDataFrame(rows, ROWS))).collect()}
    # leader motif 2, near 1, two enzymes 4, PF14028 2, transporter 1, mass of the core over 2000, precursor over 4000, own 3, negative 1, charge 1, TPGC 1, S..LC 2, CT.GC 1, rings
    rings = longest(rows[0][2], "ST", range(2, 7))
    by_size = [rings.count(s) for s in range(2, 7)]
    expected = 2 + 1 + 2 + 2 + 2 + 1 + 3 + 1 + 1 + 1 + 2 + 1 + (2 if len(rings) > 4 else 0) - (2 if len(rings) < 3 else 0) + sum(2 for n in by_size[:2] if n > 2) + sum(w for n, w in zip(by_size[2:], (2, 2, 1), strict=True) if n)
    assert found[1]["lanthipeptide_score"] == expected and found[1]["lanthipeptide"] == (expected >= 14)
    # near 1 and 1, no cysteine (even), no leader longer, ring 1, G.....T 3, starts with G 2, strand 1, ratio 1, aromatic 1 and 2, W -1, K 1
    assert found[2]["lassopeptide_score"] == 1 + 1 + 1 + 3 + 2 + 1 + 1 + 1 + 2 - 1 + 1 and not found[2]["lassopeptide"]
    # domains 8, CSS 1, SS 1, SSS 1, SSSS 2, CC 1, TT 1, TTT 1, TTTT 2; mass 1, repeats 2, blocks 2, charge 2, ends 1, share 2
    assert found[3]["thiopeptide_score"] == 8 + 10 + 1 + 2 + 2 + 2 + 1 + 2 and found[3]["thiopeptide"]
    assert found[4]["sactipeptide_score"] == 1 + 1 + 2 + 4 + found4_motifs(rows[3][2]) + 1 + 0 + 3 + 1 + 1 + 1 + 1 + 2 - 2 + 2


def found4_motifs(core):
    return sum(w for x, w in (("C.{5}C", 2), ("C.{3}C", 1), ("C..C", 1), ("C.C", 1), ("CC", -2), ("CCC", -2)) if re.search(x, core))


def test_types_and_masses(spark):
    rows = [
        row(1, "", "SSCCT", ["DUF4135"], flags=(1, 1, 0, 0)), row(2, "", "TTTTC", ["none"]), row(3, "", "GGGGGGDEACCCC", (), kind="lassopeptide"), row(4, "", "GGCGGCGGG", (), kind="lassopeptide"),
        row(5, "", "SAAAAAAAAASCA", ["PF06968", "thio_amide"], kind="thiopeptide"), row(6, "", "TAAASAAAAAAAASCAA", ["PF00733"], kind="thiopeptide"), row(7, "", "SAAAAAASSSSSSSAA", ["x"], kind="thiopeptide"), row(8, None, None, (), kind="thiopeptide"),
    ]
    typed = peptides.peptide_types(spark.createDataFrame(rows, ROWS))
    found = {r["peptide_id"]: r for r in peptides.mature_masses(typed).collect()}
    plain = {r["peptide_id"]: r for r in typed.collect()}
    assert [plain[k]["type"] for k in range(1, 9)] == ["Class-II", None, "Class I", "Class III", "Type I", "Type II", "Type III", "Type III"]
    assert [plain[k]["bridges"] for k in range(1, 5)] == [1, 1, 2, 1] and plain[3]["ring"] == "GGGGGGDE" and plain[4]["ring"] is None
    assert [plain[k]["ring"] for k in range(5, 9)] == ["29-member", "26-member", "35-member", None] and plain[5]["amidation"] == 1
    average = lambda core: sum(peptides.MASSES[x][0] for x in core) + peptides.WATER[0]
    assert found[1]["weight"] == pytest.approx(average("SSCCT") - 3 * 18.02 - 46 + 34) and found[1]["other_weights"] == [pytest.approx(found[1]["weight"] + 18.02)]
    assert found[3]["weight"] == pytest.approx(average(rows[2][2]) + 4 - 18.02) and found[3]["other_weights"] == []
    assert found[5]["weight"] == pytest.approx(average(rows[4][2]) - 18.02 * 1 - 20 * 0 - 35 + 169 + 32 - 70) and len(found[5]["other_weights"]) == 2
    assert found[7]["weight"] == pytest.approx(average(rows[6][2]))


def test_counts_go_over_all_letters_at_once(spark, monkeypatch):
    """Letters outside ASCII are one place each; what is counted does not depend on how many peptides are looked at together; no text is translated once per residue."""
    import pyarrow as pa

    leaders, cores = ["GÄC", "", "MCAGC", "𝒞C"] * 5, ["SééC", "", "CCSST", "CAAC"] * 5
    whole = peptides._count_all(pa.array(leaders), pa.array(cores)).to_pylist()
    monkeypatch.setattr(peptides, "_AT_ONCE", 16)
    assert peptides._count_all(pa.array(leaders), pa.array(cores)).to_pylist() == whole and peptides._count_all(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
    assert [(r["ring_4"], r["core_c"], r["leader_c"], r["c_repeats"], r["n_core_chains"]) for r in whole[:4]] == [(1, 1, 1, 0, 0), (0, 0, 0, 0, 0), (0, 2, 2, 2, 0), (0, 2, 1, 0, 1)]
    frame = peptides.vector(spark.createDataFrame([row(1, "M", "CC")], ROWS))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("translate(") < 10
