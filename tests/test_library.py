"""Library operators against small loops, and oracles on the smallest tables."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusloom.functions import locations as loc
from locusloom.operators import areas, hits
from locusloom.operators.rules import Rule, Rules, evaluate_rules, gene, minimum, profile, repeatable, strip_inferior
from locusloom.plans.graph import components
from locusloom.plans.intervals import islands, range_join
from locusloom.plans.ordering import prefix_totals

FOLDER = "/root/testdata/sf0.001"
FEATURES = "record_id int, gene_id bigint, start bigint, end bigint, profile string, score double"


def test_components_of_paths_stars_and_cycles(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(random.sample(edges, len(edges)), "a bigint, b bigint")).collect()}
    assert all(found[k] == 0 for k in range(301)) and all(found[k] == 1000 for k in range(1000, 1200)) and found[2002] == 2000
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_prefix_totals_and_spread_islands(spark, monkeypatch):
    random.seed(2)
    rows = [(random.choice([1, 1, 1, 2]), random.randint(0, 5000), random.randint(1, 40)) for _ in range(900)]
    frame = spark.createDataFrame([(k, s, s + n, i) for i, (k, s, n) in enumerate(rows)], "key int, start int, end int, id int")
    got = {r["id"]: (r["n"], r["t"]) for r in prefix_totals(frame, ["key"], ["start", "id"], {"t": "end"}, rows="n").collect()}
    for key in (1, 2):
        own = sorted((s, i, s + n) for i, (k, s, n) in enumerate(rows) if k == key)
        assert all(got[i] == (p, sum(x[2] for x in own[:p])) for p, (_, i, _) in enumerate(own))
    run = lambda s: {r["id"]: r["island"] for r in islands(frame, ["key"], gap=3, order=["id"], spread=s).collect()}
    plain, counted = run(False), run(True)
    monkeypatch.setattr("locusloom.plans.ordering.SMALL", 3)
    assert plain == counted == run(True)


def test_range_join_equals_nested_loop(spark):
    random.seed(3)
    make = lambda n: [(random.randint(0, 2), k, s, s + random.randint(1, 70)) for k in range(n) for s in [random.randint(0, 900)]]
    a, b = make(120), make(150)
    schema = "record_id int, id int, start int, end int"
    got = range_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["record_id"], 50).select("l.id", F.col("r.id").alias("o")).collect()
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert "NestedLoop" not in range_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["record_id"], 50)._jdf.queryExecution().toString()


def test_only_one_gene_sees_all_but_all_become_core(spark):
    spans = [(0, 2000), (2600, 4400), (4500, 6500), (8000, 9000), (9050, 11000)]  # only the third is within 2,600 of all others
    rows = [(1, k, s, e, p, 10.0) for k, ((s, e), p) in enumerate(zip(spans, "ABCDE", strict=True))]
    features = spark.createDataFrame(rows, FEATURES)
    all_five = profile("A") & profile("B") & profile("C") & profile("D") & profile("E")
    found = evaluate_rules(features, features, Rules((Rule("all", all_five, 2600, 9000),))).collect()
    assert sorted(r["gene_id"] for r in found) == [0, 1, 2, 3, 4]
    assert evaluate_rules(features, features, Rules((Rule("all", all_five, 2400, 9000),))).count() == 0


def test_conditions_on_genes_with_several_profiles(spark):
    rows = [(1, 1, 0, 10, "A", 5.0), (1, 1, 0, 10, "B", 9.0), (1, 2, 15, 20, "B", 1.0), (1, 3, 22, 30, "C", 2.0), (1, 4, 500, 510, "A", 3.0)]
    hits_ = spark.createDataFrame(rows, FEATURES)
    features = hits_.dropDuplicates(["gene_id"])
    run = lambda c: {(r["gene_id"], tuple(r["matches"])) for r in evaluate_rules(features, hits_, Rules((Rule("r", c, 10, 10),))).collect()}
    assert run(minimum(2, ["A", "B"])) == {(1, ("A", "B")), (2, ("B",))}
    assert run(repeatable(3, ["A", "B"])) == {(1, ("A", "B")), (2, ("B",))}
    assert run(gene(profile("A") & profile("B"))) == {(1, ("A", "B"))}
    assert run(profile("A") & ~profile("C")) == {(1, ("A",)), (4, ("A",))}
    with pytest.raises(ValueError):
        Rule("none", ~profile("A"), 1, 1)
    with pytest.raises(ValueError):
        minimum(0, ["A"])


def test_superior_rules_take_genes_and_areas(spark):
    rows = [(1, 1, 50, 80, "A", 1.0), (1, 2, 110, 140, "A", 1.0), (1, 2, 110, 140, "B", 1.0), (1, 3, 500, 510, "B", 1.0)]
    hits_ = spark.createDataFrame(rows, FEATURES)
    features = hits_.dropDuplicates(["gene_id"])
    rules = Rules((Rule("top", profile("A"), 40, 10), Rule("low", profile("B"), 40, 10, superiors=("top",))))
    matches = evaluate_rules(features, hits_, rules)
    left = {(r["gene_id"], r["rule"]) for r in strip_inferior(matches, rules).collect()}
    assert left == {(1, "top"), (2, "top"), (3, "low")}
    cores = matches.join(features.select("record_id", "gene_id", "start", "end"), ["record_id", "gene_id"])
    found = {(r["product"], r["core_start"], r["start"], r["end"]) for r in areas.protoclusters(cores, rules).collect()}
    assert found == {("top", 50, 40, 150), ("low", 500, 490, 520)}


def test_greedy_fold_equals_loop(spark):
    random.seed(4)
    rows = [(1, g, random.choice("pq"), s, s + random.randint(15, 60), float(random.randint(1, 99)), 0.0, k) for k in range(400) for g in [k % 25] for s in [random.randint(0, 200)]]
    frame = spark.createDataFrame(rows, "record_id int, gene_id int, profile string, start int, end int, score double, evalue double, ord int")
    profiles = spark.createDataFrame([("p", 30, 10.0), ("q", 40, 20.0)], "profile string, length int, cutoff double")
    cutoff = {"p": 10.0, "q": 20.0}
    expected = []
    for g in range(25):
        kept = []
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (cutoff[r[2]] / r[5], 1 / (r[4] - r[3]), r[3], r[2], r[7])):
            if not any(r[3] <= k[4] - 10 and r[4] >= k[3] + 10 for k in kept):
                kept.append(r)
        expected += [k[7] for k in kept]
    assert sorted(r["ord"] for r in hits.greedy_non_overlapping(frame, profiles).collect()) == sorted(expected)
    with pytest.raises(Exception, match="unknown profile"):
        hits.filter_by_cutoff(frame, profiles.where("profile = 'p'")).collect()
    with pytest.raises(ValueError):
        hits.refilter(frame, (10, 0.1), (5, 0.1))


def test_circular_locations(spark):
    parts = lambda *spans: F.array(*[loc.part(F.lit(a), F.lit(b)) for a, b in spans])
    a, b, c, n = parts((950, 1000), (0, 40)), parts((60, 120)), parts((500, 560)), F.lit(1000)
    row = spark.range(1).select(
        loc.distance(a, b, n).alias("ab"), loc.distance(b, c, n).alias("bc"), loc.distance(a, c, n).alias("ac"), loc.crosses_origin(a).alias("x"),
        loc.format_location(loc.extend(parts((950, 1000), (0, 120)), 100, n, F.lit(True))).alias("wide"), loc.format_location(loc.hull(F.concat(a, b), n, F.lit(True))).alias("hull"),
        loc.format_location(loc.offset(b, -100, n)).alias("moved"), loc.format_location(loc.extend(c, 600, n, F.lit(True))).alias("whole"), loc.format_location(loc.extend(c, 600, n, F.lit(False))).alias("clamped"),
    ).first()
    assert (row["ab"], row["bc"], row["ac"], row["x"]) == (20, 380, 390, True)
    assert row["wide"] == "join{[850:1000](+), [0:220](+)}" and row["hull"] == "join{[950:1000](+), [0:120](+)}"
    assert row["moved"] == "join{[960:1000](+), [0:20](+)}" and row["whole"] == row["clamped"] == "[0:1000](+)"


def test_regions_never_overlap_and_hold_every_area(spark):
    from locusloom.queries.areas import plain_areas

    found = plain_areas(spark, FOLDER).cache()
    regions = sorted(map(tuple, areas.regions(found).select("record_id", "start", "end").collect()))
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(regions, regions[1:], strict=False))
    assert areas.regions(found).agg(F.sum("n_areas")).first()[0] == found.count()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n.split("_")[0] in {"areas", "B7", "C4", "C8", "D1", "D9", "E4", "E9", "F7", "F13", "F19", "F23", "G3", "G6", "G9", "G18", "H3", "H5", "H7", "H13", "F26", "J7", "J11", "J16", "E12", "E15", "I4", "I8", "I11", "I13", "F9", "F11", "F20", "A15", "A17"})


@pytest.mark.parametrize("name", NAMES)
def test_oracles_agree(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "events", "documents", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    relation = con.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(c) for c in columns]
    expected = sorted((str([normal(row[p]) for p in places]) for row in relation.fetchall()))
    assert sorted(str([normal(row[c]) for c in columns]) for row in frame.collect()) == expected
