"""The pipeline over a small table: every stage's decisions, and the packed result."""

import shutil

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    for name in ("documents", "labels"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", path / f"{name}.parquet")
    return str(path)


def test_stages_keep_columns_and_take_effect(spark, folder, tmp_path):
    from locusloom.llm import minhash_dedup, mixing, quality_classifier, quality_rules

    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    expected = {
        "quality_classifier": lambda d: quality_classifier.score(d, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").count(),
        "quality_rules": lambda d: quality_rules.decided(quality_rules.ledger(d)).where("kept").count(),
        "minhash_dedup": lambda d: minhash_dedup.dedup(d).where("kept").count(),
        "mixing": lambda d: mixing.mix(d).agg(F.sum("copies")).first()[0],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        count = expected[name](docs)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == first.columns and docs.count() == count
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.where("start = 0").count() == docs.count()


TEXT = "A calm sentence tells that boat number %d lies in the harbour while people walk along the quay and talk about the weather of the coming week."


@pytest.mark.parametrize("kind", ["mixed", "long", "empty"])
def test_run_over_nulls_repeats_and_clashing_names(spark, tmp_path, kind):
    names = ("_measured", "_good", "_key", "_number", "kept", "start", "length")
    rows = [(k, None if k % 7 == 0 else "" if k % 7 == 1 else TEXT % (k // 2 if k % 5 == 0 else k * 7919), None if k % 11 == 0 else "s", *[n + str(k) for n in names]) for k in range(80)]
    rows += [rows[5], (None, TEXT % 1, "s", *names), (None, None, None, *names)]
    if kind == "long":
        rows += [(k, " ".join(TEXT % (j * 31 + k) for j in range(20_000)), "s", *names) for k in (200, 201)]
    schema = "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([] if kind == "empty" else rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(bool(rows[k][1])), 0) for k in range(80)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert not packed
        return
    assert packed and {p["doc_id"] for p in packed} <= {r[0] for r in rows if r[1]}
    by = {}
    for p in packed:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_entry_registers_all_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
