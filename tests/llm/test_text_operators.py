"""Operators that read each text for itself: rules, classifier, tokens, licences."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusloom.llm import license_scans, quality_classifier, quality_rules, token_counts
from locusloom.llm.tokenizer_files import tokenizer_path
from locusloom.llm.words import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, m string, f string"
LONG = "one two three four five six seven eight nine ten " * 4000


def docs(spark, texts):
    """Documents with columns whose names clash with results; ids repeat and may be null."""
    rows = [(None if k == 1 else k // 2 if k > 8 else k, t, None, None, None, "x", "y", "z", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


TEXTS = [
    None, "", "   \n\t ", "word", "a b c d e f g h i j " * 4, LONG, "é ü ß 日本 " * 10, "# $ % & | < > *", "Some line here\nSome line here\n\nother\n" * 3,
    "the quick brown fox jumps over the lazy dog and runs on past the river until dusk comes to the old town again", "SHOUT!! LOUD!! " * 15, "x\x0by\x0cz\rq",
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    inside = {p for places in windows.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "n_lines": len(lines), "n_caps": len(re.findall("[A-Z]", text)), "n_exclaim": text.count("!"),
        "n_same_as_last": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_slices_split_texts_into_words(limit):
    found = []
    for s in slices(pa.array(TEXTS), limit=limit):
        hashes = s.word_hashes()
        for k in range(s.n):
            spans = list(zip(s.starts[s.word_at[k] : s.word_at[k + 1]], s.ends[s.word_at[k] : s.word_at[k + 1]], strict=True))
            found.append([s.data[a:b].tobytes().decode() for a, b in spans])
            assert len(set(hashes[s.word_at[k] : s.word_at[k + 1]])) == len(set(found[-1]))
    assert found == [WORD.findall(t or "") for t in TEXTS]


def test_ledger_measures_like_brute_force(spark):
    rows = quality_rules.ledger(docs(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    expected = sorted(tuple(brute(t).values()) for t in TEXTS)
    assert sorted(tuple(r[m] for m in quality_rules.MEASURES) for r in rows) == expected
    for row in rows:
        for rule in quality_rules.RULES:
            fails = eval(rule.fails, {}, {m: row[m] for m in quality_rules.MEASURES})
            assert bool(row["fail_bits"] >> rule.bit & 1) == fails


def test_policies_and_ablations_use_stored_bits(spark):
    book = quality_rules.ledger(docs(spark, TEXTS)).cache()
    now = quality_rules.decided(book).collect()
    base = quality_rules.decided(book, quality_rules.POLICIES["2024-base"]).collect()
    assert all(not r["kept"] for r in now if r["base_failed"])
    assert sum(r["kept"] for r in base) >= sum(r["kept"] for r in now)
    bits = [r["fail_bits"] for r in now]
    for row in quality_rules.ablations(book).collect():
        bit = quality_rules.mask([row["rule"]])
        assert row["n_failed"] == sum(bool(b & bit) for b in bits)
        assert row["n_failed_alone"] == sum(b == bit for b in bits)
        assert row["n_kept_without"] == sum(not b & ~bit for b in bits)


def test_rules_keep_whole_rows(spark):
    frame = docs(spark, TEXTS)
    kept = quality_rules.keep(frame)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r["kept"] for r in quality_rules.decided(quality_rules.ledger(frame)).collect())
    assert quality_rules.ledger(frame.limit(0)).count() == 0


def test_isotonic_is_monotone_and_pools():
    fitted = quality_classifier.isotonic(np.arange(4.0), np.array([0.0, 0.6, 0.2, 1.0]), np.array([1.0, 1.0, 3.0, 1.0]))
    assert list(np.round(fitted, 6)) == [0.0, 0.3, 0.3, 1.0]


def test_classifier_learns_and_holds_out(spark):
    good = ["Clean prose that says ordinary things number %d and ends with a stop. " % k * (3 + k % 4) for k in range(150)]
    bad = ["BUY!! NOW!! $$$ ### %d " % k * (10 + k % 5) for k in range(150)]
    rows = [(k, t, "a", "b", k) for k, t in enumerate(t for pair in zip(good, bad, strict=True) for t in pair)] + [(300, None, "a", "b", 0), (300, "", None, None, 1), (None, "x y", None, None, 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, x string, score string, predicted bigint")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(300)] + [(5, None, None), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = quality_classifier.score(frame, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.95
    kept = quality_classifier.keep(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(r["predicted"] for r in found)


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    frame = docs(spark, TEXTS)
    assert {r["score"] for r in quality_classifier.score(frame, labels).collect()} == {0.5}
    assert quality_classifier.score(frame.limit(0), labels).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [*TEXTS, "aaaa" * 50, "it's we'll  don't\n\n x", "foo <|endoftext|> bar<|endoftext|>", "\x1c a \x85b\xa0c　", "½ 12 ٣ ﬁ 🙂‍🙂  "]
    rows = token_counts.token_counts(docs(spark, texts)).collect()
    expected = sorted((len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)


LICENCES = [
    None, "", "Under the MIT License. under the mit license!", "Apache License, Version 2.0", "CC-BY-NC 4.0 and cc by nc", "Licensed under CC BY-NC 4.0",
    "x " * 500 + "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU Public Licence version 3", "Released under the MIT License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in it without restriction",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of that software and associated documentation files (the Software), to deal in it without restriction",
]


def test_licence_scan_equals_regular_expressions(spark):
    rows = license_scans.scan(docs(spark, LICENCES)).collect()
    expected = []
    for text in LICENCES:
        words = license_scans.words_of(text or "")
        line = " " + " ".join(words) + " "
        starts, base = [], set()
        for phrase, label in license_scans.PHRASES:
            wanted = phrase.split()
            places = [k for k in range(len(words)) if words[k : k + len(wanted)] == wanted]
            starts += places
            base |= {label} if places else set()
        labels = base | {label for label, markup in license_scans.TEMPLATES if re.search(license_scans.pattern(license_scans.parsed(markup)) + " ", line)}
        score = 0.0 if not labels else 0.5 if labels == base else 1.0
        expected.append((len(words), len(starts), min(starts, default=-1), max(starts, default=-1), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    got = [(r["n_words"], r["n_base"], -1 if r["first_word"] is None else r["first_word"], -1 if r["last_word"] is None else r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in rows]
    assert sorted(got) == sorted(expected)
    assert {"mit", "gpl-3", "cc-by-nc"} <= {x for r in rows for x in r["labels"].split(",")}


def test_licence_markup_needs_nesting():
    with pytest.raises(ValueError):
        license_scans.parsed("a <<beginOptional>> b")


def test_held_out_fold_follows_the_id(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), quality_classifier.fold().alias("fold")).collect()
    assert all(r["fold"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_fit_equals_a_plain_ridge_of_the_same_features(spark):
    """Weights from sums over partitions against one least-squares solution of all rows, and the curve against pooled means."""
    random = np.random.default_rng(5)
    x = random.normal(size=(400, quality_classifier.FEATURES))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * random.normal(size=400) > 0.4).astype(float)
    rows = [(x[k].tolist(), float(y[k]), k % 4 == 0) for k in range(400)]
    settings = quality_classifier.Settings(components=32, parts=5)
    model = quality_classifier.fit(spark.createDataFrame(rows, "x array<double>, y double, calibrate boolean").repartition(5), settings)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale)
    draw = np.random.default_rng(settings.seed)
    frequencies = draw.normal(size=(quality_classifier.FEATURES, 32)) / settings.bandwidth
    phases = draw.uniform(0, 2 * np.pi, 32)
    z = np.concatenate([np.sqrt(2 / 32) * np.cos(np.clip((x - centre) / scale, -5, 5) @ frequencies + phases), np.ones((400, 1))], axis=1)
    train = np.arange(400) % 4 != 0
    penalty = np.diag([settings.ridge] * 32 + [1e-9])
    weights = np.linalg.solve(z[train].T @ z[train] + penalty, z[train].T @ y[train])
    assert np.allclose(model.weights, weights, atol=1e-6)
    raw = z[~train] @ weights
    low, high = raw < np.quantile(raw, 0.3), raw > np.quantile(raw, 0.7)
    score = model.score(x[~train])
    assert abs(score.mean() - y[~train].mean()) < 0.05 and score[high].mean() > score[low].mean() + 0.4
    order = np.argsort(raw)
    assert (np.diff(score[order]) >= -1e-9).all()
    # The features approximate a Gaussian kernel.
    many = np.random.default_rng(1)
    w, b = many.normal(size=(quality_classifier.FEATURES, 20_000)) / 3, many.uniform(0, 2 * np.pi, 20_000)
    f = np.sqrt(2 / 20_000) * np.cos(x[:5] @ w + b)
    assert np.allclose(f @ f.T, np.exp(-((x[:5, None] - x[None, :5]) ** 2).sum(-1) / 18), atol=0.05)


def test_whole_licences_ask_for_all_their_wording(spark):
    def written(parts, optional):
        out = []
        for p in parts:
            if isinstance(p, license_scans.Word):
                out.append(p.word.upper() + ",")
            elif isinstance(p, license_scans.Any):
                out += ["anyone"] * p.least
            elif optional:
                out += written(p.parts, optional)
        return out

    texts, expected = [], []
    for label, markup in license_scans.TEMPLATES:
        parts = license_scans.parsed(markup)
        for optional in (False, True):
            texts.append("intro " + " ".join(written(parts, optional)) + " end")
            expected.append(label)
        words = written(parts, True)
        if len(words) > 60:
            words[len(words) // 2] = "altered,"
            texts.append(" ".join(words))
            expected.append(None)
    texts += [texts[0]] * 3
    expected += [expected[0]] * 3
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["labels"].split(",") for r in license_scans.scan(frame).collect()}
    whole = [label for label, markup in license_scans.TEMPLATES if len(license_scans.words_of(markup)) > 60]
    for k, label in enumerate(expected):
        assert label is None or label in found[k], (k, label, texts[k][:80])
    altered = [k for k, label in enumerate(expected) if label is None]
    assert altered and len(whole) >= 4 and all("isc" not in found[k] and "mit" not in found[k] and "zlib" not in found[k] for k in altered)
    assert license_scans.scan(frame.limit(0)).count() == 0


def test_very_long_texts_in_every_text_operator(spark):
    from locusloom.llm import minhash_dedup, mixing, sharding

    text = LONG * 60 + "z" * 3_000_000  # 12 MB, the last word longer than a block of the hash
    frame = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, "short", "s")], "doc_id bigint, text string, source string")
    ledger = {r["doc_id"]: r for r in quality_rules.ledger(frame).collect()}
    assert ledger[1]["n_words"] == 40_000 * 60 + 1 and ledger[1]["n_repeat_words"] >= 40_000 * 60 - 1
    found = {r["doc_id"]: r for r in minhash_dedup.dedup(frame).collect()}
    assert found[2]["component_id"] == 1 and found[3]["kept"]
    assert {r["size"] for r in mixing.mix(frame).collect()} == {40_000 * 60 + 1, 1}
    assert sharding.shard(frame).agg(F.max("size")).first()[0] == len(text) + 8
    assert license_scans.scan(frame).where("n_words > 1000000").count() == 2


def test_long_words_have_the_counts_of_the_library():
    """Words that go through the queue of ranks, beside short ones, with overlaps of equal pairs and letters of several bytes."""
    import random
    import time

    from tokenizers import Tokenizer

    rng = random.Random(6)
    tool = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    count = token_counts.Counter(tokenizer_path("byte_bpe_50k.json")).count
    texts = ["".join(rng.choices(rng.choice(["a", "ab", "abc ", "etaoin", "the andor", "=-_", "é日a", "0123"]), k=rng.randint(1, 1500))) for _ in range(150)]
    texts += ["a" * 10_001, "ab" * 7000 + "a", "x" * (token_counts.LONG + 1), "x" * token_counts.LONG, "é日" * 9000]
    assert count(texts) == [len(tool.encode(t, add_special_tokens=False).ids) for t in texts]
    whole = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.time()
    assert count([whole]) == [len(tool.encode(whole, add_special_tokens=False).ids)] and time.time() - began < 60


def test_very_long_texts_in_scores_counts_and_packing(spark):
    from tokenizers import Tokenizer

    from locusloom.llm import packing

    text = LONG * 20 + "z" * 500_000
    frame = spark.createDataFrame([(1, text), (2, "short"), (3, LONG)], "doc_id bigint, text string")
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame).collect()}
    assert counted[1] == len(Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)
    pieces = packing.pack_documents(frame).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert pieces[0] == pieces[1] == len(Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids) + 1
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(frame, labels).collect()}
    assert len(scores) == 3 and all(0 <= x <= 1 for x in scores.values())


def test_token_counts_of_an_empty_table(spark):
    frame = docs(spark, TEXTS)
    assert token_counts.token_counts(frame.limit(0)).count() == 0
    assert token_counts.token_counts(frame.union(frame)).count() == 2 * frame.count()
