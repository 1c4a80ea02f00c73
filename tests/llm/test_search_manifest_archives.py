"""Ranked search, manifests and archives against plain Python, and their cases of nulls, ties, long texts and empty tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusloom.llm import lexical_search, merkle_manifest, warc_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top=10):
    """The contract, row by row."""
    bags = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            if not bag:
                continue
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms_of(text))
            if score > 0:
                found.append((score, doc_id))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item_id, k + 1, doc_id, score) for k, (score, doc_id) in enumerate(found[:top])]
    return sorted(out, key=repr)


def prose(seed, n=160):
    """Rows with shared words, copies, repeats of a word, nulls, blanks and non-ASCII letters."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Éclair", "naïve", "UP", "x1"]
    rows = [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 90)))) for k in range(n)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)] + [(7, rows[7][1]), (8, "w1 " * 400 + "w59"), (None, rows[3][1]), (None, None), (2000, None), (2001, ""), (2002, " .,;\n"), (2003, "Éclair.up-x1\tÉCLAIR")]
    rng.shuffle(rows)
    return rows


def search_rows(spark, docs, items, **options):
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


ITEMS = [(1, "w1 w2 w59 w59"), (2, "Éclair up nowhere"), (2, "w40 W41 naïve"), (None, "w3 w3 w5"), (3, None), (4, "..."), (5, "absent words only"), (6, " ".join(f"w{k}" for k in range(60)))]


def test_search_equals_every_score(spark):
    docs = prose(1)
    assert search_rows(spark, docs, ITEMS) == ranked(docs, ITEMS)


def test_search_beyond_the_probe_in_blocks_of_items_and_by_shuffle(spark, monkeypatch):
    """The least probe leaves items open whose copies tie; blocks of two items; candidate ids that are not sent to the scan."""
    docs = prose(2)
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    monkeypatch.setattr(lexical_search, "BROADCAST_IDS", 0)
    assert search_rows(spark, docs, ITEMS, top=3, probe=3) == ranked(docs, ITEMS, 3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=60), min_size=1, max_size=12), st.lists(st.integers(0, 14), min_size=1, max_size=6), st.sampled_from([1, 3, 12]))
def test_bounds_are_never_below_the_scores(docs, item, bits):
    """Also with one bit for each key, where most slices are full."""
    hashes = lambda words: lexical_search.mixed(np.array(words, np.uint64) + np.uint64(99))
    if not any(docs):
        return
    builder = lexical_search._Builder()
    with mock.patch.object(lexical_search, "BITS", bits):
        builder.add(list(range(len(docs))), np.concatenate([hashes(d) for d in docs]), np.array([len(d) for d in docs]))
    items = lexical_search.Items.of([(0, hashes(item))])
    n_docs, n_terms = sum(map(bool, docs)), sum(map(len, docs))
    w = lexical_search.Weights(n_docs, n_terms, np.arange(len(items.hashes), dtype=np.int64) + 5)
    matrix = lexical_search._matrix(items, w, [0])
    seen = 0
    for row in builder.full(True):
        if "slices" not in row:
            continue
        bounds = lexical_search._bounds(matrix, items.hashes, w, row["bits"], row["steps"], np.array(row["lengths"]), row["slices"])
        for doc_id, bound in zip(row["doc_ids"], bounds[0], strict=True):
            tf = np.array([(hashes(docs[doc_id]) == h).sum() for h in items.hashes])
            parts = w.of_term * lexical_search.part_of(tf, w.lengths(np.int64(len(docs[doc_id]))))
            assert bound >= (parts[items.terms[0]] * items.counts[0]).sum()
            seen += 1
    assert seen == n_docs


def test_search_of_empty_tables_clashing_columns_and_long_texts(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(docs, items).count() == 0
    assert lexical_search.search(docs, one).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "!")], docs.schema), one).count() == 0
    rng = random.Random(5)
    rows = [(1, " ".join(f"t{rng.randrange(3000)}" for _ in range(150_000))), (2, "x" * 3_000_000), (3, "t1 " * 400_000), (4, "t1 t2 t3")]
    wide = spark.createDataFrame([(*r, 0, 0, 0, 0, 0) for r in rows], "doc_id long, text string, item int, bound int, wanted int, of_doc int, bits int")
    asked = [(1, "t1 t2 t2"), (2, "x" * 3_000_000), (3, rows[0][1])]
    found = lexical_search.search(wide, spark.createDataFrame([(*r, 1, 2) for r in asked], "item_id long, text string, rank int, doc_id int"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(rows, asked)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    """Root, and for each leaf its siblings' digests to the left and the right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for leaf, node in enumerate(at):
            run = runs[node // 8]
            paths[leaf].append(("".join(run[: node % 8]), "".join(run[node % 8 + 1 :])))
            at[leaf] = node // 8
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], paths


def manifest_of(rows):
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree_of([x[2] for x in sorted(langs[lang], key=lambda x: x[:3])]) for lang in names}
    root, tops = tree_of([trees[lang][0] for lang in names]) if names else ("", [])
    out = []
    for lang, top in zip(names, tops, strict=True):
        for (_, _, leaf, row), path in zip(sorted(langs[lang], key=lambda x: x[:3]), trees[lang][1], strict=True):
            doc_id, text = row[0], row[1]
            changed = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            folded = leaf_of(row, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if changed else leaf
            for left, right in path + top:
                folded = h(left + folded + right)
            out.append((doc_id, leaf, trees[lang][0], root, h("".join(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["Some Text", "plain", "ÄÖ Up", "", None, "x" * 50]), rng.choice(["en", "en", "en", "de", None, "", "é", "Z"]), rng.choice(["web", None]), rng.choice([None, 5])) for k in range(n)]
    rows += [(None, "Null Id", "en", None, 1), (5, "again", "en", "web", 2), (9, "Copy", "fr", "web", 4), (9, "Copy", "fr", "web", 4), (77, "Lone", "lone", None, None)]
    rng.shuffle(rows)
    return rows


def manifest_rows(spark, rows, extra=""):
    docs = spark.createDataFrame(rows, DOCS + extra)
    return sorted((tuple(r) for r in merkle_manifest.proofs(merkle_manifest.manifest(docs)).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 8, 64, 300])
def test_manifest_equals_plain_trees(spark, n):
    rows = corpus(n)
    found = manifest_rows(spark, rows)
    assert found == manifest_of(rows)
    assert any(not r[-1] for r in found) or n == 0


def test_manifest_of_several_tiers(spark, monkeypatch):
    """Subtrees of one level, so that languages and their roots take tiers over tiers."""
    monkeypatch.setattr(merkle_manifest, "HEIGHT", 1)
    monkeypatch.setattr(merkle_manifest, "SPAN", 8)
    rows = corpus(200, 2) + [(k, "T", f"l{k}", None, None) for k in range(3000, 3080)]
    assert manifest_rows(spark, rows) == manifest_of(rows)


def test_manifest_of_an_empty_table_clashing_columns_and_long_texts(spark):
    assert manifest_rows(spark, []) == []
    rows = corpus(20, 3) + [(100, "A" * 3_000_000, "en", None, 3_000_000)]
    wide = [(*r, 1, 2, 3) for r in rows]
    assert manifest_rows(spark, wide, ", place int, tree int, leaf int") == manifest_of(rows)


def test_layout_is_a_permutation_with_subtrees_in_one_piece():
    for levels in range(1, 6):
        at = merkle_manifest.addresses(levels)
        assert sorted(np.concatenate(at).tolist()) == list(range(merkle_manifest.tree_size(levels)))
    bottom = merkle_manifest.addresses(4)  # split at half: two levels on top, then 64 parts of nine nodes
    for k in range(64):
        part = [bottom[1][k], *bottom[0][8 * k : 8 * k + 8]]
        assert sorted(part) == list(range(9 + 9 * k, 18 + 9 * k))


def archived(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        revisit = bool(ids) and page_id != max(ids)
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=repr)


PAGES = "page_id long, url string, html string"


def some_pages():
    rng = random.Random(4)
    rows = [(k, f"http://h{k}/ü?q=a b\r\nX: y", rng.choice(["<p>same</p>", "", None, f"<b>é {k}</b>\r\n\r\nWARC/1.1\r\n", "other\n"])) for k in range(120)]
    return [*rows, (5, None, "<p>same</p>"), (119, "u", rows[119][2]), (None, "n", "<p>same</p>"), (None, None, "only without id"), (300, "", "y" * 2_000_000)]


def archive_rows(spark, pages, extra="", **options):
    return sorted((tuple(r) for r in warc_archives.round_trip(spark.createDataFrame(pages, PAGES + extra), **options).collect()), key=repr)


def test_archives_give_back_every_page(spark):
    assert archive_rows(spark, some_pages()) == archived(some_pages())


def test_archives_with_hot_payloads_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc_archives, "HOT", 10)
    monkeypatch.setattr(warc_archives, "RECORDS", 7)
    pages = [(*p, 1, 2) for p in some_pages()]
    assert archive_rows(spark, pages, ", part int, payload int") == archived(some_pages())


def test_archives_of_empty_tables_and_least_payloads(spark):
    assert archive_rows(spark, []) == []
    kinds = {r[0]: r[3] for r in archive_rows(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], min_bytes=3)}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_normalised_files_are_one_member_per_record_at_the_offsets(spark, tmp_path):
    """The stream holds one member, the normalised archive one for each record; both inflate to the same records."""
    pages = spark.createDataFrame(some_pages(), PAGES).coalesce(1)
    warc_archives.write_archives(pages, f"{tmp_path}/streams")
    warc_archives.normalise(spark, f"{tmp_path}/streams", f"{tmp_path}/normal")
    streams = [p.read_bytes() for p in sorted(Path(tmp_path, "streams").glob("part*"))]
    for stream in streams:
        tool = zlib.decompressobj(wbits=31)
        tool.decompress(stream)
        assert tool.eof and not tool.unused_data
    normal = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "normal", "archives").glob("part*"))
    texts = sorted(r for s in streams for r in warc_archives.records(s))
    assert sorted(warc_archives.records(gzip.compress(normal))) == texts and len(texts) == len(some_pages())
    files = {p.name: p.read_bytes() for p in Path(tmp_path, "normal", "archives").glob("part*")}
    rows = spark.read.parquet(f"{tmp_path}/normal/index").collect()
    assert sorted(gzip.decompress(files[r.path][r.offset : r.offset + r.length]) for r in rows) == texts
    assert all(b"\r\nX: y" not in t[: t.index(b"\r\n\r\n")] for t in texts)


def test_normaliser_takes_streams_of_several_members_and_refuses_cut_ones(spark):
    texts = [warc_archives.record(k, "u", b"x" * k, None, False) + b"\r\n\r\n" for k in range(50)]
    whole = b"".join(texts)
    for content in (gzip.compress(whole), b"".join(map(gzip.compress, texts)), gzip.compress(whole[:999]) + gzip.compress(whole[999:])):
        assert list(warc_archives.records(content)) == texts
    assert list(warc_archives.records(b"")) == [] and list(warc_archives.records(warc_archives.EMPTY_MEMBER)) == []
    for broken in (gzip.compress(whole)[:-30], gzip.compress(whole[:-10])):
        with pytest.raises(ValueError, match="the archive ends"):
            list(warc_archives.records(broken))


@pytest.mark.parametrize("few", [0, 200_000])
def test_roles_are_the_same_with_and_without_a_shuffle_of_pages(spark, monkeypatch, few):
    monkeypatch.setattr(warc_archives, "FEW", few)
    monkeypatch.setattr(warc_archives, "HOT", 2)
    rows = [(1, "u", "a"), (2, None, "a"), (None, "w", "a"), (0, "v", "a"), (3, "x", None), (4, "y", ""), (5, "z", "b")]
    found = warc_archives.with_roles(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert sorted((r["page_id"] or 0, r["refers_to"], r["revisit"]) for r in found.collect()) == [(0, 2, True), (0, 2, True), (1, 2, True), (2, None, False), (3, 4, True), (4, None, False), (5, None, False)]
    # Only the plan for many payloads gives pages a key of their own to be shuffled by.
    assert ("sha1" in found._jdf.queryExecution().optimizedPlan().toString()) == (few == 0)
