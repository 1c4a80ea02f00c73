"""Operators that relate rows: near duplicates, URL filters, mixing, packing, sharding."""

import random
import re
import zlib

import numpy as np
import pytest

from locusloom.llm import embedding_dedup, minhash_dedup, mixing, packing, sharding, url_filters
from locusloom.llm.tokenizer_files import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, node string, size string"


def documents(spark, rows):
    """(id, text, source) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, s, None, "b", "n", "z") for i, t, s in rows], DOCS)


def classes(n, links):
    label = list(range(n))
    while True:
        new = list(label)
        for a, b in links:
            low = min(new[a], new[b])
            new[a] = new[b] = low
        if new == label:
            return label
        label = new


def test_vectors_equal_brute_force(spark):
    random_ = np.random.default_rng(5)
    base = random_.normal(size=(40, 16))
    vectors = [base[k % 40] + random_.normal(size=16) * (0.02 if k < 400 else 3) for k in range(700)]
    vectors += [vectors[0]] * 120 + [vectors[1]] * 3
    rows = [(k, [float(x) for x in v], k % 3 if k < 700 else 0) for k, v in enumerate(vectors)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, [1.0] * 16, None), (2005, [], 1), (2006, [1.0] * 4, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, place string, node int")
    settings = embedding_dedup.Settings(window=8, block=64, tile=50)
    found = {r["vec_id"]: r for r in embedding_dedup.dedup(frame, settings).collect()}
    assert len(found) == len(rows)
    x = np.array([r[1] for r in rows[:823]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:823]])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    expected = classes(823, list(zip(*np.nonzero(linked), strict=True)))
    assert [found[k]["n_links"] for k in range(823)] == linked.sum(axis=1).tolist()
    assert [found[k]["component_id"] for k in range(823)] == expected
    assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k in range(2000, 2007))
    assert embedding_dedup.dedup(frame.limit(0), settings).count() == 0


def test_labels_may_be_of_any_type(spark):
    """Text, and whole numbers so far apart that sums of turns and labels would meet."""
    random_ = np.random.default_rng(6)
    base = random_.normal(size=(6, 16))
    rows = [(k, [float(x) for x in base[k % 6] + random_.normal(size=16) * 0.02], k % 4) for k in range(60)]
    plain = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")
    settings = embedding_dedup.Settings(window=8, block=64, tile=50)
    expected = sorted(map(tuple, embedding_dedup.dedup(plain, settings).collect()))
    assert max(r[1] for r in expected) > 0
    for label in ("concat('l', label)", "label * (1L << 34)", "cast(label as decimal(20, 2))", "date_add(date'2020-01-01', cast(label as int))"):
        assert sorted(map(tuple, embedding_dedup.dedup(plain.selectExpr("vec_id", "embedding", f"{label.replace('1L << 34', '17179869184L')} AS label"), settings).collect())) == expected


def shingled(text):
    words = [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_near_duplicates_equal_brute_force(spark):
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        words = random.choices(vocabulary, k=random.randint(30, 120))
        for _ in range(12):
            words = list(words)  # each drifts a little from the one before, so ends are far apart
            words[random.randrange(len(words))] = random.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [texts[0].upper(), "  " + texts[0].replace(" ", "\n"), "short text", "Short  Text", "short text too", "", None, " \t", "long " * 30000]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, texts[0], "s"), (3, texts[3], "s")]
    frame = documents(spark, rows)
    found = minhash_dedup.dedup(frame).collect()
    assert len(found) == len(rows)
    sets = [shingled(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = classes(len(texts), links)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (expected[r["doc_id"]], len(sets[r["doc_id"]]))
    kept = minhash_dedup.keep(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(k for k in range(len(texts)) if expected[k] == k)
    assert minhash_dedup.dedup(frame.limit(0)).count() == 0


def test_a_drifting_group_loses_no_link(spark):
    """Copies of copies, one changed word each, and copies of one text with many changes: all links, few of the pairs that share buckets."""
    random.seed(4)
    words = random.choices([f"v{k}" for k in range(300)], k=60)
    first, texts = list(words), []
    for _ in range(60):
        words = list(words)
        words[random.randrange(60)] = f"n{random.random()}"
        texts.append(" ".join(words))
    for _ in range(80):
        texts.append(" ".join(w if random.random() > 0.03 else f"m{random.randrange(40)}" for w in first))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    frame = documents(spark, [(k, t, "s") for k, t in enumerate(texts)])
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.dedup(frame).collect()}
    assert [found[k] for k in range(len(texts))] == classes(len(texts), links)
    assert len(set(found.values())) > 1


def test_first_shared_shingles_hold_every_possible_pair(spark):
    random.seed(12)
    base = random.choices([f"w{k}" for k in range(40)], k=50)
    texts = [" ".join(w if random.random() > share else f"x{random.randrange(9)}" for w in base[: random.randint(30, 50)]) for share in (0.01, 0.05, 0.15) for _ in range(25)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    nodes = spark.createDataFrame([(k, k % 50) for k in range(len(texts))], "x bigint, class bigint")
    pairs = {(r["a"], r["b"]) for r in minhash_dedup._first_shared(nodes, documents(spark, [(k, t, "s") for k, t in enumerate(texts)]), minhash_dedup.Settings()).collect()}
    needed = {(a, b) for b in range(len(texts)) for a in range(b) if a % 50 != b % 50 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert needed and needed <= pairs


def judged(url):
    found = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in found[1]), found[2]) if found else ("", "")
    fits = lambda entry: (host == entry.split("/")[0] or host.endswith("." + entry.split("/")[0])) and path.startswith(entry[entry.index("/") :])
    rules = [(len(e), e, v) for v, e in url_filters.RULES if host and fits(e)]
    if rules:
        return host, path, max(rules)[1], max(rules)[2]
    return host, path, None, "block" if host and any(fits(e) for e in url_filters.LISTED) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/7?x", "https://a.b.example.com/en/70#y", "x://example.com/en", "http://example.net/de/8", "http://example.net/de/9", "http://org/es/", "http://notorg/es/1",
    "ftp://www.cheap-pills.example.org/fr/1", "http://cheap-pills.example.org.evil.com/fr/1", "http://spam-farm.example.com/en/2", "a://b://com/en/1", "http://com/en/", "http://com/EN/", "http://example.com" + "/x" * 3000,
]


@pytest.mark.parametrize("broadcast", [url_filters.BROADCAST_ENTRIES, 0])
def test_url_verdicts_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filters, "BROADCAST_ENTRIES", broadcast)
    rows = [(k % 7, u, "h", "p") for k, u in enumerate(URLS * 2)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string, entry string")
    found = url_filters.judge(frame, url_filters.listed_entries(spark)).collect()
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found)
    assert got == sorted((i, h, p, r or "", v) for i, u, _, _ in rows for h, p, r, v in [judged(u)])
    assert url_filters.judge(frame.limit(0), url_filters.listed_entries(spark)).count() == 0


def test_bloom_filter_has_no_false_negative_and_few_positives(spark):
    entries = spark.range(2000).selectExpr("concat('h', id, '/') as entry")
    filter_, blocks = url_filters.bloom(entries, 2000)
    asked = spark.range(20000).selectExpr("concat('h', id, '/') as key")
    probed = asked.withColumn("block", url_filters._block(asked["key"], blocks)).join(filter_, "block")
    for k, mask in enumerate(url_filters._masks(probed["key"])):
        probed = probed.where(probed[f"w{k}"].bitwiseAND(mask) == mask)
    passed = {int(r["key"][1:-1]) for r in probed.collect()}
    assert set(range(2000)) <= passed and len(passed) < 2000 + 18000 * 0.03


def test_mix_reaches_targets_and_repeats(spark):
    random.seed(1)
    rows = [(k, " ".join(["w"] * random.randint(0, 60)), random.choice(["a", "b", "c", "d", None])) for k in range(900)] + [(7, "w w", "a"), (None, None, "b"), (None, "w", None)]
    frame = documents(spark, rows)
    found = mixing.mix(frame).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == sorted((i or -1, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in ("a", "b", "c", "d", None)}
    weights, targets, free = dict(zip(sizes, (3, 1, 2, 3, 1), strict=True)), {}, set(sizes)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(targets.values())
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]]
        if not over:
            targets |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
            break
        targets |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    for source, target in targets.items():
        own = [r for r in found if r["source"] == source]
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sizes[source] and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 65
    assert sorted(map(str, mixing.mix(frame.repartition(5)).collect())) == sorted(map(str, found))
    emitted = mixing.emit(frame)
    assert emitted.columns == frame.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in emitted.collect()) == sum(r["taken"] for r in found)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    random.seed(2)
    texts = [None, "", "  ", "one", "it's Ünïcode DON'T, <|endoftext|> ok. \x1c日本", "word, " * 5000] + [" ".join(random.choices(["alpha", "Beta,", "gamma9", "δέλτα", "e!"], k=random.randint(1, 900))) for _ in range(120)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "no id", "s"), (3, "one", "s")]
    pieces = packing.pack_documents(documents(spark, rows)).collect()
    ids = {k: [*tool.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    for doc, expected in ids.items():
        own = sorted((p for p in pieces if p["doc_id"] == doc and p["doc_tokens"] == len(expected)), key=lambda p: p["start"])
        own = own[::2] if doc == 3 else own
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and sum(p["length"] for p in own) == len(expected)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(np.array(expected[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total += at if at & (at - 1) == 0 else 2048
    used = sum(p["length"] for p in pieces)
    assert total - used <= 4 * 2048  # at most one short sequence per partition
    assert packing.pack_documents(documents(spark, rows).limit(0)).count() == 0


def test_examples_keep_all_three_limits(spark):
    random.seed(6)
    rows = [(k, random.randint(0, 120), random.randint(0, 60)) for k in range(500)] + [(500, 101, 0), (501, 10, 70), (502, None, None)]
    limits = packing.Limits(tokens=100, segments=4, loss=50, waiting=64)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "example_id bigint, n_tokens bigint, n_loss bigint, offset string")
    found = packing.pack_examples(frame, limits).collect()
    assert sorted(r["example_id"] for r in found) == list(range(503))
    by = {}
    for r in found:
        if r["n_tokens"] > 100 or r["n_loss"] > 50:
            assert r["sequence_id"] is None
        else:
            by.setdefault(r["sequence_id"], []).append(r)
    assert all(len(x) <= 4 and sum(r["n_tokens"] for r in x) <= 100 and sum(r["n_loss"] for r in x) <= 50 for x in by.values())
    assert len(by) < 0.75 * sum(len(x) for x in by.values())


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_even_and_slots_gapless(spark, law):
    rows = [(k, f"text {k} " + "x" * (k % 90), "s") for k in range(1500)] + [(2000 + k, "same text", "s") for k in range(800)] + [(None, None, None), (None, "", None)]
    found = sharding.shard(documents(spark, rows), law=law).collect()
    assert len(found) == len(rows)
    loads, slots = {}, {}
    for r in found:
        loads[r["shard"]] = loads.get(r["shard"], 0) + (1 if law == "rows" else r["size"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(24))
    assert max(loads.values()) - min(loads.values()) <= (1 if law == "rows" else 2 * 110)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(by_id[i]["size"] == len(t.encode()) + 8 and by_id[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t, _ in rows if i is not None)
    assert sharding.shard(documents(spark, rows).limit(0), law=law).count() == 0


def test_one_more_shard_moves_few_rows(spark):
    rows = [(k, f"text {k}", "s") for k in range(4000)]
    frame = documents(spark, rows)
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(frame, n, nodes=128).collect()} for n in (24, 25))
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 0.12 * len(rows)  # dealing anew would move 96 %


def test_shards_equal_a_walk_round_the_ring(spark):
    """Row by row: each row of an arc fills its shard, what is over goes clockwise to the next arc whose shard has room."""
    random.seed(14)
    rows = [(k, random.choice(["same text", f"text {k}", f"other {k % 50}", None]), "s") for k in range(700)]
    placed = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(documents(spark, rows), 5, 8).collect()}
    ring = sharding.arcs(5, 8)
    hashed = spark.createDataFrame([(k, t or "") for k, t, _ in rows], "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) AS position", "octet_length(text) + 8 AS size", "crc32(cast(text AS binary)) AS crc").collect()
    own = {k: [] for k in range(len(ring))}
    for r in hashed:
        cell = (r["position"] % (1 << 64)) >> 50
        arc = next((k for k, (end, _) in enumerate(ring) if end >= cell), 0)
        own[arc].append((r["position"], r["doc_id"]))
    room = {s: 140 for s in range(5)}
    slots, expected, rest = dict.fromkeys(range(5), 0), {}, []
    for arc, some in own.items():
        for _, doc in sorted(some):
            shard = ring[arc][1]
            if room[shard]:
                room[shard] -= 1
                expected[doc] = (shard, slots[shard])
                slots[shard] += 1
            else:
                rest.append((arc, doc))
    for arc, doc in rest:
        step = next(k % len(ring) for k in range(arc + 1, arc + 1 + len(ring)) if room[ring[k % len(ring)][1]])
        shard = ring[step][1]
        room[shard] -= 1
        expected[doc] = (shard, slots[shard])
        slots[shard] += 1
    assert placed == expected


def test_examples_are_packed_about_as_tightly_as_first_fit_by_size(spark):
    rng = random.Random(12)
    examples = [(k, t, int(t * rng.uniform(0, 1))) for k in range(1500) for t in [rng.choice([rng.randint(1, 60), rng.randint(60, 700), rng.randint(700, 2048)])]]
    limits = packing.Limits(tokens=2048, segments=6, loss=1100)
    fitting = [e for e in examples if e[2] <= 1100]
    found = packing.pack_examples(spark.createDataFrame(examples, "example_id long, n_tokens long, n_loss long").coalesce(1), limits).collect()
    bins = {}
    for r in found:
        if r["sequence_id"] is not None:
            bins.setdefault(r["sequence_id"], []).append(r)
    assert sum(map(len, bins.values())) == len(fitting) and len(found) == len(examples)
    assert all(sum(r["n_tokens"] for r in b) <= 2048 and sum(r["n_loss"] for r in b) <= 1100 and len(b) <= 6 for b in bins.values())
    plain = []
    for _, tokens, loss in sorted(fitting, key=lambda e: -max(e[1] / 2048, e[2] / 1100)):
        for b in plain:
            if b[0] + tokens <= 2048 and b[1] + loss <= 1100 and b[2] < 6:
                b[0], b[1], b[2] = b[0] + tokens, b[1] + loss, b[2] + 1
                break
        else:
            plain.append([tokens, loss, 1])
    assert len(bins) <= 1.1 * len(plain)


def test_every_letter_before_a_mark_has_the_ids_of_the_library():
    """Some letters become a letter and a combining mark, which joins the mark behind it."""
    tool = packing.Ids(tokenizer_path("word_bpe_49k.json"))
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    marks = sorted(packing.MARKS)
    texts = [f"{'AL' * (k % 2)}{c}{marks[k % len(marks)]}" for k, c in enumerate(letters)]
    texts += [f"{word}{c}{mark}" for c in "\u0130\u0958\u095b\u095f\u09dc\ufb1d\ufb2a" for word in ("", "al", "\u0130") for mark in marks]
    for k in range(0, len(texts), 5000):
        some = texts[k : k + 5000]
        expected = [np.array(e.ids, "<u4").tobytes() for e in tool.tool.encode_batch_fast(some, add_special_tokens=False)]
        assert tool.of([t.encode() for t in some]) == expected


def test_conversations_are_packed_whole_under_binding_limits(spark):
    random.seed(15)
    turns = [(c, t, random.choice(["user", "assistant"]), " ".join(["word"] * random.randint(0, 90))) for c in range(150) for t in range(random.randint(1, 5))] + [(None, 0, None, None), (3, 9, "assistant", None)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    limits = packing.Limits(tokens=400, segments=3, loss=150, waiting=32)
    found = packing.pack_conversations(frame, limits).collect()
    assert sorted(-1 if r["example_id"] is None else r["example_id"] for r in found) == sorted({-1 if c is None else c for c, *_ in turns})
    by = {}
    for r in found:
        if r["sequence_id"] is not None:
            by.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["n_tokens"] for r in x) <= 400 and sum(r["n_loss"] for r in x) <= 150 and len(x) <= 3 for x in by.values())
    assert any(len(x) == 3 for x in by.values()) and any(sum(r["n_loss"] for r in x) > 120 for x in by.values())
    assert packing.pack_conversations(frame.limit(0), limits).count() == 0


def test_tiny_texts_close_no_short_sequence(spark):
    frame = documents(spark, [(k, "a b", "s") for k in range(6000)]).coalesce(1)
    sequences = {}
    for p in packing.pack_documents(frame, packing.Limits(segments=2048)).collect():
        sequences[p["sequence_id"]] = sequences.get(p["sequence_id"], 0) + p["length"]
    assert sum(n < 2048 for n in sequences.values()) <= 1


NAMES = ("_measured", "_good", "_content", "_id", "_number", "_copy", "_key", "_copies", "_row", "kept", "bands", "digest")


def test_helper_names_never_touch_the_callers_columns(spark):
    from locusloom.llm import quality_classifier, quality_rules

    text = "one quiet line says that the river runs past the old town and on to the sea where ships wait for the tide %d times"
    rows = [(k, text % k if k % 9 else None, "en", "s", *[f"{n}{k}" for n in NAMES]) for k in range(40)] + [(None, text % 99, None, None, *NAMES)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    given = {str(tuple(r)) for r in frame.collect()}
    for kept in (quality_rules.keep(frame), quality_classifier.keep(frame, labels), minhash_dedup.keep(frame), mixing.emit(frame)):
        assert kept.columns == frame.columns
        found = kept.collect()
        assert found and all(str(tuple(r)) in given for r in found)


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "a b c", "s")] * 6 + [(2, "d e", "s"), (None, "f g", "t"), (None, "f g", "t")]
    frame = documents(spark, rows)
    assert mixing.emit(frame).count() == sum(r["copies"] for r in mixing.mix(frame).collect()) > 0
    assert mixing.emit(frame.limit(0)).count() == 0


def test_spread_places_everything_within_capacity():
    ranges = sharding.spread([10, 0, 7, 3], [0, 1, 0, 1], [10, 10])
    placed = [(hi - lo, shard) for some in ranges for lo, hi, shard, _ in some]
    assert sum(n for n, _ in placed) == 20 and all(sum(n for n, s in placed if s == x) == 10 for x in (0, 1))
    with pytest.raises(ValueError):
        sharding.spread([5], [0], [3])
