"""The registered queries of this subpackage: each operator over its whole table, as its contract asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, lexical_search, license_scans, merkle_manifest, minhash_dedup, mixing, packing, quality_classifier, quality_rules, sharding, token_counts, url_filters, warc_archives


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger and current policy over all documents."""
    book = quality_rules.decided(quality_rules.ledger(_table(spark, folder, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of all documents, learned from the labels that are not held out."""
    return quality_classifier.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.token_counts(_table(spark, folder, "documents"))


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.dedup(_table(spark, folder, "embeddings"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on all page URLs."""
    judged = url_filters.judge(_table(spark, folder, "pages"), url_filters.listed_entries(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash_dedup.dedup(_table(spark, folder, "documents"))


def op8_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return license_scans.scan(_table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' tokens in sequences of 2048."""
    packed = packing.pack_documents(_table(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def conversation_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, uncut, under limits on tokens, segments and loss-bearing tokens."""
    return packing.pack_conversations(_table(spark, folder, "conversations"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of equal row counts."""
    return sharding.shard(_table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item, against all documents."""
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents, with a proof for each and what it folds up to."""
    return merkle_manifest.proofs(merkle_manifest.manifest(_table(spark, folder, "documents")))


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives, normalised, and read back by offset."""
    return warc_archives.round_trip(_table(spark, folder, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_quality_classifier, op3_token_counts, op4_embedding_dedup, op5_url_filters, op6_mixing, op7_minhash_dedup, op8_license_scans, op9_packing, op10_sharding, op11_lexical_search, op12_merkle_manifest, op13_warc, conversation_packing)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win JOIN rep USING (rid, g)) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_caps,
             len(regexp_extract_all(t, '!')) AS n_exclaim, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same_as_last
      FROM d LEFT JOIN covered USING (rid)),
b AS (SELECT *, {" + ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in quality_rules.RULES)} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {quality_rules.mask(quality_rules.CURRENT.base)}) <> 0 AS base_failed,
       (bits & {quality_rules.mask((*quality_rules.CURRENT.base, *quality_rules.CURRENT.rejects))}) = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b"""

_OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""

_MIRRORS = f"SELECT split_part(h, '.', 1) || '-' || i || substr(h, instr(h, '.')), 'block', false FROM (SELECT unnest([{', '.join(repr(entry) for entry in url_filters.LISTED)}]) AS h), range(1, {url_filters.MIRRORS + 1}) m(i)"
_VALUES = ", ".join(f"('{entry}', '{verdict}', true)" for verdict, entry in url_filters.RULES) + ", " + ", ".join(f"('{entry}', 'block', false)" for entry in url_filters.LISTED)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_OP5 = f"""
WITH e AS (SELECT entry, verdict, is_rule, split_part(entry, '/', 1) AS h, substr(entry, instr(entry, '/')) AS p FROM (SELECT * FROM (VALUES {_VALUES}) t(entry, verdict, is_rule) UNION ALL {_MIRRORS})),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
k AS (SELECT rid, path, array_to_string(labels[i:], '.') AS h FROM (SELECT rid, path, labels, unnest(range(1, len(labels) + 1)) AS i FROM (SELECT rid, path, string_split(host, '.') AS labels FROM u))),
m AS (SELECT rid, arg_max(entry, length(entry)) FILTER (is_rule) AS rule, arg_max(verdict, length(entry)) FILTER (is_rule) AS rv, arg_max(verdict, length(entry)) FILTER (NOT is_rule) AS lv
      FROM k JOIN e USING (h) WHERE starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rv, lv, 'allow') AS verdict FROM u LEFT JOIN m USING (rid)"""

_OP6 = f"""
WITH d AS (SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS source, len({_WORDS}) AS size FROM documents),
s AS (SELECT ns, source, CAST(sum(size) AS BIGINT) AS source_size, CAST(row_number() OVER (ORDER BY ns, source) AS INT) AS k FROM d GROUP BY ns, source),
w AS (SELECT *, CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights,
             coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_size,
             coalesce(sum(weight) OVER (ORDER BY 2.0 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_weight FROM w),
l AS (SELECT arg_min(lam, ratio) AS lam FROM (SELECT CAST(1.5 * CAST(everything AS DOUBLE) - 2.0 * CAST(capped_size AS DOUBLE) AS DOUBLE) / CAST(weights - capped_weight AS DOUBLE) AS lam, 2.0 * source_size / weight AS ratio FROM r) WHERE lam <= ratio),
t AS (SELECT w.*, least(lam * weight, CAST(2.0 * source_size AS DOUBLE)) AS target FROM w, l),
o AS (SELECT d.*, source_size, target, CAST(row_number() OVER (PARTITION BY d.ns, d.source ORDER BY size, doc_id) - 1 AS BIGINT) AS k,
             CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate,
             CAST(CAST('0x' || substr(md5('mix:' || d.source), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS start
      FROM d JOIN t ON d.ns = t.ns AND d.source = t.source)
SELECT doc_id, size, source_size, target, CAST(floor(start + (k + 1) * rate) - floor(start + k * rate) AS BIGINT) * size AS taken FROM o"""

_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM g),
x AS (SELECT doc_id, unnest(sh) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM either UNION SELECT r.a, l.b FROM reach r JOIN either l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept FROM n LEFT JOIN low ON a = doc_id"""


def _op8() -> str:
    phrases = [(license_scans.words_of(p), label) for p, label in license_scans.PHRASES]
    places = [f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'''w[i + {k}] = '{x}' ''' for k, x in enumerate(words))})" for words, _ in phrases]
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))
    more = ", ".join(f"CASE WHEN regexp_matches(s, '{license_scans.pattern(license_scans.parsed(markup))} ') THEN '{label}' END" for label, markup in license_scans.TEMPLATES)
    joined = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    every = "list_concat(" * (len(places) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(places)))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
q AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, {", ".join(f"{x} AS p{k}" for k, x in enumerate(places))} FROM d),
r AS (SELECT doc_id, len(w) AS n_words, {every} AS places, {joined.format(base)} AS base_labels, {joined.format(base + ", " + more)} AS labels FROM q)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, base_labels, labels,
       CASE WHEN labels = '' THEN CAST(0 AS DOUBLE) WHEN labels = base_labels THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score FROM r"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS n_terms FROM d),
q AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark),
t AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
k AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM df, c),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item, item_id, rid, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM t JOIN tf USING (term) JOIN k USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""


def _op12(levels: int = 9, above: int = 4) -> str:
    """Levels one by one: ``levels`` over rows and ``above`` over languages; a tree that has one node left stays as it is."""
    def field(c): return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    def leaf(text): return f"sha256(concat({field('doc_id')}, {field('source')}, {field('lang')}, {field('n_chars')}, {field(text)}))"
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
    def tree(name, source, key, n):
        part = [f"{name}0 AS (SELECT {key} AS tree, p, h, count(*) OVER (PARTITION BY {key}) AS c FROM {source})"]
        for k in range(n):
            run = "PARTITION BY tree, p // 8 ORDER BY p ROWS BETWEEN"
            part.append(f"{name}s{k} AS (SELECT *, coalesce(CASE WHEN c > 1 THEN string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING) END, '') AS l, coalesce(CASE WHEN c > 1 THEN string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING) END, '') AS r FROM {name}{k})")
            part.append(f"{name}{k + 1} AS (SELECT tree, p, h, count(*) OVER (PARTITION BY tree) AS c FROM (SELECT tree, p // 8 AS p, CASE WHEN min(c) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h FROM {name}{k} GROUP BY tree, p // 8))")
        return part
    ctes = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 3 = 0 THEN {leaf('folded')} END AS other FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents))",
        "e AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
        *tree("a", "e", "t", levels),
        f"u AS (SELECT tree AS t, h, row_number() OVER (ORDER BY tree) - 1 AS p FROM a{levels})",
        *tree("b", "u", "1", above),
    ]
    last = "e"
    for k in range(levels):
        fold = f"CASE WHEN s.c > 1 THEN sha256(s.l || {'coalesce(x.other, x.leaf)' if not k else 'x.f'} || s.r) ELSE {'coalesce(x.other, x.leaf)' if not k else 'x.f'} END"
        ctes.append(f"f{k} AS (SELECT x.* EXCLUDE ({'h' if not k else 'f, g'}), {fold} AS f, {'' if not k else 'x.g || '}s.l || s.r AS g FROM {last} x JOIN as{k} s ON s.tree = x.t AND s.p = x.p // {8 ** k})")
        last = f"f{k}"
    ctes.append(f"g AS (SELECT x.* EXCLUDE (p), u.p AS p, u.h AS subroot FROM {last} x JOIN u USING (t))")
    last = "g"
    for k in range(above):
        ctes.append(f"g{k} AS (SELECT x.* EXCLUDE (f, g), CASE WHEN s.c > 1 THEN sha256(s.l || x.f || s.r) ELSE x.f END AS f, x.g || s.l || s.r AS g FROM {last} x JOIN bs{k} s ON s.p = x.p // {8 ** k})")
        last = f"g{k}"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(g) AS proof_sha256, f AS folded_root, f = h AS verified FROM {last}, b{above}"


_OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
g AS (SELECT x, max(page_id) AS largest FROM p GROUP BY x),
b AS (SELECT page_id, x, largest, CAST(CAST(unhex(sha1(x)) AS BIT) AS VARCHAR) AS bits, largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS revisit FROM p JOIN g USING (x))
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, i + k + 1, 1) AS INT) << (4 - k))) AS INT), 1)), '') AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN largest END AS refers_to FROM b"""


#: Oracles. The others have none: 2 is fitted, 3 and 9 need a tokenizer, 10 hashes onto a ring; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op4_embedding_dedup": _OP4, "op5_url_filters": _OP5, "op6_mixing": _OP6, "op7_minhash_dedup": _OP7, "op8_license_scans": _op8(), "op11_lexical_search": _OP11, "op12_merkle_manifest": _op12(), "op13_warc": _OP13}
