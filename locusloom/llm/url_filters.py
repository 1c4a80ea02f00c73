"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed entry is ``host/path`` in canonical form (no scheme, host in lower case, no query or
fragment). It covers its host and all subdomains where the URL's path starts with the entry's.
Every URL therefore asks for a few keys: each host suffix with each path prefix as long as some
listed path. Keys first meet the filter; each lies in one block of 256 bits (four longs), so one
look-up reads one row. The few keys that pass are joined with the list itself, which removes false
positives; the longest entry found decides. All of it is DataFrame work.

The list and its filter are broadcast up to ``BROADCAST_ENTRIES`` counted entries (2 bytes a key in the
filter); beyond that the same joins are left to shuffle.

Defined results: null URLs and URLs without ``://`` have empty host and path and no rule; rows are
judged one by one, so repeated rows and ids keep their number; an entry without ``/`` is dropped; an empty table gives an empty result, and
with an empty list every verdict is ``default``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules that a longest match decides, and the hosts that are listed besides.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
LISTED = (
    "cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/",
    "spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/",
    "casino-win.example.com/", "casino-win.example.net/", "casino-win.example.org/",
    "adult-x.example.com/", "adult-x.example.net/", "adult-x.example.org/",
)

#: Entries up to which list and filter are broadcast.
BROADCAST_ENTRIES = 2_000_000
BITS_PER_KEY, PROBES, WORDS = 16, 6, 4


def canonical(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    text = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, shape, 2)


#: Numbered mirrors of each listed host that are listed too (``spam-farm-17.example.com/``).
MIRRORS = 20_000


def listed_entries(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES, listed: Sequence[str] = LISTED, mirrors: int = MIRRORS) -> DataFrame:
    """A list in the form that ``judge`` takes, from literal rules and blocked URLs, and numbered mirrors of these."""
    rows = [(entry, verdict, True) for verdict, entry in rules] + [(entry, "block", False) for entry in listed]
    named = spark.createDataFrame(rows, "entry string, verdict string, is_rule boolean")
    if not listed or not mirrors:
        return named
    hosts = F.explode(F.array(*[F.lit(entry) for entry in listed]))
    numbered = spark.range(1, mirrors + 1).select("id", hosts.alias("entry"))
    mirror = F.concat(F.substring_index("entry", ".", 1), F.lit("-"), F.col("id").cast("string"), F.expr("substr(entry, instr(entry, '.'))"))
    return named.unionByName(numbered.select(mirror.alias("entry"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of a key inside its block, as one mask per word."""
    other = F.xxhash64(F.lit("bits"), key)
    places = [F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(64 * WORDS - 1)) for k in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for place in places:
            here = F.when(F.shiftright(place, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
            mask = mask.bitwiseOR(here)
        masks.append(mask)
    return masks


def bloom(entries: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter as rows ``block, w0..w3``, and its number of blocks."""
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))
    masked = entries.select(_block(F.col("entry"), blocks).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("entry")))])
    return masked.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks


def judge(pages: DataFrame, entries: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` of each row of ``pages``.

    ``entries`` has ``entry``, ``verdict`` and ``is_rule``. ``rule`` is the longest rule that fits; without
    one, the longest listed entry decides, and without that ``default``.
    """
    entries = entries.select("entry", "verdict", "is_rule").where("instr(entry, '/') > 0")
    shape = entries.agg(F.count("*").alias("n"), F.collect_set(F.length("entry") - F.instr("entry", "/") + 1).alias("lengths")).first()  # as many lengths as URLs have
    n, lengths = shape["n"], sorted(shape["lengths"])
    small = (lambda df: F.broadcast(df)) if n <= BROADCAST_ENTRIES else (lambda df: df)

    host, path = canonical("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not n:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "listed": F.lit(None).cast("string")})
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: k <= F.length("path")), lambda k: F.substr("path", F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    # Keys are asked for where the URLs are read; only what passes the filter is shuffled.
    asked = urls.select("host", "path").where("host <> ''").select("host", "path", F.explode(keys).alias("key"))
    blocks, count = bloom(entries, n)
    asked = asked.withColumn("block", _block(F.col("key"), count)).join(small(blocks), "block")
    for k, mask in enumerate(_masks(F.col("key"))):
        asked = asked.where(F.col(f"w{k}").bitwiseAND(mask) == mask)
    hits = asked.select("host", "path", F.col("key").alias("entry")).distinct().join(small(entries), "entry")
    order = F.struct(F.length("entry"), F.col("entry"))
    best = hits.groupBy("host", "path").agg(
        F.max_by("entry", F.when(F.col("is_rule"), order)).alias("rule"),
        F.max_by("verdict", F.when(F.col("is_rule"), order)).alias("rule_verdict"),
        F.max_by("entry", F.when(~F.col("is_rule"), order)).alias("listed"),
        F.max_by("verdict", F.when(~F.col("is_rule"), order)).alias("listed_verdict"),
    )
    verdict = F.coalesce("rule_verdict", "listed_verdict", F.lit(default))
    # URLs without a host are dealt by their ids.
    alone = F.when(F.col("host") == "", F.coalesce("page_id", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return urls.withColumn("alone", alone).join(best.withColumn("alone", F.lit(0).cast("long")), ["host", "path", "alone"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
