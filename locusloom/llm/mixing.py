"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source has a target number of words. Its documents, in order of size, have equal expected
copies (target over source size); running totals of those, plus one offset per source, cross an
integer once for every copy that is taken. Because neighbours in that order are alike in size, the
taken words stay within about one document of the target. The order is dealt over range
partitions, so a source with a third of all rows is not one task's work.

Offsets come from the source's name, so reruns agree. Defined results: a null text has size 0;
documents without a source form one source, last in order; a source without words has target 0 and nothing is
taken; repeated rows share their source's copies like other documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.ordering import prefix_totals
from .words import free_name

#: Weights of sources in code-point order, repeating; the share of all words to take; the most that one source gives.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def word_count(text: str = "text") -> Column:
    """Runs of characters that are not white space: places where such a run begins."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to sources (``no_source``, ``source``, ``source_size``).

    Shares follow the weights, no target is above ``most`` times its source's size, and what that leaves
    over is shared again by weight among the others until none is above. One round is one sum.
    """
    placed = prefix_totals(sources, [], ["no_source", "source"], rows="_place")
    placed = cut(placed.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))))
    full = F.lit(float(most)) * F.col("source_size")
    all_words = placed.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        over = F.lit(rate) * F.col("_weight") > full if capped >= 0 else F.lit(False)
        left = placed.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("words"), F.sum(F.when(over, 0).otherwise(F.col("_weight"))).alias("weight"), F.sum(F.when(over, 1).otherwise(0)).alias("n")).first()
        if left["n"] == capped or not left["weight"]:
            break
        capped, rate = left["n"], (float(share) * all_words - float(most) * left["words"]) / left["weight"]
    return placed.withColumn("target", F.least(F.lit(rate) * F.col("_weight"), full)).drop("_place", "_weight")


def offset(source: Column) -> Column:
    """A number in [0, 1) from the source's name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), source)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def sampled(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with ``source``, ``size`` and ``doc_id``."""
    named = sized.withColumns({"no_source": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    sources = named.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    ordered = prefix_totals(named, ["no_source", "source"], ["size", "doc_id"], rows="_before")
    joined = ordered.join(targets(sources, weights, share, most), ["no_source", "source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = offset(F.col("source"))
    copies = F.floor(start + (F.col("_before") + 1) * rate) - F.floor(start + F.col("_before") * rate)
    back = F.when(~F.col("no_source"), F.col("source"))
    return joined.withColumn("copies", copies.cast("long")).withColumn("source", back).drop("no_source", "_before")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words of each row."""
    sized = cut(docs.select("doc_id", "source", word_count().alias("size")))
    return sampled(sized, weights, share, most).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it has copies, with the columns of ``docs``.

    Copies are drawn over narrow rows. Rows that are equal in all columns share their copies.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, copies = free_name(docs, "_key"), free_name(docs, "_copies")
    marked = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("content")))
    narrow = cut(marked.select(F.col(key).alias("key"), "doc_id", "source", word_count().alias("size")))
    drawn = sampled(narrow, weights, share, most).groupBy("key").agg(F.sum("copies").alias(copies), F.count("*").alias("rows")).where(F.col(copies) > 0)
    drawn = cut(drawn.withColumnRenamed("key", key))
    single = marked.join(drawn.where("rows = 1").drop("rows"), key)
    repeated = marked.join(drawn.where("rows > 1").drop("rows"), key).dropDuplicates([key])
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(key)
    return single.unionByName(repeated).select(*columns, number).select(*columns)
