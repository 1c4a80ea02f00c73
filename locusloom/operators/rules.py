"""Co-location rules: conditions on the profiles of a gene and of the genes near it, as Column expressions.

Conditions are Python objects (``profile("A") & ~profile("B")``, ``minimum(2, ["A", "B"])``). Each turns into three
columns over a gene's row: whether it is met, the profiles of the gene itself that matched, and the profiles for which genes near
it are ancillary, as they hold what the gene lacks. ``own`` is a map of the gene's profiles to their best scores. Of the
genes near it a condition asks only how many hold a fact (a condition that looks at one gene); those numbers come from ``near_counts``, so
neither pairs nor arrays of neighbours are made on linear records. Ancillary genes are found the other way round: a gene that has the profile counts
the genes near it whose rule is met and wants it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.nearness import GENE, near_counts

#: From a fact (a condition) to the number of genes near that hold it.
Near = Callable[["Condition"], Column]


def _no_names() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Satisfied:
    """What a condition says about a gene; ``wanted`` are the profiles whose holders near it are ancillary."""

    met: Column
    matches: Column
    wanted: Column


class Condition:
    """Base of all conditions."""

    def local(self, own: Column) -> tuple[Column, Column]:
        """Met and matches, looking at one gene only."""
        raise NotImplementedError

    def on(self, own: Column, near: Near) -> Satisfied:
        """What the condition says about a gene and its neighbours."""
        raise NotImplementedError

    def facts(self) -> frozenset[Condition]:
        """What it asks of single genes near."""
        raise NotImplementedError

    def names(self) -> frozenset[str]:
        """Profiles that it may want of genes near."""
        return frozenset()

    def positive(self) -> bool:
        """Whether anything in it asks for presence."""
        return True

    def __and__(self, other: Condition) -> Condition:
        return _All((self, other))

    def __or__(self, other: Condition) -> Condition:
        return _Any((self, other))

    def __invert__(self) -> Condition:
        return _Not(self)


def _joined(parts: Sequence[Condition], own: Column, near: Near, met) -> Satisfied:
    found = [p.on(own, near) for p in parts]
    return Satisfied(met([f.met for f in found]), F.array_distinct(F.concat(*[f.matches for f in found])), F.array_distinct(F.concat(*[f.wanted for f in found])))


def _and(columns: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def _or(columns: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


@dataclass(frozen=True)
class _All(Condition):
    parts: tuple

    def local(self, own):
        found = [p.local(own) for p in self.parts]
        return _and(m for m, _ in found), F.array_distinct(F.concat(*[x for _, x in found]))

    def on(self, own, near):
        return _joined(self.parts, own, near, _and)

    def facts(self):
        return frozenset().union(*[p.facts() for p in self.parts])

    def names(self):
        return frozenset().union(*[p.names() for p in self.parts])

    def positive(self):
        return any(p.positive() for p in self.parts)


@dataclass(frozen=True)
class _Any(_All):
    def local(self, own):
        found = [p.local(own) for p in self.parts]
        return _or(m for m, _ in found), F.array_distinct(F.concat(*[x for _, x in found]))

    def on(self, own, near):
        return _joined(self.parts, own, near, _or)


@dataclass(frozen=True)
class _Not(Condition):
    """Turns only whether it is met; what matched still counts."""

    part: Condition

    def local(self, own):
        met, matches = self.part.local(own)
        return ~met, matches

    def on(self, own, near):
        found = self.part.on(own, near)
        return Satisfied(~found.met, found.matches, found.wanted)

    def facts(self):
        return self.part.facts()

    def names(self):
        return self.part.names()

    def positive(self):
        return False


def _has(own: Column, name: str) -> Column:
    return F.map_contains_key(own, name)


@dataclass(frozen=True)
class _Profile(Condition):
    name: str

    def local(self, own):
        here = _has(own, self.name)
        return here, F.when(here, F.array(F.lit(self.name))).otherwise(_no_names())

    def on(self, own, near):
        here, matches = self.local(own)
        return Satisfied(here | (near(self) > 0), matches, F.when(here, _no_names()).otherwise(F.array(F.lit(self.name))))

    def facts(self):
        return frozenset([self])

    def names(self):
        return frozenset([self.name])


def profile(name: str) -> Condition:
    """The gene, or else a gene near it, has the profile."""
    return _Profile(name)


@dataclass(frozen=True)
class _Score(Condition):
    name: str
    score: float

    def _enough(self, own: Column) -> Column:
        return F.coalesce(F.try_element_at(own, F.lit(self.name)) >= self.score, F.lit(False))

    def local(self, own):
        here = self._enough(own)
        return here, F.when(here, F.array(F.lit(self.name))).otherwise(_no_names())

    def on(self, own, near):
        here, matches = self.local(own)
        return Satisfied(here | (near(self) > 0), matches, _no_names())

    def facts(self):
        return frozenset([self])


def min_score(name: str, score: float) -> Condition:
    """The gene, or a gene near it, has the profile with at least the score."""
    if score < 0:
        raise ValueError("minimum scores cannot be negative")
    return _Score(name, score)


@dataclass(frozen=True)
class _Options(Condition):
    count: int
    options: tuple[str, ...]
    distinct: bool

    def _held(self, own: Column) -> Column:
        return F.array_intersect(F.map_keys(own), F.array(*[F.lit(o) for o in self.options]))

    def local(self, own):
        held = self._held(own)
        return F.size(held) >= self.count, held

    def on(self, own, near):
        held = self._held(own)
        alone = F.size(held) >= self.count
        found = F.lit(0).cast("long")
        for option in self.options:
            n, here = near(_Profile(option)), _has(own, option)
            found = found + (F.when(here | (n > 0), 1).otherwise(0) if self.distinct else n + here.cast("int"))
        return Satisfied(alone | (found >= self.count), held, F.when(~alone & (found >= self.count), F.array(*[F.lit(o) for o in self.options])).otherwise(_no_names()))

    def facts(self):
        return frozenset(_Profile(o) for o in self.options)

    def names(self):
        return frozenset(self.options)


def minimum(count: int, options: Sequence[str]) -> Condition:
    """At least ``count`` different options on the gene and those near it; a gene that has enough alone names no others."""
    return _options(count, options, True)


def repeatable(count: int, options: Sequence[str]) -> Condition:
    """As ``minimum``, but an option counts once per gene that has it."""
    return _options(count, options, False)


def _options(count: int, options: Sequence[str], distinct: bool) -> Condition:
    if count < 1 or len(set(options)) != len(options):
        raise ValueError("a count above 0 and options without repeats are needed")
    return _Options(count, tuple(options), distinct)


@dataclass(frozen=True)
class _Gene(Condition):
    inner: Condition

    def local(self, own):
        return self.inner.local(own)

    def on(self, own, near):
        here, matches = self.inner.local(own)
        return Satisfied(here | (near(self.inner) > 0), F.when(here, matches).otherwise(_no_names()), _no_names())

    def facts(self):
        return frozenset([self.inner])

    def positive(self):
        return self.inner.positive()


def gene(inner: Condition) -> Condition:
    """The inner condition holds inside one single gene: this one or one near it."""
    return _Gene(inner)


@dataclass(frozen=True)
class Rule:
    """A named condition with its distances, and how it stands to other rules."""

    name: str
    condition: Condition
    cutoff: int
    neighbourhood: int
    category: str = "other"
    superiors: tuple[str, ...] = ()
    extender: Condition | None = None

    def __post_init__(self) -> None:
        if not self.condition.positive():
            raise ValueError(f"rule {self.name} asks only for absence")


@dataclass(frozen=True)
class Rules:
    """A set of rules."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def scaled(self, cutoff: float = 1.0, neighbourhood: float = 1.0) -> Rules:
        """The rules with their distances multiplied."""
        if cutoff <= 0 or neighbourhood <= 0:
            raise ValueError("multipliers have to be above 0")
        return Rules(tuple(replace(r, cutoff=int(r.cutoff * cutoff), neighbourhood=int(r.neighbourhood * neighbourhood)) for r in self.rules))

    def only(self, names: Iterable[str] = (), categories: Iterable[str] = ()) -> Rules:
        """The rules of the names and categories; all of them where both are empty."""
        names, categories = set(names), set(categories)
        if unknown := names - {r.name for r in self.rules}:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        return Rules(tuple(r for r in self.rules if (not names or r.name in names) and (not categories or r.category in categories)))

    def rows(self) -> list[tuple]:
        return [(r.name, r.category, r.cutoff, r.neighbourhood) for r in self.rules]


def gene_profiles(features: DataFrame, hits: DataFrame) -> DataFrame:
    """Genes with hits: ``record_id, gene_id, start, end`` and ``own``, their profiles' best scores."""
    best = hits.groupBy("record_id", "gene_id", "profile").agg(F.max("score").alias("score"))
    own = best.groupBy("record_id", "gene_id").agg(F.map_from_entries(F.collect_list(F.struct("profile", "score"))).alias("own"))
    return features.select("record_id", "gene_id", "start", "end").join(own, ["record_id", "gene_id"])


def _counted(genes: DataFrame, asked: Iterable[tuple[Condition, int]], lengths: DataFrame | None) -> tuple[DataFrame, Callable[[int], Near]]:
    """The genes with the numbers of genes near that hold each (fact, cutoff), and how to find such a column."""
    asked = sorted(set(asked), key=repr)
    facts = list(dict.fromkeys(fact for fact, _ in asked))
    flags = {fact: f"_fact_{k}" for k, fact in enumerate(facts)}
    names = {pair: f"_near_{k}" for k, pair in enumerate(asked)}
    if not asked:
        return genes, lambda cutoff: lambda fact: F.col(names[fact, cutoff])
    rows = genes.select(*GENE, "start", "end", *[F.coalesce(fact.local(F.col("own"))[0], F.lit(False)).cast("int").alias(flag) for fact, flag in flags.items()])
    counts = near_counts(rows, {names[fact, cutoff]: (flags[fact], cutoff) for fact, cutoff in asked}, lengths)
    return genes.join(counts, GENE), lambda cutoff: lambda fact: F.col(names[fact, cutoff])


def evaluated(genes: DataFrame, condition: Condition, cutoff: int, lengths: DataFrame | None = None) -> DataFrame:
    """``met``, ``matches`` and ``n_ancillary`` (pairs of a gene near and a profile wanted of it) of one condition for every gene with hits."""
    holders = {_Profile(name) for name in condition.names()}
    counted, near = _counted(genes, [(fact, cutoff) for fact in condition.facts() | holders], lengths)
    found = condition.on(F.col("own"), near(cutoff))
    ancillary = F.lit(0).cast("long")
    for name in sorted(condition.names()):
        ancillary = ancillary + F.when(F.array_contains(found.wanted, name), near(cutoff)(_Profile(name))).otherwise(0)
    return counted.select("record_id", "gene_id", found.met.alias("met"), F.sort_array(found.matches).alias("matches"), ancillary.alias("n_ancillary"))


def evaluate_rules(features: DataFrame, hits: DataFrame, rules: Rules, lengths: DataFrame | None = None) -> DataFrame:
    """``record_id, gene_id, rule, matches``: genes that define a rule's area.

    A rule counts for a gene where it is met and the gene matched something itself; then the ancillary genes count too. With
    ``lengths`` (``record_id, length, circular``) genes over the origin of a circular record are near as well. No rules give no rows.
    """
    genes = cut(gene_profiles(features, hits))
    if not rules.rules:
        return genes.select("record_id", "gene_id", F.lit("").alias("rule"), _no_names().alias("matches")).limit(0)
    counted, near = _counted(genes, [(fact, r.cutoff) for r in rules.rules for fact in r.condition.facts()], lengths)
    found = {r.name: r.condition.on(F.col("own"), near(r.cutoff)) for r in rules.rules}
    met = {name: f.met & (F.size(f.matches) > 0) for name, f in found.items()}
    matched = F.array(*[F.struct(F.lit(name).alias("rule"), F.when(met[name], f.matches).otherwise(_no_names()).alias("matches"), F.when(met[name], f.wanted).otherwise(_no_names()).alias("wanted")) for name, f in found.items()])
    judged = cut(counted.select(*GENE, "start", "end", "own", matched.alias("found")))
    own = judged.select(*GENE, F.inline("found")).select(*GENE, "rule", F.explode("matches").alias("profile"))

    wants = [(k, r.name, name, r.cutoff) for k, r in enumerate(rules.rules) for name in sorted(r.condition.names())]
    if not wants:
        return own.groupBy(*GENE, "rule").agg(F.sort_array(F.collect_set("profile")).alias("matches"))
    flags = {(rule, name): f"_want_{j}" for j, (_, rule, name, _) in enumerate(wants)}
    flagged = judged.select(*GENE, "start", "end", *[F.array_contains(F.col("found")[k]["wanted"], name).cast("int").alias(flags[rule, name]) for k, rule, name, _ in wants])
    asked = near_counts(flagged, {f"_n{flags[rule, name]}": (flags[rule, name], cutoff) for _, rule, name, cutoff in wants}, lengths)
    given = [F.when((F.col(f"_n{flags[rule, name]}") > 0) & _has(F.col("own"), name), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("profile"))) for _, rule, name, _ in wants]
    ancillary = judged.select(*GENE, "own").join(asked, GENE).select(*GENE, F.inline(F.array_compact(F.array(*given))))
    return own.unionByName(ancillary).groupBy(*GENE, "rule").agg(F.sort_array(F.collect_set("profile")).alias("matches"))


def strip_inferior(matches: DataFrame, rules: Rules) -> DataFrame:
    """Matches without those whose gene also satisfies a superior of their rule."""
    pairs = [(r.name, s) for r in rules.rules for s in r.superiors]
    if not pairs:
        return matches
    superior = matches.sparkSession.createDataFrame(pairs, "rule string, superior string")
    beaten = matches.join(superior, "rule").select("record_id", "gene_id", "rule", "superior")
    present = matches.select("record_id", "gene_id", F.col("rule").alias("superior"))
    return matches.join(beaten.join(present, ["record_id", "gene_id", "superior"]), ["record_id", "gene_id", "rule"], "left_anti")
