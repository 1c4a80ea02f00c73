"""Modules of assembly-line genes: segmentation, properties, modules over two genes, monomers, gene order, structures.

Domains have ``record_id, gene_id, start, end, profile, subtype, ord``. What may stand in a module is a small
automaton over kinds of domains. It is compiled once into a table (state by kind), so that
cutting a gene's domains into modules is one fold with look-ups, and what a module is like follows from
the state that it ends in. A gene's domains are one array, as they are few however long the record is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut
from ..plans.ordering import prefix_totals

GENE = ["record_id", "gene_id"]

#: Names of domains by class, and what marks some of them out.
DOMAIN_CLASSES = {
    "A": ("AMP-binding", "A-OX"),
    "AT": ("PKS_AT",),
    "C": ("Cglyc", "Condensation_DCL", "Condensation_LCL", "Condensation_sid", "Condensation_Starter", "Condensation_Dual", "Heterocyclization"),
    "S": ("CAL_domain", "SAT"),
    "E": ("Abhydrolase_1", "cAT", "Epimerization", "Thioesterase", "TD"),
    "KS": ("PKS_KS",),
    "+": ("PKS_DH", "PKS_DH2", "PKS_DHt", "PKS_KR", "PKS_ER", "cMT", "nMT", "oMT", "Beta_elim_lyase", "LPG_synthase_C", "TauD"),
    "CP": ("ACP", "ACP_beta", "PCP", "PKS_PP", "PP-binding"),
    "!": ("Trans-AT_docking", "TIGR01720"),
    ".": (
        "ACPS", "Aminotran_1_2", "Aminotran_3", "Aminotran_4", "Aminotran_5", "B", "ECH", "F", "FkbH", "GNAT", "Hal", "IBH_Asp", "Interface", "NAD_binding_4",
        "Polyketide_cyc", "Polyketide_cyc2", "PS", "PT", "TIGR02353", "X",
    ),
    "ignore": ("NRPS-COM_Cterm", "NRPS-COM_Nterm", "PKS_Docking_Cterm", "PKS_Docking_Nterm"),
}
FUSED_STARTERS = (*DOMAIN_CLASSES["A"], *DOMAIN_CLASSES["AT"], "Interface")
TERMINATORS = ("Thioesterase", "TD")
#: Fixed value: two domains before which a second carrier may stand.
AFTER_SECOND_CARRIER = ("LPG_synthase_C", "Beta_elim_lyase")

#: Kinds of domains that the automaton tells apart. ``*``: the two domains above follow; ``p``: counts for polyketides.
KINDS = ("ignored", "C", "C first", "KS", "KS trans", "KS iterative", "SAT", "A", "AT", "CAL", "KR", "mod", "mod p", "CP", "CP p", "CP*", "CP p*", "end", "last", "docking", "special", "other")
#: Carriers; with the two domains behind them they are the kind two places on.
_CARRIERS = (KINDS.index("CP"), KINDS.index("CP p"))
_POLYKETIDE, _PEPTIDE = {"KS", "KS trans", "KS iterative", "AT"}, {"C", "C first", "A"}
_OPENERS, _LOADERS = {"C", "C first", "KS", "KS trans", "KS iterative", "SAT"}, {"A", "AT", "CAL"}


class State(NamedTuple):
    """What an unfinished module holds: its first starter and its loader, and whether other parts have come."""

    starter: str = ""
    loader: str = ""
    polyketide: bool = False
    modified: bool = False
    carrier: bool = False
    end: str = ""
    docking: bool = False
    granted: int = 0
    begun: bool = False

    @property
    def trans_at(self) -> bool:
        return bool(self.polyketide and self.starter and not self.loader and (self.starter == "KS trans" or self.docking))

    @property
    def complete_later(self) -> bool:
        """Complete where another module stands before it."""
        return bool(self.carrier and (self.trans_at or (self.loader and self.starter not in _LOADERS)))

    @property
    def complete_first(self) -> bool:
        return bool(self.carrier and (self.trans_at or self.loader))

    def takes(self, kind: str) -> bool:
        """Whether the domain can follow in this module."""
        if not self.begun:
            return True
        if kind in _OPENERS:
            return False
        if self.granted or kind in ("docking", "special"):
            return True
        if self.end:
            return False
        if kind in _LOADERS:
            clash = {self.starter, kind} & _POLYKETIDE and {self.starter, kind} & _PEPTIDE
            return not (self.loader or self.modified or self.carrier or clash)
        if kind in ("KR", "mod", "mod p"):
            return not self.carrier or (kind == "KR" and self.trans_at)
        return not (kind in ("CP", "CP p") and self.carrier)

    def with_one(self, kind: str) -> State:
        """The state after the domain."""
        new = self._replace(begun=True, granted=max(0, self.granted - 1), polyketide=self.polyketide or kind in _POLYKETIDE or kind == "KR" or " p" in kind)
        if kind in _OPENERS | _LOADERS and not self.starter:
            return new._replace(starter=kind, loader=kind if kind in _LOADERS else "")
        if kind in _LOADERS:
            return new._replace(loader=kind)
        if kind in ("KR", "mod", "mod p"):
            return new._replace(modified=True)
        if kind.startswith("CP"):
            return new._replace(carrier=True, granted=2 if self.carrier and kind.endswith("*") else new.granted)
        if kind in ("end", "last"):
            return new._replace(end=kind)
        return new._replace(docking=new.docking or kind == "docking")


@lru_cache(maxsize=1)
def _compiled() -> tuple[list[State], list[int]]:
    """All states that can be reached, and for each state and kind twice the next state, plus 1 where a new module opens."""
    states, table, at = [State()], [], 0
    place = {State(): 0}
    while at < len(states):
        for kind in KINDS:
            here = states[at]
            opens = kind != "ignored" and not here.takes(kind)
            after = here if kind == "ignored" else (State() if opens else here).with_one(kind)
            if after not in place:
                place[after] = len(states)
                states.append(after)
            table.append(2 * place[after] + opens)
        at += 1
    return states, table


def _holds(what, state: Column) -> Column:
    """Whether something holds in a state; the answers of all states are one literal."""
    return F.substr(F.lit("".join("01"[bool(what(s))] for s in _compiled()[0])), state + 1, F.lit(1)) == "1"


def kind_of(profile: Column, subtype: Column, following: Column, second: Column) -> Column:
    """The kind (place in ``KINDS``) of a domain; ``following`` and ``second`` are the profiles after it. An unknown profile is an error."""
    code = {k: F.lit(i) for i, k in enumerate(KINDS)}
    starred = F.coalesce((following == AFTER_SECOND_CARRIER[0]) & (second == AFTER_SECOND_CARRIER[1]), F.lit(False))
    within = lambda name: profile.isin(*DOMAIN_CLASSES[name])
    return (
        F.when(within("ignore"), code["ignored"])
        .when(profile == "Condensation_Starter", code["C first"]).when(within("C"), code["C"])
        .when(within("KS"), F.when(subtype == "Trans-AT-KS", code["KS trans"]).when(subtype == "Iterative-KS", code["KS iterative"]).otherwise(code["KS"]))
        .when(profile == "SAT", code["SAT"]).when(profile == "CAL_domain", code["CAL"]).when(within("A"), code["A"]).when(within("AT"), code["AT"])
        .when(profile == "PKS_KR", code["KR"]).when(within("+"), F.when(profile.startswith("PKS"), code["mod p"]).otherwise(code["mod"]))
        .when(within("CP"), F.when(profile.startswith("PKS"), F.when(starred, code["CP p*"]).otherwise(code["CP p"])).when(starred, code["CP*"]).otherwise(code["CP"]))
        .when(profile.isin(*TERMINATORS), code["last"]).when(within("E"), code["end"])
        .when(profile == "Trans-AT_docking", code["docking"]).when(within("!"), code["special"]).when(within("."), code["other"])
        .otherwise(F.raise_error(F.concat(F.lit("could not classify domain: "), F.coalesce(profile, F.lit("null")))).cast("int"))
    )


def _moves() -> Column:
    return F.split(F.lit(" ".join(map(str, _compiled()[1]))), " ").cast("array<int>")


def _from(state: Column, kinds: Column) -> Column:
    """The state that kinds lead to from another one."""
    table = _moves()
    return F.aggregate(kinds, state, lambda s, kind: F.shiftright(F.element_at(table, s * len(KINDS) + kind + 1), 1))


def walked(kinds: Column) -> Column:
    """A struct of an array of kinds: ``state`` at the end, ``opened`` modules after the first, ``marks``, the module of each domain."""
    table = _moves()

    def step(state: Column, kind: Column) -> Column:
        move = F.element_at(table, state["state"] * len(KINDS) + kind + 1)
        opened = (state["opened"] + move % 2).cast("int")
        return F.struct(F.shiftright(move, 1).alias("state"), opened.alias("opened"), F.concat(state["marks"], F.array(opened)).alias("marks"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("opened"), F.array().cast("array<int>").alias("marks"))
    return F.aggregate(kinds, start, step)


def segment_modules(domains: DataFrame) -> DataFrame:
    """Domains with ``kind`` and ``module`` (from 0 in each gene, in order of start, end, ``ord``); those outside modules by their nature go."""
    row = F.struct("start", "end", "ord", "profile", "subtype")
    genes = domains.groupBy(*GENE).agg(F.sort_array(F.collect_list(row)).alias("d"))
    profile = lambda k: F.get("d", k)["profile"]
    kinds = genes.withColumn("kinds", F.transform("d", lambda d, k: kind_of(d["profile"], d["subtype"], profile(k + 1), profile(k + 2))))
    marked = kinds.withColumn("marks", walked(F.col("kinds"))["marks"])
    each = F.transform("d", lambda d, k: F.struct(d.alias("d"), F.get("kinds", k).alias("kind"), F.get("marks", k).alias("module")))
    rows = marked.select(*GENE, F.inline(each)).where(F.col("kind") != 0)
    return rows.select(*GENE, "d.start", "d.end", "d.ord", "d.profile", "d.subtype", "kind", "module")


def module_properties(domains: DataFrame, keys: Sequence[str] = (*GENE, "module")) -> DataFrame:
    """Per module ``n_domains, complete, starter, terminating, trans_at, iterative, kind, peptide, polyketide`` and ``fused``, whether it begins with a domain that fused genes may share.

    A module that lies on two genes, or is not the first of its gene, needs a starter besides its loader. ``domains`` may have ``later`` (true: never a first module).
    """
    later = F.max(F.col("later").cast("int")) == 1 if "later" in domains.columns else F.lit(False)
    place = F.struct("part", "start", "end", "ord", "kind") if "part" in domains.columns else F.struct("start", "end", "ord", "kind")
    order = F.sort_array(F.collect_list(place))
    found = domains.groupBy(*keys).agg(order.alias("d"), F.min_by("profile", place).alias("head"), later.alias("later"))
    # A ketoreductase that goes with a joined module is taken as it is: it may follow what ends a module and changes none of what is asked here.
    own = F.filter("d", lambda d: d["part"] < 2) if "part" in domains.columns else F.col("d")
    at = walked(F.transform(own, lambda d: d["kind"]))["state"]
    first = (F.col("module") == 0) & ~F.col("later")
    pick = lambda what: _holds(what, F.col("at"))
    alone = pick(lambda s: s.starter in _LOADERS and bool(s.starter))
    peptide, polyketide = pick(lambda s: bool({s.starter, s.loader} & _PEPTIDE)), pick(lambda s: s.polyketide)
    return found.withColumn("at", at).select(
        *keys, F.size("d").alias("n_domains"),
        F.when(first, pick(lambda s: s.complete_first)).otherwise(pick(lambda s: s.complete_later)).alias("complete"),
        (pick(lambda s: s.starter in ("C first", "SAT", "CAL")) | (alone & first)).alias("starter"),
        pick(lambda s: s.end == "last").alias("terminating"), pick(lambda s: s.trans_at).alias("trans_at"), pick(lambda s: s.starter == "KS iterative").alias("iterative"),
        F.when(peptide, "nrps").when(polyketide, "pks").otherwise("unknown").alias("kind"), peptide.alias("peptide"), polyketide.alias("polyketide"), F.col("head").isin(*FUSED_STARTERS).alias("fused"),
    )


def _complete_in(genes: pa.Table, table: np.ndarray, whole: np.ndarray, kinds: np.ndarray) -> pa.Table:
    """The complete modules of whole genes, whose domains stand in order; all genes take their next step through the automaton at once."""
    kind = genes["kind"].to_numpy()
    held = np.flatnonzero(kind)  # the others are ignored, and change no state
    kind, gene = kind[held], np.cumsum(genes["first"].to_numpy())[held]
    begins = np.diff(gene, prepend=-1) != 0
    starts = np.flatnonzero(begins)
    sizes = np.diff(starts, append=len(held))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    state, after, first = np.zeros(len(starts), np.int64), np.zeros(len(held), np.int64), begins.copy()
    for k in range(sizes[0] if len(sizes) else 0):
        at = starts[: np.searchsorted(-sizes, -k)] + k  # of genes with more than k domains
        move = table[state[: len(at)] * len(KINDS) + kind[at]]
        state[: len(at)] = after[at] = move >> 1
        begins[at] |= (move & 1).astype(bool)
    opens = np.flatnonzero(begins)
    ends = np.append(opens[1:], len(held))
    last = after[ends - 1] if len(opens) else after
    complete = np.flatnonzero(whole[first[opens].astype(int), last])
    names = pa.ListArray.from_arrays(pa.array(np.append(opens, len(held)), pa.int32()), genes["name"].combine_chunks().take(pa.array(held)))
    value = pc.binary_join(names.take(pa.array(complete)), "|")
    return genes.select(GENE).take(pa.array(held[opens[complete]])).append_column("kind", pa.array(kinds[last[complete]], pa.string())).append_column("value", value)


def complete_modules(domains: DataFrame) -> DataFrame:
    """``record_id, gene_id, kind, value`` as ``compare.module_tuples`` has it from ``segment_modules`` and ``module_properties``, by one shuffle and one walk.

    A module begins in the automaton's first state, so the state after its last domain is the same whether the gene or the module is walked. Domains
    are ordered in Spark; an Arrow task walks over the genes of a batch together. A gene on the edge of a batch waits for the next.
    """
    states, moves = _compiled()
    table, whole = np.array(moves), np.array([[s.complete_later for s in states], [s.complete_first for s in states]])
    kinds = np.array(["nrps" if {s.starter, s.loader} & _PEPTIDE else "pks" if s.polyketide else "generic" for s in states], object)
    columns = {c: domains.schema[c].dataType.simpleString() for c in GENE}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            new = np.flatnonzero(batch["first"].to_numpy(zero_copy_only=False))
            if len(new) and waiting:
                yield from _complete_in(pa.Table.from_batches([*waiting, batch.slice(0, new[-1])]), table, whole, kinds).to_batches()
                waiting = []
            elif len(new) and new[-1]:
                yield from _complete_in(pa.Table.from_batches([batch.slice(0, new[-1])]), table, whole, kinds).to_batches()
            waiting.append(batch.slice(new[-1]) if len(new) else batch)
        if waiting:
            yield from _complete_in(pa.Table.from_batches(waiting), table, whole, kinds).to_batches()

    sort = [*GENE, "start", "end", "ord", "profile", "subtype"]
    place = Window.partitionBy(*GENE).orderBy(*sort[2:])
    dealt = domains.select(*sort).dropna(subset=GENE).repartition(*GENE)
    ahead = dealt.withColumns({"_next": F.lead("profile").over(place), "_second": F.lead("profile", 2).over(place), "first": F.row_number().over(place) == 1})
    name = F.when(F.col("profile").startswith("Condensation_"), "Condensation").otherwise(F.col("profile"))
    rows = ahead.sortWithinPartitions(*sort).select(*GENE, "first", kind_of(F.col("profile"), F.col("subtype"), F.col("_next"), F.col("_second")).alias("kind"), name.alias("name"))
    return rows.mapInArrow(walk, ", ".join([*[f"{c} {kind}" for c, kind in columns.items()], "kind string", "value string"]))


def join_modules(domains: DataFrame, genes: DataFrame) -> DataFrame:
    """Domains with ``owner`` (the gene that a module begins on) and its ``module``, after modules over two genes are joined; ``later`` marks those.

    ``domains`` are segmented; ``genes`` (``record_id, region, gene_id, start, strand``) are all genes of the regions. Neighbours on one
    strand join the last module of the one and the first of the other (in reading direction) where the first part is incomplete, the second part is incomplete or begins with a
    domain that fused genes share, they are not of two kinds, and together they are one complete module. A ketoreductase alone after a
    joined trans-AT module goes with it. A module takes part once; the pair that comes first on the record has it.
    """
    domains = cut(domains)  # asked for several times, and walked each time otherwise
    known = module_properties(domains)
    bounds = domains.groupBy(*GENE).agg(F.min("module").alias("low"), F.max("module").alias("high"))
    row = F.struct("start", "end", "ord", "kind", "profile", "subtype")
    kinds = domains.groupBy(*GENE, "module").agg(F.sort_array(F.collect_list(row)).alias("d")).select(*GENE, "module", F.transform("d", lambda d: d["kind"]).alias("kinds"), F.transform("d", lambda d: F.struct(d["profile"].alias("profile"), d["subtype"].alias("subtype"))).alias("domains"))
    parts = known.join(kinds, [*GENE, "module"]).select(*GENE, "module", "complete", "peptide", "polyketide", "fused", "kinds", "domains")

    region = Window.partitionBy("record_id", "region").orderBy("start", "gene_id")
    nearby = genes.join(bounds, GENE, "left").withColumns({"place": F.row_number().over(region), "next": F.lead(F.struct("gene_id", "strand", "low", "high")).over(region)})
    pairs = nearby.where(F.col("low").isNotNull() & F.col("next.low").isNotNull() & (F.col("strand") == F.col("next.strand")))
    ahead = F.col("strand") != -1
    me, other = F.struct("gene_id", "low", "high"), F.struct("next.gene_id", "next.low", "next.high")
    pairs = pairs.withColumns({"head": F.when(ahead, me).otherwise(other), "tail": F.when(ahead, other).otherwise(me)})
    side = lambda name: parts.select("record_id", F.col("gene_id").alias(f"{name}_gene"), F.col("module").alias(f"{name}_module"), F.struct("complete", "peptide", "polyketide", "fused", "domains").alias(f"{name}_part"))
    named = pairs.select("record_id", "region", "place", F.col("head.gene_id").alias("head_gene"), F.col("head.high").alias("head_module"), F.col("tail.gene_id").alias("tail_gene"), F.col("tail.low").alias("tail_module"), (F.col("low") == F.col("high")).alias("single"))
    both = named.join(side("head"), ["record_id", "head_gene", "head_module"]).join(side("tail"), ["record_id", "tail_gene", "tail_module"])
    # What follows a carrier is asked of the two parts together: domains behind them, in other modules, no longer count.
    both = both.withColumn("_row", F.concat("head_part.domains", "tail_part.domains"))
    profile = lambda k: F.get("_row", k)["profile"]
    both = both.withColumn("end", walked(F.transform("_row", lambda d, k: kind_of(d["profile"], d["subtype"], profile(k + 1), profile(k + 2)))))
    two_kinds = (F.col("head_part.polyketide") & F.col("tail_part.peptide")) | (F.col("head_part.peptide") & F.col("tail_part.polyketide"))
    state = lambda what: _holds(what, F.col("end.state"))
    able = both.where(~F.col("head_part.complete") & (~F.col("tail_part.complete") | F.col("tail_part.fused")) & ~two_kinds & (F.col("end.opened") == 0) & state(lambda s: s.complete_later))
    able = able.withColumn("trans_at", state(lambda s: s.trans_at))

    # Pairs that follow each other over a gene with one module compete for it: in such a run every other pair is taken.
    runs = Window.partitionBy("record_id", "region").orderBy("place")
    follows = F.coalesce((F.lag("place").over(runs) == F.col("place") - 1) & F.col("single"), F.lit(False))
    run = able.withColumn("run", F.sum((~follows).cast("int")).over(runs.rowsBetween(Window.unboundedPreceding, 0)))
    taken = run.withColumn("turn", F.row_number().over(Window.partitionBy("record_id", "region", "run").orderBy("place"))).where(F.col("turn") % 2 == 1)
    taken = cut(taken.select("record_id", "head_gene", "head_module", "tail_gene", "tail_module", "trans_at"))

    kr = KINDS.index("KR")
    lone = parts.where((F.size("kinds") == 1) & (F.element_at("kinds", 1) == kr)).select("record_id", F.col("gene_id").alias("tail_gene"), (F.col("module") - 1).alias("tail_module"))
    moved = taken.select("record_id", F.col("tail_gene").alias("gene_id"), F.col("tail_module").alias("module"), F.col("head_gene").alias("owner"), F.col("head_module").alias("into"), F.lit(1).alias("part"))
    carried = taken.where("trans_at").join(lone, ["record_id", "tail_gene", "tail_module"]).select("record_id", F.col("tail_gene").alias("gene_id"), (F.col("tail_module") + 1).alias("module"), F.col("head_gene").alias("owner"), F.col("head_module").alias("into"), F.lit(2).alias("part"))
    heads = taken.select("record_id", F.col("head_gene").alias("gene_id"), F.col("head_module").alias("module"), F.col("head_gene").alias("owner"), F.col("head_module").alias("into"), F.lit(0).alias("part"))
    used = moved.unionByName(heads)
    every = used.unionByName(carried.join(used.select(*GENE, "module"), [*GENE, "module"], "left_anti"))
    joined = domains.join(every, [*GENE, "module"], "left")
    return joined.withColumns({"later": F.col("owner").isNotNull(), "owner": F.coalesce("owner", "gene_id"), "module": F.coalesce("into", "module"), "part": F.coalesce("part", F.lit(0))}).drop("into")


#: Domains, or genes, of one record that ``record_genes`` may take in one task.
OF_RECORD = 1_000_000


def plain_lines(domains: DataFrame, genes: DataFrame, most: int = OF_RECORD) -> bool:
    """Whether ``record_genes`` may be asked: no record has more than ``most`` domains or genes, each gene of the regions has one row, and none lacks what it is known by."""
    odd = lambda *names: F.max(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])).alias("odd")
    most_of = lambda counts, *more: counts.agg(F.coalesce(F.max("n"), F.lit(0)) <= most, ~F.coalesce(F.max("odd"), F.lit(False)), *more).first()
    if not all(most_of(domains.groupBy("record_id").agg(F.count("*").alias("n"), odd(*GENE)))):
        return False
    rows = genes.repartition("record_id").groupBy(*GENE).agg(F.count("*").alias("rows"), odd(*GENE, "region", "start", "strand"))
    counts = rows.groupBy("record_id").agg(F.sum("rows").alias("n"), F.max("rows").alias("rows"), F.max("odd").alias("odd"))
    return all(most_of(counts, F.coalesce(F.max("rows"), F.lit(1)) == 1))


def record_genes(domains: DataFrame, genes: DataFrame) -> DataFrame:
    """One row per gene with what ``segment_modules`` and ``join_modules`` tell of its modules; both tables are dealt by record once, and nothing is joined or stored.

    ``d`` has all domains of a gene, ``held`` those in modules (``profile, module``), ``high`` is its last module. ``heads`` says that the last module goes on in another gene,
    whose part of it is ``behind``; ``tails`` that the first one began on another gene; ``head_kr`` and ``tail_kr`` that a ketoreductase alone went along. ``head_state`` and ``tail_state``
    are what such a module ends in, ``first_state`` and ``state`` the gene's own first and last module. ``chained``: it shares a module with a gene of a smaller number. Genes that are not
    in ``genes`` have no ``region``. Only for what ``plain_lines`` allows.
    """
    # A domain's kind but for what follows it is found where it is read, as functions over arrays are slow.
    row = F.struct("start", "end", "ord", "profile", kind_of(F.col("profile"), F.col("subtype"), F.lit(None), F.lit(None)).alias("kind"))
    line = F.struct("region", "start", "strand")
    none = lambda df, what: F.lit(None).cast(df.select(what.alias("x")).schema["x"].dataType)
    parts, lines = domains.select(*GENE, none(genes, line).alias("line"), row.alias("row")), genes.select(*GENE, line.alias("line"), none(domains, row).alias("row"))
    rows = parts.unionByName(lines).repartition("record_id").groupBy(*GENE).agg(F.max("line").alias("line"), F.sort_array(F.collect_list("row")).alias("d"))

    def followed(array: str) -> Column:
        profile = lambda k: F.get(array, k)["profile"]
        before = lambda k: (profile(k + 1) == AFTER_SECOND_CARRIER[0]) & (profile(k + 2) == AFTER_SECOND_CARRIER[1])
        return F.transform(array, lambda d, k: F.when(d["kind"].isin(*_CARRIERS) & before(k), d["kind"] + 2).otherwise(d["kind"]))

    kinds = rows.withColumn("kinds", followed("d"))
    marked = kinds.withColumn("walk", walked(F.col("kinds")))
    each = F.transform("d", lambda d, k: F.struct(d["profile"].alias("profile"), d["kind"].alias("kind"), F.get("kinds", k).alias("here"), F.get("walk.marks", k).alias("module")))
    held = marked.select(*GENE, "line.region", "line.start", "line.strand", "d", F.filter(each, lambda d: d["kind"] != 0).alias("held"), F.col("walk.state").alias("state"), F.col("walk.opened").alias("high"))
    of = lambda k: F.filter("held", lambda d: d["module"] == k)
    split = held.withColumns({"first": of(0), "last": of(F.col("high")), "second": of(1)})
    plain = F.transform("first", lambda d: d["here"])
    stated = split.withColumn("first_state", F.when(F.col("high") == 0, F.col("state")).otherwise(walked(plain)["state"]))

    # What a module is like, asked of the state that it ends in.
    asked = {"complete": None, "peptide": lambda s: bool({s.starter, s.loader} & _PEPTIDE), "polyketide": lambda s: s.polyketide}
    whole_first, whole_later = lambda s: s.complete_first, lambda s: s.complete_later
    of_last = [(F.when(F.col("high") == 0, _holds(whole_first, F.col("state"))).otherwise(_holds(whole_later, F.col("state"))) if what is None else _holds(what, F.col("state"))).alias(f"last_{c}") for c, what in asked.items()]
    of_first = [_holds(what or whole_first, F.col("first_state")).alias(f"first_{c}") for c, what in asked.items()]
    lone = (F.size("second") == 1) & F.coalesce(F.get("second", 0)["kind"] == KINDS.index("KR"), F.lit(False))
    fused = F.coalesce(F.get("first", 0)["profile"].isin(*FUSED_STARTERS), F.lit(False))
    me = F.struct("gene_id", "strand", "high", "state", "first", "last", (F.size("held") > 0).alias("any"), *of_last, *of_first, fused.alias("fused"), lone.alias("lone"))
    region = Window.partitionBy("record_id", "region").orderBy("start", "gene_id")
    told = stated.withColumn("me", me).drop("first", "last", "second")
    nearby = told.withColumns({"place": F.row_number().over(region), "next": F.lead("me").over(region)})

    ahead = F.col("strand") != -1
    head, tail = (lambda c: F.when(ahead, F.col(f"me.{c}")).otherwise(F.col(f"next.{c}"))), (lambda c: F.when(ahead, F.col(f"next.{c}")).otherwise(F.col(f"me.{c}")))
    two_kinds = (head("last_polyketide") & tail("first_peptide")) | (head("last_peptide") & tail("first_polyketide"))
    fits = F.col("region").isNotNull() & F.col("me.any") & F.col("next.any") & (F.col("strand") == F.col("next.strand")) & ~head("last_complete") & (~tail("first_complete") | tail("fused")) & ~two_kinds
    # What follows a carrier is asked of the two parts together: domains behind them, in other modules, no longer count.
    both = nearby.withColumn("_row", F.when(fits, F.concat(head("last"), tail("first"))))
    both = both.withColumn("_kinds", followed("_row"))
    ended = both.withColumn("_end", walked(F.col("_kinds"))).drop("_row", "_kinds")
    state = lambda what: _holds(what, F.col("_end.state"))
    able = F.coalesce((F.col("_end.opened") == 0) & state(whole_later), F.lit(False))
    ended = ended.withColumns({"_able": able, "_trans": state(lambda s: s.trans_at)}).drop("_end")

    # Pairs that follow each other over a gene with one module compete for it: in such a run every other pair is taken.
    flag = lambda c, step=1: (F.lag(c, step, False) if step > 0 else F.lead(c, -step, False)).over(region)
    follows = F.col("_able") & F.col("_before") & (F.col("high") == 0)
    run = ended.withColumn("_before", flag("_able")).withColumn("_begin", F.max(F.when(F.col("_able") & ~follows, F.col("place"))).over(region.rowsBetween(Window.unboundedPreceding, 0)))
    taken = run.withColumn("_own", F.col("_able") & ((F.col("place") - F.col("_begin")) % 2 == 0)).drop("_able", "_before", "_begin", "place")
    # A module that is another pair's already is not carried along.
    other = F.when(ahead, (F.col("next.high") == 1) & F.col("_behind")).otherwise((F.col("high") == 1) & F.col("_prior"))
    seen = taken.withColumns({"_prior": flag("_own"), "_behind": flag("_own", -1)})
    seen = seen.withColumns({"_kr": F.col("_own") & F.col("_trans") & tail("lone") & ~other, "_joined": F.when(F.col("_own"), _from(head("state"), F.transform(tail("first"), lambda d: d["here"])))})
    seen = seen.withColumns({"_prior_kr": flag("_kr"), "_prior_joined": F.lag("_joined").over(region), "_prior_first": F.lag("me.first").over(region), "_prior_gene": F.lag("gene_id").over(region)})
    forward, back = lambda c: F.when(F.col("_own") & ahead, c), lambda c: F.when(F.col("_prior") & ~ahead, c)
    of_head = lambda one, two: F.coalesce(forward(one), back(two))
    of_tail = lambda one, two: F.coalesce(F.when(F.col("_own") & ~ahead, one), F.when(F.col("_prior") & ahead, two))
    sure = lambda c: F.coalesce(c, F.lit(False))
    yes, kr, joined = (F.lit(True), F.lit(True)), (F.col("_kr"), F.col("_prior_kr")), (F.col("_joined"), F.col("_prior_joined"))
    chained = (F.col("_own") & (F.col("gene_id") > F.col("next.gene_id"))) | (F.col("_prior") & (F.col("gene_id") > F.col("_prior_gene")))
    return seen.select(
        *GENE, "region", "start", "strand", "d", "held", "high", "state", "first_state", sure(of_head(*yes)).alias("heads"), of_head(F.col("next.first"), F.col("_prior_first")).alias("behind"), sure(of_head(*kr)).alias("head_kr"),
        of_head(*joined).alias("head_state"), sure(of_tail(*yes)).alias("tails"), sure(of_tail(*kr)).alias("tail_kr"), of_tail(*joined).alias("tail_state"), sure(chained).alias("chained"),
    )


def owned_modules(genes: DataFrame) -> DataFrame:
    """``record_id, owner, module, profiles`` of the modules that begin on the genes of ``record_genes``, their domains in order over both genes."""
    names = lambda domains: F.transform(domains, lambda d: d["profile"])
    none = F.array().cast("array<string>")
    behind = F.when(F.col("heads"), F.concat(names("behind"), F.when(F.col("head_kr"), F.array(F.lit("PKS_KR"))).otherwise(none))).otherwise(none)
    rows = genes.where(F.size("held") > 0).select("record_id", F.col("gene_id").alias("owner"), "held", "high", "tails", "tail_kr", behind.alias("_behind"), F.explode(F.sequence(F.lit(0), F.col("high"))).alias("module"))
    kept = rows.where(~(F.col("tails") & (F.col("module") == 0)) & ~(F.col("tail_kr") & (F.col("module") == 1)))
    own = names(F.filter("held", lambda d: d["module"] == F.col("module")))
    return kept.select("record_id", "owner", "module", F.concat(own, F.when(F.col("module") == F.col("high"), F.col("_behind")).otherwise(none)).alias("profiles"))


def ends_of(genes: DataFrame) -> DataFrame:
    """``opens`` and ``closes`` of genes of ``record_genes`` that stand in regions, as ``find_ends`` asks for them, and ``chained``, with the names ``ps`` of all domains."""
    at = lambda what, state: _holds(what, F.col(state))
    loads = lambda s: s.starter in ("C first", "SAT", "CAL")
    single = F.col("high") == 0
    opens = F.when(F.col("tails"), at(loads, "tail_state")).when(F.col("heads") & single, at(loads, "head_state")).otherwise(at(lambda s: loads(s) or s.starter in _LOADERS, "first_state"))
    last = lambda s: s.end == "last"
    alone = single | (F.col("tail_kr") & (F.col("high") == 1))
    closes = F.when(F.col("heads"), F.lit(False)).when(F.col("tails") & alone, at(last, "tail_state")).otherwise(at(last, "state"))
    any_held = F.size("held") > 0
    return genes.where("region is not null").select("record_id", "region", "gene_id", "start", "strand", (any_held & opens).alias("opens"), (any_held & closes).alias("closes"), "chained", F.transform("d", lambda d: d["profile"]).alias("ps"))


#: Polyketide units, and the prefixes that reductive domains turn into each other, in the order in which they act.
UNITS = ("mal", "mmal", "mxmal", "emal")
REDUCTIONS = ((("PKS_KR",), "", "oh"), (("PKS_DH", "PKS_DH2", "PKS_DHt"), "oh", "cc"), (("PKS_ER",), "cc", "red"))
METHYLATIONS = (("nMT", "NMe"), ("cMT", "Me"), ("oMT", "OMe"))


def monomer(base: Column, profiles: Column, polyketide: Column, trans_at: Column) -> Column:
    """The monomer that a complete module (its domains' profiles in order) makes of a substrate; empty without one.

    Reductive domains change a polyketide unit step by step, methylations and a methyl of the unit stand before it, an epimerised one begins with D.
    """
    base = F.when(trans_at, "mal").otherwise(F.coalesce(base, F.lit("")))
    for domains, before, after in REDUCTIONS:
        acts = polyketide & F.arrays_overlap(profiles, F.array(*[F.lit(d) for d in domains]))
        base = F.when(acts & base.isin(*[before + u for u in UNITS]), F.concat(F.lit(after), F.substring(base, len(before) + 1, 99))).otherwise(base)
    marks = F.create_map(*[F.lit(x) for pair in METHYLATIONS for x in pair])
    methyls = F.filter(F.transform(profiles, lambda p: F.try_element_at(marks, p)), lambda m: m.isNotNull())
    branched = base.endswith("mmal")
    own = F.when(branched, F.regexp_replace(base, "mmal$", "mal")).otherwise(base)
    none = F.array().cast("array<string>")
    turned = F.when(F.array_contains(profiles, "Epimerization"), F.array(F.lit("D"))).otherwise(none)
    return F.when(base == "", "").otherwise(F.array_join(F.concat(turned, methyls, F.when(branched, F.array(F.lit("Me"))).otherwise(none), F.array(own)), "-"))


def combine_predictions(matches: Column, single: Column, groups: Sequence[Column], uncertain: Column) -> Column:
    """Substrates of one domain from code matches and model predictions, as a distinct array in order.

    ``matches``: array of (``substrates``, ``code``, ``long_code``), shares of equal places (code: of ten); ``single``: the single-substrate model's names, null for
    none; ``groups``: models of growing groups, null for none. At a full code match the best matches stand; at nine of ten a single prediction that is among
    the matches, else without one matches and the tightest group together; at eight the single prediction, or that; below, the tightest prediction of all. An uncertain
    domain has only matches of at least eight.
    """
    none = F.array().cast("array<string>")
    ordered = F.array_sort(matches, lambda a, b: F.when((a["code"] > b["code"]) | ((a["code"] == b["code"]) & (a["long_code"] > b["long_code"])), -1).when((a["code"] == b["code"]) & (a["long_code"] == b["long_code"]), 0).otherwise(1))
    top = F.element_at(F.slice(ordered, 1, 1), 1)
    quality = F.when(F.size(matches) > 0, top["code"]).otherwise(0.0)
    best = F.flatten(F.transform(F.filter(ordered, lambda m: m["long_code"] == top["long_code"]), lambda m: m["substrates"]))
    every = F.flatten(F.transform(ordered, lambda m: m["substrates"]))
    tightest = F.coalesce(*groups)
    shared = F.when(tightest.isNull(), every).otherwise(F.array_intersect(every, tightest))
    certain = (
        F.when(quality == 1.0, best)
        .when(single.isNotNull() & (quality == 0.9), F.when(F.array_contains(every, F.element_at(single, 1)), single).otherwise(none))
        .when(single.isNotNull(), single).when(quality >= 0.8, shared).otherwise(F.coalesce(tightest, none))
    )
    return F.array_distinct(F.when(uncertain, F.when(quality >= 0.8, best).otherwise(none)).otherwise(certain))


def find_ends(genes: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """``start_gene, end_gene`` per area, null where there is none or more than one.

    ``genes`` has ``gene_id, opens`` (its first module is a starter), ``closes`` (its last module terminates and does not go on in another gene) and ``classic`` (its
    first domains are those of a loading gene). Without any other opening gene than the end, a single classic one counts.
    """
    ends = genes.groupBy(*keys).agg(F.sum(F.col("closes").cast("int")).alias("n"), F.max(F.when(F.col("closes"), F.col("gene_id"))).alias("gene"))
    ended = ends.select(*keys, F.when(F.col("n") == 1, F.col("gene")).alias("end_gene"))
    others = genes.join(ended, list(keys)).withColumn("_free", F.col("end_gene").isNull() | (F.col("gene_id") != F.col("end_gene")))
    count = lambda c: F.sum((F.col("_free") & F.col(c)).cast("int"))
    named = lambda c: F.max(F.when(F.col("_free") & F.col(c), F.col("gene_id")))
    seen = others.groupBy(*keys, "end_gene").agg(count("opens").alias("n"), named("opens").alias("opening"), count("classic").alias("m"), named("classic").alias("loading"))
    return seen.select(*keys, F.when(F.col("n") == 1, F.col("opening")).when((F.col("n") == 0) & (F.col("m") == 1), F.col("loading")).alias("start_gene"), "end_gene")


def colinear_groups(genes: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Add ``place``: genes along the strand that most of them are on (ties forward), genes that share a module kept together.

    ``genes`` has ``gene_id, start, strand, chained`` (shares a module with the gene before it) and ``ends`` (has a terminating domain besides others). A
    chain is read along its own strand; if the first gene then has such a domain, the order of chains is turned round once more.
    """
    numbered = prefix_totals(genes.withColumn("_breaks", (~F.col("chained")).cast("long")), keys, ["start", "gene_id"], sums={"_chain": "_breaks"}, rows=None)
    numbered = cut(numbered.withColumn("_chain", F.col("_chain") + F.col("_breaks")).drop("_breaks"))
    inside = F.when(F.col("strand") == -1, -F.col("start")).otherwise(F.col("start"))
    place = F.struct("_turned", "_inside", "gene_id")
    sides = numbered.groupBy(*keys).agg(F.sum("strand").alias("_sum"))
    keyed = numbered.join(sides, list(keys)).withColumns({"_inside": inside, "_turned": F.when(F.col("_sum") < 0, -F.col("_chain")).otherwise(F.col("_chain"))})
    heads = keyed.groupBy(*keys).agg(F.min_by("ends", place).alias("_flip"))
    flipped = keyed.join(heads, list(keys)).withColumn("_turned", F.when(F.col("_flip"), -F.col("_turned")).otherwise(F.col("_turned")))
    counted = prefix_totals(flipped, keys, ["_turned", "_inside", "gene_id"], rows="_before")
    return counted.withColumn("place", (F.col("_before") + 1).cast("int")).drop("_chain", "_sum", "_inside", "_turned", "_flip", "_before")


def colinear_places(genes: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """As ``colinear_groups``, where a key's genes may meet in one task: by windows, which leave rows where they are dealt."""
    whole = Window.partitionBy(*keys)
    chain = F.sum((~F.col("chained")).cast("long")).over(whole.orderBy("start", "gene_id").rowsBetween(Window.unboundedPreceding, 0))
    numbered = genes.withColumns({"_chain": chain, "_sum": F.sum("strand").over(whole), "_inside": F.when(F.col("strand") == -1, -F.col("start")).otherwise(F.col("start"))})
    turned = numbered.withColumn("_turned", F.when(F.col("_sum") < 0, -F.col("_chain")).otherwise(F.col("_chain")))
    first = F.first("ends").over(whole.orderBy("_turned", "_inside", "gene_id").rowsBetween(Window.unboundedPreceding, 0))
    flipped = turned.withColumn("_flip", first).withColumn("_turned", F.when(F.col("_flip"), -F.col("_turned")).otherwise(F.col("_turned")))
    return flipped.withColumn("place", F.row_number().over(whole.orderBy("_turned", "_inside", "gene_id"))).drop("_chain", "_sum", "_inside", "_turned", "_flip")


#: Residues by character, for pairs of docking ends.
HYDROPHOBIC, POSITIVE, NEGATIVE = "AVILFWYM", "HKR", "DE"


def _attraction(a: Column, b: Column) -> Column:
    """1 for two hydrophobic or oppositely charged residues, -1 for equally charged ones."""
    both = lambda letters: a.isin(*letters) & b.isin(*letters)
    opposite = (a.isin(*POSITIVE) & b.isin(*NEGATIVE)) | (a.isin(*NEGATIVE) & b.isin(*POSITIVE))
    return F.when(both(HYDROPHOBIC) | opposite, 1).when(both(POSITIVE) | both(NEGATIVE), -1).otherwise(0)


def best_order(units: DataFrame, keys: Sequence[str] = ("area_id",), most: int = 10) -> DataFrame:
    """``order`` (unit ids) and ``score`` per area: the order of its units with the best sum over neighbours, of equal ones the least by starts.

    ``units`` has ``unit, start, role`` (``start`` and ``end`` units have their place, others null), ``tail`` and ``head`` (two residues at its end and its beginning; null:
    not known) and ``follower`` (the unit that follows it on the record, or null). A neighbour that follows on the record counts 1, and each pair of residues -1 to 1.
    The sum is additive, so all sets of units are grown step by step with the best way to end in each unit: at most ``most * 2**most`` rows per
    area instead of all permutations. Areas with more free units are left out.
    """
    keys = list(keys)
    free = units.where("role is null")
    able = units.groupBy(*keys).agg(F.sum(F.col("role").isNull().cast("int")).alias("n")).where(F.col("n") <= most)
    bits = Window.partitionBy(*keys).orderBy("start", "unit")
    member = F.struct("unit", "start", "tail", "head", "follower")
    numbered = cut(free.join(able, keys).select(*keys, member.alias("u"), F.call_function("shiftleft", F.lit(1), F.row_number().over(bits) - 1).alias("bit")))
    edge = lambda role: units.where(F.col("role") == role).select(*keys, member.alias(role))
    begun = able.join(edge("start"), keys, "left").join(edge("end"), keys, "left")
    empty = F.array().cast("array<struct<start:bigint,unit:bigint>>")
    item = lambda u: F.struct(u["start"].cast("bigint").alias("start"), u["unit"].cast("bigint").alias("unit"))
    state = begun.select(*keys, "n", F.col("end"), F.lit(0).alias("mask"), F.col("start").alias("last"), F.lit(0).alias("score"), F.when(F.col("start").isNotNull(), F.array(item(F.col("start")))).otherwise(empty).alias("path"))

    def gained(last: Column, u: Column) -> Column:
        near = F.when(last["follower"] == u["unit"], 1).otherwise(0)
        residues = [_attraction(F.substring(last["tail"], k, 1), F.substring(u["head"], k, 1)) for k in (1, 2)]
        return F.coalesce(near, F.lit(0)) + F.when(last["tail"].isNotNull() & u["head"].isNotNull(), residues[0] + residues[1]).otherwise(0)

    done = []
    for turn in range(most + 1):
        done.append(state.where(F.col("n") == turn))
        grown = state.where(F.col("n") > turn).join(numbered, keys).where(F.col("mask").bitwiseAND(F.col("bit")) == 0)
        grown = grown.select(*keys, "n", "end", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), F.col("u").alias("last"), (F.col("score") + F.when(F.col("last").isNotNull(), gained(F.col("last"), F.col("u"))).otherwise(0)).alias("score"), F.concat("path", F.array(item(F.col("u")))).alias("path"))
        best = grown.groupBy(*keys, "n", "end", "mask", F.col("last")).agg(F.min(F.struct((-F.col("score")).alias("loss"), "path")).alias("best"))
        state = cut(best.select(*keys, "n", "end", "mask", "last", (-F.col("best.loss")).alias("score"), F.col("best.path").alias("path")))
    ways = reduce(DataFrame.unionByName, done)
    last = F.when(F.col("end").isNotNull() & F.col("last").isNotNull(), gained(F.col("last"), F.col("end"))).otherwise(0)
    closed = ways.select(*keys, (F.col("score") + last).alias("score"), F.when(F.col("end").isNotNull(), F.concat("path", F.array(item(F.col("end"))))).otherwise(F.col("path")).alias("path"))
    chosen = closed.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("loss"), "path")).alias("best"))
    return chosen.select(*keys, F.transform("best.path", lambda p: p["unit"]).alias("order"), (-F.col("best.loss")).alias("score"))


def structure_string(modules: DataFrame, codes: DataFrame, keys: Sequence[str] = ("area_id",), end: str = "C(=O)O") -> DataFrame:
    """``structure`` per area: its monomers' structures (``codes``: ``name, code``, names in lower case) in order of ``place``.

    A monomer without a code stands with its ``substrate``'s, and without that with none. The O that the next one replaces is cut from all
    but the last; ``end`` follows where the last is a polyketide unit. An area's modules are few, so they are one array.
    """
    named = lambda name, column: codes.select(F.col("name").alias(name), F.col("code").alias(column))
    rows = modules.withColumns({"_m": F.lower("monomer"), "_s": F.lower("substrate")}).join(named("_m", "_mc"), "_m", "left").join(named("_s", "_sc"), "_s", "left")
    chunks = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("_mc", "_sc", F.lit("")).alias("code"), "monomer"))).alias("m"))
    size = F.size("m")
    joined = F.array_join(F.transform("m", lambda x, k: F.when(k < size - 1, F.regexp_replace(x["code"], r"C\(=O\)O$", "C(=O)")).otherwise(x["code"])), "")
    return chunks.select(*keys, F.concat(joined, F.when(F.element_at("m", -1)["monomer"].endswith("mal"), end).otherwise("")).alias("structure"))
