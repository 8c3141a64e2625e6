"""Co-occurrence of predicates: masks of what units show, masks of what is known of them, and expressions over both.

A predicate looks at a placement's blocks. Of a chain with two representatives for more than two reads the reads between are
not stored, so that an alignment's extent may be missed there: absence of a predicate that depends on the extent is not
known then. Bit i of a mask belongs to predicate i.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.evidence import span_end, span_start

MOST = 64


@dataclass(frozen=True)
class Predicate:
    name: str
    holds: Callable[[Column], Column]
    extent: bool = True  # whether it depends on more than the junctions


def region(name: str, start: int, end: int, match: str = "anchor") -> Predicate:
    """The placement's first base lies in the region, or one of its blocks overlaps it."""
    if match == "anchor":
        return Predicate(name, lambda b: (span_start(b) >= start) & (span_start(b) < end))
    return overlap(name, start, end, 1)


def overlap(name: str, start: int, end: int, least: int) -> Predicate:
    return Predicate(name, lambda b: G.overlap(b, start, end) >= least)


def starts(name: str, start: int, end: int) -> Predicate:
    return region(name, start, end)


def ends(name: str, start: int, end: int) -> Predicate:
    return Predicate(name, lambda b: (span_end(b) >= start) & (span_end(b) < end))


def junction(name: str, donor: int, acceptor: int, near: int = 0) -> Predicate:
    return Predicate(name, lambda b: G.has_junction(b, donor, acceptor, near, near), extent=False)


def path(name: str, junctions: list[tuple[int, int]], whole: bool = True) -> Predicate:
    return Predicate(name, lambda b: (G.has_path if whole else G.has_subpath)(b, junctions), extent=False)


def parse(text: str, names: list[str]) -> Callable[[dict[str, Column]], Column]:
    """A function of the names' columns (null: unknown) for an expression of names, "!", "&", "|" and parentheses."""
    tokens = re.findall(r"[A-Za-z_]\w*|[!&|()]|\S", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def one() -> Callable:
        token = take()
        if token == "!":
            inner = one()
            return lambda c: ~inner(c)
        if token == "(":
            inner = many("|")
            if take() != ")":
                raise ValueError(f"a parenthesis is open in {text!r}")
            return inner
        if token not in names:
            raise ValueError(f"{token!r} is no predicate of {names}")
        return lambda c: c[token]

    def many(sign: str) -> Callable:
        lower = one if sign == "&" else lambda: many("&")
        parts = [lower()]
        while peek() == sign:
            take()
            parts.append(lower())

        def joined(c: dict[str, Column]) -> Column:
            out = parts[0](c)
            for p in parts[1:]:
                out = out & p(c) if sign == "&" else out | p(c)
            return out

        return joined

    found = many("|")
    if peek():
        raise ValueError(f"{peek()!r} is left over in {text!r}")
    return found


def complete() -> Column:
    """Whether every read of the record is stored."""
    return ~((F.size("reps") > 1) & (F.col("weight") > F.size("reps")))


def placements_of(which: str) -> Column:
    """A record's placements: of unique reads, or also the primary ones of multimapping reads ("direct")."""
    return {"unique": F.col("reps"), "direct": F.concat("reps", "mms")}[which]


def masked(rows: DataFrame, predicates: list[Predicate], placements: str = "unique") -> DataFrame:
    """rows with `mask`, what any placement shows, and `known`, of which predicates that says all."""
    if len(predicates) > MOST or len({p.name for p in predicates}) < len(predicates):
        raise ValueError(f"at most {MOST} predicates of different names")
    mask = known = F.lit(0).cast("long")
    for i, p in enumerate(predicates):
        shown = F.exists(placements_of(placements), p.holds)
        sure = shown | complete() if p.extent else F.lit(True)
        mask = mask.bitwiseOR(F.when(shown, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        known = known.bitwiseOR(F.when(sure, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("mask", mask).withColumn("known", known)


def states(predicates: list[Predicate]) -> dict[str, Column]:
    """Each predicate as true, false, or null where its absence is not known."""
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    return {p.name: F.when(bit("mask", i), True).when(bit("known", i), False) for i, p in enumerate(predicates)}


def by_class(found: DataFrame) -> DataFrame:
    """Masks of classes: shown if any record shows it, known if all records know it."""
    return found.groupBy("cell", "umi_class").agg(F.bit_or("mask").alias("mask"), F.bit_and("known").alias("known"))


def patterns(found: DataFrame) -> DataFrame:
    """Units, classes and cells by mask and completeness."""
    return found.groupBy("mask", "known").agg(F.count("*").alias("units"), F.count_distinct("umi_class").alias("umis"), F.count_distinct("cell").alias("cells"))


def select(found: DataFrame, predicates: list[Predicate], expression: str) -> DataFrame:
    """found with `state`: whether the expression holds, null if that is unknown."""
    return found.withColumn("state", parse(expression, [p.name for p in predicates])(states(predicates)))


def match_within(rows: DataFrame, predicates: list[Predicate], expression: str, how: str, placements: str = "unique") -> DataFrame:
    """rows with `state`: the expression over single placements, held by "any" or by "all" of them; false where there are none.

    Where reads are not stored and a predicate of the expression depends on extent, any that is not true, and all that is not
    false, are unknown.
    """
    test = parse(expression, [p.name for p in predicates])
    used = [p for p in predicates if p.name in re.findall(r"\w+", expression)]
    each = lambda b: test({p.name: p.holds(b) for p in predicates})
    of = placements_of(placements)
    open_ = ~complete() if any(p.extent for p in used) else F.lit(False)
    if how == "any":
        state = F.when(F.exists(of, each), True).when(open_, None).otherwise(False)
    else:
        state = F.when(~F.forall(of, each), False).when(open_, None).otherwise(True)
    return rows.withColumn("state", F.when(F.size(of) == 0, False).otherwise(state))
