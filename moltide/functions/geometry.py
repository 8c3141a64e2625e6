"""Geometry predicates and three-valued folds. Null is Unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.evidence import junctions


def overlap(blocks: Column, start: int, end: int) -> Column:
    """Largest overlap of a block with [start, end)."""
    return F.array_max(F.transform(blocks, lambda b: F.greatest(F.least(b["end"], F.lit(end)) - F.greatest(b["start"], F.lit(start)), F.lit(0))))


def total_overlap(blocks: Column, start: int, end: int) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.greatest(F.least(b["end"], F.lit(end)) - F.greatest(b["start"], F.lit(start)), F.lit(0)))


def has_junction(blocks: Column, donor: int, acceptor: int, left: int = 0, right: int = 0) -> Column:
    """A junction at most `left` off the donor and `right` off the acceptor."""
    return F.exists(junctions(blocks), lambda j: (F.abs(j["donor"] - donor) <= left) & (F.abs(j["acceptor"] - acceptor) <= right))


def has_path(blocks: Column, path: list[tuple[int, int]]) -> Column:
    """The junctions of the path one directly after another."""
    j, n = junctions(blocks), len(path)
    wanted = F.array(*[F.struct(F.lit(d).cast("long").alias("donor"), F.lit(a).cast("long").alias("acceptor")) for d, a in path])
    return F.when(F.size(j) < n, False).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(F.size(j) - (n - 1), F.lit(1))), lambda i: F.slice(j, i, n) == wanted))


def has_subpath(blocks: Column, path: list[tuple[int, int]]) -> Column:
    """The junctions of the path in order, others between them."""
    at = F.lit(0)
    wanted = F.array(*[F.struct(F.lit(d).cast("long").alias("donor"), F.lit(a).cast("long").alias("acceptor")) for d, a in path])
    return F.aggregate(junctions(blocks), at, lambda s, j: F.when((s < len(path)) & (F.get(wanted, s) == j), s + 1).otherwise(s)) == len(path)


def kleene_any(p: Column) -> Column:
    """OR over a group: true if any is, else unknown if any is, else false."""
    return F.when(F.count_if(p) > 0, True).when(F.count_if(p.isNull()) > 0, None).otherwise(False)


def kleene_all(p: Column) -> Column:
    """AND over a group; true of none."""
    return F.when(F.count_if(~p) > 0, False).when(F.count_if(p.isNull()) > 0, None).otherwise(True)


def parse_locus(text: Column) -> Column:
    """chrom:start-end, commas in the numbers ignored; null unless start < end."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    part = lambda i: F.regexp_extract(plain, r"^(.+):([0-9]+)-([0-9]+)$", i)
    start, end = part(2).try_cast("long"), part(3).try_cast("long")
    return F.when(start < end, F.struct(part(1).alias("chrom"), start.alias("start"), end.alias("end")))


def pack(bases: Column) -> Column:
    """Two bits a base, A C G T; null for other letters."""
    return F.when(bases.rlike("^[ACGT]{1,16}$"), F.conv(F.translate(bases, "ACGT", "0123"), 4, 10).cast("long"))


def hamming_one(a: Column, b: Column) -> Column:
    """Packed sequences (up to 12 bases) that differ in exactly one base."""
    x = a.bitwiseXOR(b)
    return F.bit_count((x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(5592405))) == 1


def unversion(gene: Column) -> Column:
    return F.regexp_replace(gene, r"\.[0-9]+$", "")


def unpack(code: Column, length: int) -> Column:
    """The bases of a packed sequence of that length."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 4), length, "0")
    return F.translate(digits, "0123", "ACGT")
