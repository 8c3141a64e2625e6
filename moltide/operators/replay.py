"""Replay of an annotation over evidence: candidates, one-gene rule, best gene, UMI collapse, and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import hamming_one
from ..sources.archive import stored
from ..sources.evidence import TILE, junctions, placements, span_end, span_start


def tiles(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / TILE), F.floor((end - 1) / TILE))


def interval_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a (start, end) and b (bstart, bend) that overlap, as an equi-join on tiles: no pair appears twice."""
    a = a.withColumn("tile", F.explode(tiles(F.col("start"), F.col("end"))))
    b = b.withColumn("tile", F.explode(tiles(F.col("bstart"), F.col("bend"))))
    first = F.floor(F.greatest("start", "bstart") / TILE) == F.col("tile")
    return a.join(b, [*keys, "tile"]).where((F.col("start") < F.col("bend")) & (F.col("bstart") < F.col("end")) & first).drop("tile")


def concordant(blocks: Column, exons: Column) -> Column:
    """Every block lies in an exon, and every junction is one of consecutive exons."""
    inside = F.forall(blocks, lambda b: F.exists(exons, lambda e: (b["start"] >= e["start"]) & (b["end"] <= e["end"])))
    spliced = F.forall(junctions(blocks), lambda j: F.array_contains(junctions(exons), j))
    return inside & spliced


#: What decides which genes fit a record.
GEOMETRY = ["chrom", "strand_rev", "reps", "mms"]
#: Geometries that are sent to all tasks; more of them meet the records in a shuffle.
MOST_SHAPES = 50_000


def fitting(shapes: DataFrame, tx: DataFrame, of: str = "gene_id", strand: str = "forward", full: bool = False) -> DataFrame:
    """shapes (distinct GEOMETRY, and more) with `found`: for each placement the sorted set of genes or transcripts (`of`) that fit.

    full: a block that overlaps the gene's span is enough, as for intron-inclusive counts. Without it what fits covers the
    placement, so that the tile of its first base is enough. Shapes without placements have no row.
    """
    t = tx.withColumnRenamed("strand_rev", "gene_rev")
    p = shapes.select("*", F.posexplode(F.concat("reps", "mms")).alias("place", "blocks"))
    if full:
        t = t.groupBy("chrom", "gene_id", "gene_rev").agg(F.min(span_start(F.col("exons"))).alias("bstart"), F.max(span_end(F.col("exons"))).alias("bend"))
        fits = F.exists("blocks", lambda b: (b["start"] < F.col("bend")) & (b["end"] > F.col("bstart")))
        p = p.withColumn("tile", F.explode(tiles(span_start(F.col("blocks")), span_end(F.col("blocks")))))
    else:
        t = t.select("chrom", "gene_rev", "exons", of).withColumn("bstart", span_start(F.col("exons"))).withColumn("bend", span_end(F.col("exons")))
        fits = concordant(F.col("blocks"), F.col("exons"))
        p = p.withColumn("tile", F.floor(span_start(F.col("blocks")) / TILE))
    same = {"forward": F.col("strand_rev") == F.col("gene_rev"), "reverse": F.col("strand_rev") != F.col("gene_rev"), "unstranded": F.lit(True)}[strand]
    t = t.withColumn("tile", F.explode(tiles(F.col("bstart"), F.col("bend"))))
    each = p.join(t, ["chrom", "tile"], "left").groupBy(*shapes.columns, "place").agg(F.array_sort(F.collect_set(F.when(same & fits, F.col(of)))).alias("ids"))
    return each.groupBy(*shapes.columns).agg(F.collect_list("ids").alias("found"))


def looked_up(rows: DataFrame, tx: DataFrame, columns: dict[str, Column], most: int = MOST_SHAPES, **how) -> DataFrame:  # noqa: ANN003
    """rows with columns made of `found` (see fitting), decided once for each distinct geometry; rows without placements are left out."""
    table = stored(fitting(rows.select(*GEOMETRY).distinct(), tx, **how).select(*[F.col(c).alias(f"__{c}") for c in GEOMETRY], *[v.alias(k) for k, v in columns.items()]))
    table = F.broadcast(table) if table.count() <= most else table.hint("merge")
    same = F.lit(True)
    for c in GEOMETRY:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}")) if c in ("chrom", "strand_rev") else F.col(c) == F.col(f"__{c}")
    return rows.join(table, same).drop(*[f"__{c}" for c in GEOMETRY])


def assigned(rows: DataFrame, tx: DataFrame, strand: str = "forward", full: bool = False, most: int = MOST_SHAPES) -> DataFrame:
    """sample, cell, umi_class, weight, gene_id and copies: how many of a record's placements fit this gene and no other."""
    one = F.transform(F.filter("found", lambda x: F.size(x) == 1), lambda x: F.get(x, F.lit(0)))
    genes = F.transform(F.array_distinct(one), lambda g: F.struct(g.alias("gene_id"), F.size(F.filter(one, lambda x: x == g)).cast("long").alias("copies")))
    return looked_up(rows, tx, {"genes": genes}, most, strand=strand, full=full).select("sample", "cell", "umi_class", "weight", F.explode("genes").alias("g")).select("sample", "cell", "umi_class", "weight", "g.gene_id", "g.copies")


def gene_rows(rows: DataFrame, tx: DataFrame, strand: str = "forward", full: bool = False) -> DataFrame:
    """Evidence rows (placements, each with its chain's whole weight) with their gene, where exactly one fits."""
    return assigned(rows, tx, strand, full).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def best_gene(found: DataFrame) -> DataFrame:
    """The gene of each class: most weight, ties to the smaller id. Both steps run where a class's rows have been dealt."""
    sums = found.select("cell", "umi_class", "gene_id", "weight").repartition("cell", "umi_class").groupBy("cell", "umi_class", "gene_id").agg(F.sum("weight").alias("w"))
    return sums.groupBy("cell", "umi_class").agg(F.min_by("gene_id", F.struct(-F.col("w"), "gene_id")).alias("gene_id"), F.max("w").alias("w"))


#: Bases of a class that count, by the masks of the parts that are left out in turn.
LOW, PARTS = 0xFFFFFF, [0x3F << (6 * k) for k in range(4)]


def dealt(classes: DataFrame) -> DataFrame:
    """classes four times, each without one quarter of the twelve bases: classes one base apart meet once (part, rest), with few others."""
    low = F.col("umi_class").bitwiseAND(F.lit(LOW))
    return classes.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), low.bitwiseAND(F.lit(LOW & ~mask)).alias("rest")) for k, mask in enumerate(PARTS)]))).select(*classes.columns, "x.part", "x.rest")


def umi_edges(rows: DataFrame) -> DataFrame:
    """Classes of a cell that differ in one base of the last twelve, whatever is before those."""
    c = dealt(rows.select("cell", "umi_class").distinct())
    a, b = (c.withColumnRenamed("umi_class", n) for n in "ab")
    return a.join(b.hint("merge"), ["cell", "part", "rest"]).where((F.col("a") < F.col("b")) & hamming_one(F.col("a"), F.col("b"))).select("cell", "a", "b")


def outranked(best: DataFrame, edges: DataFrame | None) -> DataFrame:
    """cell, gene_id, a, and b with its weight wb: neighbours of the same cell and gene of which b ranks before a (more weight, then smaller class).

    Without edges the neighbours are found within each cell and gene.
    """
    before = F.expr("wb > wa or wb = wa and b < a")
    if edges is None:
        c = dealt(best.select("cell", "gene_id", "umi_class", "w"))
        a, b = (c.withColumnRenamed("umi_class", n).withColumnRenamed("w", f"w{n}") for n in "ab")
        met = a.join(b.hint("merge"), ["cell", "gene_id", "part", "rest"]).where(before & hamming_one(F.col("a"), F.col("b")))
    else:
        both = edges.union(edges.select("cell", F.col("b").alias("a"), F.col("a").alias("b")))
        mine = best.select("cell", "gene_id", F.col("umi_class").alias("a"), F.col("w").alias("wa"))
        other = best.select("cell", "gene_id", F.col("umi_class").alias("b"), F.col("w").alias("wb"))
        met = mine.join(both, ["cell", "a"]).join(other, ["cell", "gene_id", "b"]).where(before)
    return met.select("cell", "gene_id", "a", "b", "wb")


def collapse(best: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """UMIs of each cell and gene: classes without a neighbour that ranks before them. The first-ranked class of each stays."""
    absorbed = outranked(best, edges).select("cell", "gene_id", "a").distinct()
    counts = best.select("cell", "gene_id", F.lit(1).cast("long").alias("n")).union(absorbed.select("cell", "gene_id", F.lit(-1).cast("long")))
    return counts.groupBy("cell", "gene_id").agg(F.sum("n").alias("umis"))


def best_of(rows: DataFrame, tx: DataFrame, strand: str = "forward", full: bool = False) -> DataFrame:
    return best_gene(assigned(rows, tx, strand, full).withColumn("weight", F.col("weight") * F.col("copies")))


def gene_counts(rows: DataFrame, tx: DataFrame, strand: str = "forward", full: bool = False) -> DataFrame:
    return collapse(best_of(rows, tx, strand, full))


def compare(rows: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts under two annotations where they differ."""
    x, y = (gene_counts(rows, t).withColumnRenamed("umis", n) for t, n in ((a, "annotation_a_count"), (b, "annotation_b_count")))
    both = x.join(y, ["cell", "gene_id"], "full_outer").fillna(0, ["annotation_a_count", "annotation_b_count"])
    return both.withColumn("signed_delta_b_minus_a", F.col("annotation_b_count") - F.col("annotation_a_count")).where("signed_delta_b_minus_a <> 0")


def benjamini_hochberg(df: DataFrame, p: str, to: str = "q", by: list[str] | None = None) -> DataFrame:
    """q-values: the running minimum of p n / rank from the largest p on."""
    w = Window.partitionBy(*(by or []))
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(p))).withColumn("__n", F.count("*").over(w))
    down = w.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(to, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down))).drop("__r", "__n")


def audit(rows: DataFrame, tx: DataFrame) -> DataFrame:
    """Evidence rows and their read weight by whether no gene, one gene or more fit; records of one geometry are counted together."""
    shapes = rows.groupBy(*GEOMETRY).agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    bucket = F.when(F.size("ids") == 0, "none").when(F.size("ids") == 1, "single").otherwise("multi")
    return fitting(shapes, tx).select("n", "w", F.explode("found").alias("ids")).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("rows_"), F.sum("w").alias("reads"))


def fates(rows: DataFrame, tx: DataFrame) -> DataFrame:
    """Classes of each cell by the genes that fit their rows."""
    some = {"one": F.exists("found", lambda x: F.size(x) == 1), "more": F.exists("found", lambda x: F.size(x) > 1)}
    fate = F.when(F.col("one") & F.col("more"), "mixed").when(F.col("one"), "single").when(F.col("more"), "multi_only").otherwise("no_gene")
    classes = looked_up(rows, tx, some).groupBy("cell", "umi_class").agg(*[F.max(c).alias(c) for c in some])
    return classes.groupBy(fate.alias("fate")).agg(F.count("*").alias("classes"), F.count_distinct("cell").alias("cells"))


def equivalence_classes(rows: DataFrame, tx: DataFrame) -> DataFrame:
    """Transcript equivalence classes: the transcripts that fit every row of a class, with how many classes and cells have them.

    A class with a row that nothing fits has no compatible set, and one whose rows share no transcript is in conflict. A
    record brings what its placements share.
    """
    shared = lambda sets: F.aggregate(sets, F.get(sets, F.lit(0)), F.array_intersect)
    names = F.array_join(shared(F.col("found")), "\n")
    c = looked_up(rows, tx, {"unmatched": F.exists("found", lambda x: F.size(x) == 0), "names": names}, of="transcript_id")
    met = c.select("cell", "umi_class", "unmatched", "names").repartition("cell", "umi_class").groupBy("cell", "umi_class")
    each = met.agg(F.max("unmatched").alias("unmatched"), F.collect_set("names").alias("sets"))
    # of one set nothing is compared; those of a class are few
    split = F.transform("sets", lambda x: F.filter(F.split(x, "\n"), lambda y: y != ""))
    ts = F.when(F.size("sets") == 1, F.get("sets", F.lit(0))).otherwise(F.array_join(shared(split), "\n"))
    each = each.select("cell", F.when(F.col("unmatched"), None).otherwise(ts).alias("ts"))
    status = F.when(F.col("ts").isNull(), "no_compatible").when(F.col("ts") == "", "conflict").otherwise("assigned")
    sets = each.groupBy(status.alias("status"), F.nullif("ts", F.lit("")).alias("ts")).agg(F.count("*").alias("classes"), F.count_distinct("cell").alias("cells"))
    return sets.select("status", F.sha2(F.replace("ts", F.lit("\n"), F.lit(",")), 256).alias("ec_id"), F.coalesce(F.size(F.split("ts", "\n")), F.lit(0)).alias("transcripts"), "classes", "cells")


def versus(blocks: Column, exons: Column) -> Column:
    """How a placement lies to a transcript: Concordant, ExonIntron, Intron, ExonIntronSpan or Incompatible."""
    inside = lambda b: F.exists(exons, lambda e: (b["start"] >= e["start"]) & (b["end"] <= e["end"]))
    off = lambda b: F.forall(exons, lambda e: (b["end"] <= e["start"]) | (b["start"] >= e["end"]))
    beyond = (span_start(blocks) < span_start(exons)) | (span_end(blocks) > span_end(exons))
    spliced = F.forall(junctions(blocks), lambda j: F.array_contains(junctions(exons), j))
    crossing = F.exists(blocks, lambda b: ~inside(b) & ~off(b))
    state = F.when(beyond | ~spliced, "Incompatible").when(crossing, "ExonIntronSpan").when(F.forall(blocks, inside), "Concordant")
    return state.when(F.exists(blocks, inside), "ExonIntron").otherwise("Intron")


def states(rows: DataFrame, tx: DataFrame) -> DataFrame:
    """Distinct placements (with `copies`) and transcripts of either strand whose spans meet, and how they lie to each other."""
    p = placements(rows).groupBy("chrom", "strand_rev", "blocks").agg(F.count("*").alias("copies"))
    p = p.withColumn("start", span_start(F.col("blocks"))).withColumn("end", span_end(F.col("blocks")))
    t = tx.withColumnRenamed("strand_rev", "gene_rev").withColumn("bstart", span_start(F.col("exons"))).withColumn("bend", span_end(F.col("exons")))
    return interval_join(p, t, ["chrom"]).withColumn("state", versus(F.col("blocks"), F.col("exons")))


def survivors(best: DataFrame, edges: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """cell, gene_id, umi_class and survivor: the class into which each one collapses, step by step to its first-ranked neighbour.

    Every class with a neighbour of the same cell and gene that ranks before it points to the first of those; these pointers
    alone are doubled until none moves, and each round's table ends the lineage. All other classes survive.
    """
    now = outranked(best, edges).groupBy("cell", "gene_id", "a").agg(F.min_by("b", F.struct(-F.col("wb"), "b")).alias("to")).checkpoint()
    for _ in range(rounds):
        step = now.select("cell", "gene_id", F.col("a").alias("to"), F.col("to").alias("next"))
        moved = now.join(step, ["cell", "gene_id", "to"], "left").select("cell", "gene_id", "a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")).checkpoint()
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            found = best.join(now.withColumnRenamed("a", "umi_class"), ["cell", "gene_id", "umi_class"], "left")
            return found.select("cell", "gene_id", "umi_class", F.coalesce("to", "umi_class").alias("survivor"))
    raise RuntimeError(f"survivors still move after {rounds} rounds")
