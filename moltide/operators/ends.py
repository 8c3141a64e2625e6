"""Transcript ends: windows anchored at a first site, nearest catalogue sites, tails, tests of end usage, internal priming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.evidence import span_end, span_start
from .queries import cells, islands, three_prime, umis
from .replay import interval_join

# Polyadenylation signals, best first
PAS = ["AATAAA", "ATTAAA", "TATAAA", "AGTAAA", "AAGAAA", "AATACA", "CATAAA", "GATAAA", "AATATA", "AATAGA", "ACTAAA", "AATGAA"]
#: Internal priming: A among the 20 bases behind the end, or the longest run of A within 140.
IP_COUNT, IP_RUN = 12, 8


def anchored_windows(points: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """Windows [first, first + gap] that start at the first point outside the window before; not transitive.

    No window reaches over a distance above gap, so that points are cut into islands first and only an island's distinct
    points are folded together.
    """
    cut = islands(points.select(*by, at).distinct(), by, at, gap)
    sites = F.array_sort(F.collect_list(F.col(at).cast("long")))
    kind = "array<struct<first:bigint,last:bigint,points:bigint>>"

    def step(done: Column, x: Column) -> Column:
        now = F.element_at(done, -1)
        inside = F.when(F.size(done) > 0, x <= now["first"] + gap).otherwise(False)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(now["first"].alias("first"), x.alias("last"), (now["points"] + 1).alias("points"))))
        return F.when(inside, longer).otherwise(F.concat(done, F.array(F.struct(x.alias("first"), x.alias("last"), F.lit(1).cast("long").alias("points"))))).cast(kind)

    with_try = lambda done, x: F.when(F.size(done) == 0, F.array(F.struct(x.alias("first"), x.alias("last"), F.lit(1).cast("long").alias("points"))).cast(kind)).otherwise(step(done, x))
    folded = cut.groupBy(*by, "island").agg(F.aggregate(sites, F.array().cast(kind), with_try).alias("w"))
    return folded.select(*by, F.explode("w").alias("w")).select(*by, F.col("w.first").alias("start"), (F.col("w.last") + 1).alias("end"), "w.points")


def nearest(points: DataFrame, catalogue: DataFrame, by: list[str]) -> DataFrame:
    """points (by, point) with the distance to the nearest site of the catalogue (by, site), null if there is none.

    Both are put in one order, and the last site before and the first one after are carried along.
    """
    both = points.select(*by, F.col("point").alias("at"), F.lit(None).cast("long").alias("site")).union(catalogue.select(*by, F.col("site").alias("at"), F.col("site").cast("long")))
    w = Window.partitionBy(*by).orderBy("at")
    back = F.last("site", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("site", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    return both.withColumn("b", back).withColumn("a", ahead).where("site is null").select(*by, F.col("at").alias("point"), F.least(F.col("at") - F.col("b"), F.col("a") - F.col("at")).alias("distance"))


def tail_clusters(rows: DataFrame, gap: int = 25) -> DataFrame:
    """Terminal tails clustered by strand: span, summit (most UMIs, then lower), UMIs, cells and samples."""
    tails = rows.where("tail is not null").select("chrom", "strand_rev", F.col("tail").alias("at"), "umi_class", "cell", "sample").distinct()
    counted = tails.groupBy("chrom", "strand_rev", "at").agg(F.count_distinct("umi_class").alias("n"))
    cut = islands(counted, ["chrom", "strand_rev"], "at", gap)
    by = ["chrom", "strand_rev", "island"]
    shape = cut.groupBy(*by).agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.max_by("at", F.struct("n", -F.col("at"))).alias("summit"))
    held = tails.join(cut.select(*by, "at"), ["chrom", "strand_rev", "at"]).groupBy(*by).agg(umis(), cells(), F.count_distinct("sample").alias("samples"))
    return shape.join(held, by).drop("island")


def g_statistic(counts: DataFrame, by: list[str], row: str, column: str, n: str) -> DataFrame:
    """Likelihood-ratio statistic and degrees of freedom of each table of counts (by, row, column, n); zero cells may be missing."""
    live = counts.where(F.col(n) > 0)
    t = [live.groupBy(*by, *c).agg(F.sum(n).alias(name)) for c, name in (([row], "r"), ([column], "c"), ([], "t"))]
    cell = live.join(t[0], [*by, row]).join(t[1], [*by, column]).join(t[2], by)
    part = 2 * F.col(n) * F.ln(F.col(n) * F.col("t") / (F.col("r") * F.col("c")))
    df = (F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)
    return cell.groupBy(*by).agg(F.greatest(F.sum(part), F.lit(0.0)).alias("g"), df.alias("df"))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution with k degrees of freedom: closed sums for even and odd k."""
    import math

    if x <= 0:
        return 1.0
    h = x / 2
    if k % 2 == 0:
        term = total = math.exp(-h)
        for i in range(1, k // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (k + 1) // 2):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def end_tests(rows: DataFrame, tx: DataFrame, gap: int = 24, least_site: int = 5, least_gene: int = 20, group: str = "grp", extend: int = 0) -> DataFrame:
    """Genes whose 3' sites are used unevenly by groups: sites, UMIs, G and degrees of freedom.

    A gene's window is its span, `extend` longer at its 3' end; points count once per point, cell and class.
    """
    span = tx.groupBy("chrom", "gene_id", "strand_rev").agg(F.min(span_start(F.col("exons"))).alias("s"), F.max(span_end(F.col("exons"))).alias("e"))
    genes = span.select("chrom", "strand_rev", "gene_id", (F.col("s") - F.when(F.col("strand_rev"), extend).otherwise(0)).alias("bstart"), (F.col("e") + F.when(F.col("strand_rev"), 0).otherwise(extend)).alias("bend"))
    points = three_prime(rows).select("chrom", "strand_rev", "point", group, "cell", "umi_class").distinct().groupBy("chrom", "strand_rev", "point", group).agg(F.count("*").alias("n"))
    inside = interval_join(points.withColumn("start", F.col("point")).withColumn("end", F.col("point") + 1), genes, ["chrom", "strand_rev"])
    sites = islands(inside.select("gene_id", "point").distinct(), ["gene_id"], "point", gap)
    table = inside.join(sites, ["gene_id", "point"]).groupBy("gene_id", "island", group).agg(F.sum("n").alias("n"))
    big = table.groupBy("gene_id", "island").agg(F.sum("n").alias("site")).where(F.col("site") >= least_site)
    genes_kept = big.groupBy("gene_id").agg(F.count("*").alias("sites"), F.sum("site").alias("umis")).where((F.col("umis") >= least_gene) & (F.col("sites") >= 2))
    kept = table.join(big.select("gene_id", "island"), ["gene_id", "island"]).join(genes_kept.select("gene_id"), "gene_id")
    return g_statistic(kept, ["gene_id"], "island", group, "n").join(genes_kept, "gene_id").where("df > 0")


def priming(sequence: Column, point: Column) -> Column:
    """Of the bases behind a forward end: A among 20, the longest run of A in 140, and whether the site may be internal priming."""
    behind = F.substring(sequence, point + 1, F.lit(140))
    first = F.left(behind, F.lit(20))
    a20 = F.char_length(first) - F.char_length(F.replace(first, F.lit("A"), F.lit("")))
    run = F.coalesce(F.array_max(F.transform(F.split(F.regexp_replace(behind, "[^A]", " "), " "), F.char_length)), F.lit(0))
    return F.struct(a20.alias("a20"), run.alias("run"), ((a20 >= IP_COUNT) | (run >= IP_RUN)).alias("internal"))


def signal(sequence: Column, point: Column) -> Column:
    """The best polyadenylation signal 60 to 5 bases before a forward end, or null."""
    start = F.greatest(point - 60, F.lit(0))
    before = F.substring(sequence, start + 1, F.greatest(point - 5 - start, F.lit(0)))
    return F.coalesce(*[F.when(F.contains(before, F.lit(m)), m) for m in PAS])
