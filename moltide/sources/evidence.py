"""Molecular evidence as DataFrames: one row per molecule record, its placements nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Genomic width of an access bin, and of the bins by which intervals meet in joins.
CHUNK, TILE = 4_000_000, 4_096


def block(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def junctions(blocks: Column) -> Column:
    """Gaps between consecutive blocks."""
    return F.transform(F.slice(blocks, 2, 1_000_000), lambda b, i: F.struct(F.get(blocks, i)["end"].alias("donor"), b["start"].alias("acceptor")))


def span_start(blocks: Column) -> Column:
    return F.get(blocks, F.lit(0))["start"]


def span_end(blocks: Column) -> Column:
    return F.element_at(blocks, -1)["end"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What records are made of (see records), a few short columns each. Only the columns named reach the scans.

    Lines are cut to what is used before they are joined, and orders meet the dimension tables first, being fewer.
    """
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linestatus").select(
        "l_orderkey", F.concat(F.lit("chr"), (F.col("l_partkey") % 3 + 1).cast("int").cast("string")).alias("chrom"), (F.col("l_linestatus") == "F").alias("strand_rev"),
        (F.pmod("l_suppkey", F.lit(20)) * 200 + 80).cast("long").alias("anchor"), F.col("l_linenumber").cast("long").alias("weight"), (F.col("l_quantity").cast("long") % 3).cast("int").alias("n_junc"),
        (F.col("l_partkey") % 4 * 100).cast("long").alias("shift"), (F.col("l_tax") > 0.075).alias("is_mm"), (F.col("l_discount") > 0.085).alias("has_tail"),
    )
    owners = (
        read("orders", "o_orderkey", "o_custkey")
        .join(read("customer", "c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    joined = lines.join(owners.select("o_orderkey", "c_custkey", "r_name", "c_mktsegment"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("r_name").alias("sample"), F.col("c_custkey").cast("long").alias("cell"), F.col("c_mktsegment").alias("grp"), F.col("l_orderkey").cast("long").alias("umi_class"), "chrom", "strand_rev", "anchor", "weight", "n_junc", "shift", "is_mm", "has_tail")


def shaped(made: DataFrame) -> DataFrame:
    """made (see base, and whatever else it has) with reps, mms and tail in place of what they are made of."""
    p, d, n = F.col("anchor"), F.col("shift"), F.col("n_junc")
    first = F.slice(F.array(block(p, p + 20), block(p + 100 + d, p + 120 + d), block(p + 200 + d, p + 220 + d)), F.lit(1), n + 1)
    second = F.slice(F.array(block(p + 5, p + 20 + F.when(n == 0, 2).otherwise(0)), block(p + 100 + d, p + 120 + d + F.when(n == 1, 3).otherwise(0)), block(p + 200 + d, p + 223 + d)), F.lit(1), n + 1)
    none = F.array().cast("array<array<struct<start:bigint,end:bigint>>>")
    reps = F.when(F.col("is_mm"), none).when(F.col("weight") > 1, F.array(first, second)).otherwise(F.array(first))
    tail = F.when(F.col("has_tail"), F.when(F.col("strand_rev"), p).otherwise(span_end(first)))
    kept = [c for c in made.columns if c not in ("n_junc", "shift", "is_mm", "has_tail")]
    return made.select(*kept, reps.alias("reps"), F.when(F.col("is_mm"), F.array(first)).otherwise(none).alias("mms"), tail.alias("tail"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records projected from the order tables: sample, cell, grp, umi_class, chrom, strand_rev, anchor, weight, reps, mms, tail.

    reps and mms are arrays of placements, each an array of blocks. A record has one or two representatives of one chain of
    `weight` reads, or one multimapping signature. tail is the anchor of a terminal tail, or null.
    """
    return shaped(base(spark, sf_dir))


def placements(rows: DataFrame, mm: bool = True) -> DataFrame:
    """One row per representative and, with mm, per primary placement of a multimapping signature."""
    return rows.withColumn("blocks", F.explode(F.concat("reps", "mms") if mm else F.col("reps"))).drop("reps", "mms")


def junction_rows(rows: DataFrame, mm: bool = True) -> DataFrame:
    """One row per junction of each placement."""
    return placements(rows, mm).withColumn("j", F.explode(junctions(F.col("blocks")))).select("*", "j.donor", "j.acceptor").drop("j")


def annotation(spark: SparkSession, slots: int = 20, isoforms: int = 3) -> DataFrame:
    """Transcripts of a generated annotation: chrom, gene_id, transcript_id, strand_rev and exons."""
    k, j = F.col("k"), F.col("j")
    grid = spark.range(slots).withColumnRenamed("id", "k").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(isoforms - 1)))).withColumn("chrom", F.explode(F.array(F.lit("chr1"), F.lit("chr2"), F.lit("chr3"))))
    slot = F.floor(k / 2).cast("long")
    exons = F.array(block(k * 200 + 50, k * 200 + 100), block(k * 200 + 180 + 100 * j, k * 200 + 200 + 100 * j), block(k * 200 + 280 + 100 * j, k * 200 + 340 + 100 * j))
    return grid.select("chrom", F.concat("chrom", F.lit(":g"), slot.cast("string")).alias("gene_id"), F.concat("chrom", F.lit(":t"), k.cast("string"), F.lit("."), j.cast("string")).alias("transcript_id"), (slot % 2 == 1).alias("strand_rev"), exons.alias("exons"))
