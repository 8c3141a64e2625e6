"""From alignments to records: CIGAR geometry, barcode correction, and the reductions of a class's reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.evidence import junctions, placements, span_end, span_start

BLOCKS = "array<struct<start:bigint,end:bigint>>"
STATE = f"struct<done:{BLOCKS},start:bigint,end:bigint,ref:bigint>"
#: Least share of the posterior that a corrected barcode needs; the largest quality that counts.
POSTERIOR, MOST_QUALITY, BARCODE = 0.975, 33, 16
#: Parts of a barcode that are left out in turn; the byte of a quality that is not given.
QUARTERS, MISSING = 4, 127


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Blocks of an alignment that starts at pos (0-based): N splits, M = X and D extend, other operations take no reference."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))

    def step(s: Column, o: Column) -> Column:
        n, op = o["n"], o["op"]
        match, open_ = op.isin("M", "=", "X"), s["start"].isNotNull()
        skip = op == "N"
        done = F.when(skip & open_, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"])
        start = F.when(skip, None).when(match, F.coalesce(s["start"], s["ref"])).otherwise(s["start"])
        end = F.when(match, s["ref"] + n).when(op == "D", s["end"] + n).otherwise(s["end"])
        ref = s["ref"] + F.when(match | skip | (op == "D"), n).otherwise(0)
        return F.struct(done.alias("done"), start.alias("start"), end.alias("end"), ref.alias("ref")).cast(STATE)

    first = F.struct(F.array().cast(BLOCKS).alias("done"), F.lit(None).cast("long").alias("start"), pos.cast("long").alias("end"), pos.cast("long").alias("ref")).cast(STATE)
    last = lambda s: F.when(s["start"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(ops, first, step, last)


def correct_barcodes(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """reads (read, code, quals) with `cell`: the code itself if listed, else the neighbour at one base that holds enough of the posterior.

    Codes are 16 bases of two bits, the first base highest; quals has their 16 Phred values, or is null. A neighbour weighs
    (exact reads of it + 1) x the chance of an error at its base, 0.01 where the quality is missing. Codes one base apart
    agree in three of their four quarters: each is dealt four times, with one quarter left out, and meets its neighbours once
    and 255 others at most. Neither side is small by nature, so none is broadcast.
    """
    known = whitelist.select("code").distinct()
    listed = known.hint("merge")
    exact = reads.join(listed, "code", "left_semi")
    counts = known.join(exact.groupBy("code").agg(F.count("*").alias("n")).hint("merge"), "code", "left").select(F.col("code").alias("cell"), F.coalesce("n", F.lit(0)).alias("n"))

    def dealt(df: DataFrame, code: str, *columns: Column) -> DataFrame:
        kept = [F.col(code).bitwiseAND(F.lit(~(0xFF << (8 * (QUARTERS - 1 - k))))) for k in range(QUARTERS)]
        return df.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("quarter"), c.alias("rest"), *[f(k) for f in columns]) for k, c in enumerate(kept)])))

    def quality(k: int) -> Column:
        """The four qualities of a quarter, a byte each, MISSING for those that are not there."""
        each = [F.get("quals", F.lit(4 * k + i)) for i in range(4)]
        return sum(F.coalesce(F.when(q > MOST_QUALITY, MOST_QUALITY).when(q < 0, 0).otherwise(q), F.lit(MISSING)).cast("int") * (1 << 8 * i) for i, q in enumerate(each)).alias("q")

    a = dealt(reads.join(listed, "code", "left_anti"), "code", quality).select("read", "code", "x.*")
    b = dealt(counts, "cell").select("cell", "n", "x.*").hint("merge")
    d = F.col("code").bitwiseXOR(F.col("cell"))
    one = F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(0x55555555))) == 1
    base = BARCODE - 1 - F.floor((F.length(F.bin(d)) - 1) / 2).cast("int")
    q = F.expr("shiftright(q, cast(8 * (at % 4) as int)) & 255")
    error = F.when(q == MISSING, 0.01).otherwise(F.pow(F.lit(10.0), -q / 10.0))
    tried = a.join(b, ["quarter", "rest"]).where(one).withColumn("at", base).select("read", "code", "cell", ((F.col("n") + 1) * error).alias("w"))
    best = tried.groupBy("read", "code").agg(F.max_by("cell", "w").alias("cell"), (F.max("w") / F.sum("w")).alias("share")).where(F.col("share") > POSTERIOR)
    return exact.select("read", "code", F.col("code").alias("cell")).union(best.select("read", "code", "cell"))


def ordinals(rows: DataFrame) -> DataFrame:
    """Distinct records' keys with their place in genome order (chrom, anchor, cell, class, strand), from 0.

    Records number themselves within their anchor; what lies before an anchor is a running sum over anchors, of which a
    chromosome has a bounded number, and over chromosomes.
    """
    keys = rows.select("chrom", "anchor", "cell", "umi_class", "strand_rev").distinct()
    sizes = keys.groupBy("chrom", "anchor").agg(F.count("*").alias("n"))
    before = sizes.select("chrom", "anchor", (F.sum("n").over(Window.partitionBy("chrom").orderBy("anchor")) - F.col("n")).alias("inside"))
    chroms = sizes.groupBy("chrom").agg(F.sum("n").alias("n"))
    ahead = chroms.select("chrom", (F.sum("n").over(Window.orderBy("chrom")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("chrom", "anchor").orderBy("cell", "umi_class", "strand_rev")) - 1
    return keys.withColumn("own", own).join(before, ["chrom", "anchor"]).join(ahead, "chrom").withColumn("ordinal", F.col("own") + F.col("inside") + F.col("ahead")).drop("own", "inside", "ahead")


def chains(rows: DataFrame) -> DataFrame:
    """Per class, strand and junction chain: first and last geometry under (start, longest first), and how many were seen."""
    p = placements(rows, mm=False)
    order = F.struct(span_start(F.col("blocks")), -span_end(F.col("blocks")))
    return p.groupBy("cell", "umi_class", "chrom", "strand_rev", junctions(F.col("blocks")).alias("chain")).agg(F.min_by("blocks", order).alias("first"), F.max_by("blocks", order).alias("last"), F.count("*").alias("seen"))


def geometries(rows: DataFrame) -> DataFrame:
    """Every distinct geometry of a class with its multiplicity."""
    return placements(rows, mm=False).groupBy("cell", "umi_class", "chrom", "strand_rev", "blocks").agg(F.count("*").alias("seen"))


def signatures(rows: DataFrame) -> DataFrame:
    """Identical multimapping signatures of a class, their weights added up."""
    return rows.where(F.size("mms") > 0).groupBy("cell", "umi_class", "chrom", "strand_rev", "mms").agg(F.sum("weight").alias("weight"))


def splice_table(tx: DataFrame) -> DataFrame:
    """Junctions of an annotation with their strand, as seeds for an aligner."""
    return tx.select("chrom", "strand_rev", F.explode(junctions(F.col("exons"))).alias("j")).select("chrom", "strand_rev", "j.donor", "j.acceptor").distinct()


def cell_numbers(rows: DataFrame) -> DataFrame:
    """cell, n (molecules) and new_id of every cell: ids from 0 by descending n, ties by old id.

    Sorted by range and numbered from the partitions' sizes, so no task holds all cells.
    """
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "cell")
    kinds = counts.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", new_id long"
    return rows.sparkSession.createDataFrame(counts.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), kinds.replace(",", ", "))


def renumber_cells(rows: DataFrame) -> DataFrame:
    """rows with each molecule's cell replaced by its new id."""
    ids = cell_numbers(rows).select("cell", "new_id")
    return rows.join(ids, "cell").withColumn("cell", F.col("new_id")).select(*rows.columns)
