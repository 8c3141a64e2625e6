"""Text inputs: annotations, sequences, barcode lists, groups, plans, designs, site catalogues, federations, metadata.

A file that breaks its rules raises InputError with the first lines that do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import parse_locus

MOST_REQUESTS, BARCODE = 100_000, 16
BLOCKS = "array<struct<start:bigint,end:bigint>>"


class InputError(ValueError):
    pass


def refuse(bad: DataFrame, why: str) -> None:
    if found := [tuple(r) for r in bad.limit(3).collect()]:
        raise InputError(f"{why}: {found}")


def unique(df: DataFrame, *columns: str) -> None:
    refuse(df.groupBy(*columns).count().where("count > 1"), f"repeated {', '.join(columns)}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """at (from 0) and line of a small file, without blank lines and comments."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return text.where("trim(line) <> '' and line not like '#%'")


def tabbed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """at and the columns of a file whose first line names them."""
    lines = numbered_lines(spark, path).withColumn("x", F.split("line", "\t"))
    head = lines.orderBy("at").first()
    if head is None or head.x != columns:
        raise InputError(f"the header is {head and head.x}, not {columns}")
    body = lines.where(F.col("at") > head["at"])
    refuse(body.where(F.size("x") != len(columns)).select("line"), "lines with another number of fields")
    return body.select("at", *[F.get("x", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def barcodes(spark: SparkSession, path: str, length: int = BARCODE) -> DataFrame:
    """barcode: the distinct lines of that length."""
    return spark.read.text(path).select(F.trim("value").alias("barcode")).where(F.length("barcode") == length).distinct()


def cells(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """barcode of each line; repeated ones, and those that `known` (barcode) lacks, are errors."""
    found = numbered_lines(spark, path).select(F.trim("line").alias("barcode"))
    unique(found, "barcode")
    if known is not None:
        refuse(found.join(known, "barcode", "left_anti"), "unknown barcodes")
    return found


def groups(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """barcode, grp and the group's rank by its first line, from lines `barcode<TAB>group`."""
    lines = numbered_lines(spark, path).withColumn("x", F.split("line", "\t"))
    refuse(lines.where("size(x) <> 2 or trim(x[0]) = '' or trim(x[1]) = ''").select("line"), "not a barcode and a group")
    found = lines.select("at", F.trim(F.get("x", F.lit(0))).alias("barcode"), F.trim(F.get("x", F.lit(1))).alias("grp"))
    unique(found, "barcode")
    if known is not None:
        refuse(found.join(known, "barcode", "left_anti").select("barcode"), "unknown barcodes")
    first = found.groupBy("grp").agg(F.min("at").alias("first"))
    order = F.array_sort(F.collect_list("first").over(_all()))
    rank = first.select("grp", (F.array_position(order, F.col("first")) - 1).cast("int").alias("rank"))
    return found.join(rank, "grp").select("barcode", "grp", "rank")


def _all():  # noqa: ANN202
    """Over all groups of one small file."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def batch_plan(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, chrom, start, end of the requests of a plan with the header id, kind, locus."""
    rows = tabbed(spark, path, ["id", "kind", "locus"])
    if (n := rows.count()) > MOST_REQUESTS:
        raise InputError(f"{n} requests; {MOST_REQUESTS} are allowed")
    unique(rows, "id")
    refuse(rows.where("kind not in ('region', 'junction')").select("id", "kind"), "unknown kinds")
    found = rows.withColumn("l", parse_locus(F.col("locus")))
    refuse(found.where("l is null").select("id", "locus"), "not a locus")
    return found.select("id", "kind", "l.chrom", "l.start", "l.end")


def design(spark: SparkSession, path: str, columns: list[str], once: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The rows of a design; the columns `once` hold no value twice."""
    rows = tabbed(spark, path, columns)
    refuse(rows.where(" or ".join(f"trim({c}) = ''" for c in columns)).select(*columns), "empty fields")
    for c in once:
        unique(rows, c)
    return rows.select(*columns)


def sites(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand_rev, start, end, name and score of the sites of a BED file, packed or not."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, end long, name string, score double, strand string")
    refuse(rows.where("chrom is null or start is null or end is null or start < 0 or end <= start or strand is null or strand not in ('+', '-')"), "not a site")
    return rows.select("chrom", (F.col("strand") == "-").alias("strand_rev"), "start", "end", "name", "score")


def attribute(name: str) -> Column:
    found = F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "([^"]*)"', 1)
    return F.when(found != "", found)


def merged(blocks: Column) -> Column:
    """Sorted blocks of which those that touch or overlap are one."""

    def add(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        meets = F.when(F.size(done) > 0, b["start"] <= last["end"]).otherwise(False)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], b["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(b))).cast(BLOCKS)

    # the first block is there before the fold, as no last one may be asked of none
    rest = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.aggregate(rest, F.slice(blocks, F.lit(1), F.lit(1)).cast(BLOCKS), add)


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, gene_id, gene_name, transcript_id, strand_rev and exons (0-based, merged) of the transcripts of a GTF."""
    line = F.split("value", "\t")
    rows = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select("value", line.alias("x"))
    rows = rows.where(F.get("x", F.lit(2)) == "exon").select("value", *[F.get("x", F.lit(k)).alias(c) for k, c in ((0, "chrom"), (3, "first"), (4, "last"), (6, "strand"), (8, "attributes"))])
    rows = rows.withColumn("first", F.col("first").try_cast("long")).withColumn("last", F.col("last").try_cast("long")).withColumn("gene_id", attribute("gene_id")).withColumn("transcript_id", attribute("transcript_id")).withColumn("gene_name", attribute("gene_name"))
    refuse(rows.where("first is null or last is null or first < 1 or last < first or strand is null or strand not in ('+', '-') or gene_id is null or transcript_id is null").select("value"), "not an exon")
    block = F.struct((F.col("first") - 1).alias("start"), F.col("last").alias("end"))
    tx = rows.groupBy("chrom", "gene_id", "transcript_id", (F.col("strand") == "-").alias("strand_rev")).agg(F.min("gene_name").alias("gene_name"), F.array_sort(F.collect_list(block)).alias("exons"))
    return tx.select("chrom", "gene_id", "gene_name", "transcript_id", "strand_rev", merged(F.col("exons")).alias("exons"))


def resolve(tx: DataFrame, names: DataFrame) -> DataFrame:
    """name, how it was found (id, unversioned or symbol) and gene_id: the first way that finds a gene; several genes are an error."""
    genes = tx.select("gene_id", "gene_name").distinct()
    plain = F.regexp_replace("gene_id", r"\.[0-9]+$", "")
    ways = genes.select(F.col("gene_id").alias("name"), F.lit(0).alias("way"), "gene_id").union(genes.select(plain, F.lit(1), "gene_id")).union(genes.where("gene_name is not null").select("gene_name", F.lit(2), "gene_id"))
    found = names.join(ways, "name").groupBy("name").agg(F.min_by(F.struct("way"), "way").alias("first")).select("name", "first.way").join(ways, ["name", "way"]).groupBy("name", "way").agg(F.collect_set("gene_id").alias("genes"))
    refuse(found.where("size(genes) > 1"), "ambiguous names")
    refuse(names.join(found, "name", "left_anti"), "unknown names")
    return found.select("name", F.get(F.array(F.lit("id"), F.lit("unversioned"), F.lit("symbol")), "way").alias("how"), F.get("genes", F.lit(0)).alias("gene_id"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, sequence (upper case) and sha256 of every contig; packed files are read too."""
    entry = F.regexp_replace("value", "\r", "")
    parts = spark.read.text(path, lineSep=">").select(F.split(entry, "\n", 2).alias("x")).where(F.trim(F.get("x", F.lit(0))) != "")
    out = parts.select(F.get(F.split(F.get("x", F.lit(0)), r"\s"), F.lit(0)).alias("contig"), F.upper(F.regexp_replace(F.coalesce(F.get("x", F.lit(1)), F.lit("")), r"\s", "")).alias("sequence"))
    unique(out, "contig")
    return out.withColumn("sha256", F.sha2("sequence", 256))


def federation(spark: SparkSession, path: str) -> DataFrame:
    """sample, path and metadata of the members of a federation; no sample and no path may come twice."""
    kinds = "schema_version int, assembly string, archives array<struct<sample:string,path:string,metadata:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("f")).select("f.*")
    refuse(rows.where("schema_version is null or schema_version <> 1 or archives is null"), "not a federation of version 1")
    members = rows.select("assembly", F.explode("archives").alias("a")).select("assembly", "a.*")
    unique(members, "sample")
    unique(members, "path")
    return members


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """sample, barcode and values (by column) of cells; each column's type is checked, and whether it may be missing."""
    kinds = "columns map<string,struct<type:string,optional:boolean>>, cells map<string,map<string,map<string,string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kinds).alias("m")).select("m.*")
    one = whole.select("columns", F.explode("cells").alias("sample", "c")).select("columns", "sample", F.explode("c").alias("barcode", "values"))
    refuse(one.where(F.exists(F.map_keys("values"), lambda k: ~F.array_contains(F.map_keys("columns"), k))).select("sample", "barcode"), "columns that are not declared")
    lacking = F.exists(F.map_entries("columns"), lambda e: ~F.coalesce(e["value"]["optional"], F.lit(False)) & F.element_at("values", e["key"]).isNull())
    refuse(one.where(lacking).select("sample", "barcode"), "a column is missing")
    fits = lambda v, t: F.when(t == "int", v.try_cast("long").isNotNull()).when(t == "float", v.try_cast("double").isNotNull()).when(t == "bool", v.isin("true", "false")).otherwise(t == "string")
    wrong = F.exists(F.map_entries("values"), lambda e: e["value"].isNotNull() & ~fits(e["value"], F.element_at("columns", e["key"])["type"]))
    refuse(one.where(wrong).select("sample", "barcode"), "values of another type")
    return one.select("sample", "barcode", "values")


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file of that text, in any of Spark's file systems; none is overwritten."""
    from .archive import file_system

    fs, target = file_system(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path
