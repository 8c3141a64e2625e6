"""Stored evidence: records in genomic bins, with the catalogues that plan queries over them.

An archive is a folder of Parquet tables: records (by sample, chrom and bin, sorted by anchor), junctions, chunks and tails.
It is written beside its final place and renamed into it, so that no reader meets half of one and none is overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evidence import CHUNK, base, junction_rows, shaped

PARTS = ["sample", "chrom", "bin"]
#: Records of a file. Small files are read together, with 4 MB counted for each: about 4 million records a task at most.
FILE_ROWS = 250_000


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and the executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/moltide-files"


def stored(df: DataFrame) -> DataFrame:
    """df written into the scratch folder and read back, so that it is computed once."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def install(spark: SparkSession, staged: str, path: str) -> None:
    """Move what is complete to its place; what is there already stays and is an error."""
    fs, source = file_system(spark, staged)
    _, target = file_system(spark, path)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise FileExistsError(path)


def write_archive(rows: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Store records; a bin's rows are dealt by anchor, so that a full bin is not one task.

    finish makes the rest of a record's columns once it is dealt, so that those are not shuffled. Files hold at most
    FILE_ROWS, which bounds what a task reads, and all its tables of keys, whatever the input.
    """
    spark = rows.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    binned = rows.withColumn("bin", F.floor(F.col("anchor") / CHUNK).cast("int"))
    finish(binned.repartitionByRange(*PARTS, "anchor").sortWithinPartitions(*PARTS, "anchor")).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*PARTS).parquet(f"{staged}/records")
    kept = spark.read.parquet(f"{staged}/records")
    shapes = kept.groupBy(*PARTS, "reps", "mms").agg(F.count("*").alias("n"))  # junctions are found once for each geometry
    supported = junction_rows(shapes).groupBy("sample", "chrom", "donor", "acceptor").agg(F.sum("n").alias("supporting_children"), F.array_sort(F.collect_set("bin")).alias("bins"))
    supported.write.partitionBy("chrom").parquet(f"{staged}/junctions")
    kept.groupBy(*PARTS).agg(F.count("*").alias("n_mols"), F.max("anchor").alias("max_anchor")).withColumn("bin_start", F.col("bin").cast("long") * CHUNK).write.parquet(f"{staged}/chunks")
    kept.where("tail is not null").select("sample", "chrom", "strand_rev", "tail", "umi_class", "cell").write.partitionBy("chrom").parquet(f"{staged}/tails")
    install(spark, staged, path)


def read_archive(spark: SparkSession, path: str, table: str = "records") -> DataFrame:
    """A table of the archive, read as far as the query asks for it."""
    return spark.read.parquet(f"{path}/{table}")


def stored_region(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """Records whose anchor lies in [start, end): other chromosomes and bins are not opened."""
    found = read_archive(spark, path).where((F.col("chrom") == chrom) & F.col("bin").between(start // CHUNK, max(start, end - 1) // CHUNK))
    return found.where((F.col("anchor") >= start) & (F.col("anchor") < end)).drop("bin")


def stored_junction(spark: SparkSession, path: str, chrom: str, donor: int, acceptor: int) -> DataFrame:
    """Records of the bins that the catalogue names for the junction."""
    at = (F.col("chrom") == chrom) & (F.col("donor") == donor) & (F.col("acceptor") == acceptor)
    named = read_archive(spark, path, "junctions").where(at).select("sample", "chrom", F.explode("bins").alias("bin")).distinct()  # a bin of a chromosome each
    found = read_archive(spark, path).where(F.col("chrom") == chrom).join(named, PARTS, "left_semi").drop("bin")
    return junction_rows(found).where(at)


_kept: dict[tuple, str] = {}


def evidence_path(spark: SparkSession, sf_dir: str) -> str:
    """The archive of the order tables' projection, written once for a session and the tables as they are."""
    stamps = []
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        fs, p = file_system(spark, f"{sf_dir}/{name}.parquet")
        status = fs.getFileStatus(p)
        stamps.append((status.getModificationTime(), fs.getContentSummary(p).getLength()))
    key = (spark.sparkContext.applicationId, sf_dir, tuple(stamps))
    if key not in _kept:
        path = f"{scratch(spark)}/archive-{uuid.uuid4().hex}"
        write_archive(base(spark, sf_dir), path, shaped)
        _kept[key] = path
    return _kept[key]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(spark, evidence_path(spark, sf_dir)).drop("bin")
