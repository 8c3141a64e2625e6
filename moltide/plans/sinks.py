"""Writers: tables as TSV or JSON lines, sparse matrices as MatrixMarket folders. Nothing is overwritten, nothing half stays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.archive import install


def write_text(df: DataFrame, path: str, kind: str) -> None:
    """df in a folder of files of the kind tsv (with a header) or json; a folder that is there is an error."""
    staged = f"{path}.{uuid.uuid4().hex}"
    if kind == "tsv":
        df.write.csv(staged, sep="\t", header=True, nullValue="", emptyValue='""')
    elif kind == "json":
        df.write.json(staged)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    install(df.sparkSession, staged, path)


def numbered(df: DataFrame, column: str, to: str) -> DataFrame:
    """The column's distinct values in order, from 1: sorted by range, numbered from the partitions' sizes."""
    values = df.select(column).distinct().orderBy(column)
    kind = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame(values.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1)), f"`{column}` {kind}, `{to}` long")


def write_mex(counts: DataFrame, path: str, feature: str, barcode: str, value: str) -> None:
    """Folders features, barcodes and matrix of counts (feature, barcode, value): lines in order, the header in a part of its own before the others."""
    spark = counts.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    counts.write.parquet(f"{staged}.counts")
    counts = spark.read.parquet(f"{staged}.counts")
    features, cells = numbered(counts, feature, "f"), numbered(counts, barcode, "b")
    features.orderBy("f").select(F.col(feature).cast("string")).write.text(f"{staged}/features")
    cells.orderBy("b").select(F.col(barcode).cast("string")).write.text(f"{staged}/barcodes")
    size = [x.count() for x in (features, cells, counts)]
    spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), (" ".join(map(str, size)),)], "value string").coalesce(1).write.text(f"{staged}/matrix/part=0")
    lines = counts.join(features, feature).join(cells, barcode).orderBy("b", "f").select(F.concat_ws(" ", "f", "b", value).alias("value"))
    lines.write.text(f"{staged}/matrix/part=1")
    install(spark, staged, path)


def read_mex(spark: SparkSession, path: str) -> DataFrame:
    """feature, barcode (from 1) and umis of a matrix that write_mex wrote."""
    x = F.split("value", " ")
    return spark.read.text(f"{path}/matrix/part=1").select(*[F.get(x, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("feature", "barcode", "umis"))])
