"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker unpacks at a time, but for a single longer text.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable, *columns: int, most: int = SLICE_BYTES) -> Iterator:
    """The batches in slices of about `most` bytes in the columns (numbers of string or binary ones), a row at least.

    Spark bounds what it hands to a worker by bytes already; a slice bounds what the worker makes of it.
    """
    import pyarrow.compute as pc

    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy().astype(np.int64) for k in columns)
        group = (np.cumsum(size) - size) // most if batch.num_rows else np.zeros(0, np.int64)
        cut = np.nonzero(np.diff(group, prepend=-1))[0].tolist() if len(group) else [0]
        for s, e in zip(cut, [*cut[1:], batch.num_rows], strict=True):
            yield batch.slice(s, e - s)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Only a session whose executors run on this machine gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='moltide-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/moltide-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so a lost executor costs one reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._moltide_path = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables made by materialise() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_moltide_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark removes them once the driver has collected its garbage.

    The first round frees the frames, and the second one the shuffles that only they knew.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of the edges a-b: (node, smallest node of its component), for nodes that are not that smallest one."""
    if not len(a):
        return a[:0], a[:0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := label[label], label):
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of some of the pairs a-b that connect what all of them connect: a spanning forest."""
    chosen, left = [], np.arange(len(a))
    if len(a):
        _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        label = np.arange(at.max() + 1)
        while len(left):
            x, y = label[i[left]], label[j[left]]
            left, x, y = left[x != y], x[x != y], y[x != y]
            # each component but the smallest of those that meet hooks on a smaller one: no cycles
            high, first = np.unique(np.maximum(x, y), return_index=True)
            chosen.append(left[first])
            label[high] = np.minimum(x, y)[first]
            while not np.array_equal(up := label[label], label):
                label = up
    return np.concatenate(chosen) if chosen else left


def shrink_edges(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges (a, b) by the stars of its local components: never more rows, same components."""

    def local(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > 500_000:
                x, y = star_components(a, b)
                if len(x) > 250_000:  # nothing left to merge here: hand on and start anew
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                    x, y = x[:0], y[:0]
                a, b = x, y
        a, b = star_components(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(local, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected edges (a long, b long), without nulls: (node, root) for every node of an edge, root the smallest node.

    Raises if max_rounds do not end it; the rounds needed grow with the logarithm of the longest path.

    Alternating large-star and small-star rounds. A hub costs no group: minima are aggregated on the map side, and the
    join that applies them reads both sides from plain exchanges, so that adaptive execution can split a hot key.
    """
    spark = edges.sparkSession
    now = materialise(shrink_edges(edges.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(30,0)"))).first())

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "min")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = materialise(small, "edges")
        discard(now, least, large, low)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components are not joined after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def ranked(rows: DataFrame, keys: list[str], to: str) -> DataFrame:
    """rows with the column `to`: their place, from 0, in the order of the keys, which no two rows share.

    Sorted by range; each partition numbers its rows from where the ones before it end.
    """
    numbered = rows.orderBy(*keys).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.sparkSession.createDataFrame(numbered, f"{kinds}, {to} long")


#: Rows that number themselves together, on average, and the fewest such sets of a group.
NUMBER_ROWS, NUMBER_SETS = 250_000, 4


def number_rows(rows: DataFrame, group: str, keys: list[str], to: str) -> DataFrame:
    """rows with the column `to`: gapless numbers from 0 within each `group`, in no order that means anything.

    A group is dealt by a hash of the keys into sets, however large it is: each set numbers its rows by itself and starts
    where the sets before it end. The table of starts has a row for each group and set. rows must be a written table.
    """
    sets = max(NUMBER_SETS, rows.count() // (NUMBER_ROWS * 8))
    rows = rows.withColumn("__set", F.pmod(F.xxhash64(F.lit("number"), *keys), F.lit(sets)).cast("int"))
    ends = rows.groupBy(group, "__set").agg(F.count("*").alias("__n"))
    start = ends.select(group, "__set", (F.sum("__n").over(Window.partitionBy(group).orderBy("__set")) - F.col("__n")).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group, "__set").orderBy(*[F.col(k).asc_nulls_first() for k in keys])) - 1
    numbered = rows.withColumn("__own", own).join(start, [group, "__set"])
    return numbered.withColumn(to, (F.col("__start") + F.col("__own")).cast("long")).drop("__set", "__own", "__start")
