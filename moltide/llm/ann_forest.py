"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees.

A tree gives every vector a string of BITS signs of random projections; its strings are held as a sorted array, in which
the vectors that share a prefix with a query are a range. For each query all trees descend to their longest matches and
then ascend together, a bit at a time, until the ranges hold a share of the shard (CANDIDATES, with repeats between
trees); the distinct vectors in them are ranked by their exact cosine in double precision.

The index is dealt into shards by a hash of the vector, each with trees of its own rows, and the queries into blocks; a
task searches one block in one shard, and the shards' best merge. Equal vectors are one entry with its smallest ids, as
many as an answer can use, so a hot vector is neither indexed nor searched twice. No index row and no candidate in a
reached range is left out.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; only vectors of equal length
meet. Rows with a null id take no part; repeated rows (equal id and vector) are separate neighbours. A query never finds
its own id. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

TREES, BITS, CANDIDATES, SEED = 64, 32, 0.7, 12345
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARDS = 25_000, 20_000, 12
OUT = "entry long, vec_id long, score double"


class Forest:
    """Sorted hash strings of all trees over the rows of v (unit vectors)."""

    def __init__(self, v: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.trees, self.bits, self.n = trees, bits, len(v)
        codes = [self.code(v, t) for t in range(trees)]
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order, strict=True)]

    def code(self, v: np.ndarray, tree: int) -> np.ndarray:
        planes = np.random.default_rng([SEED, tree]).standard_normal((v.shape[1], self.bits))
        return ((v @ planes > 0) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries that share the first d bits with each query begin and end: [tree, d, query]."""
        low = np.empty((self.trees, self.bits + 1, len(q)), np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            code = self.code(q, t)
            for d in range(self.bits + 1):
                prefix = code >> (self.bits - d) << (self.bits - d)
                low[t, d] = np.searchsorted(self.sorted[t], prefix, "left")
                high[t, d] = np.searchsorted(self.sorted[t], prefix + (1 << (self.bits - d)), "left")
        return low, high

    def candidates(self, q: np.ndarray, enough: float):  # noqa: ANN201
        """For each query the positions reached once the trees, ascending together, hold at least `enough` entries."""
        low, high = self.ranges(q)
        held = (high - low).sum(axis=0, dtype=np.int64)  # falls with depth
        depth = np.maximum((held >= min(enough, self.n * self.trees)).sum(axis=0) - 1, 0)
        for k, d in enumerate(depth.tolist()):
            reached = np.zeros(self.n, bool)
            for t in range(self.trees):
                reached[self.order[t][low[t, d, k] : high[t, d, k]]] = True
            yield np.nonzero(reached)[0]


def cosines(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order of sums, so that a pair's score does not depend on its surroundings."""
    return (rows * q).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((q * q).sum()))


def best_in_shard(entries: np.ndarray, vectors: np.ndarray, ids: list[list[int]], ask: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """Best k ids for each query of the shard's entries."""
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / scale
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    forest = Forest(unit)
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(queries), 1000):
        part = queries[at : at + 1000]
        q = part / np.abs(part).max(axis=1, keepdims=True)
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
        for i, found in enumerate(forest.candidates(q, CANDIDATES * len(vectors))):
            about = unit[found] @ q[i]
            if len(found) > k:
                found = found[about >= np.partition(about, len(about) - k)[len(about) - k] - 1e-9]
            score = cosines(vectors[found], part[i])
            pairs = sorted((-s, v) for s, f in zip(score.tolist(), found.tolist(), strict=True) for v in ids[f])[:k]
            out[0].extend([ask[at + i]] * len(pairs))
            out[1].extend(v for _, v in pairs)
            out[2].extend(-s for s, _ in pairs)
    return out


def search(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row whose id is divisible by `every`."""
    spark = df.sparkSession
    vec = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    rows = rows.where(F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0))
    rows = materialise(rows, "vectors")
    # the k + 1 smallest ids of equal vectors: one may be the query's own
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    asked = rows.where(F.col("vec_id") % every == 0)
    entries = first.groupBy("vec").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # two entries may share a smallest id where rows repeat it with other vectors
    entries = materialise(entries.withColumn("entry", F.xxhash64("vec", "entry")), "entries")
    # distinct() over the whole vector has partial aggregation: a hot query vector meets as one row
    queries = materialise(entries.join(asked.select("vec").distinct(), "vec", "left_semi").select("entry", "vec"), "queries")
    n, q = entries.count(), queries.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-q // BLOCK_ROWS))
    # every block of the stated query set meets every shard
    left = entries.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("dim", F.size("vec"))
    right = queries.withColumn("block", F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("dim", F.size("vec"))

    def run(key, index, ask):  # noqa: ANN001
        import pyarrow as pa

        kinds = pa.schema([("entry", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not index.num_rows or not ask.num_rows:
            return kinds.empty_table()
        flat = lambda t: t.column("vec").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        found = best_in_shard(index.column("entry").to_numpy(), flat(index), index.column("ids").to_pylist(), ask.column("entry").to_numpy(), flat(ask), k + 1)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, kinds, strict=True)], schema=kinds)

    near = left.groupBy("shard", "block", "dim").cogroup(right.groupBy("shard", "block", "dim")).applyInArrow(run, OUT)
    by_score = Window.partitionBy("entry").orderBy(F.col("score").desc(), "vec_id")
    near = near.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1).drop("r")
    near = materialise(near, "near")
    who = materialise(asked.join(entries.select("vec", "entry"), "vec").select(F.col("vec_id").alias("query_id"), "entry"), "who")
    # a query row's k + 1 candidates are collected, not ranked in a window over all rows of its id
    lists = materialise(near.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found")), "lists")
    found = who.join(lists, "entry").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return found.select("query_id", F.posexplode("found").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
