"""SimHash near-duplicate detection with vantage-point trees over Hamming space.

A 64-bit fingerprint is cut into radius // 2 + 1 blocks (two halves for 3 bits). Two fingerprints that differ in at most
`radius` bits differ in at most one bit in one block, so each block has a vantage-point tree of its own, searched with
that smaller radius.
The upper levels of a tree are made on the driver from a bounded sample of fingerprints; any tree gives exact results,
the sample only balances it. Every fingerprint goes to the leaf (shard) that holds it and, as a visitor, to each other
leaf that the triangle inequality cannot rule out. A shard splits further in its task, compares whole fingerprints and
returns the links as a forest, never as all pairs of a group.

Rows: a null text counts as empty; a text without words has fingerprint 0 and links as any other. Equal rows are kept,
each with its result. A null id is kept; it never names a component unless all ids of the component are null. An empty
table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, forest, materialise, slices, table

SEED = 42
#: Fingerprints that a shard should hold at most, on average; the sampled fingerprints for each shard.
SHARD_ROWS, SAMPLE_PER_SHARD, LEAST_SHARDS = 20_000, 48, 64
DENSE = 384


def hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; fewer words make one shingle, none make no hash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, f = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([f(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    return np.array([f(joined[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """Bit i is set if it is set in over half the shingle hashes."""
    h = hashes(text, k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * ones > len(h)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def block(fps: np.ndarray, h: int, blocks: int) -> np.ndarray:
    """Bits of block h of the fingerprints cut into so many blocks."""
    low, high = 64 * h // blocks, 64 * (h + 1) // blocks
    return (fps.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)


def split(values: np.ndarray) -> tuple[np.uint32, int] | None:
    """Vantage point and radius of the ball that holds about half of the values; None if no candidate separates them."""
    for at in (0, len(values) // 2, len(values) - 1, len(values) // 3):
        p = values[at]
        d = np.bitwise_count(values ^ p)
        t = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        if 0 < np.count_nonzero(d <= t) < len(d):
            return p, t
    return None


def grow(values: np.ndarray, leaf: int, tree: list | None = None) -> list:
    """Nodes (pivot, t, inside, outside), or None for a leaf; children by position."""
    tree = [] if tree is None else tree
    at = len(tree)
    tree.append(None)
    cut = split(values) if len(values) > leaf else None
    if cut:
        near = np.bitwise_count(values ^ cut[0]) <= cut[1]
        inside = len(tree)
        grow(values[near], leaf, tree)
        outside = len(tree)
        grow(values[~near], leaf, tree)
        tree[at] = (cut[0], cut[1], inside, outside)
    return tree


def descend(values: np.ndarray, home: np.ndarray, visit: np.ndarray, pivot: np.uint32, t: int, r: int) -> tuple:
    """Homes and visitors (positions) of the ball and of the rest; the triangle inequality prunes visits."""
    dh, dv = (np.bitwise_count(values[x] ^ pivot).astype(np.int16) for x in (home, visit))
    inside = (home[dh <= t], np.concatenate([home[(dh > t) & (dh - r <= t)], visit[dv - r <= t]]))
    outside = (home[dh > t], np.concatenate([home[(dh <= t) & (dh + r > t)], visit[dv + r > t]]))
    return inside, outside


def route(values: np.ndarray, tree: list, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each leaf with the positions of its homes and visitors."""
    todo = [(0, np.arange(len(values)), np.zeros(0, np.int64))]
    while todo:
        at, home, visit = todo.pop()
        if not len(home) and not len(visit):
            continue
        if tree[at] is None:
            yield at, home, visit
            continue
        pivot, t, inside, outside = tree[at]
        a, b = descend(values, home, visit, pivot, t, r)
        todo += [(inside, *a), (outside, *b)]


def agreeing(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Share of the sketch's 4-bit minima that agree, less what unrelated texts share: about the Jaccard similarity."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        x = sketches[i[at : at + (1 << 16)]] ^ sketches[j[at : at + (1 << 16)]]
        out[at : at + (1 << 16)] = ((x & 15) == 0).mean(axis=1) / 2 + ((x >> 4) == 0).mean(axis=1) / 2
    return (out - 1 / 16) / (15 / 16)


def linked(nodes: np.ndarray, fps: np.ndarray, is_home: np.ndarray, h: int, radius: int, sketches: np.ndarray | None = None, least: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between the shard's homes, and between homes and visitors.

    A link: at most `radius` differing bits and, where there are sketches, an estimated similarity of at least `least`.
    """
    blocks = radius // 2 + 1
    r, values, whole = radius // blocks, block(fps, h, blocks), fps.view(np.uint64)
    found_a, found_b, held = [nodes[:0]], [nodes[:0]], 0

    def fewer() -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        at = forest(a, b)
        return a[at], b[at]

    todo = [(np.nonzero(is_home)[0], np.nonzero(~is_home)[0])]
    while todo:
        home, visit = todo.pop()
        if not len(home):
            continue
        if len(home) > DENSE and (cut := split(values[home])):
            a, b = descend(values, home, visit, *cut, r)
            if max(len(a[0]) + len(a[1]), len(b[0]) + len(b[1])) < len(home) + len(visit):
                todo += [a, b]
                continue
        other = np.concatenate([home, visit])
        step = max(1, 1_000_000 // len(other))
        for at in range(0, len(home), step):
            x = home[at : at + step]
            i, j = np.nonzero(np.bitwise_count(whole[x][:, None] ^ whole[other][None, :]) <= radius)
            i, j = x[i], other[j]
            keep = nodes[i] != nodes[j]
            i, j = i[keep], j[keep]
            if sketches is not None:
                keep = agreeing(sketches, i, j) >= least
                i, j = i[keep], j[keep]
            found_a.append(nodes[i])
            found_b.append(nodes[j])
            held += len(i)
            if held > 400_000:
                a, b = fewer()
                found_a, found_b, held = [a], [b], 0
    return fewer()


def links(rows: DataFrame, radius: int = 3, least: float = 0) -> DataFrame:
    """Links (a, b) between nodes that connect all that the pairs within radius connect, a forest for each shard.

    rows: node long, fp long, each node once, and sketch binary if links also ask for a similarity of about `least`.
    """
    spark = rows.sparkSession
    n = rows.count()
    blocks = radius // 2 + 1
    shards = max(LEAST_SHARDS, n // SHARD_ROWS)
    size = SAMPLE_PER_SHARD * shards
    sample = np.array([x[0] for x in (rows.select("fp").sample(min(1.0, 1.3 * size / n), seed=7).limit(size).collect() if n else [])], np.int64)
    trees = [grow(block(sample, h, blocks), SAMPLE_PER_SHARD) for h in range(blocks)]
    r = radius // blocks
    sketched = "sketch" in rows.columns

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).to_numpy()
            for h in range(blocks):
                for leaf, home, visit in route(block(x, h, blocks), trees[h], r):
                    at = np.concatenate([home, visit])
                    taken = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), blocks * leaf + h)), pa.array(np.arange(len(at)) < len(home)), *taken.columns], ["shard", "home", *taken.schema.names])

    def shard(key, got):  # noqa: ANN001
        import pyarrow as pa

        sketches = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.uint8).reshape(got.num_rows, -1) if sketched else None
        a, b = linked(got.column("node").to_numpy(), got.column("fp").to_numpy(), got.column("home").to_numpy(), key[0].as_py() % blocks, radius, sketches, least)
        return pa.table({"a": a, "b": b})

    kinds = "node long, fp long" + ", sketch binary" * sketched
    return rows.select("node", "fp", *["sketch"] * sketched).mapInArrow(deal, f"shard long, home boolean, {kinds}").groupBy("shard").applyInArrow(shard, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest id of those reachable over links of at most radius differing bits) of each row."""
    docs = materialise(fingerprints(df, id_col, text_col, shingle), "fp")
    least = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    root = materialise(connected_components(links(least.select(F.col("fp").alias("node"), "fp"), radius)), "roots")
    named = root.join(least.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    named = materialise(least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return docs.join(named, "fp", "left").select("doc_id", "fp", "component_id")


#: Most near copies by similarity: fingerprints of two-word shingles differ in few bits where texts differ in scattered
#: words; a sketch of 64 minima of 4 bits rules out unrelated texts. What this misses is found by prefixes of shingle sets.
NEAR_SHINGLE, NEAR_BITS, SKETCH, SKETCH_LEAST = 2, 9, 64, 0.6
#: Shingles that a task remembers while it compares texts.
REMEMBERED = 1_000_000
#: Share and least number of rows in which frequent shingles are counted, how often one is seen there, and how many are kept.
COUNTED, COUNTED_ROWS, FREQUENT, FREQUENT_MOST = 0.1, 5_000, 3, 200_000


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (rising) that a sample of docs (doc_id, text) repeats, and their counts."""
    rows = docs.count()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(text, shingle)).view(np.int64))], ["h"])

    part = docs.select("text").sample(min(1.0, max(COUNTED, COUNTED_ROWS / max(rows, 1))), seed=11)
    counts = materialise(part.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT), "counts")
    least, held = FREQUENT, 0
    for c, n in sorted(map(tuple, counts.groupBy("c").count().collect()), reverse=True):
        held += n
        if held > FREQUENT_MOST:
            least = c + 1
            break
    found = counts.where(F.col("c") >= least).toPandas()
    discard(counts)
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """Of a set of shingles, rare ones first, so many that any set that is alike enough has one of them in its own prefix.

    The order is the same for all sets, by count among the frequent ones and then by hash, whatever was counted.
    """
    count = np.zeros(len(h), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
        count = np.where(frequent[0][at] == h, frequent[1][at], 0)
    return h[np.lexsort((h, count))][: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def prefix_candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, label, size, prefix) of different labels, among them all whose sets are alike enough.

    Prefixes of alike sets meet, that of the smaller one within its first size - least + 1 shingles, where least is what two
    sets of its size must share. Sizes and places of a shingle that both hold bound what they can share.
    """
    share = similarity / (1 + similarity)
    held = nodes.select("node", "label", "size", F.posexplode("prefix").alias("at", "h"))
    # shingles of one label alone make no pairs; a written table, so that the joins read plain exchanges
    keys = materialise(held.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h"), "keys")
    met = materialise(held.join(keys, "h"), "met")
    names = ["node", "label", "size", "at"]
    x = met.where(F.col("at") <= F.col("size") - F.ceil(2 * share * F.col("size") - 1e-9)).select("h", *[F.col(k).alias(f"x_{k}") for k in names])
    y = met.select("h", *[F.col(k).alias(f"y_{k}") for k in names])
    n, m = F.col("x_size"), F.col("y_size")
    apart = (F.col("x_label") != F.col("y_label")) & ((n < m) | ((n == m) & (F.col("x_node") < F.col("y_node")))) & (n >= similarity * m - 1e-9)
    most = F.least("x_at", "y_at") + 1 + F.least(n - F.col("x_at"), m - F.col("y_at")) - 1
    pairs = x.join(y, (x["h"] == y["h"]) & apart & (most >= share * (n + m) - 1e-9))
    out = materialise(pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "pairs")
    discard(keys, met)
    return out


def sketch(h: np.ndarray) -> bytes:
    """Low 4 bits of each of SKETCH minima of the hashes h under different multiply-xor orders; two minima to a byte."""
    if not len(h):
        return bytes(SKETCH // 2)
    mult = (np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        x = (h[at : at + 4096] ^ (h[at : at + 4096] >> np.uint64(29)))[:, None] * mult
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    low = ((least >> np.uint64(7)) & np.uint64(15)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and group_id of the rows whose text has copies or near copies among other rows; group_id is the smallest id of the group.

    Equal texts are one node; nodes link if the Jaccard similarity of their sets of `shingle` words is `similarity` or
    more, checked on whole texts. Links are looked for twice: first along the shards' forests of near fingerprints, which
    joins large groups at little cost, then, between texts that are still apart, by all pairs whose prefixes meet, which
    leaves out no pair. Rows with a null id take no part. Texts without words are copies of each other only if they are
    equal.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(x, NEAR_SHINGLE) for x in texts], np.uint64).view(np.int64)
            digests = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
            sets = [np.unique(hashes(x, shingle)) for x in texts]
            sketches, sizes = [sketch(h) for h in sets], [len(h) for h in sets]
            firsts = [prefix(h, frequent.value, similarity).view(np.int64) if len(h) else [] for h in sets]
            columns = [batch.column(0), pa.array(fps), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest", "sketch", "size", "prefix"])

    marked = materialise(docs.mapInArrow(run, "doc_id long, fp long, digest binary, sketch binary, size int, prefix array<long>"), "marked")
    kept = [F.first(k).alias(k) for k in ("fp", "sketch", "size", "prefix")]
    nodes = materialise(marked.groupBy("digest").agg(F.min("doc_id").alias("node"), *kept, F.count("*").alias("copies")), "nodes")

    def alike(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(batches, 2, 3):
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > REMEMBERED:
                    sets.clear()
                    held = 0
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        sets[node] = np.unique(hashes(text, shingle))
                        held += len(sets[node])
                n = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                keep.append(n >= similarity * (len(sets[a]) + len(sets[b]) - n) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def decide(edges: DataFrame) -> DataFrame:
        wanted = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        texts = materialise(docs.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
        both = edges.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        true = materialise(both.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long"), "true")
        discard(texts, edges)
        return true

    edges = materialise(links(nodes.select("node", "fp", "sketch"), NEAR_BITS, SKETCH_LEAST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    true = decide(edges)
    root = connected_components(true)
    labelled = materialise(nodes.select("node", "size", "prefix").join(root, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "prefix"), "labelled")
    more = decide(prefix_candidates(labelled, similarity))
    root = materialise(connected_components(true.union(more)), "roots")
    discard(labelled, true, more)
    # the smallest node is the smallest id, as a node's number is its smallest id
    grouped = nodes.join(root, "node", "left").where("copies > 1 or root is not null").select("digest", F.coalesce("root", "node").alias("group_id"))
    return marked.join(materialise(grouped, "grouped"), "digest").select("doc_id", "group_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
