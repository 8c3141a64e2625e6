"""Substring dedup by collinear chaining: fuzzy passages that later documents share with earlier ones.

Words are runs of letters and digits, case folded. From every text come seeds, the k-mers of words that are least by hash
in some window of WINDOW neighbouring k-mers: an equal run of WINDOW + K - 1 words has one seed at least. A seed that
several documents hold links each of them to the first (by id) that holds it and to the one before it, never all to all.
Between two documents, seeds are chained in order, a chain paying for the gaps between its seeds; a Fenwick tree of best
prefixes finds the best chain to extend. A document whose whole text an earlier one holds is one passage, of the first such
document, and takes no part in the chains of others. A single seed is a chain too. Where a chain spans less than eight words, three of
the four words before and after one of its seeds must agree as well, which holds wherever it lies in eight equal words. Chains are aligned word by word over the texts
around them until the texts no longer agree, and what aligns well enough is a passage. Passages of a document that touch
are merged, whatever documents they come from, and those of MIN_WORDS or more stay.

A null or short text has no seeds. Rows with a null id have no passages and keep their text. Rows of equal id and text are
one document; rows that repeat an id with another text are documents of their own, in the order of the texts' hashes.
Passages that only repeat within one document are not looked for. An empty table gives no rows. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, ranked, release, slices, table

K, WINDOW = 5, 6
#: What a seed adds to a chain's score and what each word of a gap, in either text, takes away.
SEED_SCORE, GAP_COST = 8.0, 0.1
#: Fewer aligned words than LEAST_WORDS are chance. MARGIN: characters around a chain; whole texts where an alignment reaches the end.
LEAST_SEEDS, LEAST_WORDS, SIMILARITY, MIN_WORDS, MARGIN = 1, 7, 0.7, 40, 320
#: What a word that differs takes from an alignment's score, how far the score may fall, and how many words an edit spans.
PENALTY, DROP, LOOK = SIMILARITY / (1 - SIMILARITY), 16.0, 8
#: Words between two passages that are one; documents that are few enough to be sent to all tasks as a list of ids.
BETWEEN, FEW = 3, 500_000
#: Holders from which a seed is hot: its rows are dealt by ranges of ids; and places times places that are all paired.
HOT, RANGES, PLACES = 1_000, 64, 64
#: Neighbouring words on either side of a seed that it brings along, and how many must agree if a few words are to be a chain.
AROUND, BACKING = 4, 3
#: Documents in which hot seeds are looked for, and how many such seeds are listed.
SAMPLED, MOST_HOT = 5_000, 100_000
ALIGNED = ["doc", "rep", "start", "end", "first", "last", "similarity", "a", "b"]
MULT, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x3001: folded code point, and whether it belongs to words."""
    code = np.arange(0x3001, dtype=np.uint32)
    fold = np.where((code >= 65) & (code <= 90) | (code >= 0xC0) & (code <= 0xDE) & (code != 0xD7), code + 32, code).astype(np.uint32)
    word = (code >= 0xA1) & ~((code >= 0x2000) & (code <= 0x206F)) & (code != 0x3000) & (code != 0x1680)
    word |= (code >= 48) & (code <= 57) | (code >= 65) & (code <= 90) | (code >= 97) & (code <= 122)
    return fold, word


FOLD, WORD = tables()


def powers(n: int) -> np.ndarray:
    out = np.full(n, MULT)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = powers(4096)


def words_of(texts: list[str], tables: tuple[np.ndarray, np.ndarray] = (FOLD, WORD)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (characters of its own text) and text number of every word; tables as of tables()."""
    fold, word = tables
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(np.append(0, sizes + 1))[:-1]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(codes, 0x3000)
    inside = np.where(codes > 0x3000, True, word[low])
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end, begin
    folded = np.where(codes > 0x3000, codes, fold[low]).astype(np.uint64)
    at = np.arange(len(codes)) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [len(codes)]])))
    value = mix(folded + np.uint64(1)) * POWERS[at % len(POWERS)]
    value[~inside] = 0
    text = np.searchsorted(first, begin, "right") - 1
    return mix(np.add.reduceat(value, begin)), begin - first[text], end - first[text], text


def window_extreme(x: np.ndarray, w: int, take) -> np.ndarray:  # noqa: ANN001
    """take (minimum or maximum) over x[i : i + w] for each i that has a whole window."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = take(out[:-step], out[step:])
        have += step
    return out


def seeds_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Text number, hash, word and character position and context of the seeds, by text and position.

    The context has 4 bits, not all zero, for each of the AROUND words before and after; none beyond the text's ends.
    """
    h, begin, _, text = words_of(texts)
    n = len(h) - K + 1
    if n <= 0:
        return begin[:0], h[:0], begin[:0], begin[:0], begin[:0]
    kmer = np.zeros(n, np.uint64)
    for t in range(K):
        kmer = kmer * MULT + h[t : t + n]
    kmer = mix(kmer)
    whole = text[:n] == text[K - 1 :]
    # k-mers of different texts stand apart by as many empty places as a window has, and at least one at the end
    place = np.arange(n) + text[:n] * WINDOW + WINDOW
    spread = np.full(place[-1] + 2 * WINDOW, np.iinfo(np.uint64).max)
    spread[place[whole]] = kmer[whole]
    least = window_extreme(spread, WINDOW, np.minimum)
    # of windows that hold empty places only those at the borders of short texts matter; there the least k-mer is taken too
    chosen = np.zeros(len(spread), bool)
    top = window_extreme(np.where(least == np.iinfo(np.uint64).max, 0, least), WINDOW, np.maximum)
    chosen[WINDOW - 1 : WINDOW - 1 + len(top)] = spread[WINDOW - 1 : WINDOW - 1 + len(top)] == top
    keep = whole & chosen[place]
    at, own = np.nonzero(keep)[0], text[:n][keep]
    word = at - np.searchsorted(text, own)
    nibble, context = (h >> np.uint64(40)).astype(np.int64) % 15 + 1, np.zeros(len(at), np.int64)
    for t, step in enumerate([*range(-AROUND, 0), *range(K, K + AROUND)]):
        there = np.clip(at + step, 0, len(h) - 1)
        inside = (at + step == there) & (text[there] == own)
        context |= np.where(inside, nibble[there], 0) << 4 * t
    return own, kmer[keep], word, begin[:n][keep], context


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words of two contexts agree, on either side at the best of three shifts."""
    low, side = np.int64(0x1111), np.int64(0xFFFF)

    def equal(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        apart = p ^ q
        apart |= apart >> 2
        apart |= apart >> 1
        there = p | p >> 2
        there |= there >> 1
        return np.bitwise_count(~apart & there & low)

    total = 0
    for shift in (0, 4 * AROUND):
        p, q = x >> shift & side, y >> shift & side
        total = total + np.maximum(np.maximum(equal(p, q), equal(p >> 4, q)), equal(p, q >> 4))
    return total


def hot_seeds(docs: DataFrame, rows: int) -> np.ndarray:
    """Seeds (rising) that a sample of docs shows in more than about HOT of the `rows` documents.

    Only where rows are dealt depends on it, not what is found. A sampled document has a bounded number of them, and so has
    the list: it keeps the most frequent.
    """
    part = min(1.0, SAMPLED / max(rows, 1))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 0):
            text, h, *_ = seeds_of(batch.column(0).to_pylist())
            once = np.unique(np.stack([h.view(np.int64), text]), axis=1)[0] if len(h) else h.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(once)], ["h"])

    counts = docs.select("text").sample(part, seed=5).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") > max(2, HOT * part)).orderBy(F.col("n").desc(), "h").limit(MOST_HOT).toPandas()
    return np.sort(found["h"].to_numpy(np.int64))


def seeds(docs: DataFrame, hot: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """h, doc, place and context of each seed of docs (doc, text), and the range of documents to which a hot seed is dealt (0 for others).

    place: word position << 32 | character position.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy()
            text, h, word, at, context = seeds_of(batch.column(1).to_pylist())
            h = h.view(np.int64)
            doc = ids[text]
            of = np.zeros(len(h), np.int32)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                of[is_hot] = 1 + np.searchsorted(cuts, doc[is_hot], "right")
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(of), pa.array(doc), pa.array(word << 32 | at), pa.array(context.astype(np.uint32).view(np.int32))], ["h", "range", "doc", "place", "context"])

    return docs.mapInArrow(run, "h long, range int, doc long, place long, context int")


def paired(a: list, b: list) -> list[tuple]:
    """Places of a seed in two texts; a seed at very many places of both pairs them in order, from the front and from the back."""
    if len(a) * len(b) <= PLACES:
        return [(x, y) for x in a for y in b]
    return sorted({*zip(a, b, strict=False), *zip(a[::-1], b[::-1], strict=False)})


#: In `held`: the seed's neighbours agree too.
BACKED = 1 << 62
ANCHOR = "doc long, rep long, place long, held long"


class Linker:
    """Links the holders of each seed, given in order, to the first holder and to the one before.

    Rows come sorted by seed, range, document and place, in batches of any size. of `ends` a row is kept for each range of a
    hot seed: its first and its last holder, with places.
    """

    def __init__(self) -> None:
        # a document and its places, each with its context
        self.first: tuple[int, list[tuple[int, int]]] | None = None
        self.prior: tuple[int, list[tuple[int, int]]] | None = None
        self.held: tuple[int, list[tuple[int, int]]] | None = None
        self.key: tuple[int, int] | None = None
        self.out: list[tuple] = []
        self.ends: list[tuple] = []

    def close(self) -> None:
        """The document at hand is complete."""
        if self.held:
            doc, places = self.held
            if self.prior:
                rep = self.prior[0]
                self.out += [(doc, rep, *x, *y) for x, y in paired(places, self.prior[1])]
                if (rep := self.first[0]) != self.prior[0]:
                    self.out += [(doc, rep, *x, *y) for x, y in paired(places, self.first[1])]
            else:
                self.first = self.held
            self.prior, self.held = self.held, None

    def begin(self, key: tuple[int, int] | None) -> None:
        self.close()
        if self.key and self.key[1]:
            self.ends.append((*self.key, *[x for doc, places in (self.first, self.prior) for x in (doc, [p for p, _ in places])]))
        self.key, self.first, self.prior = key, None, None

    def rows(self, h: list[int], of: list[int], doc: list[int], place: list[int], context: list[int]) -> None:
        for key, d, *p in zip(zip(h, of, strict=True), doc, place, context, strict=True):
            if key != self.key:
                self.begin(key)
            if self.held and self.held[0] != d:
                self.close()
            if self.held:
                self.held[1].append(tuple(p))
            else:
                self.held = (d, [tuple(p)])


def linked(found: DataFrame) -> DataFrame:
    """Rows of seeds() as anchors; the ranges of hot seeds as rows of their own, their ends in arrays."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        link = Linker()

        def out(final: bool) -> pa.RecordBatch:
            if final:
                link.begin(None)
            n, m = len(link.out), len(link.ends)
            table = np.array(link.out, np.int64).reshape(-1, 6)
            table[:, 4] |= np.where(agreeing(table[:, 3] & 0xFFFFFFFF, table[:, 5] & 0xFFFFFFFF) >= BACKING, BACKED, 0)
            ends = [list(c) for c in zip(*link.ends, strict=True)] or [[]] * 6
            anchors = [pa.concat_arrays([pa.array(table[:, k].copy()), pa.nulls(m, pa.int64())]) for k in (0, 1, 2, 4)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))
            borders = [pa.array([None] * n + c, t) for c, t in zip(ends, kinds, strict=True)]
            link.out, link.ends = [], []
            return pa.RecordBatch.from_arrays([*anchors, *borders], ["doc", "rep", "place", "held", "h", "range", "low", "low_at", "high", "high_at"])

        for batch in batches:
            h, of, doc, place, context = (batch.column(k).to_numpy() for k in range(5))
            if not len(h):
                continue
            # most seeds stand alone: those rows are passed over at once
            new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
            size = np.diff(np.append(np.nonzero(new)[0], len(h)))
            group = np.cumsum(new) - 1
            keep = (size[group] > 1) | (of > 0)
            keep[group == 0] = keep[group == group[-1]] = True  # these may go on in another batch
            link.rows(*(c[keep].tolist() for c in (h, of, doc, place, context)))
            if len(link.out) > 100_000:
                yield out(False)
        yield out(True)

    kinds = f"{ANCHOR}, h long, range int, low long, low_at array<long>, high long, high_at array<long>"
    return found.repartition("h", "range").sortWithinPartitions("h", "range", "doc", "place").mapInArrow(run, kinds)


def anchors_of(docs: DataFrame, rows: int) -> DataFrame:
    """doc, rep, place and held: the places of each seed in a document, and in the first one and the one before that hold it.

    Seeds are dealt by their hash, hot ones also by ranges of documents, so that no task holds a seed of all documents; the
    first document of a hot seed's range is linked to the last one of the range before, and to the first of all.
    """
    hot = hot_seeds(docs, rows)
    cuts = np.array(sorted(set(docs.approxQuantile("doc", [k / RANGES for k in range(1, RANGES)], 0.005))), np.int64) if len(hot) else hot
    found = linked(seeds(docs, hot, cuts))
    if not len(hot):
        return found.select("doc", "rep", "place", "held")
    found = materialise(found, "anchors")
    release(docs.sparkSession)
    by = Window.partitionBy("h").orderBy("range")  # RANGES rows at most
    ends = found.where("h is not null").withColumn("before", F.lag(F.struct("high", "high_at")).over(by)).withColumn("start", F.first(F.struct("low", "low_at")).over(by)).where("before is not null")
    pairs = F.arrays_zip("low_at", F.col("to.at").alias("at"))
    # of the places of a hot seed in one document those in order are paired, as every other seed's where they are many
    both = ends.select("low", "low_at", F.explode(F.array(F.struct(F.col("before.high").alias("doc"), F.col("before.high_at").alias("at")), F.struct(F.col("start.low").alias("doc"), F.col("start.low_at").alias("at")))).alias("to")).select(F.col("low").alias("doc"), F.col("to.doc").alias("rep"), F.explode(pairs).alias("p"))
    over = both.select("doc", "rep", F.col("p.low_at").alias("place"), F.col("p.at").bitwiseOR(F.lit(BACKED)).alias("held")).where("place is not null and held is not null").distinct()
    return found.where("h is null").select("doc", "rep", "place", "held").union(over)


def best_chains(a: list[int], b: list[int]) -> list[list[int]]:
    """Chains (positions of seeds, in order) of the seeds at a (rising) and b; each seed is in one chain at most."""
    n = len(a)
    steps = np.diff(a), np.diff(b)  # words
    if (steps[0] > 0).all() and (steps[1] > 0).all() and (GAP_COST * (steps[0] + steps[1]) < SEED_SCORE).all():
        return [list(range(n))] if n >= LEAST_SEEDS else []
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(b)))}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ranks) + 1)
    score, link = [SEED_SCORE] * n, [-1] * n
    pending: list[int] = []
    for i in range(n):
        while pending and a[pending[0]] < a[i]:  # seeds at the same place don't extend each other
            j = pending.pop(0)
            held, r = (score[j] + GAP_COST * (a[j] + b[j]), j), ranks[b[j]]
            while r < len(tree):
                if tree[r] < held:
                    tree[r] = held
                r += r & -r
        best, r = (-1e18, -1), ranks[b[i]] - 1
        while r:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        if best[1] >= 0 and (value := best[0] - GAP_COST * (a[i] + b[i])) > 0:
            score[i] += value
            link[i] = best[1]
        pending.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = link[i]
        if len(chain) >= LEAST_SEEDS:
            out.append(chain[::-1])
    return out


CHAIN = "doc long, rep long, a array<int>, b array<int>, a_from int, a_to int, b_from int, b_to int"


def chains(anchors: DataFrame) -> DataFrame:
    """Chains of the anchors: seeds' word positions in doc and in rep, and the characters at which the first and the last one begin."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def whole(t: pa.Table) -> pa.RecordBatch:
            doc, rep, place, held = (t.column(k).to_numpy() for k in range(4))
            at, rat, char, rchar = place >> 32, (held & ~BACKED) >> 32, place & 0xFFFFFFFF, held & 0xFFFFFFFF
            backed = (held & BACKED) > 0
            cut = np.nonzero((np.diff(doc) != 0) | (np.diff(rep) != 0))[0] + 1
            rows: list[tuple] = []
            for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(doc)).tolist(), strict=True):
                a, b = at[s:e].tolist(), rat[s:e].tolist()
                for chain in best_chains(a, b):
                    i, j = s + chain[0], s + chain[-1]
                    if a[chain[-1]] - a[chain[0]] < BACKING and not backed[s + np.array(chain)].any():
                        continue
                    rows.append((doc[s], rep[s], [a[k] for k in chain], [b[k] for k in chain], char[i], char[j], rchar[i], rchar[j]))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int32()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "rep", "a", "b", "a_from", "a_to", "b_from", "b_to"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            doc, rep = held.column(0).to_numpy(), held.column(1).to_numpy()
            new = np.nonzero((np.diff(doc) != 0) | (np.diff(rep) != 0))[0] + 1
            if len(new):  # the last pair of documents may go on in the next batch
                yield whole(held.slice(0, int(new[-1])))
                held = held.slice(int(new[-1]))
        if held is not None and held.num_rows:
            yield whole(held)

    return anchors.repartition("doc", "rep").sortWithinPartitions("doc", "rep", "place", "held").mapInArrow(run, CHAIN)


def common_words(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence: a bit for each word of x, all of them moved on at once by each word of y."""
    if x == y:
        return len(x)
    at: dict[int, int] = {}
    for i, word in enumerate(x):
        at[word] = at.get(word, 0) | 1 << i
    every = (1 << len(x)) - 1
    row = every
    for word in y:
        if hit := row & at.get(word, 0):
            row = (row + hit | row - hit) & every
    return len(x) - row.bit_count()


#: Words that an edit takes from either text, substitutions first, then by how uneven it is.
EDITS = [(u, span - u) for span in range(1, 2 * LOOK + 1) for u in sorted(range(max(0, span - LOOK), min(span, LOOK) + 1), key=lambda u: abs(2 * u - span))]


def next_match(x: list[int], y: list[int], p: int, q: int) -> tuple[int, int] | None:
    """The least edit of EDITS after which two words of both texts (at an end of a text, one) agree."""
    n, m = len(x), len(y)
    if n - p > LOOK + 1 and m - q > LOOK + 1:
        at: dict[tuple[int, int], list[int]] = {}
        for v in range(LOOK + 1):
            at.setdefault((y[q + v], y[q + v + 1]), []).append(v)
        found = [(u + v, abs(u - v), u, v) for u in range(LOOK + 1) for v in at.get((x[p + u], x[p + u + 1]), ())]
        return min(found)[2:] if found else None
    for u, v in EDITS:
        if p + u < n and q + v < m and x[p + u] == y[q + v] and (p + u + 1 == n or q + v + 1 == m or x[p + u + 1] == y[q + v + 1]):
            return u, v
    return None


def extend(x: list[int], y: list[int], i: int, j: int, step: int, cut: tuple[bool, bool]) -> tuple[int, int, int, bool]:
    """How far (positions, and equal words) the alignment goes on from i, j, and whether it may go on beyond a cut.

    cut: whether the words of either text are cut off on this side. An edit is crossed where two words (at an end of a
    text, one) agree beyond it; the alignment ends at its best score once the score has fallen by DROP or no such place is
    near.
    """
    x, y = (x[i + 1 :], y[j + 1 :]) if step > 0 else (x[:i][::-1], y[:j][::-1])
    n, m = len(x), len(y)  # words left
    p = q = same = 0
    score = 0.0
    best = (0.0, 0, 0, 0)
    on = False
    while True:
        while p < n and q < m and x[p] == y[q]:
            p, q, same, score = p + 1, q + 1, same + 1, score + 1
        if score > best[0]:
            best = (score, p, q, same)
        if score < best[0] - DROP:
            break
        if not (near := next_match(x, y, p, q)):
            over = p == n and not cut[0] or q == m and not cut[1]
            on = not over and (cut[0] and n - p <= 2 * LOOK or cut[1] and m - q <= 2 * LOOK)
            break
        u, v = near
        kept = common_words(x[p : p + u], y[q : q + v]) if u and v else 0
        score += kept - PENALTY * (max(u, v) - kept)
        p, q, same = p + u, q + v, same + kept
    return i + step * best[1], j + step * best[2], best[3], on


def align(x: list[int], y: list[int], i: list[int], j: list[int], low: tuple[bool, bool], high: tuple[bool, bool]) -> list[tuple[int, int, float, bool]]:
    """Parts of the words x that a chain (places i in x and j in y) aligns with y: first and last word, similarity, and whether the part may go on where the words are cut off; low and high: whether either text is cut before and after."""
    parts, same = [], 0
    begin = 0
    for t in range(1, len(i) + 1):
        kept = common_words(x[i[t - 1] : i[t]], y[j[t - 1] : j[t]]) if t < len(i) else 0
        if t < len(i) and kept - PENALTY * (max(i[t] - i[t - 1], j[t] - j[t - 1]) - kept) >= -DROP:
            same += kept
            continue
        i0, j0, before, back = extend(x, y, i[begin], j[begin], -1, low)
        i1, j1, after, ahead = extend(x, y, i[t - 1], j[t - 1], 1, high)
        n, m, all_same = i1 - i0 + 1, j1 - j0 + 1, same + before + after + 1
        if back or ahead or n >= LEAST_WORDS and all_same >= SIMILARITY * max(n, m):
            parts.append((i0, i1, all_same / max(n, m), back or ahead))
        begin, same = t, 0
    return parts


def aligned_batch(rows: list[tuple], width: int):  # noqa: ANN201
    """Rows of the first `width` columns of ALIGNED as a batch."""
    import pyarrow as pa

    kinds = (*[pa.int64()] * 2, *[pa.int32()] * 4, pa.float64(), *[pa.list_(pa.int32())] * 2)[:width]
    columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * width
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ALIGNED[:width])


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """Documents as doc and text, what doc stands for (doc, doc_id, text_hash) if ids repeat, and how many rows there are.

    Where no id repeats doc is the id. Else documents are numbered by id and hash of the text, so that rows of equal id and
    text are one document and other rows that repeat an id are documents of their own.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    rows, ids = docs.groupBy("doc").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    if not rows or rows == ids:
        return docs, None, rows or 0
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    names = materialise(ranked(hashed.select(F.col("doc").alias("doc_id"), "text_hash").distinct(), ["doc_id", "text_hash"], "doc"), "names")
    docs = hashed.dropDuplicates(["doc", "text_hash"]).withColumnRenamed("doc", "doc_id").join(names, ["doc_id", "text_hash"]).select("doc", "text")
    return materialise(docs, "docs"), names, rows


def copies_of(docs: DataFrame) -> DataFrame:
    """doc and source of each document whose whole text an earlier one holds too, the first of them; 128 bits of hash tell texts apart."""
    hashed = docs.select("doc", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    least = materialise(hashed.groupBy("h", "g").agg(F.min("doc").alias("source"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    # a join of plain exchanges, so that adaptive execution can split a very large group of copies
    out = materialise(hashed.join(least, ["h", "g"]).where("doc <> source").select("doc", "source"), "copies")
    discard(least)
    return out


def whole_texts(copies: DataFrame) -> DataFrame:
    """Documents (doc, source, text) as passages from their first word to their last."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 2):
            _, begin, end, text = words_of(batch.column(2).to_pylist())
            s, e = (np.searchsorted(text, np.arange(batch.num_rows), side) for side in ("left", "right"))
            keep = np.nonzero(e > s)[0]
            s, e, n = s[keep], e[keep], len(keep)
            taken = batch.take(pa.array(keep))
            columns = [taken.column(0), taken.column(1), begin[s], end[e - 1], np.zeros(n), e - s - 1, np.ones(n)]
            kinds = (*[pa.int64()] * 2, *[pa.int32()] * 4, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c if k < 2 else c.astype(t.to_pandas_dtype()), t) for k, (c, t) in enumerate(zip(columns, kinds, strict=True))], ALIGNED[:7])

    return copies.select("doc", "source", "text").mapInArrow(run, "doc long, rep long, start int, end int, first int, last int, similarity double")


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start and end (characters), words, similarity and source_doc_id of each passage that an earlier document holds too.

    text_hash is that of the document's text where ids repeat, else null.
    """
    every, names, rows = keyed(df, id_col, text_col)
    copies = copies_of(every)
    listed = F.broadcast(copies) if copies.count() <= FEW else copies
    docs = every.join(listed, "doc", "left_anti")
    todo = materialise(chains(anchors_of(docs, rows)), "chains")
    release(df.sparkSession)
    done = [whole_texts(every.join(listed, "doc"))]

    def sided(found: DataFrame, texts: DataFrame, window: bool) -> DataFrame:
        """found with the text, base and whether the text goes on, of both sides' windows or of whole texts."""
        whole = texts.select(F.col("doc").alias("n"), F.col("text").alias("whole"))
        # a document that very many others share is met by requests without text, and split on their side; all others
        # meet in the tasks of the later documents
        for side, begin, end in (("rep", "b_from", "b_to"), ("doc", "a_from", "a_to")):
            low, high = F.greatest(F.col(begin) - MARGIN, F.lit(0)), F.col(end) + MARGIN
            cut = [F.substring("whole", low + 1, high - low), low, F.char_length("whole") > high] if window else [F.col("whole")]
            found = found.join(whole, F.col(side) == F.col("n")).select(*found.columns, *[c.alias(f"{side}_{k}") for c, k in zip(cut, ("text", "base", "more"), strict=False)])
        return found

    def within(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 8, 11):
            out: list[tuple] = []
            doc, rep, a, b, a_from, a_to, b_from, b_to, y, y_base, y_more, x, x_base, x_more = (batch.column(k).to_pylist() for k in range(14))
            xs, ys = words_of(x), words_of(y)
            x_at, y_at = (np.searchsorted(w[3], np.arange(len(doc) + 1)) for w in (xs, ys))
            for k in range(len(doc)):
                s, e, u, v = x_at[k], x_at[k + 1], y_at[k], y_at[k + 1]
                first, last = xs[1][s:e], xs[2][s:e]
                i0, j0 = int(np.searchsorted(first, a_from[k] - x_base[k])), int(np.searchsorted(ys[1][u:v], b_from[k] - y_base[k]))
                i, j = [i0 + t - a[k][0] for t in a[k]], [j0 + t - b[k][0] for t in b[k]]
                for p, q, alike, on in align(xs[0][s:e].tolist(), ys[0][u:v].tolist(), i, j, (x_base[k] > 0, y_base[k] > 0), (x_more[k], y_more[k])):
                    if on:
                        out.append((doc[k], rep[k], None, None, None, None, None, a[k], b[k]))
                        break
                    out.append((doc[k], rep[k], x_base[k] + int(first[p]), x_base[k] + int(last[q]), p - i0 + a[k][0], q - i0 + a[k][0], alike, None, None))
            yield aligned_batch(out, 9)

    def whole(batches: Iterator) -> Iterator:
        for batch in slices(batches, 3, 4):
            for doc, rep, found, y, x in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                (xs, first, last, _), ys = words_of([x]), words_of([y])[0].tolist()
                xs, out = xs.tolist(), []
                for c in found:
                    parts = align(xs, ys, c["a"], c["b"], (False, False), (False, False))
                    out += [(doc, rep, int(first[p]), int(last[q]), p, q, alike) for p, q, alike, _ in parts]
                yield aligned_batch(list(dict.fromkeys(out)), 7)

    kinds = "doc long, rep long, start int, end int, first int, last int, similarity double"
    got = materialise(sided(todo, docs, True).mapInArrow(within, f"{kinds}, a array<int>, b array<int>"), "aligned")
    done.append(got.where("a is null").select(*ALIGNED[:7]))
    discard(todo)
    release(df.sparkSession)
    # what comes to the end of a window is aligned again in whole texts, all chains of two documents at once
    again = materialise(got.where("a is not null").groupBy("doc", "rep").agg(F.collect_list(F.struct("a", "b")).alias("chains")), "again")
    wanted = again.select("doc").union(again.select("rep")).distinct()
    wanted = F.broadcast(wanted) if 2 * again.count() <= FEW else wanted
    done.append(materialise(sided(again, docs.join(wanted, "doc", "left_semi"), False).mapInArrow(whole, kinds), "aligned"))
    discard(again)
    release(df.sparkSession)
    pieces = done[0]
    for other in done[1:]:
        pieces = pieces.union(other)
    aligned = pieces.distinct()
    by = Window.partitionBy("doc").orderBy("first", "last", "rep", "similarity", "start")
    # passages with at most a few words between them are one
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = aligned.withColumn("new", (reach.isNull() | (F.col("first") > reach + 1 + BETWEEN)).cast("int")).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.col("last") - F.col("first")
    merged = islands.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("words"), F.max("similarity").alias("similarity"), F.max_by("rep", F.struct(length, -F.col("rep"))).alias("source"))
    merged = merged.where(F.col("words") >= min_words).drop("island")
    if names is None:
        out = merged.select(F.col("doc").alias("doc_id"), F.lit(None).cast("long").alias("text_hash"), "start", "end", "words", "similarity", F.col("source").alias("source_doc_id"))
    else:
        out = merged.join(names, "doc").join(names.select(F.col("doc").alias("source"), F.col("doc_id").alias("source_doc_id")), "source")
    return out.select("doc_id", "start", "end", "words", "similarity", "source_doc_id", "text_hash")


def cut_passages(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the passages cut out of the texts; rows of which no word is left go, other rows and columns stay."""
    spans = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    text = F.col(text_col).cast("string")
    out = df.join(spans, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__hash").isNull() | (F.col("__hash") == F.xxhash64(text))), "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["end"]))
    ends = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.char_length(text)))
    left = F.array_join(F.zip_with(starts, ends, lambda s, e: F.substring(text, s + 1, F.greatest(e - s, F.lit(0)))), "")
    out = out.withColumn("__left", F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(left))
    kept = out.where(F.col("__spans").isNull() | (F.trim(F.translate("__left", "\n\t\r", "   ")) != ""))
    return kept.select(*[F.col("__left").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op3_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents")).drop("text_hash")
