"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is good or bad. A line's evidence are binned measures of itself and of the lines before and
after it; two neighbouring labels have a weight for each pair. Forward-backward gives each line's chance to be good; the
mean of these, weighted by the lines' lengths, is the document's quality, which a logistic curve maps to the share of
good documents. Weights are learnt on the driver from at most `sample` labelled documents (FIT_DOCUMENTS), those first by
a hash of their id: lines begin with their document's label, then the lines of bad documents are labelled anew by the
model, and the fit is repeated. Scores come from texts alone.

A null text, or one of blank lines only, is one blank line. Equal rows get equal scores. A null label or id takes no part
in the fit. Without labelled documents of both kinds every score is 0.5. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Labelled documents that the fit takes at most, and their characters together; longer samples leave out what exceeds them.
FIT_DOCUMENTS, FIT_CHARACTERS = 4_000, 32_000_000
BINS, STEPS, ROUNDS, RATE, RIDGE = 8, 60, 2, 0.15, 1e-3
FOLDS, THRESHOLD = 5, 0.3

#: Character classes: 0 other symbol, 1 lower letter, 2 upper letter, 3 digit, 4 space, 5 stop or comma, 6 "!" or "?", 7 "|" and other brackets.
LETTER, UPPER, DIGIT, SPACE, STOP, LOUD, FENCE = range(1, 8)


def character_classes() -> np.ndarray:
    out = np.zeros(0x250, np.int8)
    for c in range(len(out)):
        x = chr(c)
        out[c] = UPPER if x.isupper() else LETTER if x.isalpha() else DIGIT if x.isdigit() else SPACE if x.isspace() else STOP if x in ".,;:'\"-" else LOUD if x in "!?" else FENCE if x in "|<>{}[]()\\/=_" else 0
    return out


CLASSES = character_classes()
MEASURES = 14
#: Characters that are looked at together.
PART = 1 << 18


def totals(parts: list[str]) -> np.ndarray:
    """For each part its characters by class, the words that begin in it (white space before the first), and its last character's class."""
    codes = np.frombuffer("\n".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.where(codes < len(CLASSES), CLASSES[np.minimum(codes, len(CLASSES) - 1)], np.int8(LETTER))
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    start = np.cumsum(np.append(1, length[:-1] + 1))
    word = np.append(False, (kind[1:] != SPACE) & (kind[:-1] == SPACE))
    spans = np.stack([start, start + length], 1).ravel()

    def total(x: np.ndarray) -> np.ndarray:  # an empty span would sum to its first place
        return np.add.reduceat(x, spans, dtype=np.int32)[::2] * (length > 0)

    return np.stack([*[total(kind == k) for k in range(8)], total(word), kind[start + np.maximum(length, 1) - 1]], 1).astype(np.int64)


def words_in(line: str) -> tuple[float, float]:
    """Shares of a line's words that are distinct, and that repeat the one before; a long line is not split at once."""
    if len(line) <= PART:
        x = line.split()
        return len(set(x)) / max(1, len(x)), sum(map(str.__eq__, x, x[1:])) / max(1, len(x))
    n = same = 0
    seen, before = set(), None
    for m in re.finditer(r"\S+", line):
        word = hash(m[0])
        n, same, before = n + 1, same + (word == before), word
        seen.add(word)
    return len(seen) / max(1, n), same / max(1, n)


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures (a row for each line), the lines' lengths, and how many lines each text has.

    Characters are counted in parts of PART characters at most, so that a long text or line needs no more memory at once.
    """
    lines, sizes = [], []
    for t in texts:
        found = [x for x in t.split("\n") if x and not x.isspace()] or [""]
        lines += found
        sizes.append(len(found))
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    counts, held, size = [], [], 0
    for k, line in enumerate(lines):
        if len(line) <= PART:
            held.append(line)
            size += len(line)
        else:
            cut = [totals([line[at : at + PART]])[0] for at in range(0, len(line), PART)]
            one = np.sum(cut, axis=0)
            # a word that goes on in the next part begins once
            one[8] -= sum(not line[at - 1].isspace() and not line[at].isspace() for at in range(PART, len(line), PART))
            one[9] = cut[-1][9]
            counts += [totals(held)] * bool(held) + [one[None, :]]
            held, size = [], 0
        if held and (size > PART or k + 1 == len(lines)):
            counts.append(totals(held))
            held, size = [], 0
    by = np.concatenate(counts).T if counts else np.zeros((10, 0), np.int64)
    n = np.maximum(length, 1)
    words = np.maximum(by[8], 1)
    letters = np.maximum(by[LETTER] + by[UPPER], 1)
    ordinal = np.repeat(np.arange(len(sizes)), sizes)
    hashes = np.fromiter(map(hash, lines), np.int64, len(lines))
    _, inverse, often = np.unique(np.stack([ordinal, hashes], 1), axis=0, return_inverse=True, return_counts=True)
    last = by[9]
    distinct, echoed = np.array([words_in(x) for x in lines]).reshape(-1, 2).T
    columns = [np.log1p(length), (by[LETTER] + by[UPPER]) / n, by[UPPER] / letters, by[DIGIT] / n, by[SPACE] / n, by[STOP] / words, by[LOUD] / words, by[FENCE] / words, by[0] / n, letters / words, np.minimum(often[inverse.ravel()], 5), (last == STOP).astype(float), distinct, echoed]
    return np.stack(columns, 1), n.astype(float), np.array(sizes)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1)


def neighbours(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the line before and after each line of its document; -1 for none."""
    n = int(sizes.sum())
    ends = np.cumsum(sizes)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    before[np.append(0, ends[:-1])] = -1
    after[ends - 1] = -1
    return before, after


def feature_ids(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each line the features that hold: bins of the line, the line before and the line after, and missing neighbours."""
    per = MEASURES * (BINS + 1)
    own = bins + np.arange(MEASURES) * (BINS + 1)
    out = [own]
    for k, at in enumerate(neighbours(sizes), 1):
        ids = own[at] + k * (per + 1)
        ids[at < 0] = k * (per + 1) + per
        out.append(ids)
    return np.concatenate(out, 1)


FEATURES = 3 * (MEASURES * (BINS + 1) + 1) + 1


def chains(sizes: np.ndarray) -> list[np.ndarray]:
    """Positions of the first lines of all documents, of the second lines, and so on."""
    start = np.cumsum(np.append(0, sizes[:-1]))
    order = np.argsort(-sizes, kind="stable")
    counts = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right") if len(sizes) else []
    return [start[order[:c]] + t for t, c in enumerate(counts)]


def marginals(unary: np.ndarray, pair: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each line to be good, and expected counts of label pairs. unary: log-odds of good; pair: 2 x 2 weights."""
    steps = chains(sizes)
    score = np.stack([np.zeros(len(unary)), unary], 1)
    ahead, back = np.empty_like(score), np.zeros_like(score)
    for t, at in enumerate(steps):
        if t:
            into = ahead[steps[t - 1][: len(at)]][:, :, None] + pair
            ahead[at] = score[at] + np.logaddexp(into[:, 0], into[:, 1])
        else:
            ahead[at] = score[at]
        ahead[at] -= ahead[at].max(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        before = steps[t - 1][: len(at)]
        out = pair + (score[at] + back[at])[:, None, :]
        joint = ahead[before][:, :, None] + out
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[before] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        back[before] -= back[before].max(axis=1, keepdims=True)
    odds = (ahead + back)[:, 1] - (ahead + back)[:, 0]
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500))), expected


def weighted_mean(p: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.cumsum(np.append(0, sizes[:-1]))
    return np.add.reduceat(p * length, at) / np.add.reduceat(length, at) if len(sizes) else np.zeros(0)


class Model:
    def __init__(self) -> None:
        self.edges = [np.zeros(0)] * MEASURES
        self.weights, self.pair, self.curve = np.zeros(FEATURES), np.zeros((2, 2)), (0.0, 0.0)

    def unary(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[ids].sum(axis=1) + self.weights[-1]

    def qualities(self, texts: list[str]) -> np.ndarray:
        x, length, sizes = measures(texts)
        p, _ = marginals(self.unary(feature_ids(binned(x, self.edges), sizes)), self.pair, sizes)
        return weighted_mean(p, length, sizes)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.curved(self.qualities(texts)) if texts else np.zeros(0)

    def curved(self, q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(q / (1 - q)) + self.curve[1])))

    def learn(self, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Gradient ascent with adaptive steps on the chains' conditional likelihood; weight: of each line's label."""
        before, _ = neighbours(sizes)
        inner = np.nonzero(before >= 0)[0]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[before[inner]].astype(int), y[inner].astype(int)), 1.0)
        n, fast, slow = len(y), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for step in range(1, STEPS + 1):
            p, expected = marginals(self.unary(ids), self.pair, sizes)
            err = (y - p) * weight
            g = np.bincount(ids.ravel(), np.repeat(err, ids.shape[1]), FEATURES)
            g[-1] = err.sum()
            g = np.concatenate([g, (seen - expected).ravel()]) / n - RIDGE * np.append(self.weights, self.pair)
            fast = 0.9 * fast + 0.1 * g
            slow = 0.99 * slow + 0.01 * g * g
            move = RATE * (fast / (1 - 0.9**step)) / (np.sqrt(slow / (1 - 0.99**step)) + 1e-8)
            self.weights += move[:FEATURES]
            self.pair += move[FEATURES:].reshape(2, 2)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Model learnt from documents with labels 0 and 1."""
    model, good = Model(), np.array(labels, float)
    if len(set(labels)) < 2:
        return model
    x, length, sizes = measures(texts)
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(MEASURES)]
    ids = feature_ids(binned(x, model.edges), sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    y = good[document]
    share = good.mean()
    weight = np.where(good > 0, 0.5 / share, 0.5 / (1 - share))[document]
    for k in range(ROUNDS):
        model.learn(ids, sizes, y, weight)
        if k + 1 < ROUNDS:
            p, _ = marginals(model.unary(ids), model.pair, sizes)
            worst = np.minimum.reduceat(p, np.cumsum(np.append(0, sizes[:-1])))[document]
            y = np.where((good[document] == 0) & (p > 0.5) & (p > worst), 1.0, good[document])
    p, _ = marginals(model.unary(ids), model.pair, sizes)
    q = np.clip(weighted_mean(p, length, sizes), 1e-6, 1 - 1e-6)
    z = np.log(q / (1 - q))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a ridge, so that separable labels end too
        s = 1 / (1 + np.exp(-(a * z + b)))
        r = s * (1 - s)
        grad = np.array([((good - s) * z).sum() - 0.1 * a, (good - s).sum() - 0.01 * b])
        hess = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 0.01]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    model.curve = (float(a), float(b))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = FIT_DOCUMENTS, characters: int = FIT_CHARACTERS) -> Model:
    """Model from at most `sample` labelled documents outside the held-out fold, whose texts have at most `characters` together.

    Rows that repeat an id count as one, that of the longest text.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    sizes = found.groupBy("doc_id").agg(F.max(F.struct(F.char_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("x")).select("doc_id", "x.n", "x.h").toPandas().sort_values(["n", "doc_id"])
    taken = sizes[sizes["n"].cumsum() <= characters][["doc_id", "h"]]
    if taken.empty:
        return fit([], [])
    one = docs.sparkSession.createDataFrame(taken, "doc_id long, h long")
    rows = found.join(F.broadcast(one), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id"]).select("doc_id", "text", "label").toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["label"].tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores([x or "" for x in batch.column(1).to_pylist()]))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, with all their columns, whose score reaches the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, at):
            yield batch.filter(pa.array(model.scores([x or "" for x in batch.column(at).to_pylist()]) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit_table(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
