"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their votes are counted by pattern over all
documents, and expectation-maximisation on the pattern counts estimates how often each labeller says what for good
and for bad documents; that gives each pattern a posterior. A logistic scorer over hashed features (letter trigrams
and binned statistics of the text) is then trained on the posteriors of all documents, and scores each of them.

The features are written once; each step of the training reads them and adds up its gradient in whole numbers, so that the
model is the same however the rows are spread. The patterns are at most 3 ** 11, whatever the number of documents. Odd input: a null text counts as empty; the empty
table trains nothing and returns no rows; repeated rows each get the same answer; scores equal to the threshold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import docstats
from tidemark.llm import textbytes as tb
from tidemark.llm.shared import HASH_UNITS, forget, hash_unit, materialise

GOOD, BAD, NONE = 2, 1, 0
#: The first ones know one fault each, the last three what is good. Texts of few words get fewer votes.
LABELLERS = ("empty", "symbols", "capitals", "repeats", "lines", "shouting", "sameness", "tables", "letters", "sentences", "variety")
SAMPLE_DOCS = 4096  #: documents that sample() draws; nothing is fitted on them
DIMENSIONS = 2048  #: hashed features: one half for trigrams, one for binned statistics
EM_ROUNDS = 100
PASSES = 80  #: over the features at most, one for each gradient
FLAT = 1e-5  #: length of the gradient at which the training ends
DECAY = 1e-4
THRESHOLD = 0.35  #: at most; a score below the threshold is rejected
KEEP_GOOD = 0.002  #: share of the documents with a good posterior that the threshold may reject
CELLS = 1 << 10  #: of a histogram of scores; the threshold is read from two, one within a cell of the other
FIXED = 1 << 20
UNIT = 1 << 32  #: parts of a unit in which gradients are added up
ROWS = 256  #: texts whose features are dense at once
RESULT = "pattern int, score double"
FEATURES = "pattern int, length long, bins binary, trigrams binary"


def ratios(x: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics as ratios; 0 where there is nothing to divide by."""
    col = {name: x[:, i].astype(float) for i, name in enumerate(docstats.NAMES)}
    words, letters, lines = (np.maximum(col[k], 1) for k in ("n_words", "n_letters", "n_lines"))
    return {
        "words": col["n_words"], "symbols": col["n_symbols"] / words, "capitals": col["n_upper"] / letters,
        "repeats": col["n_repeat_words"] / words, "lines": col["n_dup_lines"] / lines, "shouting": col["n_shouts"] / words,
        "variety": col["n_distinct_words"] / words, "sentences": col["n_stops"] / words, "tables": col["n_pipes"] / words,
        "digits": col["n_digits"] / letters, "word_length": col["word_chars"] / words, "n_lines": col["n_lines"], "letters": (col["n_letters"] + col["n_stops"]) / np.maximum(col["word_chars"], 1),
    }


def votes(x: np.ndarray) -> np.ndarray:
    """Votes of the labellers, a row for each text."""
    r = ratios(x)
    n, enough = r["words"], r["words"] >= 10
    n_dup = x[:, docstats.NAMES.index("n_dup_lines")]
    faults = [
        n < 1,
        r["symbols"] > 0.25,
        enough & (r["capitals"] > 0.5),
        enough & (r["repeats"] > 0.3),
        (n_dup >= 3) & (r["lines"] > 0.3),
        enough & (r["shouting"] > 0.3),
        enough & (r["variety"] < 0.55 / (1 + n / 3000)),
        enough & (r["tables"] > 0.2),
    ]
    virtues = [
        (enough & (r["letters"] > 0.9), (n >= 20) & (r["letters"] < 0.8)),
        (enough & (r["sentences"] > 0.03) & (r["capitals"] < 0.15), (n >= 50) & (r["sentences"] < 0.02)),
        (enough & (r["variety"] > 0.6 / (1 + n / 3000)) & (r["repeats"] < 0.1), enough & (r["variety"] < 0.4 / (1 + n / 3000))),
    ]
    return np.stack([np.where(f, BAD, np.where(enough, GOOD, NONE)) for f in faults] + [np.where(bad, BAD, np.where(good, GOOD, NONE)) for good, bad in virtues], axis=1)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """``says[c, j, v]``: how often labeller j, where it votes, says v of a document of class c (0 bad, 1 good).

    A labeller that does not vote says nothing about the class: ``says[c, j, 0]`` is 1. ``share``: of good documents.
    """

    says: np.ndarray
    share: float

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        v = votes_of(np.asarray(pattern, np.int64))
        log = np.log(self.says)[:, np.arange(len(LABELLERS)), v].sum(-1)
        gap = np.clip(log[0] - log[1] + np.log((1 - self.share) / self.share), -500, 500)
        return 1 / (1 + np.exp(gap))

    def accuracies(self) -> np.ndarray:
        """For each labeller, how often a vote that it casts is right."""
        return self.share * self.says[1, :, GOOD] + (1 - self.share) * self.says[0, :, BAD]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation over pattern counts. At first a bad vote outweighs good ones: each labeller knows one fault."""
    v = votes_of(patterns)
    p = np.where((v == BAD).any(1), 0.02, 0.98)
    cast = (v[:, :, None] == np.arange(3)) & (np.arange(3) != NONE)
    model = LabelModel(np.ones((2, len(LABELLERS), 3)), 0.5)
    for _ in range(EM_ROUNDS):
        weight = np.stack([(1 - p) * counts, p * counts])
        says = np.einsum("cp,pjv->cjv", weight, cast) + 0.5
        says /= says[:, :, 1:].sum(2, keepdims=True)
        says[:, :, NONE] = 1
        model = LabelModel(says, float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99)))
        new = model.posterior(patterns)
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return model


BINS = np.array([0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9, 1.5, 3, 6, 10, 20, 50, 200, 1000])


def binned(x: np.ndarray) -> np.ndarray:
    """Hashed features of binned statistics, one column for each statistic."""
    half = DIMENSIONS // 2
    out = [half + (j * 0x9E3779B1 + np.searchsorted(BINS, r, "right") * 0x85EBCA6B) % (1 << 32) * 0xC2B2AE35 % (1 << 32) * half // (1 << 32) for j, r in enumerate(ratios(x).values())]
    return np.stack([o.astype(np.int64) for o in out], axis=1)


def trigram_slots(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Hashed feature of the three bytes that end at each place, letters in lower case; before a text's head are line feeds."""
    low = tb.ASCII_LOWER[data].astype(np.uint32)
    code = low.copy()
    code[1:] |= low[:-1] << np.uint32(8)
    code[2:] |= low[:-2] << np.uint32(16)
    code[1:2] |= np.uint32(0x0A0000)  # before the first text there is no line feed in the data
    code[heads] = low[heads] | np.uint32(0x0A0A00)
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - (DIMENSIONS // 2).bit_length() + 1)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dense feature rows: shares of trigrams and indicators of bins."""
    n, half = len(offsets) - 1, DIMENSIONS // 2
    slots = trigram_slots(data, offsets[:-1]) + np.repeat(np.arange(n) * half, np.diff(offsets))
    out = np.zeros((n, DIMENSIONS), np.float32)
    out[:, :half] = np.bincount(slots, minlength=n * half).reshape(n, half) / np.diff(offsets)[:, None] * 20
    np.put_along_axis(out, binned(x), 1.0, axis=1)
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray, x: np.ndarray) -> np.ndarray:
        lengths, heads = np.diff(offsets), offsets[:-1]
        total = np.zeros(len(lengths), np.int64)
        table = self.table()
        for lo in range(0, len(data), tb.SEGMENT):  # one segment of bytes at a time, also within one text
            hi = min(lo + tb.SEGMENT, len(data))
            back = min(lo, 2)
            a, b = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            total[a:b] += np.add.reduceat(table[trigram_slots(data[lo - back : hi], heads[(heads >= lo - back) & (heads < hi)] - lo + back)[back:]], np.maximum(offsets[a:b] - lo, 0))
        return logistic(self.margins(total, lengths, binned(x)))

    def table(self) -> np.ndarray:
        """Weights of the trigrams in whole numbers: equal texts sum up equally."""
        return np.round(self.weights[: DIMENSIONS // 2] * 20 * FIXED).astype(np.int64)

    def margins(self, total: np.ndarray, lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return total / (FIXED * lengths) + self.weights[np.sort(bins, axis=1)].sum(1) + self.bias


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """How often each hashed trigram stands in each text, a row for each, ROWS texts and one segment of bytes at a time."""
    half = DIMENSIONS // 2
    for a in range(0, len(offsets) - 1, ROWS):
        at = offsets[a : a + ROWS + 1]
        out = np.zeros((len(at) - 1) * half, np.int64)
        for lo in range(int(at[0]), int(at[-1]), tb.SEGMENT):
            hi = min(lo + tb.SEGMENT, int(at[-1]))
            back = min(lo, 2)
            heads = at[:-1][(at[:-1] >= lo - back) & (at[:-1] < hi)] - lo + back
            slots = trigram_slots(data[lo - back : hi], heads)[back:]
            out += np.bincount(slots + np.repeat(np.arange(len(at) - 1) * half, np.diff(np.clip(at, lo, hi))), minlength=len(out))
        yield out.reshape(-1, half)


def feature_table(docs: DataFrame, text: str) -> DataFrame:
    """Pattern of votes and features of every document, written to the shared folder.

    Counts of trigrams take the fewest bytes that hold the largest one of their text.
    """

    @F.arrow_udf(f"struct<{FEATURES}>")
    def measure(texts: pa.Array) -> pa.Array:
        patterns, lengths, bins, packed = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [], []
        for _, _, data, offsets in tb.blocks(texts):
            x, _ = docstats.measure(data, offsets)
            patterns.append(pattern_of(votes(x)).astype(np.int32))
            lengths.append(np.diff(offsets))
            bins += [row.tobytes() for row in binned(x).astype("<i2")]
            for counts in trigram_counts(data, offsets):
                width = np.select([counts.max(1) < 1 << 8, counts.max(1) < 1 << 16], [1, 2], 8)
                as_width = {w: counts.astype(f"<u{w}") for w in set(width.tolist())}
                packed += [as_width[w][i].tobytes() for i, w in enumerate(width.tolist())]
        columns = [pa.array(np.concatenate(patterns)), pa.array(np.concatenate(lengths)), pa.array(bins, pa.binary()), pa.array(packed, pa.binary())]
        return pa.StructArray.from_arrays(columns, ["pattern", "length", "bins", "trigrams"])

    return materialise(docs.select(measure(F.col(text)).alias("f")).select("f.*"), "quality-features")


def dense(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Patterns, lengths, bins and counts of trigrams of the rows of a batch, those of one width together."""
    widths = pc.binary_length(batch["trigrams"]).to_numpy(zero_copy_only=False) // (DIMENSIONS // 2)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        for lo in range(0, len(at), ROWS):
            part = batch.take(pa.array(at[lo : lo + ROWS]))
            bins, counts = (np.frombuffer(part[name].buffers()[2], kind).reshape(part.num_rows, -1) for name, kind in (("bins", "<i2"), ("trigrams", f"<u{w}")))
            yield part["pattern"].to_numpy(), part["length"].to_numpy(), bins, counts.astype(float)


@dataclass
class Posteriors:
    """Of each pattern that occurs: how many documents have it and how surely these are good."""

    pattern: np.ndarray
    count: np.ndarray
    good: np.ndarray

    def of(self, pattern: np.ndarray) -> np.ndarray:
        return self.good[np.searchsorted(self.pattern, pattern)]

    def weights(self) -> tuple[float, float]:
        """Weights of a bad and of a good document, with which both classes weigh half of all."""
        n, good = self.count.sum(), (self.count * self.good).sum()
        return n / (2 * max(n - good, 1)), n / (2 * max(good, 1))


def added_up(table: DataFrame, totals_of, slots: int) -> np.ndarray:
    """Sums of the arrays of whole numbers that ``totals_of`` gives for (patterns, lengths, bins, counts)."""

    def task(batches):
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for part in dense(batch):
                total += totals_of(*part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array(total)], ["slot", "total"])

    sums = table.mapInArrow(task, "slot int, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    out = np.zeros(slots)
    for slot, total in sums.collect():
        out[slot] = int(total)
    return out


def loss_and_gradient(table: DataFrame, sent, at: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss on soft labels over all documents, both classes weighing the same; its gradient by weights and bias."""
    scorer = Scorer(at[:-1], float(at[-1]), THRESHOLD)
    half, trigrams = DIMENSIONS // 2, scorer.table().astype(float)

    def totals_of(pattern, length, bins, counts):
        p, (bad, good) = sent.value.of(pattern), sent.value.weights()
        balance = p * good + (1 - p) * bad
        z = scorer.margins(counts @ trigrams, length, bins)
        gap = balance * (logistic(z) - p)
        whole = np.rint(gap * UNIT)
        out = np.empty(DIMENSIONS + 2)
        out[:half] = np.rint(gap / length * UNIT) @ counts  # whole numbers below 2 ** 53 add up exactly in any order
        out[half:DIMENSIONS] = np.bincount(bins.ravel() - half, np.repeat(whole, bins.shape[1]), half)
        out[DIMENSIONS] = whole.sum()
        out[DIMENSIONS + 1] = np.rint(balance * (np.logaddexp(0, z) - p * z) * UNIT).sum()
        return out.astype(np.int64)

    out = added_up(table, totals_of, DIMENSIONS + 2) / UNIT / sent.value.count.sum()
    out[:half] *= 20
    return out[-1] + DECAY / 2 * float(at @ at), out[:-1] + DECAY * at


def minimum(value, at: np.ndarray) -> np.ndarray:
    """Where a convex function is least, by its values and gradients: L-BFGS, steps halved until the function falls."""
    now, slope = value(at)
    passes, steps = 1, []
    while passes < PASSES and np.linalg.norm(slope) > FLAT:
        way, shares = slope.copy(), []
        for step, turn in reversed(steps):
            shares.append(step @ way / (step @ turn))
            way -= shares[-1] * turn
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / np.linalg.norm(slope)
        for (step, turn), share in zip(steps, reversed(shares), strict=True):
            way += step * (share - turn @ way / (step @ turn))
        far = 1.0
        new, new_slope = value(at - way)
        passes += 1
        while new > now - 1e-4 * far * (slope @ way) and passes < PASSES:
            far /= 2
            new, new_slope = value(at - far * way)
            passes += 1
        if new >= now:
            break
        if (far * way) @ (slope - new_slope) > 0:
            steps.append((-far * way, new_slope - slope))
        at, now, slope = at - far * way, new, new_slope
    return at


def threshold_of(table: DataFrame, sent, scorer: Scorer) -> float:
    """THRESHOLD, or the score (its millionths cut) below which KEEP_GOOD of all documents with a good posterior lie, if that is less."""
    surely, trigrams = sent.value.good >= 0.9, scorer.table().astype(float)
    rank, first, size = int(KEEP_GOOD * sent.value.count[surely].sum()), 0, 1
    if not surely.any():
        return THRESHOLD
    for _ in range(2):
        first, size = first * CELLS, size * CELLS

        def totals_of(pattern, length, bins, counts, first=first, size=size):
            s = logistic(scorer.margins(counts @ trigrams, length, bins))
            cell = np.floor(s[sent.value.of(pattern) >= 0.9] * size).astype(np.int64) - first
            return np.bincount(cell[(cell >= 0) & (cell < CELLS)], minlength=CELLS)

        below = np.cumsum(added_up(table, totals_of, CELLS))
        cell = int(np.searchsorted(below, rank, "right"))
        rank -= int(below[cell - 1]) if cell else 0
        first += cell
        if first / size >= THRESHOLD:
            break
    return min(THRESHOLD, first / size)


def sample(docs: DataFrame, text: str, key: str, n_docs: float) -> tuple[np.ndarray, np.ndarray]:
    """Features and patterns of SAMPLE_DOCS documents drawn by hash of id and text (twice as many at most), for a look at them."""

    @F.arrow_udf("struct<pattern: int, features: binary>")
    def gather(texts: pa.Array) -> pa.Array:
        patterns, packed = [], []
        for _, _, data, offsets in tb.blocks(texts, 1 << 20):
            x, _ = docstats.measure(data, offsets)
            patterns.append(pattern_of(votes(x)))
            packed += [row.astype(np.float16).tobytes() for row in features(data, offsets, x)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(patterns).astype(np.int32) if patterns else [], pa.int32()), pa.array(packed, pa.binary())], ["pattern", "features"])

    share = int(min(1.0, SAMPLE_DOCS / max(n_docs, 1)) * HASH_UNITS)
    drawn = docs.select(F.col(text).alias("text"), hash_unit(F.col(key), F.col(text)).alias("at")).where(F.col("at") < share)
    # which rows come is fixed: first by hash of id and text, then by features
    rows = drawn.select("at", gather("text").alias("x")).select("at", "x.*").orderBy("at", "features").limit(2 * SAMPLE_DOCS).toArrow()
    x = np.array([np.frombuffer(b, np.float16) for b in rows["features"].to_pylist()], np.float32).reshape(-1, DIMENSIONS)
    return x, rows["pattern"].to_numpy()


def fit(docs: DataFrame, text: str = "text") -> tuple[LabelModel, Scorer]:
    """Label model, scorer and threshold, each from all documents."""
    table = feature_table(docs, text)
    rows = sorted(table.groupBy("pattern").count().collect())
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    labels = estimate(patterns, counts)
    scorer = Scorer(np.zeros(DIMENSIONS), 0.0, THRESHOLD)
    if rows:
        sent = docs.sparkSession.sparkContext.broadcast(Posteriors(patterns, counts, labels.posterior(patterns)))
        at = minimum(lambda w: loss_and_gradient(table, sent, w), np.zeros(DIMENSIONS + 1))
        scorer = Scorer(at[:-1], float(at[-1]), THRESHOLD)
        scorer.threshold = threshold_of(table, sent, scorer)
    forget(table)
    return labels, scorer


def score(spark, scorer: Scorer, text: str | Column) -> Column:
    """Column of each text's ``pattern`` of votes and ``score``."""
    sent = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf(RESULT)
    def answer(texts: pa.Array) -> pa.Array:
        patterns, scores = [np.empty(0, np.int64)], [np.empty(0)]
        for _, _, data, offsets in tb.blocks(texts):
            x, _ = docstats.measure(data, offsets)
            patterns.append(pattern_of(votes(x)))
            scores.append(sent.value.scores(data, offsets, x))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(patterns).astype(np.int32)), pa.array(np.concatenate(scores))], ["pattern", "score"])

    return answer(text)


def posterior(spark, labels: LabelModel, pattern: str | Column) -> Column:
    """Column of the posterior that a document with this pattern of votes is good."""
    sent = spark.sparkContext.broadcast(labels)

    @F.arrow_udf("double")
    def answer(patterns: pa.Array) -> pa.Array:
        return pa.array(sent.value.posterior(patterns.to_numpy(zero_copy_only=False)))

    return answer(pattern)
