"""Language-model scores by deleted interpolation.

The model is a bigram model: P(w | v) = a(k) c(v w) / c(v) + b(k) c(w) / N + g(k) / (V + 1), maximum-likelihood
estimates of three orders mixed with weights that depend on k, the bucket (by powers of two) of how often the context
v was seen. The weights of each bucket are learned by expectation-maximisation on held-out counts: every training
token in turn is held out, its own occurrence deleted from all three counts. A text begins after a start mark and
ends with an end token; all unknown words share the 1 / (V + 1).

Work goes by blocks of rows. A block sends each distinct word and bigram once, as sorted 64-bit hashes with its
training counts, packed by hash range; a range's task sums them and answers each block with the totals in the same
order; the block then has all counts of its tokens. Neither a frequent word nor a large source weighs on one task: a
block sends a word once however often it stands there, and ranges are cut by the hash, their number by the bytes.
For the mixture weights each block counts its held-out events in cells (bucket, ratio, count), whose number is bounded.

Odd input: a null or empty text is the end token alone; without training text N = V = 0, counts are 0 and each token
is scored 1 / (V + 1) by both scores; rows that repeat an id are each answered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.shared import forget, materialise

BLOCK_BYTES = 8 << 20
RANGE_BYTES = 48 << 20  #: bytes of the corpus for each hash range
LEAST_RANGES = 64
END, START = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x57A27000057A2700)
SPARE_BITS = 18  #: a bigram's hash has so many bits more than the number of tokens, so that fewer than one in 2 ** 18 shares it
EM_ROUNDS = 60
GRID = 8  #: cells for each doubling of a ratio or count
A_SCHEMA = "kind string, block bigint, range int, hashes binary, counts binary, keys array<bigint>, train array<boolean>, sizes array<int>, tokens binary"
B_SCHEMA = "kind string, block bigint, range int, counts binary, known bigint, total bigint"
C_SCHEMA = "key bigint, held_out boolean, n_tokens bigint, n_known bigint, words binary, pairs binary, contexts binary, cells array<struct<cell: int, n: bigint>>"


def bigrams(words: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Hash of each token with the one before it; ``first`` are the places of texts' first tokens."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first] = START
    return tb.mix(before * np.uint64(0xD6E8FEB86659FD93) + words) >> np.uint64(64 - bits)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block, each text's end token included, and the number of each text."""
    low = tb.ASCII_LOWER[data]
    starts, ends = tb.spans(low, tb.NOT_SPACE)
    ptr = tb.pointers(starts, offsets)
    sizes = np.diff(ptr) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = tb.hashes(low, starts, ends)
    return out, sizes


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 up as compressed bytes: all lowest bytes, then all next ones, up to the widest."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : packed[0]] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Rising numbers by their steps."""
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


A_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("range", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary())])
B_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("range", pa.int32()), ("counts", pa.binary()), ("known", pa.int64()), ("total", pa.int64())])
CELL = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))
C_ARROW = pa.schema([("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("contexts", pa.binary()), ("cells", CELL)])


def ranges_of(hashes: np.ndarray, n_ranges: int, bits: int) -> tuple[list[int], list[int]]:
    """Bounds of the ranges in sorted hashes of so many bits, and the least hash of each range."""
    lows = [r << bits - n_ranges.bit_length() + 1 for r in range(n_ranges)]
    return [*np.searchsorted(hashes, np.array(lows, np.uint64)).tolist(), len(hashes)], lows


def cut(batches: Iterator[pa.RecordBatch], n_ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (key, train, text) as range parts of their distinct words and bigrams, and their token sequences."""
    block = TaskContext.get().partitionId() << 32
    for rows in batches:
        keys, train = rows.column("key"), rows.column("train").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in tb.blocks(rows.column("text"), BLOCK_BYTES):
            words, sizes = tokens(data, offsets)
            first = np.cumsum(sizes) - sizes
            learn = np.repeat(train[lo:hi], sizes)
            out = []
            for kind, hashes, size in (("word", words, 64), ("pair", bigrams(words, first, bits), bits)):
                distinct, which = np.unique(hashes, return_inverse=True)
                counts = np.bincount(which[learn], minlength=len(distinct))
                bounds, lows = ranges_of(distinct, n_ranges, size)
                for r, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if b > a:
                        out.append({"kind": kind, "block": block, "range": r, "hashes": pack_sorted(distinct[a:b] - np.uint64(lows[r])), "counts": pack(counts[a:b])})
                if kind == "word":  # frequent words get small numbers
                    order = np.argsort(-np.bincount(which, minlength=len(distinct)), kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    whole = {"kind": "text", "block": block, "range": None, "keys": keys.slice(lo, hi - lo).to_pylist(), "train": train[lo:hi].tolist(), "sizes": sizes.tolist(), "tokens": pack(rank[which]), "counts": pack(order), "hashes": pack_sorted(distinct)}
            for a in range(0, len(out), 256):
                yield batch(A_ARROW, out[a : a + 256])
            yield batch(A_ARROW, [whole])
            block += 1


def add_up(part: pa.Table) -> pa.Table:
    """Totals over all blocks of one kind's hashes in one range, for each block in the order it sent them."""
    kind, number = part["kind"][0].as_py(), part["range"][0].as_py()
    hashes = [unpack_sorted(x) for x in part["hashes"].to_pylist()]
    counts = np.concatenate([unpack(x) for x in part["counts"].to_pylist()])
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(which, counts, len(distinct)).astype(np.int64)  # exact below 2 ** 53
    rows, at = [], 0
    for block, h in zip(part["block"].to_pylist(), hashes, strict=True):
        rows.append({"kind": kind, "block": block, "range": number, "counts": pack(totals[which[at : at + len(h)]])})
        at += len(h)
    rows.append({"kind": "sum-" + kind, "block": None, "range": number, "known": int((totals > 0).sum()), "total": int(totals.sum())})
    return pa.Table.from_pylist(rows, B_ARROW)


def grid(x: np.ndarray) -> np.ndarray:
    """Cell of a number from 0 up: 0 to 15 as they are, then GRID cells for each doubling."""
    return np.where(x < 16, x, 16 + np.round(GRID * (np.log2(np.maximum(x, 16)) - 4))).astype(np.int64)


def ungrid(cell: np.ndarray) -> np.ndarray:
    return np.where(cell < 16, cell, np.exp2(4 + (cell - 16) / GRID))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def cells_of(words: np.ndarray, pairs: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Cells of held-out training tokens, each without its own occurrence: bucket, ratio to the context, count of the word."""
    ratio = np.where((pairs > 1) & (contexts > 1), np.minimum(1 + np.round(-GRID * np.log2(np.maximum(pairs - 1, 1) / np.maximum(contexts - 1, 1))), 511), 0)
    return (bucket(contexts - 1) * 512 + ratio.astype(np.int64)) * 512 + grid(words - 1)


def count_up(part: pa.Table, bits: int) -> pa.Table:
    """A block's texts with the totals of each token, its pair and its context; and its held-out events by cell."""
    kinds = np.array(part["kind"].to_pylist())
    order = np.argsort(np.array(part["range"].to_pylist(), object).astype(float), kind="stable")
    column = part["counts"].to_pylist()
    totals = {k: np.concatenate([unpack(column[i]) for i in order if kinds[i] == k] or [np.empty(0, np.uint64)]).astype(np.int64) for k in ("word", "pair")}
    (text,) = part.take(np.flatnonzero(kinds == "text")).to_pylist()
    sizes = np.array(text["sizes"], np.int64)
    which = unpack(text["counts"]).astype(np.int64)[unpack(text["tokens"]).astype(np.int64)]
    words = unpack_sorted(text["hashes"])[which]
    ends = np.cumsum(sizes)
    first = ends - sizes
    _, pair = np.unique(bigrams(words, first, bits), return_inverse=True)
    c_word, c_pair = totals["word"][which], totals["pair"][pair]
    c_context = np.empty_like(c_word)
    c_context[1:] = c_word[:-1]
    c_context[first] = -1  # the start mark: as many as training texts, which are as many as end tokens
    c_end = totals["word"][which[ends - 1]][0] if len(ends) else 0
    c_context[first] = c_end
    learn = np.repeat(np.array(text["train"], bool), sizes)
    cells, n = np.unique(cells_of(c_word[learn], c_pair[learn], c_context[learn]), return_counts=True)
    known = np.add.reduceat(c_word > 0, first, dtype=np.int64)
    rows = [
        {"key": key, "held_out": not train, "n_tokens": b - a, "n_known": k, "words": pack(c_word[a:b]), "pairs": pack(c_pair[a:b]), "contexts": pack(c_context[a : a + 1])}
        for key, train, a, b, k in zip(text["keys"], text["train"], first.tolist(), ends.tolist(), known.tolist(), strict=True)
    ]
    rows.append({"cells": [{"cell": c, "n": k} for c, k in zip(cells.tolist(), n.tolist(), strict=True)]})
    return pa.Table.from_pylist(rows, C_ARROW)


class Mixture:
    """Weights of the three orders by bucket, with N and V."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, total: int, known: int):
        self.total, self.known = total, known
        b, ratio, word = cells // 512 // 512, cells // 512 % 512, cells % 512
        p = np.stack([np.where(ratio > 0, np.exp2(-(ratio - 1) / GRID), 0.0), ungrid(word) / max(total - 1, 1), np.full(len(cells), 1 / (known + 1))])
        self.weights = np.tile(np.array([0.4, 0.5, 0.1]), (66, 1))
        self.weights[0] = 0, 0.9, 0.1
        for _ in range(EM_ROUNDS if len(cells) else 0):
            share = self.weights[b].T * p
            share *= counts / np.maximum(share.sum(0), 1e-300)
            new = np.stack([np.bincount(b, s, 66) for s in share], axis=1)
            new[:, 2] += 1e-3  # an unknown word is never impossible
            seen = new.sum(1) > 0.01
            self.weights[seen] = new[seen] / new[seen].sum(1, keepdims=True)

    def scores(self, words: np.ndarray, pairs: np.ndarray, start: int) -> tuple[float, float]:
        """Sums of log10 of add-one unigrams, and of the mixture."""
        n, v = self.total, self.known
        base = np.log10((words + 1) / (n + (v + 1))).sum()
        contexts = np.concatenate([[start], words[:-1]])
        w = self.weights[bucket(contexts)]
        p = w[:, 0] * pairs / np.maximum(contexts, 1) + w[:, 1] * words / max(n, 1) + w[:, 2] / (v + 1)
        return float(base), float(np.log10(np.maximum(p, 1e-300)).sum())


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; it learns from rows not held out."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    n_ranges = max(LEAST_RANGES, 1 << (size["bytes"] // RANGE_BYTES).bit_length())
    bits = min(64, SPARE_BITS + (size["rows"] + size["bytes"] // 2).bit_length())  # a token but the last has a byte and a space
    rows = docs.select(F.col(key).cast("bigint").alias("key"), (~held_out).alias("train"), F.coalesce(text, F.lit("")).alias("text"))
    parts = materialise(rows.mapInArrow(lambda batches: cut(batches, n_ranges, bits), A_SCHEMA), "ngram-parts", by="kind")
    sent = parts.where("kind <> 'text'").select("kind", "block", "range", "hashes", "counts")
    sums = materialise(sent.groupBy("kind", "range").applyInArrow(add_up, B_SCHEMA), "ngram-sums")
    forget(parts, "kind=word", "kind=pair")
    whole = {r["kind"]: r for r in sums.where("block is null").groupBy("kind").agg(F.sum("known").alias("known"), F.sum("total").alias("total")).collect()}
    n, v = (whole["sum-word"]["total"], whole["sum-word"]["known"]) if whole else (0, 0)

    texts = parts.where("kind = 'text'").select("kind", "block", "range", "counts", "hashes", "keys", "train", "sizes", "tokens")
    answers = sums.where("block is not null").select("kind", "block", "range", "counts", *[F.lit(None).cast(t).alias(c) for c, t in (("hashes", "binary"), ("keys", "array<bigint>"), ("train", "array<boolean>"), ("sizes", "array<int>"), ("tokens", "binary"))])
    counted = materialise(texts.unionByName(answers).groupBy("block").applyInArrow(lambda part: count_up(part, bits), C_SCHEMA), "ngram-counts")
    forget(parts)
    forget(sums)
    cells = counted.where("cells is not null").select(F.explode("cells").alias("c")).groupBy("c.cell").agg(F.sum("c.n").alias("n")).collect()
    cells.sort()
    mixture = spark.sparkContext.broadcast(Mixture(np.array([r[0] for r in cells], np.int64), np.array([r[1] for r in cells], float), n, v))

    @F.arrow_udf("struct<base_score: double, score: double>")
    def scored(words: pa.Array, pairs: pa.Array, contexts: pa.Array) -> pa.Array:
        found = [mixture.value.scores(unpack(w).astype(np.int64), unpack(p).astype(np.int64), int(unpack(c)[0])) for w, p, c in zip(words.to_pylist(), pairs.to_pylist(), contexts.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(2)], ["base_score", "score"])

    out = counted.where("cells is null").withColumn("s", scored("words", "pairs", "contexts"))
    return out.select("key", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "s.base_score", "s.score")
