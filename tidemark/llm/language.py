"""Language identification by cross-parsing entropy.

Per language, labelled text becomes a suffix automaton, made total as a table: where a letter cannot extend the
present match, the phrase ends, one is counted, and the next match begins with that letter. A text's phrases times
the bits of a pointer into the labelled text estimate its cross entropy with the language; the lowest wins.

Texts are read whole, as lower-case letters with every other run as one gap. Pieces of PIECE symbols of many texts move
through a table together, first each from a guessed state; a piece that the one before it hands another state is stepped again
until it falls in with its first way. So the phrases are those of the whole text, wherever pieces are cut.

What is learned is a bounded sample: SAMPLE_DOCS labelled texts a language, drawn by hash from the different ones, and of
their different lines those that come first by hash, whole, up to SAMPLE_SYMBOLS symbols. More than TOTAL_SYMBOLS /
SAMPLE_SYMBOLS languages share TOTAL_SYMBOLS alike, so none is left out.

Results for odd input: null text, or none with a letter: ``und`` and score 0. No labelled row: every text is ``und``. Equal
entropies: the language with more labelled texts, then the smaller name. Repeated rows are each answered. Only (text) is read for an answer.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.shared import hash_unit, HASH_UNITS

UNKNOWN = "und"
SAMPLE_DOCS = 100  #: different labelled texts per language, drawn by hash
SAMPLE_LINES = 2_000  #: lines of them that are sent to the driver, first by hash
SAMPLE_SYMBOLS = 30_000  #: symbols of those that an automaton learns
SAMPLE_CHARS = 20_000  #: a longer line is learned to here
TOTAL_SYMBOLS = 600_000  #: symbols of all languages, which bounds the tables
PIECE = 256
CONFIDENCE_SYMBOLS = 50  #: at most so many symbols count as evidence in a score
REJECT_SCORE = 0.3
RESULT = "lang_pred string, score double"
POINTS = 0x110000


@cache
def letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(POINTS, np.uint32)
    for p in range(POINTS):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            out[p] = ord(low) if len(low) == 1 else p
    return out


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a block, each run of other characters as one 0, and the rows' offsets in them; every row ends with 0."""
    text = data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(tb.per_row(data, offsets, tb.HEAD)[0])
    if ends[-1] != len(codes):  # invalid bytes: count the characters of each row as decoded
        ends = np.cumsum([len(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    low = letters()[codes]
    keep = low != 0
    keep[1:] |= low[:-1] != 0
    keep[0] = True
    keep[ends - 1] = True
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return low[keep], np.concatenate([[0], kept[ends]])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``text``."""
    goto, link, size, last = [{}], [-1], [0], 0
    for c in text:
        new = len(goto)
        goto.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return goto


def parse_table(text: list[int], width: int) -> np.ndarray:
    """Total table over (state, symbol): four times the next state's offset, plus the phrases that end there.

    A symbol that cannot extend the match ends it; one that the language does not have is a phrase of its own besides.
    """
    goto = suffix_automaton(text)
    broken = np.full(width, 2, np.int32)
    for c, to in goto[0].items():
        broken[c] = to * width * 4 + 1
    out = np.tile(broken, (len(goto), 1))
    out[0] = 1
    for s, edges in enumerate(goto):
        if edges:
            out[s, list(edges)] = np.fromiter(edges.values(), np.int64) * width * 4
    return out.ravel()


def phrase_counts(table: np.ndarray, codes: np.ndarray, ends: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Phrases of each text in the parse by ``table``; ``codes`` are the texts' symbols, ``ends`` their offsets and the end."""
    sizes = np.diff(ends)
    each = -(-sizes // piece)
    owner = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    begin = ends[:-1][owner] + nth * piece
    length = np.minimum(piece, ends[1:][owner] - begin)
    opened = table[0] >> 2  # a text begins after a gap; so is every piece guessed to
    way, closed = np.empty((piece, len(begin)), np.int32), np.zeros((piece, len(begin)), np.uint8)
    after = np.full(len(begin), opened, np.int32)  # the state in which a piece is left
    todo, state, first = np.argsort(-length, kind="stable"), np.full(len(begin), opened, np.int32), True
    given = np.full(len(begin), opened, np.int32)  # the state in which it was entered
    while len(todo):
        lengths = length[todo]
        for t in range(piece):
            k = int(np.searchsorted(-lengths, -t, "left"))  # pieces longer than t
            if not k:
                break
            todo, state, lengths = todo[:k], state[:k], lengths[:k]
            step = table[state + codes[begin[todo] + t]]
            state = step >> 2
            if not first:
                other = state != way[t, todo]
                closed[t, todo] = step & 3
                todo, state, lengths = todo[other], state[other], lengths[other]
                way[t, todo] = state
            else:
                way[t, todo], closed[t, todo] = state, step & 3
            done = lengths == t + 1
            after[todo[done]] = state[done]
        first = False
        wrong = np.flatnonzero((nth[1:] > 0) & (after[:-1] != given[1:])) + 1
        given[wrong] = after[wrong - 1]
        todo = wrong[np.argsort(-length[wrong], kind="stable")]
        state = given[todo]
    counts = np.bincount(owner, closed.sum(axis=0, dtype=np.int64), len(sizes)).astype(np.int64)
    last = np.cumsum(each) - 1
    return counts + (after[last] > 0)  # the phrase that is open at the end


class Model:
    """Names in order of preference, the symbols' classes, and for each language its table and pointer bits."""

    def __init__(self, labelled: list[tuple[str, list[str]]]):
        self.names = [name for name, _ in labelled]
        room = min(SAMPLE_SYMBOLS, TOTAL_SYMBOLS // max(len(labelled), 1))
        found = []
        for _, lines in labelled:
            parts, ends = [np.empty(0, np.uint32)], [0]
            for _, _, data, offsets in tb.blocks(pa.array(lines, pa.string())):
                low, cuts = symbols(data, offsets)
                parts.append(low)
                ends += (ends[-1] + cuts[1:]).tolist()
            whole = [e for e in ends if e <= room]
            found.append(np.concatenate(parts)[: whole[-1] or room])  # whole lines; of a first one that is longer, its beginning
        self.alphabet = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)
        self.alphabet = self.alphabet[self.alphabet > 0]
        width = len(self.alphabet) + 2  # the gap, the letters, any other letter
        self.tables = [parse_table(self.classes(x).tolist(), width) for x in found]
        self.bits = np.array([np.log2(len(x) + 2) for x in found])

    def classes(self, low: np.ndarray) -> np.ndarray:
        lut = self.__dict__.get("lut")
        if lut is None:
            lut = np.full(POINTS, len(self.alphabet) + 1, np.uint16)
            lut[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            lut[0] = 0
            self.lut = lut
        return lut[low]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lut"}

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by language and row, and the rows' letters."""
        low, ends = symbols(data, offsets)
        n_letters = np.add.reduceat(low != 0, ends[:-1], dtype=np.int64)
        codes = self.classes(low).astype(np.int32)
        phrases = np.array([phrase_counts(table, codes, ends) for table in self.tables]).reshape(len(self.tables), len(ends) - 1)
        return phrases * self.bits[:, None] / np.maximum(np.diff(ends), 1), n_letters

    def predict(self, texts: pa.Array) -> pa.StructArray:
        names, scores = [], []
        for lo, hi, data, offsets in tb.blocks(texts):
            if not self.tables:
                names += [UNKNOWN] * (hi - lo)
                scores.append(np.zeros(hi - lo))
                continue
            bits, n = self.entropies(data, offsets)
            best = bits.argmin(0)
            weight = np.exp2(-(bits - bits.min(0)) * np.minimum(n, CONFIDENCE_SYMBOLS))
            scores.append(np.where(n > 0, 1 / weight.sum(0), 0.0))
            names += [self.names[i] if k else UNKNOWN for i, k in zip(best, n, strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.empty(0)]), pa.float64())], ["lang_pred", "score"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the bounded sample described above. Copies of a text count and are drawn once."""
    usable = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = usable.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("count")).orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not counts:
        return Model([])
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, SAMPLE_DOCS / r["count"]) * HASH_UNITS))])
    lines = usable.where(hash_unit("text") < share[F.col("lang")]).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.trim("line") != "").select("lang", F.substring("line", 1, SAMPLE_CHARS).alias("line")).distinct().withColumn("at", F.xxhash64("line"))
    first = Window.partitionBy("lang").orderBy("at", "line")
    drawn = lines.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE_LINES)
    budget = F.sum(F.length("line")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("before", F.coalesce(budget, F.lit(0))).where(F.col("before") < 2 * SAMPLE_SYMBOLS)
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in drawn.orderBy("lang", "nth").collect():
        texts[r["lang"]].append(r["line"])
    return Model([(name, found) for name, found in texts.items() if found])


def predict(spark, model: Model, text: str | Column) -> Column:
    """Column of ``lang_pred`` and ``score`` for a column of texts."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def answer(texts: pa.Array) -> pa.Array:
        return sent.value.predict(texts)

    return answer(text)


def rejected(answer: Column) -> Column:
    """Whether a text is of no learned language: no letters, or languages that cannot be told apart."""
    return (answer["lang_pred"] == UNKNOWN) | (answer["score"] < REJECT_SCORE)
