"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each place the state's own piece and those along its
output links relax the best score of the place from that of each piece's start. The best path by the model's piece
scores is the encoding, an unknown character is spelt in byte pieces, and decoding joins the pieces' bytes again.

No piece has a word mark behind another character, so a best path is cut before each run of word marks, and around
line feeds where no longer piece holds one; both are verified on the model. The distinct parts of a block of rows are
encoded once, all of them a step at a time. Texts come back from their ids byte for byte; a word mark that stands in
the text itself is spelt in bytes, so it is not mistaken for a space. Null texts count as empty and have no ids.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  #: default of the path parameter
MARK = "▁"
OWN_MARK = "\udc00"  # stands for a word mark of the text: a code point that no text has
UNKNOWN_PENALTY = 10.0
UNKNOWN = (1, -1, 0.0)
COMMON = 160  #: characters in the dense table
LONGEST = 64  #: characters of a part that is encoded together with others
AT_ONCE = 1 << 15
BLOCK_BYTES = 1 << 20


class Pieces:
    """Pieces and scores of a model: all that its file says about encoding."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.digest = sha256(repr((self.names, self.usable, self.scores)).encode("utf-8", "replace")).hexdigest()
        self.bytes_of = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if any(MARK in x.lstrip(MARK) for x, ok in zip(self.names, self.usable, strict=True) if ok):
            raise ValueError("a piece has a word mark behind another character")
        if len(self.bytes_of) != 256:
            raise ValueError("the model has no byte pieces, so texts would not come back")


class Automaton:
    """Aho-Corasick automaton over the usable pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.goto: list[dict[str, int]] = [{}]
        self.depth = [0]
        own: list[tuple[int, int, float] | None] = [None]
        for i, (name, ok) in enumerate(zip(pieces.names, pieces.usable, strict=True)):
            if not ok or not name:
                continue
            s = 0
            for c in name:
                if c not in self.goto[s]:
                    self.goto[s][c] = len(self.goto)
                    self.goto.append({})
                    self.depth.append(self.depth[s] + 1)
                    own.append(None)
                s = self.goto[s][c]
            own[s] = (len(name), i, pieces.scores[i])
        self.fail = [0] * len(self.goto)
        self.outputs: list[tuple[tuple[int, int, float], ...]] = [()] * len(self.goto)  # the state's piece, then its output links'
        queue = list(self.goto[0].values())
        for s in queue:
            self.outputs[s] = ((own[s],) if own[s] else ()) + self.outputs[self.fail[s]]
            for c, to in self.goto[s].items():
                f = self.fail[s]
                while f and c not in self.goto[f]:
                    f = self.fail[f]
                self.fail[to] = self.goto[f].get(c, 0)
                queue.append(to)
        scores = [x for x, ok in zip(pieces.scores, pieces.usable, strict=True) if ok]
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.single = {x for x, ok in zip(pieces.names, pieces.usable, strict=True) if ok and len(x) == 1}
        self.known = {c for x, ok in zip(pieces.names, pieces.usable, strict=True) if ok for c in x}
        self.lone_feed = not any("\n" in x and len(x) > 1 for x, ok in zip(pieces.names, pieces.usable, strict=True) if ok)
        self._tabulate()

    def _tabulate(self) -> None:
        """The automaton as arrays over the characters with most edges, for many parts at a time."""
        edges = Counter(c for e in self.goto for c in e if c in self.single)
        common = {c: k for k, (c, _) in enumerate(edges.most_common(COMMON))}
        self.class_of = np.full(max(map(ord, common), default=0) + 2, -1, np.int16)
        for c, k in common.items():
            self.class_of[32 if c == MARK else ord(c)] = k
        self.table = np.zeros((len(self.goto), max(len(common), 1)), np.int32)
        self.link = np.zeros(len(self.goto), np.int32)  # the nearest suffix that is a piece
        self.size = np.zeros(len(self.goto), np.int32)  # of the state's own piece, and its id
        self.id = np.zeros(len(self.goto), np.int32)
        self.score = np.zeros(len(self.goto))
        queue = [0]
        for s in queue:
            f = self.fail[s]
            if s:
                self.table[s] = self.table[f]
                self.link[s] = f if self.size[f] else self.link[f]
            if s and self.outputs[s] and self.depth[s] == self.outputs[s][0][0]:
                self.size[s], self.id[s], self.score[s] = self.outputs[s][0]
            for c, to in self.goto[s].items():
                queue.append(to)
                if c in common:
                    self.table[s, common[c]] = to

    def best_paths(self, classes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths over parts of common characters, one part after another, and their numbers: all parts step together."""
        n = len(sizes)
        if not n:
            return np.empty(0, "<i4"), np.empty(0, np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        longest = int(sizes[0])
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((longest + 1, n), np.int32)  # the state whose piece ends here on the best path
        state = np.zeros(n, np.int32)
        active = np.searchsorted(-sizes, -np.arange(longest), "left")
        for t in range(longest):
            k = int(active[t])
            now = self.table[state[:k], classes[begin[:k] + t]]
            state[:k] = now
            who = np.arange(k)
            node = np.where(self.size[now] > 0, now, self.link[now])
            while len(who):
                live = node > 0
                if not live.all():
                    who, node = who[live], node[live]
                value = best[t + 1 - self.size[node], who] + self.score[node]
                better = value > best[t + 1, who]
                best[t + 1, who[better]] = value[better]
                back[t + 1, who[better]] = node[better]
                node = self.link[node]
        at, column, out = sizes.copy(), np.arange(n), []
        while len(column):
            node = back[at[column], column]
            out.append((column, self.id[node]))
            at[column] -= self.size[node]
            column = column[at[column] > 0]
        counts = np.empty(n, np.int64)
        counts[order] = np.bincount(np.concatenate([c for c, _ in out]), minlength=n)
        ends = np.cumsum(counts)
        ids = np.empty(ends[-1], "<i4")
        for k, (column, piece) in enumerate(out):
            ids[ends[order[column]] - 1 - k] = piece
        return ids, counts

    def step(self, state: int, c: str) -> int:
        """Next state over failure links, kept for the next time."""
        s = state
        while s and c not in self.goto[s]:
            s = self.fail[s]
        to = self.goto[s].get(c, 0)
        if c in self.known:
            self.goto[state][c] = to  # what the failure links lead to is as good as an edge
        return to

    def best_path(self, part: str) -> list[int]:
        """Ids of the best path over one part, in one pass."""
        delta, outputs, single, unknown = self.goto, self.outputs, self.single, self.unknown_score
        best, back, state, i = [0.0], [None], 0, 0
        for c in part:
            try:
                state = delta[state][c]
            except KeyError:
                state = self.step(state, c)
            top, step = -1e300, None
            i += 1
            for out in outputs[state]:
                value = best[i - out[0]] + out[2]
                if value > top:
                    top, step = value, out
            if c not in single and best[-1] + unknown > top:
                top, step = best[-1] + unknown, UNKNOWN
            best.append(top)
            back.append(step)
        out, i = [], len(part)
        while i:
            size, piece, _ = back[i]
            if piece >= 0:
                out.append(piece)
            else:
                c = MARK if part[i - 1] == OWN_MARK else part[i - 1]
                out += [self.pieces.bytes_of[b] for b in reversed(c.encode("utf-8", "replace"))]
            i -= size
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and the number of each text."""
        joined = "".join([" " + x if x else "" for x in texts])  # each text begins with a word mark
        if MARK in joined:
            joined = joined.replace(MARK, OWN_MARK)
        if not joined:
            return np.empty(0, "<i4"), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.cumsum([0, *(len(x) + 1 if x else 0 for x in texts)])
        space, feed = codes == 32, codes == 10
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        if self.lone_feed:
            cut |= feed
            cut[1:] |= feed[:-1]
        cut[rows[:-1][rows[:-1] < len(codes)]] = True
        begin = np.flatnonzero(cut)
        sizes = np.diff(begin, append=len(codes))
        _, first, which = np.unique(tb.hashes(codes, begin, begin + sizes), return_index=True, return_inverse=True)
        begin_of, size_of = begin[first], sizes[first]

        classes = self.class_of[np.minimum(codes, len(self.class_of) - 1)]
        rare = np.concatenate([[0], np.cumsum(classes < 0)])
        plain = (size_of <= LONGEST) & (rare[begin_of + size_of] == rare[begin_of])
        counts, at, ids, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), [], 0
        by_size = np.flatnonzero(plain)
        by_size = by_size[np.argsort(-size_of[by_size], kind="stable")]
        for lo in range(0, len(by_size), AT_ONCE):  # parts of like size, so that the tables of a step stay small
            some = by_size[lo : lo + AT_ONCE]
            found, counts[some] = self.best_paths(classes, begin_of[some], size_of[some])
            at[some] = total + np.cumsum(counts[some]) - counts[some]
            total += len(found)
            ids.append(found)
        others = [np.array(self.best_path(joined[a : a + n].replace(" ", MARK)), "<i4") for a, n in zip(begin_of[~plain].tolist(), size_of[~plain].tolist(), strict=True)]
        counts[~plain] = [len(x) for x in others]
        at[~plain] = total + np.cumsum(counts[~plain]) - counts[~plain]
        ids = np.concatenate([np.empty(0, "<i4"), *ids, *others])

        each = counts[which]
        ends = np.cumsum(each)
        place = np.arange(ends[-1]) + np.repeat(at[which] - (ends - each), each)
        upto = np.concatenate([[0], ends])[np.searchsorted(begin, rows)]
        return ids[place], np.diff(upto)


_LOADED: dict[str, Automaton] = {}


def _loaded(pieces: Pieces) -> Automaton:
    """The automaton of a model, built once in each worker."""
    if pieces.digest not in _LOADED:
        _LOADED.clear()
        _LOADED[pieces.digest] = Automaton(pieces)
    return _LOADED[pieces.digest]


def encoded(automaton: Automaton, texts: pa.Array, check=None) -> tuple[pa.ListArray, list[bool]]:
    """Ids of the texts; and for each text what ``check`` says of its ids and itself."""
    values, counts, said = [np.empty(0, "<i4")], [np.zeros(1, np.int64)], []
    for lo, hi, _, _ in tb.blocks(texts, BLOCK_BYTES):
        rows = [x or "" for x in texts.slice(lo, hi - lo).to_pylist()]
        found, sizes = automaton.encode(rows)
        values.append(found)
        counts.append(sizes)
        if check:
            said += [check(found[b - n : b], x) for x, n, b in zip(rows, sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(values))), said


def encode(spark, text: str | Column, path: str = MODEL) -> Column:
    """Column of the ids of each text (array of int)."""
    sent = spark.sparkContext.broadcast(Pieces(path))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return encoded(_loaded(sent.value), texts)[0]

    return ids(text)


def spelling(pieces: Pieces) -> list[bytes]:
    """The bytes that each id stands for; nothing for control pieces."""
    spelt = {i: bytes([b]) for b, i in pieces.bytes_of.items()}
    return [spelt.get(i, name.replace(MARK, " ").encode() if ok else b"") for i, (name, ok) in enumerate(zip(pieces.names, pieces.usable, strict=True))]


def joined(table: list[bytes], ids: np.ndarray) -> str:
    """The text of ids; byte sequences that are no text become replacement characters."""
    whole = b"".join([table[i] for i in ids.tolist()])
    return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


def decode(spark, ids: str | Column, path: str = MODEL) -> Column:
    """Column of the texts that ids stand for; null ids are the empty text."""
    sent = spark.sparkContext.broadcast(spelling(Pieces(path)))

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        values = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        return pa.array([joined(sent.value, values[b - n : b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.string())

    return text(ids)


def encode_and_compare(spark, text: str | Column, path: str = MODEL) -> Column:
    """Column of ``ids`` and ``round_trip``: whether decoding them gives the text back. Both in one pass of one worker."""
    sent = spark.sparkContext.broadcast(Pieces(path))

    @F.arrow_udf("struct<ids: array<int>, round_trip: boolean>")
    def both(texts: pa.Array) -> pa.Array:
        table = spelling(sent.value)
        ids, same = encoded(_loaded(sent.value), texts, lambda found, x: joined(table, found) == x)
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return both(text)
