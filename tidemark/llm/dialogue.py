"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

A repaired conversation's role initials are ``(s?(ua)+)?``. Reading them leaves one of four states: nothing yet, a system
row, a user row, an assistant row (the first and the last may end it). Edits of a row: Keep 0, Rerole 2, Delete 3; an empty row may be inserted
anywhere for 2; rows that are blank or repeated must go; a truncated row that stays costs 1. Of the cheapest edits those with the
ASCII-least audit (initials of the edits in order) are taken.

Hirschberg's divide and conquer. Costs of the first half are carried forward from the entry state and those of the second half
backward from the exit state, four numbers each; where their sum is least, the halves meet. Ties go to the crossing whose
audit is least: with each cost travels its rank among the four states by the least audit that reaches them. Two such audits
have as many rows behind them and end in a row's edit, so neither begins with the other, and a rank is all that later
steps need. Both halves are then solved alike, in linear space.

A long conversation is cut into pieces of PIECE rows. A piece is summed up by the costs and ranks from each entry to each exit state,
FAN pieces by the same kind of summary, and so on to one for each conversation; entry and exit states are then handed
down the same tree, each node being solved as rows are. No task holds more than PIECE rows or FAN summaries.

Odd input: null roles and texts count as one space, so such a row is blank; null turns come first; equal turns keep the order of
the files; a null id is a conversation of its own; no row gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from tidemark.llm.shared import free_name, materialise, numbered
from tidemark.operators import scans

PIECE = 1024
FAN = 256
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
FAR = 1 << 40  #: no way
SPACES = "[\\x20\\x09-\\x0D]"
STATES = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = STATES
ENDINGS = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  #: by a user or an assistant row, whichever may come
ROLES = {USER: "user", ASSISTANT: "assistant"}

Costs = tuple[int, ...]
Summary = tuple[tuple[Costs, Costs], ...]  #: of each entry state: costs and ranks of the exit states


def ways(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit): cost and edits of a row. ``kind``: 2 * initial (0 other, 1 s, 2 u, 3 a) + truncated; 8: must go."""
    initial, cut = divmod(kind, 2) if kind < 8 else (0, 0)
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for entry in STATES:
        at, before, paid = entry, "", 0
        for _ in range(3):
            edits = [(at, DELETE, "D")]
            if kind < 8:
                edits.append((NEXT[at], REROLE + cut * CUT, "R"))
                if initial == NEXT[at] or (initial == SYSTEM and at == NOTHING):
                    edits.append((initial, KEEP + cut * CUT, "K"))
            for exit_, cost, letter in edits:
                out[entry, exit_] = min(out.get((entry, exit_), (FAR, "")), (paid + cost, before + letter))
            at, before, paid = NEXT[at], before + "I", paid + INSERT
    return out


WAYS = [ways(k) for k in range(9)]


def ranks(keys: Sequence) -> Costs:
    order = sorted(STATES, key=lambda s: keys[s])
    return tuple(order.index(s) for s in STATES)


def row_summary(kind: int) -> Summary:
    found = [[WAYS[kind].get((a, b), (FAR, "~")) for b in STATES] for a in STATES]
    return tuple((tuple(c for c, _ in row), ranks([(w, b) for b, (_, w) in enumerate(row)])) for row in found)


ROWS = [row_summary(k) for k in range(9)]


def fronts(front: tuple[Costs, Costs], step: Summary) -> tuple[Costs, Costs]:
    """Costs and ranks of the states after ``step``, from those before it."""
    costs, rank = front
    keys, out = [], []
    for b in STATES:
        cost, r, a = min((costs[a] + step[a][0][b], rank[a], a) for a in STATES)
        out.append(min(cost, FAR))
        keys.append((cost >= FAR, r, step[a][1][b], b))
    return tuple(out), ranks(keys)


def backs(costs: Costs, step: Summary) -> Costs:
    """Costs from the states before ``step`` to the end, from those after it."""
    return tuple(min(FAR, *(step[a][0][b] + costs[b] for b in STATES)) for a in STATES)


def least(costs: Costs) -> tuple[Costs, int]:
    """Costs less their least, which tell steps apart, and that least. Unreachable stays so."""
    low = min(costs)
    return tuple(FAR if c >= FAR else c - low for c in costs), low


@lru_cache(1 << 16)
def row_front(front: tuple[Costs, Costs], kind: int) -> tuple[tuple[Costs, Costs], int]:
    costs, rank = fronts(front, ROWS[kind])
    costs, low = least(costs)
    return (costs, rank), low


@lru_cache(1 << 16)
def row_back(costs: Costs, kind: int) -> tuple[Costs, int]:
    return least(backs(costs, ROWS[kind]))


def carried_front(front: tuple[Costs, Costs], item: int | Summary) -> tuple[tuple[Costs, Costs], int]:
    if isinstance(item, int):
        return row_front(front, item)
    costs, rank = fronts(front, item)
    costs, low = least(costs)
    return (costs, rank), low


def carried_back(costs: Costs, item: int | Summary) -> tuple[Costs, int]:
    return row_back(costs, item) if isinstance(item, int) else least(backs(costs, item))


def start(state: int) -> tuple[Costs, Costs]:
    return tuple(0 if s == state else FAR for s in STATES), ranks([(s != state, s) for s in STATES])


def summed(items: Sequence[int | Summary]) -> Summary:
    """The summary of a run of rows, or of summaries."""
    out = []
    for entry in STATES:
        front, paid = start(entry), 0
        for item in items:
            front, low = carried_front(front, item)
            paid += low
        out.append((tuple(FAR if c >= FAR else c + paid for c in front[0]), front[1]))
    return tuple(out)


def crossings(items: Sequence[int | Summary], entry: int, exit_: int) -> list[int]:
    """The state before each item and after the last, on the audit-least cheapest way from ``entry`` to ``exit_``."""
    out = [entry] * (len(items) + 1)
    out[-1] = exit_
    todo = [(0, len(items))]
    while todo:  # the two ends of a run are known; its middle is found
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        front = start(out[lo])
        for i in range(lo, mid):
            front, _ = carried_front(front, items[i])
        costs: Costs = tuple(0 if s == out[hi] else FAR for s in STATES)
        for i in range(hi - 1, mid - 1, -1):
            costs, _ = carried_back(costs, items[i])
        out[mid] = min(STATES, key=lambda s: (front[0][s] + costs[s], front[1][s]))
        todo += [(lo, mid), (mid, hi)]
    return out


def edits_between(kinds: Sequence[int], states: Sequence[int]) -> list[str]:
    """The edits at each row, inserted ones before the row's own."""
    return [WAYS[k][a, b][1] for k, a, b in zip(kinds, states, states[1:], strict=False)]


def best_exit(summary: Summary) -> tuple[int, int]:
    """Cost of the cheapest repair of a whole conversation and its last state, ties by audit."""
    costs, rank = summary[NOTHING]
    cost, _, exit_ = min((costs[s] + INSERT * len(ENDINGS[s]), rank[s], s) for s in STATES)
    return cost, exit_


def repair_kinds(kinds: Sequence[int]) -> tuple[int, str]:
    """Cost and audit of one conversation in memory."""
    cost, exit_ = best_exit(summed(kinds))
    return cost, "".join(edits_between(kinds, crossings(kinds, NOTHING, exit_))) + ENDINGS[exit_]


# ---- on Spark ----------------------------------------------------------------------------------




def flat(summary: Summary) -> list[int]:
    return [c for costs, _ in summary for c in costs] + [r for _, rank in summary for r in rank]


def shaped(values: Sequence[int]) -> Summary:
    return tuple((tuple(values[4 * a : 4 * a + 4]), tuple(values[16 + 4 * a : 20 + 4 * a])) for a in STATES)


@F.arrow_udf(ArrayType(LongType()))
def summary_of_rows(kinds: pa.Array) -> pa.Array:
    return pa.array([flat(summed(k)) for k in kinds.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(LongType()))
def summary_of_nodes(nodes: pa.Array) -> pa.Array:
    return pa.array([flat(summed([shaped(s) for s in group])) for group in nodes.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(LongType()))
def cost_and_exit(node: pa.Array) -> pa.Array:
    return pa.array([list(best_exit(shaped(s))) for s in node.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(ArrayType(IntegerType()))
def states_in(nodes: pa.Array, entry: pa.Array, exit_: pa.Array) -> pa.Array:
    rows = zip(nodes.to_pylist(), entry.to_pylist(), exit_.to_pylist(), strict=True)
    return pa.array([crossings([shaped(s) for s in group], a, b) for group, a, b in rows], pa.list_(pa.int32()))


@F.arrow_udf(ArrayType(StringType()))
def edits_of(kinds: pa.Array, entry: pa.Array, exit_: pa.Array) -> pa.Array:
    rows = zip(kinds.to_pylist(), entry.to_pylist(), exit_.to_pylist(), strict=True)
    return pa.array([edits_between(k, crossings(k, a, b)) for k, a, b in rows], pa.list_(pa.string()))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, copy, initial, blank, cut, same) of each row; ``same`` is equal where role and text are."""
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    letter = F.substring("role", 1, 1)
    cut = ~F.col("text").rlike(f"[.!?]{SPACES}*\\z")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    return rows.select("conv_id", "turn", "nth", "copy", initial.alias("initial"), letter.alias("letter"), F.col("text").rlike(f"\\A{SPACES}*\\z").alias("blank"), cut.alias("cut"), F.unhex(same).alias("same"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, kinds, head, blank, duplicate, truncated, illegal): runs of PIECE rows of each conversation in order.

    ``head`` is the place of the first row.
    """
    order = ["turn", "nth", "copy"]
    placed = scans.numbered(scans.split_ordered(marked(rows), ["conv_id"], order), ["conv_id"], order, "at").withColumn("at", F.col("at") - 1)
    placed = materialise(placed.select("conv_id", *order, "at", "initial", "letter", "blank", "cut", "same"), "dialogue-rows")
    firsts = placed.groupBy("conv_id", "same").agg(F.min("at").alias("at")).select("conv_id", "at", F.lit(True).alias("first"))
    info = F.struct("at", "initial", "letter", "blank", "cut", *order)
    own = placed.select("conv_id", F.floor(F.col("at") / PIECE).alias("piece"), info.alias("row"), F.lit(None).cast("long").alias("first"))
    before = own.where(F.col("row.at") % PIECE == PIECE - 1).withColumn("piece", F.col("piece") + 1)  # the row before a piece, for its first pair
    first = firsts.select("conv_id", F.floor(F.col("at") / PIECE).alias("piece"), F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.col("at").alias("first"))
    grouped = own.unionByName(before).unionByName(first).groupBy("conv_id", "piece")
    gathered = grouped.agg(F.array_sort(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"))

    own_rows = F.filter("rows", lambda r: r["at"] >= F.col("piece") * PIECE)
    faults = F.transform(own_rows, lambda r: F.struct(r["initial"].alias("initial"), F.when(r["blank"], 1).when(~F.array_contains("firsts", r["at"]), 2).when(r["cut"], 3).otherwise(0).alias("fault")))
    gathered = gathered.withColumn("faults", faults).where(F.size("faults") > 0)
    count = lambda k: F.size(F.filter("faults", lambda r: r["fault"] == k)).cast("long")
    kinds = F.transform("faults", lambda r: F.when(r["fault"].isin(1, 2), 8).otherwise(2 * r["initial"] + (r["fault"] == 3).cast("int")))
    pairs = F.zip_with(F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 2, F.size("rows")), lambda a, b: F.concat(a["letter"], b["letter"]))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    head = F.element_at(own_rows, 1)
    head = F.struct(*[head[c].alias(c) for c in order])
    return gathered.select("conv_id", "piece", kinds.alias("kinds"), head.alias("head"), count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"), illegal.alias("illegal"))


def joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """``a`` and the columns of ``b`` that are not keys, by conversation (null like any other) and ``keys``."""
    right = b.select(F.col("conv_id").alias("_c"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in ("conv_id", *keys)])
    cond = a["conv_id"].eqNullSafe(right["_c"])
    for k in keys:
        cond = cond & (a[k] == right[f"_k_{k}"])
    return a.join(right, cond, how).drop("_c", *[f"_k_{k}" for k in keys])


def solved(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost, ending) and (conv_id, piece, edits): summaries go up a tree of FAN, entry and exit states come down."""
    levels = [materialise(pieces.select("conv_id", F.col("piece").alias("node"), "kinds", summary_of_rows("kinds").alias("summary")), "dialogue-level")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last:  # one round for each factor of FAN in the longest conversation
        below = levels[-1].groupBy("conv_id", F.floor(F.col("node") / FAN).alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), F.col("summary")))).alias("below"))
        below = below.select("conv_id", "node", F.transform("below", lambda x: x["summary"]).alias("below"))
        levels.append(materialise(below.withColumn("summary", summary_of_nodes("below")), "dialogue-level"))
        last //= FAN
    top = levels[-1].select("conv_id", cost_and_exit("summary").alias("x")).select("conv_id", F.col("x")[0].alias("cost"), F.col("x")[1].cast("int").alias("exit"))
    ending = F.element_at(F.create_map(*[F.lit(v) for pair in ENDINGS.items() for v in pair]), F.col("exit"))
    whole = top.select("conv_id", "cost", ending.alias("ending"))
    ends = top.select("conv_id", F.lit(0).cast("long").alias("node"), F.lit(NOTHING).alias("entry"), "exit")
    for level in levels[:0:-1]:
        states = joined(level, ends, "node").select("conv_id", "node", states_in("below", "entry", "exit").alias("states"))
        parts = states.select("conv_id", "node", "states", F.explode(F.sequence(F.lit(0), F.size("states") - 2)).alias("i"))
        ends = parts.select("conv_id", (F.col("node") * FAN + F.col("i")).alias("node"), F.col("states")[F.col("i")].alias("entry"), F.col("states")[F.col("i") + 1].alias("exit"))
    edits = joined(levels[0], ends, "node").select("conv_id", F.col("node").alias("piece"), edits_of("kinds", "entry", "exit").alias("edits"))
    return whole, edits


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, nth, copy): nulls as one space, ``nth`` the place of the row in its files."""
    nth = free_name(conversations, "nth")
    rows = numbered(conversations.select("conv_id", "turn", "role", "text"), nth)
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", "turn", *spaced, F.col(nth).alias("nth"), F.lit(0).alias("copy"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`ordered_rows` with one in four harmed, by crc32 of conversation and turn: lost, emptied, unpunctuated, doubled, or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = rows.withColumn("harm", harm).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "nth", copies.alias("copy"))


def audits(rows: DataFrame, pieces: DataFrame, whole: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    counts = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    letters = edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", F.array_join("edits", "").alias("s")))).alias("s"))
    found = joined(joined(joined(counts, turns), whole), letters)
    audit = F.concat(F.array_join(F.transform("s", lambda x: x["s"]), ""), F.col("ending"))
    return found.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"))


REPAIRED = pa.schema([("conv", pa.string()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
BATCH_CHARS = 4 << 20


class Rewriter:
    """Follows a conversation's rows and edits, and keeps the repaired rows that are not yet handed on."""

    def __init__(self):
        self.out, self.held = [], 0
        self.begin(None)

    def begin(self, conv: str | None) -> None:
        self.conv, self.state, self.n, self.queue, self.at, self.ending = conv, NOTHING, 0, [], 0, ""

    def put(self, role: str, text: str, edit: str) -> None:
        self.out.append((self.conv, self.n, role, text, edit))
        self.n, self.held = self.n + 1, self.held + len(text)

    def insert(self, letters: str) -> None:
        for _ in letters:
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], "", "I")

    def row(self, role: str, text: str) -> None:
        edit, self.at = self.queue[self.at], self.at + 1
        self.insert(edit[:-1])
        if edit[-1] == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self.put(role, text, "K")
        elif edit[-1] == "R":
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], text, "R")

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * len(REPAIRED)
        self.out, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, REPAIRED.types, strict=True)], schema=REPAIRED)


def apply_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows, from rows (conv, role, text, edits, ending) in order, where each piece's edits stand before its rows."""
    work = Rewriter()
    for batch in batches:
        for i in range(batch.num_rows):
            conv, role, text, edits, ending = (batch.column(c)[i].as_py() for c in range(5))
            if conv != work.conv:
                work.insert(work.ending)
                work.begin(conv)
            if edits is None:
                work.row(role, text)
            else:
                work.queue, work.at, work.ending = edits, 0, ending
            if work.held >= BATCH_CHARS:
                yield work.taken()
        yield work.taken()
    work.insert(work.ending)
    yield work.taken()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, from repaired rows in order."""
    schema = pa.schema([("conv", pa.string()), ("sha", pa.string())])
    conv, sha = None, None
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            key, role, text = (batch.column(c)[i].as_py() for c in (0, 2, 3))
            if sha is None or key != conv:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = key, hashlib.sha256()
                sha.update(f"{role}:{text}".encode())
            else:
                sha.update(f"\n{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": sha.hexdigest()}], schema)


def repaired(rows: DataFrame, pieces: DataFrame, whole: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, nth, role, text, edit): the rows of the repaired conversations, in order within each. ``conv`` is the id as text.

    The texts are shuffled once; a task streams its conversations and holds one batch.
    """
    steps = joined(joined(pieces.select("conv_id", "piece", "head"), edits, "piece"), whole)
    empty = F.lit(None).cast("string")
    steps = steps.select("conv_id", "head.*", F.lit(0).alias("after"), empty.alias("role"), empty.alias("text"), "edits", "ending")
    texts = rows.select("conv_id", "turn", "nth", "copy", F.lit(1).alias("after"), "role", "text", F.lit(None).cast("array<string>").alias("edits"), empty.alias("ending"))
    stream = texts.unionByName(steps).withColumn("conv", F.col("conv_id").cast("string"))
    stream = stream.repartition("conv").sortWithinPartitions("conv", "turn", "nth", "copy", "after")
    return stream.select("conv", "role", "text", "edits", "ending").mapInArrow(apply_edits, "conv string, nth long, role string, text string, edit string")


class Repair:
    """The repair of rows (conv_id, turn, role, text, nth, copy): its audits, repaired rows and their digests."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.pieces = materialise(pieces_of(rows), "dialogue-pieces")
        self.whole, edits = solved(self.pieces)
        self.edits = materialise(edits, "dialogue-edits")

    def audits(self) -> DataFrame:
        return audits(self.rows, self.pieces, self.whole, self.edits)

    def repaired(self) -> DataFrame:
        return repaired(self.rows, self.pieces, self.whole, self.edits)

    def digests(self) -> DataFrame:
        """(conv, sha): a hash over a text is one stream, so a conversation's is computed in one task, row by row."""
        return self.repaired().mapInArrow(digests, "conv string, sha string")


def repair(conversations: DataFrame) -> Repair:
    """The repair of conversations as they are."""
    return Repair(ordered_rows(conversations))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conversation id of ``conversations``: faults, cost and audit of the repair after damage, and the repaired text's digest."""
    work = Repair(damaged(ordered_rows(conversations)))
    every = conversations.select("conv_id").distinct()
    found = joined(every, work.audits(), how="left")
    shas = work.digests().select(F.col("conv").alias("_d"), "sha")
    found = found.join(shas, found["conv_id"].cast("string").eqNullSafe(shas["_d"]), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
