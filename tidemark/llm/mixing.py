"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in order by hash and cut into blocks. With weight w, block i (from 0) is released at
slot floor(i / w) and due at slot ceil((i + 1) / w); earliest-deadline-first among the released blocks gives every
prefix of the schedule less than one block more or less of each source than its weight asks.

Weights are exact fractions, read as the decimals they are written with, so no rounding adds up along a schedule. The
schedule of a phase depends on its past, so the driver runs it, one step for each block; rows of SLOTS slots leave the
driver in lots of LOT slots. When the first source has no block left, a new phase begins with the weights of the
remaining ones, scaled to one. Every document is placed exactly once.

Odd input: a null source is a source of its own; sources without a weight, or of weight 0, come after all others; ties
of deadlines go to the smaller name; rows that repeat an id are placed one after another; no row gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import islice
from math import lcm

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import free_name, materialise

BLOCK = 16  #: documents of a block
SLOTS = 2_000  #: slots of a row of the plan
LOT = 1 << 20  #: slots that are on the driver at a time
BUCKET = 4096  #: documents of a source that are ordered in one piece
TEMPERATURE = 0.5  #: exponent on the sources' sizes in target_weights
NULL_SOURCE = "\x00"


def whole_weights(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Weights as whole numbers that sum to ``slots``, at least 1 for a positive one, by largest remainders."""
    given = {k: float(w) for k, w in weights.items() if w > 0}
    total = sum(given.values())
    exact = {k: w / total * slots for k, w in given.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    for k in sorted(given, key=lambda k: (int(exact[k]) - exact[k], k)):
        if sum(out.values()) >= slots:
            break
        out[k] += 1
    while (extra := sum(out.values()) - slots) > 0:  # many sources below one slot: take from the largest
        k = max(out, key=lambda k: (out[k], k))
        out[k] -= min(extra, max(1, out[k] // 2))
    return out


def schedule(weights: Mapping[str, int]) -> Iterator[str]:
    """The source of each slot without end, by earliest deadline first among released blocks; weights are whole shares."""
    slots = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]  # by release
    ready: list[tuple[int, str, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, name, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * slots // weights[name]), name, i))
        _, name, i = heapq.heappop(ready)
        yield name
        t += 1
        heapq.heappush(waiting, ((i + 1) * slots // weights[name], name, i + 1))


def period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot up to the sum of the weights, after which the schedule repeats."""
    return list(islice(schedule(weights), sum(weights.values())))


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Positive weights as whole numbers in exactly their proportions."""
    given = {k: Fraction(str(w)) for k, w in weights.items() if w > 0}
    common = lcm(*(x.denominator for x in given.values()))
    return {k: int(x * common) for k, x in given.items()}


def phase_rows(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = SLOTS) -> Iterator[dict]:
    """Rows (phase, source, first_block, end_block, slot0, quota, span, at): where the blocks of a source go.

    Block b of a row goes to slot0 + (b - first_block) // quota * span + at[(b - first_block) % quota]; a row is of
    ``slots`` slots at most, and a phase has as many rows as it needs.
    """
    left = {k: n for k, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    slot0, phase = 0, 0
    while left:
        live = {k: weights.get(k, 0.0) for k in left}
        if not any(w > 0 for w in live.values()):
            live = dict.fromkeys(left, 1.0)
        order = schedule(exact_weights(live))
        while live.keys() <= left.keys():  # the phase ends with the last block of some source
            at: dict[str, list[int]] = {}
            for t, k in enumerate(islice(order, slots), 1):
                at.setdefault(k, []).append(t - 1)
                left[k] -= 1
                if not left[k]:
                    del left[k]
                    break
            for k, places in at.items():
                yield {"phase": phase, "source": k, "first_block": done[k], "end_block": done[k] + len(places), "slot0": slot0, "quota": len(places), "span": t, "at": places}
                done[k] += len(places)
            slot0 += t
        phase += 1


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = SLOTS) -> list[dict]:
    """All of :func:`phase_rows`."""
    return list(phase_rows(blocks, weights, slots))


def target_weights(sizes: Mapping[str, float], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Weights that flatten the sources' sizes: size ** temperature, scaled to one."""
    raised = {k: max(n, 0.0) ** temperature for k, n in sizes.items()}
    total = sum(raised.values()) or 1.0
    return {k: x / total for k, x in raised.items()}


def planned(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    """(s, block, phase, slot) of every block. Lots are written out, so the driver holds one of them at a time."""
    schema = "phase int, source string, first_block long, end_block long, slot0 long, quota long, span long, at array<int>"
    rows, held, lots = [], 0, []
    for r in phase_rows(blocks, weights):
        rows.append(tuple(r.values()))
        held += r["quota"]
        if held >= LOT:
            lots.append(materialise(spark.createDataFrame(rows, schema), "plan"))
            rows, held = [], 0
    lots.append(spark.createDataFrame(rows, schema))
    plan = reduce(DataFrame.unionAll, lots).select(F.col("source").alias("s"), "first_block", "phase", "slot0", F.posexplode("at").alias("nth", "t"))
    return plan.select("s", (F.col("first_block") + F.col("nth")).alias("block"), "phase", (F.col("slot0") + F.col("t")).alias("slot"))


def place(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, and a struct ``mix`` of its place.

    Without weights, those of :func:`target_weights` on the sources' numbers of documents are used. The rank of a
    document in its source is counted in pieces of the source's hash order, so no source is ordered in one task.
    """
    spark = docs.sparkSession
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE)).alias("s")).agg(F.count("*").alias("n")).collect()}
    weights = target_weights(counts) if weights is None else weights
    total = sum(w for w in weights.values() if w > 0) or 1.0

    sources = spark.createDataFrame([(k, -(-n // BUCKET)) for k, n in counts.items()], "s string, pieces long")
    unit = F.shiftrightunsigned(F.xxhash64(key), 33)  # 31 bits
    name = F.coalesce(F.col(source).cast("string"), F.lit(NULL_SOURCE))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("s"), unit.alias("u"), F.col(key).alias("k"))
    bucketed = rows.join(F.broadcast(sources), "s").withColumn("piece", F.shiftright(F.col("u") * F.col("pieces"), 31))  # a row for each source

    sizes = docs.select(name.alias("s"), unit.alias("u")).join(F.broadcast(sources), "s")
    sizes = sizes.groupBy("s", F.shiftright(F.col("u") * F.col("pieces"), 31).alias("piece")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("s", "piece", "n", F.coalesce(before, F.lit(0)).alias("before"))
    # each piece has the places of the blocks that it has a part of, so that rows need no join by block
    own = F.explode(F.sequence(F.floor(F.col("before") / F.lit(block)), F.floor((F.col("before") + F.col("n") - 1) / F.lit(block))))
    plan = planned(spark, {k: -(-n // block) for k, n in counts.items()}, weights)
    places = offsets.select("s", "piece", "before", own.alias("block")).join(plan, ["s", "block"])
    places = places.groupBy("s", "piece", "before").agg(F.array_sort(F.collect_list(F.struct("block", "phase", "slot"))).alias("places"))
    within = F.row_number().over(Window.partitionBy("s", "piece").orderBy("u", "k"))
    ranked = bucketed.withColumn("at_piece", within).join(places, ["s", "piece"]).withColumn("rank", F.col("before") + F.col("at_piece") - 1)

    found = ranked.withColumn("block", F.floor(F.col("rank") / F.lit(block)))
    nth = F.col("block") - F.col("places")[0]["block"]
    found = found.withColumn("part", F.element_at("places", (nth + 1).cast("int"))).drop("places")
    slot = F.col("part.slot")
    share = F.create_map(*[F.lit(x) for k in counts for x in (k, weights.get(k, 0.0) / total)])[F.col("s")] if counts else F.lit(None).cast("double")
    mixed = F.struct("rank", "block", F.col("part.phase").alias("phase"), slot.alias("slot"), (slot * block + F.col("rank") % block).alias("position"), share.alias("weight"))
    return found.select("row", mixed.alias("mix"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``mix`` (rank, block, phase, slot, position, weight): their place.

    Options are those of :func:`place`. ``position`` numbers the documents of the slots from 0: its order is the mixture.
    """
    return place(docs, **options).select("row.*", F.col("mix").alias(free_name(docs, "mix")))


def ordered(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, which the files written of it keep.

    The texts are shuffled twice, for the ranks and for the order; meanwhile they are packed, which takes about a third less.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*[packed(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
    rows = place(rows, **options).select("row", F.col("mix.position").alias("position")).orderBy("position").select("row.*")
    return rows.select(*[unpacked(F.col(text)).alias(c) if c == text else x for c, x in zip(docs.columns, columns, strict=True)])


def packed(text: Column) -> Column:
    """Texts as compressed bytes; null stays null."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.array([None if x is None else press(x) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return pack(text)


def unpacked(data: Column) -> Column:
    @F.arrow_udf("string")
    def unpack(packs: pa.Array) -> pa.Array:
        press = zstandard.ZstdDecompressor().decompress
        return pa.array([None if x is None else press(x) for x in packs.to_pylist()], pa.binary()).cast(pa.string())

    return unpack(data)
