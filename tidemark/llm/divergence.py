"""Divergence of sources within a language, by cube partitioning.

Terms are runs of letters and non-ASCII characters; a language keeps those that at least MIN_DOCS of its documents
have. Each (language, source) group gives every kept term a whole number of billionths, and the divergence of a group
from another is the sum over all kept terms of floor((p - q)^2 / q).

Pairs of groups times terms make a cube. It is cut into (group block, group block, term block) cells; the counts of a
group block in a term block are one packed slice, which is sent to every cell that has the block on either side. A
task owns a cell and sums the divergences of its pairs over its terms, and the cells are then added up along the term
axis. Terms that neither side of a cell has are not listed: each adds the same amount, so they are counted instead.

A cell holds at most about 2 * GROUPS groups and TERMS terms, whatever the input. All arithmetic is in whole numbers.

Odd input: null text, language and source count as empty ones; a group without kept terms keeps its row in every pair; a language
without kept terms has divergences of zero; rows that repeat an id are documents of their own; no row gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.shared import materialise, numbered

MIN_DOCS = 3
UNIT = 1_000_000_000
TOP = 200  #: terms reported for a group
GROUPS = 12  #: groups of a block, on average
TERMS = 16_384  #: terms of a block, on average
BLOCK_BYTES = 4 << 20

TERM = (tb._ALL >= 0x80) | ((tb._ALL >= 0x41) & (tb._ALL <= 0x5A)) | ((tb._ALL >= 0x61) & (tb._ALL <= 0x7A))
COUNTED = "lang string, source string, term string, docs long, n long"
SLICE = pa.schema([("lang", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()), ("cell", pa.int64()), ("slice", pa.binary())])
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("listed", pa.int64()), ("n", pa.int64()), ("n_item", pa.int64())])


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact for counts of any size; ``terms`` is not 0."""
    return F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(11,0)"), (total + terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, occurrences) of the distinct terms of each text, and the terms. Terms are told apart by their bytes."""
    starts, ends = tb.spans(data, TERM)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)])), pa.py_buffer(tb.ASCII_LOWER[data[TERM[data]]])]
    )
    coded = words.dictionary_encode()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(tb.pointers(starts, offsets)))
    size = max(len(coded.dictionary), 1)
    keys, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
    return keys // size, keys % size, n, coded.dictionary


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED for (lang, source, text), summed up within blocks of texts."""
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (x.split() for x in COUNTED.split(", "))])
    for batch in batches:
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        width = max(len(sources.dictionary), 1)
        group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        for lo, hi, data, offsets in tb.blocks(batch.column(2), BLOCK_BYTES):
            row, term, n, dictionary = terms_of(data, offsets)
            if not len(row):
                continue
            keys = group[lo:hi][row] * len(dictionary) + term
            order = np.argsort(keys, kind="stable")
            found, first = np.unique(keys[order], return_index=True)
            of = found // len(dictionary)
            yield pa.record_batch(
                [
                    langs.dictionary.take(pa.array(of // width)), sources.dictionary.take(pa.array(of % width)),
                    dictionary.take(pa.array(found % len(dictionary))).cast(pa.binary()).cast(pa.string()),
                    pa.array(np.diff(first, append=len(keys))), pa.array(np.add.reduceat(n[order], first)),
                ],
                schema=schema,
            )


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, per): the kept terms and their counts by source, of which a term has at most one for each source."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    by_source = texts.mapInArrow(count_batches, COUNTED).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per"))
    return by_term.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "per")


def block_of(source: str, blocks: int) -> int:
    return zlib.crc32(source.encode()) % blocks


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, terms, n_lang, blocks, cells, block) of every occurring group."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sums = kept.select("lang", F.explode("per").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    every = docs.select(*names).distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    every = every.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    totals = every.groupBy("lang").agg(
        F.sum("n").alias("n_lang"), F.ceil(F.count("*") / GROUPS).cast("long").alias("blocks"), F.greatest(F.ceil(F.max("terms") / TERMS), F.lit(1)).cast("long").alias("cells")
    )
    return every.join(totals, "lang").withColumn("block", F.pmod(F.crc32(F.col("source").cast("binary")), F.col("blocks")))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed slices of (lang, t, blocks, cells, per): the counts of a group block in a term block, once for each cell that needs them."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        t, blocks, cells = (batch.column(i).to_numpy() for i in (1, 2, 3))
        per = batch.column(4)
        flat = per.flatten()
        at = np.repeat(np.arange(len(per)), per.value_lengths().to_numpy())
        sources = flat.field("source").dictionary_encode()
        names, code, n = sources.dictionary.to_pylist(), sources.indices.to_numpy(), flat.field("n").to_numpy()
        lang, cell = langs.indices.to_numpy()[at], (t % cells)[at]
        of = np.array([zlib.crc32(s.encode()) for s in names], np.int64)[code] % blocks[at]
        order = np.lexsort((of, cell, lang))
        cut = np.flatnonzero((np.diff(lang[order]) != 0) | (np.diff(cell[order]) != 0) | (np.diff(of[order]) != 0)) + 1
        for part in np.split(order, cut):
            if not len(part):
                continue
            first = part[0]
            used, local = np.unique(code[part], return_inverse=True)
            table = pa.record_batch([pa.array(t[at[part]]), pa.array(local.astype(np.int32)), pa.array(n[part])], ["t", "source", "n"])
            table = table.set_column(1, "source", pa.DictionaryArray.from_arrays(pa.array(local.astype(np.int32)), pa.array([names[k] for k in used])))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            packed, own, every = sink.getvalue().to_pybytes(), int(of[first]), range(int(blocks[at[first]]))
            rows = [(langs.dictionary[int(lang[first])].as_py(), min(own, b), max(own, b), int(cell[first]), packed) for b in every]
            for row in rows:  # one by one, since a slice may be large
                yield pa.record_batch([[x] for x in row], schema=SLICE)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count; distinct counts are few, and their shares are exact whatever their size."""
    values, at = np.unique(counts, return_inverse=True)
    return np.array([1 + UNIT * (int(c) + 1) // (total + terms) for c in values], np.int64)[at]


def own_cell(cell: pa.Table) -> pa.Table:
    """The partial divergences of a cell: of each group of the one block from each of the other, both ways."""
    lang, lo, hi = (cell.column(c)[0].as_py() for c in ("lang", "lo", "hi"))
    heads = [(g["source"], g["n"], g["block"], g["terms"]) for row in cell.column("groups").to_pylist() if row for g in row]
    heads.sort()
    place = {source: i for i, (source, *_) in enumerate(heads)}
    t, g, n = [], [], []
    for packed in cell.column("slice").drop_null():
        table = pa.ipc.open_stream(pa.py_buffer(packed.as_py())).read_all()
        sources = table.column("source").combine_chunks()
        sources = sources.chunk(0) if isinstance(sources, pa.ChunkedArray) else sources
        g.append(np.array([place[s] for s in sources.dictionary.to_pylist()], np.int64)[sources.indices.to_numpy()])
        t.append(table.column("t").to_numpy())
        n.append(table.column("n").to_numpy())
    listed, at = np.unique(np.concatenate(t), return_inverse=True) if t else (np.empty(0, np.int64), np.empty(0, np.int64))
    counts = np.zeros((len(heads), len(listed)), np.int64)
    if t:
        counts[np.concatenate(g), at] = np.concatenate(n)
    p = np.stack([shares(counts[i], h[1], max(h[3], 1)) for i, h in enumerate(heads)]) if heads else counts
    rows = []
    for a, (source, n_a, block, _) in enumerate(heads):
        beside = [b for b, h in enumerate(heads) if b != a and {block, h[2]} == {lo, hi}]
        if beside:
            q = p[beside]
            value = ((p[a] - q) ** 2 // q).sum(axis=1)
            rows += [(lang, source, heads[b][0], int(v), len(listed), n_a, heads[b][1]) for b, v in zip(beside, value, strict=True)]
    return pa.Table.from_pylist([dict(zip(PARTIAL.names, r, strict=True)) for r in rows], PARTIAL)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each group from each other group of its language."""
    sizes = groups.select("lang", "terms", "blocks", "cells").distinct()  # a row for each language
    sent = numbered(kept, "t").join(sizes, "lang").select("lang", "t", "blocks", "cells", "per").mapInArrow(slices, "lang string, lo long, hi long, cell long, slice binary")
    head = groups.groupBy("lang", "block", "blocks", "cells").agg(F.collect_list(F.struct("source", "n", "block", "terms")).alias("groups"))
    head = head.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    head = head.select("lang", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cell", F.lit(None).cast("binary").alias("slice"), "groups")
    both = sent.withColumn("groups", F.lit(None).cast(head.schema["groups"].dataType)).unionByName(head)
    partial = both.groupBy("lang", "lo", "hi", "cell").applyInArrow(own_cell, "lang string, source string, item string, value long, listed long, n long, n_item long")
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("listed").alias("listed"), F.max("n").alias("n"), F.max("n_item").alias("n_item"))
    unlisted = gap(share(F.lit(0), F.col("n"), F.col("terms")), share(F.lit(0), F.col("n_item"), F.col("terms"))) * (F.col("terms") - F.col("listed"))
    return summed.join(sizes, "lang").select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("value") + unlisted).otherwise(F.lit(0)).cast("long").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has and uses more than its language."""
    total = F.aggregate("per", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = kept.select("lang", "term", total.alias("of_lang"), F.explode("per").alias("x"))
    rows = rows.select("lang", F.col("x.source").alias("source"), "term", "of_lang", F.col("x.n").alias("own")).join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), share(F.col("own"), F.col("n"), F.col("terms")).alias("p"), share(F.col("of_lang"), F.col("n_lang"), F.col("terms")).alias("q"))
    return rows.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).cast("long").alias("value"))


def ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences from other groups, and the ``top`` terms that set a group apart."""
    kept = materialise(kept_terms(docs), "divergence-terms")
    groups = materialise(groups_of(docs, kept), "divergence-groups")
    return ranked(pair_values(kept, groups), "pair").unionByName(ranked(term_values(kept, groups), "term").where(F.col("rank") <= top))


def sql() -> str:
    """The query over ``documents`` in SQL."""
    share = lambda c, n, v: f"(1 + ({UNIT}::HUGEINT * ({c} + 1)) // ({n} + {v}))"
    gap = "CAST((p - q) * (p - q) // q AS BIGINT)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
every AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {share('coalesce(c.n, 0)', 't.n', 'v.v')} AS p
  FROM t JOIN v USING (lang) JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
l AS (SELECT lang, term, {share('sum(n)', 'any_value(total)', 'any_value(v)')} AS q
  FROM (SELECT c.*, v, sum(n) OVER (PARTITION BY lang) AS total FROM c JOIN v USING (lang)) GROUP BY lang, term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {gap} AS value FROM every JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
