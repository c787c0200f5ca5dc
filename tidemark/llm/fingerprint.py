"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

Each paragraph (a line with something in it) is hashed to a wide vector, and a document's fingerprint is the sum of
its paragraphs' vectors, each lane modulo a power of two. Order does not matter, a paragraph is inserted by adding
its vector and deleted by subtracting it, and equal texts have equal fingerprints. The vector has two parts:

* 8 lanes modulo 2**32 from SHA-256 of the paragraph, which tell documents apart;
* WIDE lanes modulo 2**16: plus or minus one, the signs of MD5 bits, for each sentence of the paragraph. The squared
  distance of two documents there, divided by WIDE, estimates in how many sentences they differ, so that likeness can
  be read off two fingerprints, also where an edit falls inside a paragraph.

Only DataFrame functions are used. Paragraphs are exploded and summed where their documents lie, so that the
texts are shuffled once. Odd input: null text counts as empty; a text without paragraphs has the zero fingerprint and is like itself
only; rows that repeat an id, or have none, follow one another by their text's hash (null ids last); the only document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise

STRONG = 8
WIDE = 120  #: lanes of signs: 60 bits from each half of an MD5
PACK = 2  #: lanes summed in one number
ROOM = 30  #: bits of each; a text of two gigabytes, the most that a row can hold, has fewer than 2**30 sentences
CELLS = 64  #: least number of id ranges in which neighbours are sought
CELL_ROWS = 16_384  #: and one more for so many documents; a range of over twice as many is cut again


def sentences(text: str | Column) -> Column:
    """The text's sentences as (sentence, paragraph): the paragraph stands with its first sentence, and is null with others."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) > 0)
    within = lambda p: F.transform(F.split(p, "[.!?]"), lambda s, i: F.struct(s.alias("sentence"), F.when(i == 0, p).alias("paragraph")))
    return F.flatten(F.transform(lines, within))


def hex_number(digits: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(digits, at, n), 16, 10).cast("bigint")


def sums_of(sentence: Column, paragraph: Column) -> list[Column]:
    """Aggregates: the number of sentences, the strong lanes, and the counts of set bits, PACK lanes in a number."""
    sentence = F.when(F.length(F.trim(sentence)) > 0, sentence)
    strong, marks = F.sha2(paragraph, 256), F.md5(sentence)
    sums = [F.count(sentence).alias("n")]
    sums += [F.coalesce(F.sum(hex_number(strong, 8 * i + 1, 8)), F.lit(0)).alias(f"s{i}") for i in range(STRONG)]
    mask = sum(1 << ROOM * i for i in range(PACK))
    for half in range(2):
        bits = hex_number(marks, 1 + 16 * half, 15)
        sums += [F.coalesce(F.try_sum(F.shiftright(bits, j).bitwiseAND(F.lit(mask))), F.lit(0)).alias(f"w{half * ROOM + j}") for j in range(ROOM)]
    return sums


def fingerprint_of_sums() -> Column:
    """(text, signs): the fingerprint in hex digits, strong lanes then wide ones, and the wide lanes as numbers.

    A wide lane is twice its set bits less the number of sentences.
    """
    strong = [F.lpad(F.hex(F.pmod(F.col(f"s{i}"), F.lit(1 << 32))), 8, "0") for i in range(STRONG)]
    lanes = [2 * F.shiftright(F.col(f"w{half * ROOM + j}"), ROOM * i).bitwiseAND(F.lit((1 << ROOM) - 1)) - F.col("n") for half in range(2) for i in range(PACK) for j in range(ROOM)]
    wide = F.array_join(F.transform(F.array(*lanes), lambda x: F.lpad(F.hex(F.pmod(x, F.lit(1 << 16))), 4, "0")), "")
    return F.struct(F.lower(F.concat(*strong, wide)).alias("text"), F.array(*lanes).alias("signs"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the estimated share of sentences in which two fingerprints differ, from 0 to 1; 1 for equal ones."""
    square = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v * v)
    gap = square(F.zip_with(a["signs"], b["signs"], lambda x, y: x - y))
    both = square(a["signs"]) + square(b["signs"])
    return F.when(a["text"] == b["text"], F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.greatest(both, F.lit(1).cast("bigint"))))


def whole_steps(at: Column, low: Column, width: Column) -> Column:
    """How many whole widths ``at`` lies above ``low``, exactly for all longs."""
    exact = lambda x: x.cast("decimal(38,0)")
    return F.call_function("div", exact(at) - exact(low), exact(width))


def cut(rows: DataFrame, heavy: DataFrame, tie: Column | None) -> DataFrame:
    """(at, cell, done, ...) with the rows of the cells in ``heavy`` in cells of their own.

    A cell is cut in ranges of the same width of its ids; one of a single id, which is then ``done``, in ranges of ``tie``, if that is given.
    """
    part = whole_steps(F.col("at"), F.col("low"), F.col("width"))
    if tie is not None:
        unit = F.shiftright(tie, 33) + F.lit(1 << 30)  # 31 bits
        part = F.when(F.col("one_id"), F.shiftright(unit * F.col("parts"), 31)).otherwise(part)
    found = rows.join(F.broadcast(heavy), rows["cell"] == heavy["was"], "left")
    return found.withColumn("cell", F.coalesce(F.col("first") + part, "cell")).withColumn("done", F.col("done") | F.coalesce("one_id", F.lit(False))).drop(*heavy.columns)


def cell_cuts(ids: DataFrame, cells: int) -> tuple[list[DataFrame], bool]:
    """Tables for :func:`cut`, one for each time that cells are cut again, and whether an id was cut.

    Each cut makes a cell's range narrower by the number of its parts, so few are needed however the ids lie; a table has
    at most one row for 2 * CELL_ROWS documents.
    """
    cuts: list[DataFrame] = []
    any_id = False
    while True:
        for heavy in cuts[-1:]:
            ids = cut(ids, heavy, None)
        sizes = ids.where("not done").groupBy("cell").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("n") > 2 * CELL_ROWS)
        sizes = sizes.withColumn("parts", 1 + F.ceil(F.col("n") / CELL_ROWS)).withColumn("one_id", F.col("low") == F.col("high"))
        before = F.sum("parts").over(Window.partitionBy(F.lit(0)).orderBy("cell")) - F.col("parts")
        heavy = sizes.select(F.col("cell").alias("was"), "low", (1 + whole_steps(F.col("high"), F.col("low").cast("decimal(38,0)") - 1, F.col("parts"))).alias("width"), "parts", "one_id", (F.lit(cells) + before).alias("first"))
        heavy = materialise(heavy, "cells")
        told = heavy.agg(F.sum("parts").alias("parts"), F.max("one_id").alias("one_id")).first()
        if told["parts"] is None:
            return cuts, any_id
        cuts.append(heavy)
        cells += told["parts"]
        any_id = any_id or told["one_id"]


def in_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(cell, extra, key, tie, id, text): rows by ranges of the key; each range also gets, marked ``extra``, the row that follows its last.

    In descending order the next row of a range's last is the head of the next lower range; after the last of all comes the
    first. Ranges with too many rows are cut again, those of one id by the hash of the text, so that neither clusters of ids nor
    missing or repeated ones meet in one task. There is one head a cell, a number that the row count bounds, and they are all that is broadcast.
    """
    ids = docs.select(F.col(key).cast("bigint").alias("id"))
    bounds = ids.agg(F.count("*").alias("rows"), F.coalesce(F.min("id"), F.lit(0)).alias("low"), F.coalesce(F.max("id"), F.lit(0)).alias("high")).first()
    cells = CELLS + bounds["rows"] // CELL_ROWS
    low = bounds["low"] - 1  # null ids come last
    width = -(-(bounds["high"] - low + 1) // cells)
    at = F.coalesce(F.col(key).cast("bigint"), F.lit(low))
    cell = whole_steps(at, F.lit(low), F.lit(width))

    keyed = docs.select(at.alias("at"), cell.alias("cell"), F.lit(False).alias("done"), F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    cuts, any_id = cell_cuts(keyed.select("at", "cell", "done"), cells)
    tie = F.xxhash64("text")
    for heavy in cuts:
        keyed = cut(keyed, heavy, tie)
    keyed = keyed.withColumn("mark", F.when(F.col("done"), F.bitwise_not(tie)) if any_id else F.lit(None).cast("bigint"))

    heads = keyed.groupBy("cell").agg(F.max(F.struct("at", "mark")).alias("head"))
    upwards = Window.partitionBy(F.lit(0)).orderBy("head")
    heads = heads.select(F.col("head.at").alias("head_at"), F.col("head.mark").alias("head_mark"), F.coalesce(F.lead("cell").over(upwards), F.first("cell").over(upwards)).alias("also"))
    rows = keyed.join(F.broadcast(heads), (F.col("at") == F.col("head_at")) & F.col("mark").eqNullSafe(F.col("head_mark")), "left")
    own, also = F.struct(F.col("cell"), F.lit(False).alias("extra")), F.struct(F.col("also").alias("cell"), F.lit(True).alias("extra"))
    places = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, also))
    rows = rows.select(F.col("at").alias("key"), "id", "text", F.explode(places).alias("to"))
    return rows.select("to.cell", "to.extra", "key", tie.alias("tie"), "id", "text")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, fingerprint, signs) of each row, by one explode and one aggregation. For use on its own."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("row", "id", F.explode_outer(sentences("text")).alias("x"))
    found = rows.groupBy("row", "id").agg(*sums_of(F.col("x.sentence"), F.col("x.paragraph"))).withColumn("fp", fingerprint_of_sums())
    return found.select("id", F.col("fp.text").alias("fingerprint"), F.col("fp.signs").alias("signs"))


def edited_and_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's fingerprint, that of its text with the last third replaced from the next document, and both likenesses."""
    order = Window.partitionBy("cell").orderBy("extra", F.desc("key"), "tie")
    rows = in_cells(docs, key, text).withColumn("at", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", F.when(~F.col("extra"), edited))
    kept = ["cell", "at", "extra", "id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited_sha256", F.sha2("edited", 256))
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text")), F.struct(F.lit(1).alias("version"), F.coalesce("edited", F.lit("")).alias("text")))
    pieces = rows.select(*kept, F.explode(versions).alias("v")).select(*kept, "v.version", F.explode_outer(sentences(F.col("v.text"))).alias("x"))
    summed = pieces.groupBy(*kept, "version").agg(*sums_of(F.col("x.sentence"), F.col("x.paragraph"))).select(*kept, "version", fingerprint_of_sums().alias("fp"))
    along = Window.partitionBy("cell").orderBy("at", "version")  # a text, its edited text, the next text, ...
    beside = summed.withColumn("edited_fp", F.lead("fp", 1).over(along)).withColumn("next_fp", F.lead("fp", 2).over(along))
    return beside.where("version = 0 and not extra").select(
        "id", "n_chars", "edited_sha256",
        F.col("fp.text").alias("fingerprint"), F.col("edited_fp.text").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def sql() -> str:
    """The query over ``documents`` in SQL."""
    number = lambda h, at, n: f"CAST('0x' || substr({h}, {at}, {n}) AS BIGINT)"
    strong = ", ".join(f"sum({number('sha256(p)', 8 * i + 1, 8)}) AS s{i}" for i in range(STRONG))
    wide = ", ".join(f"2 * sum(({number('md5(s)', 1 + 16 * half, 15)} >> {ROOM * i + j}) & 1) - count(*)" for half in range(2) for i in range(PACK) for j in range(ROOM))
    shown = " || ".join(f"lpad(to_hex(CAST(coalesce(s{i}, 0) AS HUGEINT) % 4294967296), 8, '0')" for i in range(STRONG))
    square = lambda x: f"list_sum(list_transform({x}, lambda v: v * v))"
    near = lambda a, b: (
        f"CASE WHEN {a}.fp = {b}.fp THEN 1.0 ELSE greatest(0.0, 1.0 - CAST(list_sum(list_transform(list_zip({a}.g, {b}.g), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS DOUBLE)"
        f" / greatest({square(f'{a}.g')} + {square(f'{b}.g')}, 1)) END"
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_text
  FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited FROM d),
v AS (SELECT doc_id, 0 AS k, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
p AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS p FROM v),
s AS (SELECT doc_id, k, unnest(string_split_regex(p, '[.!?]')) AS s FROM p WHERE length(trim(p, ' ')) > 0),
strong AS (SELECT doc_id, k, {strong} FROM p WHERE length(trim(p, ' ')) > 0 GROUP BY ALL),
wide AS (SELECT doc_id, k, [{wide}] AS g FROM s WHERE length(trim(s, ' ')) > 0 GROUP BY ALL),
f AS (
  SELECT v.doc_id, v.k, coalesce(g, list_transform(range({WIDE}), lambda x: 0)) AS g, {shown} AS head
  FROM v LEFT JOIN strong ON v.doc_id = strong.doc_id AND v.k = strong.k LEFT JOIN wide ON v.doc_id = wide.doc_id AND v.k = wide.k),
h AS (SELECT doc_id, k, g, lower(head || list_aggregate(list_transform(g, lambda x: lpad(to_hex(CAST(((x % 65536) + 65536) % 65536 AS BIGINT)), 4, '0')), 'string_agg', '')) AS fp FROM f)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  {near('a', 'b')} AS near_edited, {near('a', 'c')} AS near_next
FROM e JOIN h a ON a.doc_id = e.doc_id AND a.k = 0 JOIN h b ON b.doc_id = e.doc_id AND b.k = 1 JOIN h c ON c.doc_id = e.next_id AND c.k = 0
"""
