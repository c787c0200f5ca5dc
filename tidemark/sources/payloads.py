"""Normalisation of provider payloads. Every function takes a table of payload texts, so parsing spreads over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions.numeric import running_product
from tidemark.functions.scalars import bar_available, clamp_ingestion, holding_available, record_key, short_interest_available, vintage_available
from tidemark.sources.lake import content_version

OHLCV = ("open", "high", "low", "close", "volume")


def _bars(rows: DataFrame, day: Column, source: str, batch_time: Column) -> DataFrame:
    """Common tail: clocks, content hash and source."""
    b = rows.withColumn("ts", day).withColumn("available_time", bar_available("ts"))
    b = b.withColumn("ingestion_time", clamp_ingestion(batch_time, "available_time")).withColumn("source", F.lit(source))
    if "adjusted_close" not in b.columns:
        b = b.withColumn("adjusted_close", F.lit(None).cast("double"))
    b = b.withColumn("data_version", content_version("ts", *OHLCV, "adjusted_close"))
    return b.select("security_id", "ts", *OHLCV, "adjusted_close", "available_time", "ingestion_time", "data_version", "source")


# ---- price payloads -----------------------------------------------------------------------------------


def csv_bars(lines: DataFrame, batch_time: Column) -> DataFrame:
    """``line``: date,open,high,low,close,volume,adj_close; an empty adjusted price is NULL."""
    r = lines.select("security_id", F.from_csv("line", schema.EOD_CSV).alias("r")).select("security_id", "r.*")
    return _bars(r.withColumnRenamed("adj_close", "adjusted_close"), F.to_timestamp("date", "yyyy-MM-dd"), "file", batch_time)


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """One <SYMBOL>.csv per security with a header; the symbol comes from the file name."""
    r = spark.read.option("header", True).schema(schema.EOD_CSV).csv(folder)
    return r.withColumn("security_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def in_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive date filter."""
    return rows.filter(F.col("date").between(start, end))


def csv_issues(lines: DataFrame) -> DataFrame:
    """Records with missing or empty required fields and which ones."""
    names = ("date", *OHLCV)
    text = F.split("line", ",")
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.try_element_at(text, F.lit(i + 1))), F.lit("")) == "", F.lit(n)) for i, n in enumerate(names)]))
    return lines.withColumn("missing", missing).filter(F.size("missing") > 0).select("security_id", "line", F.array_join("missing", ",").alias("missing"))


def json_bars(payloads: DataFrame, batch_time: Column) -> DataFrame:
    """``payload``: JSON array of end-of-day rows with ISO timestamps and adjusted prices."""
    shape = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double,adjClose:double>>"
    r = payloads.select("security_id", F.inline(F.from_json("payload", shape))).withColumnRenamed("adjClose", "adjusted_close")
    return _bars(r, F.to_timestamp(F.substring("date", 1, 10), "yyyy-MM-dd"), "json", batch_time)


def json_actions(payloads: DataFrame) -> DataFrame:
    """End-of-day rows to 0-2 actions each: a split when the factor is not 1, a dividend when cash is positive."""
    shape = "array<struct<date:string,splitFactor:double,divCash:double>>"
    r = payloads.select("security_id", F.inline(F.from_json("payload", shape)))
    split = F.struct(
        F.when(F.col("splitFactor") > 1, "SPLIT").otherwise("REVERSE_SPLIT").alias("action_type"), F.col("splitFactor").alias("amount"),
        ((F.col("splitFactor") != 1) & F.col("splitFactor").isNotNull()).alias("keep"),
    )
    paid = F.struct(F.lit("CASH_DIVIDEND").alias("action_type"), F.col("divCash").alias("amount"), F.coalesce(F.col("divCash") > 0, F.lit(False)).alias("keep"))
    both = r.select("security_id", F.to_timestamp(F.substring("date", 1, 10), "yyyy-MM-dd").alias("event_time"), F.explode(F.filter(F.array(split, paid), lambda x: x["keep"])).alias("a"))
    return both.select("security_id", "event_time", "a.action_type", "a.amount")


def plain_csv_bars(lines: DataFrame, batch_time: Column) -> DataFrame:
    """CSV lines without adjusted prices, dates as yyyyMMdd."""
    r = lines.select("security_id", F.from_csv("line", "date string, open double, high double, low double, close double, volume double").alias("r")).select("security_id", "r.*")
    return _bars(r, F.to_timestamp("date", "yyyyMMdd"), "plain", batch_time)


def keyed_json_bars(payloads: DataFrame, batch_time: Column) -> DataFrame:
    """JSON object keyed by date with fields ``1. open`` to ``5. volume`` as text."""
    fields = {n: f"{i}. {n}" for i, n in enumerate(OHLCV, 1)}
    r = payloads.select("security_id", F.explode(F.from_json("payload", "map<string,map<string,string>>")).alias("date", "f"))
    r = r.select("security_id", "date", *[F.col("f")[key].cast("double").alias(n) for n, key in fields.items()])
    return _bars(r, F.to_timestamp("date", "yyyy-MM-dd"), "keyed", batch_time)


def tagged_actions(records: DataFrame) -> DataFrame:
    """Tagged split and dividend records; ratio 1 and amounts of 0 or less are dropped."""
    kind = F.when(F.col("kind") == "dividend", "CASH_DIVIDEND").when(F.col("value") > 1, "SPLIT").otherwise("REVERSE_SPLIT")
    keep = F.when(F.col("kind") == "dividend", F.col("value") > 0).otherwise((F.col("value") != 1) & (F.col("value") > 0))
    return records.filter(keep).select("security_id", "event_time", kind.alias("action_type"), F.col("value").alias("amount"))


def text_json_bars(payloads: DataFrame, batch_time: Column) -> DataFrame:
    """JSON arrays whose numbers are text."""
    shape = "array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>"
    r = payloads.select("security_id", F.inline(F.from_json("payload", shape)))
    r = r.select("security_id", "datetime", *[F.col(x).try_cast("double").alias(x) for x in OHLCV])
    return _bars(r, F.to_timestamp("datetime", "yyyy-MM-dd"), "text", batch_time)


def html_price(html, patterns: list[str]) -> Column:
    """First match of an ordered list of patterns over the whole page, commas removed."""
    hits = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns]
    return F.regexp_replace(F.coalesce(*hits), ",", "").try_cast("double")


# ---- company filings --------------------------------------------------------------------------------------

FACTS = "map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,fy:int,fp:string,form:string,filed:string,accn:string>>>>>"


def company_facts(payloads: DataFrame) -> DataFrame:
    """Nested facts to rows: concept x unit x entry; 10-K and 10-Q only, incomplete or too early entries dropped."""
    a = payloads.select("security_id", F.explode(F.from_json("payload", FACTS)).alias("concept", "c"))
    b = a.select("security_id", "concept", F.explode("c.units").alias("unit", "entries"))
    e = b.select("security_id", "concept", "unit", F.explode("entries").alias("e")).select("security_id", "concept", "unit", "e.*")
    end, filed = F.try_to_timestamp("end", F.lit("yyyy-MM-dd")), F.try_to_timestamp("filed", F.lit("yyyy-MM-dd"))
    e = e.withColumn("period_end", end).withColumn("filed_time", filed)
    whole = F.col("val").isNotNull() & F.col("period_end").isNotNull() & F.col("filed_time").isNotNull()
    kept = e.filter(F.col("form").isin("10-K", "10-Q") & whole & (F.col("filed_time") >= F.col("period_end")))
    return kept.select(
        "security_id", "concept", "unit", "period_end", F.coalesce("fy", F.year("period_end")).alias("fiscal_year"), F.col("fp").alias("fiscal_period"),
        F.col("form").alias("form_type"), F.col("val").alias("value"), F.col("filed_time").alias("available_time"),
    )


def form4_transactions(documents: DataFrame) -> DataFrame:
    """Ownership XML to one row per non-derivative transaction; rows without date, code or shares are dropped."""
    d = documents.select("security_id", "accession", F.from_xml("xml", schema.FORM4_XML).alias("x"))
    rows = d.select("security_id", "accession", "x.reportingOwner", "x.aff10b5One", F.posexplode("x.nonDerivativeTable.nonDerivativeTransaction").alias("no", "t"))

    def yes(col):
        return F.coalesce(F.lower(F.col(col)).isin("1", "true"), F.lit(False))

    rel = "reportingOwner.reportingOwnerRelationship"
    out = rows.select(
        F.concat_ws("-", "accession", F.col("no").cast("string")).alias("record_id"),
        "security_id",
        F.col("reportingOwner.reportingOwnerId.rptOwnerCik").alias("owner_cik"),
        yes(f"{rel}.isDirector").alias("is_director"),
        yes(f"{rel}.isOfficer").alias("is_officer"),
        yes("aff10b5One").alias("is_10b5_1_plan"),
        F.try_to_timestamp("t.transactionDate.value", F.lit("yyyy-MM-dd")).alias("transaction_date"),
        F.col("t.transactionCoding.transactionCode").alias("transaction_code"),
        F.col("t.transactionAmounts.transactionShares.value").try_cast("double").alias("shares"),
        F.col("t.transactionAmounts.transactionPricePerShare.value").try_cast("double").alias("price"),
    )
    return out.dropna(subset=["transaction_date", "transaction_code", "shares"])


def form4_filings(payloads: DataFrame) -> DataFrame:
    """Parallel arrays of recent filings to rows of form 4."""
    shape = "struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>>"
    z = payloads.select("security_id", F.from_json("payload", shape).alias("r"))
    rows = z.select("security_id", F.explode(F.arrays_zip("r.form", "r.accessionNumber", "r.filingDate")).alias("z"))
    return rows.select("security_id", F.col("z.form").alias("form"), F.col("z.accessionNumber").alias("accession"), F.col("z.filingDate").alias("filing_date")).filter(F.col("form") == "4")


def profile(payloads: DataFrame) -> DataFrame:
    """Industry text as sector, first exchange that is not empty."""
    r = payloads.select("security_id", F.from_json("payload", "struct<sicDescription:string,exchanges:array<string>>").alias("r"))
    first = F.try_element_at(F.filter("r.exchanges", lambda x: x.isNotNull() & (x != "")), F.lit(1))
    return r.select("security_id", F.col("r.sicDescription").alias("sector"), first.alias("exchange"))


def older_filing_files(payloads: DataFrame) -> DataFrame:
    r = payloads.select("security_id", F.explode(F.from_json("payload", "struct<files:array<struct<name:string>>>")["files"]).alias("f"))
    return r.select("security_id", F.col("f.name").alias("name")).filter(F.col("name").isNotNull())


def resolve_cik(symbols: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Ticker to zero-padded 10-digit key."""
    m = ticker_map.select(F.upper("ticker").alias("_t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return symbols.join(m, F.upper(F.col("ticker")) == F.col("_t"), "left").drop("_t")


def info_table(documents: DataFrame) -> DataFrame:
    """Holdings XML, one ``infoTable`` element per row; a missing field is an error. CUSIPs stay text."""
    # a generator: the filter below would be pushed under a projection, and each of its fields parse the text again
    r = documents.select("accession", F.inline(F.array(F.from_xml("xml", schema.INFO_TABLE_XML))))
    r = r.select("accession", "cusip", F.col("nameOfIssuer").alias("issuer"), F.col("shrsOrPrnAmt.sshPrnamt").alias("amount"))
    whole = F.col("cusip").isNotNull() & F.col("issuer").isNotNull() & F.col("amount").isNotNull()
    ok = F.assert_true(whole, F.lit("an information table row lacks a field"))
    return r.filter(ok.isNull()).select("accession", "cusip", "issuer", F.col("amount").cast("double").alias("shares"))


def filing_date(text) -> Column:
    """Date in one of four formats, else an error when evaluated."""
    formats = ("dd-MMM-yyyy", "yyyyMMdd", "MM/dd/yyyy", "yyyy-MM-dd")
    proper = F.initcap(F.lower(F.trim(text)))
    found = F.coalesce(*[F.to_date(F.try_to_timestamp(proper, F.lit(f))) for f in formats])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unreadable filing date "), text)).cast("date"))


def submission_rows(lines: DataFrame) -> DataFrame:
    """Tab-separated submissions: quarterly holdings reports and their amendments."""
    r = lines.select(F.from_csv("line", schema.SUBMISSIONS_TSV, {"sep": "\t"}).alias("r")).select("r.*").filter(F.col("SUBMISSIONTYPE").startswith("13F-HR"))
    return r.select(
        F.col("ACCESSION_NUMBER").alias("accession"), F.col("CIK").alias("cik"), filing_date(F.col("PERIODOFREPORT")).alias("period"), filing_date(F.col("FILING_DATE")).alias("filing_date"),
        F.col("SUBMISSIONTYPE").alias("submission_type"),
    )


# ---- membership, identifiers, holdings files -----------------------------------------------------------------


def snapshot_members(rows: DataFrame) -> DataFrame:
    """(date, comma-joined tickers) to (as_of, ticker)."""
    t = F.explode(F.transform(F.split("tickers", ","), lambda x: F.trim(x)))
    return rows.select(F.to_date("date").alias("as_of"), t.alias("ticker")).filter(F.col("ticker") != "")


def ticker_intervals(lines: DataFrame) -> DataFrame:
    """ticker,start,end lines with a strict ticker pattern; an empty end is open."""
    r = lines.select(F.from_csv("line", schema.INTERVALS_CSV).alias("r")).select("r.*")
    ok = F.assert_true(F.col("ticker").rlike(r"^[A-Za-z0-9#.\-]+$"), F.lit("bad ticker"))
    end = F.nullif(F.trim("end_date"), F.lit(""))
    return r.filter(ok.isNull()).select("ticker", F.to_timestamp("start_date", "yyyy-MM-dd").alias("start_date"), F.to_timestamp(end, "yyyy-MM-dd").alias("end_date"))


def ticker_renames(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_csv("line", schema.RENAMES_CSV).alias("r")).select("r.*")


def short_interest_rows(lines: DataFrame) -> DataFrame:
    """Combined short-interest lines; an empty security is an error, 999.99 days to cover is undefined."""
    r = lines.select(F.from_csv("line", schema.SHORT_INTEREST_CSV).alias("r")).select("r.*")
    ok = F.assert_true(F.coalesce(F.trim("security_id"), F.lit("")) != "", F.lit("empty security_id"))
    r = r.filter(ok.isNull()).withColumn("settlement_date", F.col("settlement_date").cast("timestamp"))
    return r.withColumn("days_to_cover", F.nullif("days_to_cover", F.lit(999.99))).withColumn("available_time", short_interest_available("settlement_date"))


def short_interest_json(payloads: DataFrame) -> DataFrame:
    shape = "struct<symbolCode:string,settlementDate:string,currentShortPositionQuantity:double,averageDailyVolumeQuantity:double,daysToCoverQuantity:double>"
    r = payloads.select(F.from_json("payload", shape).alias("r")).select("r.*")
    return r.select(
        F.col("symbolCode").alias("security_id"), F.to_timestamp("settlementDate", "yyyy-MM-dd").alias("settlement_date"), F.col("currentShortPositionQuantity").alias("quantity"),
        F.nullif("daysToCoverQuantity", F.lit(999.99)).alias("days_to_cover"),
    )


def holdings_rows(lines: DataFrame, filer_level: bool = False) -> DataFrame:
    """Combined or filer-level holdings lines, available 45 days after the quarter."""
    shape = schema.FILER_HOLDINGS_CSV if filer_level else schema.HOLDINGS_CSV
    r = lines.select(F.from_csv("line", shape).alias("r")).select("r.*").withColumn("quarter_end", F.col("quarter_end").cast("timestamp"))
    return r.withColumn("available_time", holding_available("quarter_end"))


def usd_stocks(listings: DataFrame) -> DataFrame:
    return listings.filter((F.upper("currency") == "USD") & (F.lower("asset_type") == "stock"))


def cusip_tickers(payloads: DataFrame) -> DataFrame:
    """JSON map ticker to list of cusips, as rows; one cusip under two tickers is an error."""
    rows = payloads.select(F.explode(F.from_json("payload", "map<string,array<string>>")).alias("ticker", "cusips")).select("ticker", F.explode("cusips").alias("cusip"))
    g = rows.groupBy("cusip").agg(F.countDistinct("ticker").alias("n"), F.min("ticker").alias("ticker"))
    ok = F.assert_true(F.col("n") == 1, F.lit("a cusip belongs to two tickers"))
    return g.filter(ok.isNull()).select("cusip", "ticker")


def overrides(rows: DataFrame) -> DataFrame:
    """(ticker, kind, value) override rows to sorted sets per ticker and kind."""
    return rows.groupBy("ticker", "kind").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"))


def mapping_answers(answers: DataFrame) -> DataFrame:
    """Positional answers: the i-th answer belongs to the i-th cusip; no data gives a NULL ticker."""
    shape = "array<struct<data:array<struct<ticker:string>>>>"
    z = answers.select(F.explode(F.arrays_zip("cusips", F.from_json("response", shape).alias("response"))).alias("z"))
    return z.select(F.col("z.cusips").alias("cusip"), F.try_element_at("z.response.data", F.lit(1))["ticker"].alias("ticker"))


def index_memberships(intervals: DataFrame, universe: str) -> DataFrame:
    """Closed ticker intervals as membership rows; the end date becomes valid_to as it is."""
    return intervals.select(F.col("ticker").alias("security_id"), F.lit(universe).alias("universe"), F.col("start_date").alias("valid_from"), F.col("end_date").alias("valid_to"))


# ---- macro ---------------------------------------------------------------------------------------------------


def macro_value(text) -> Column:
    """A dot is a missing value; any other unreadable text is an error (ANSI cast)."""
    return F.when(F.trim(text) == ".", None).otherwise(F.trim(text).cast("double"))


def vintage_records(rows: DataFrame, source: str) -> DataFrame:
    day = F.date_format("observation_date", "yyyy-MM-dd")
    return rows.select(
        record_key(F.lit(source), "series_id", day, F.date_format("realtime_start", "yyyy-MM-dd")).alias("record_id"), "series_id", "observation_date",
        macro_value(F.col("raw_value")).alias("value"), "realtime_start", vintage_available("realtime_start").alias("available_time"),
    )


def merge_split_vintages(rows: DataFrame) -> DataFrame:
    """Vintages cut by paging joined again: same date and value, adjacent or equal start. A date has few vintages."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id", "observation_date").orderBy("realtime_start", "realtime_end")
    same = F.lag("value").over(w).eqNullSafe(F.col("value"))
    touches = F.col("realtime_start") <= F.date_add(F.lag("realtime_end").over(w), 1)
    begin = F.when(same & F.coalesce(touches, F.lit(False)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    islands = rows.withColumn("begin", begin).withColumn("island", F.sum("begin").over(w))
    return islands.groupBy("series_id", "observation_date", "island").agg(
        F.min("realtime_start").alias("realtime_start"), F.max("realtime_end").alias("realtime_end"), F.max("value").alias("value")
    ).drop("island")


def factor_csv(files: DataFrame) -> DataFrame:
    """Factor file texts: preamble skipped up to the header, stop at the first blank line, percent to fraction.

    ``files``: (name, text). A file is split inside its own row; files spread over tasks.
    """
    lines = F.split("text", r"\r?\n")
    located = files.select("name", lines.alias("ls")).withColumn("head", F.array_position(F.transform("ls", lambda x: F.startswith(x, F.lit(",Mkt-RF"))), True))
    body = F.slice("ls", F.col("head").cast("int") + 1, F.size("ls"))
    cut = located.withColumn("body", body).withColumn("stop", F.array_position(F.transform("body", lambda x: F.trim(x) == ""), True))
    rows = F.when(F.col("stop") > 0, F.slice("body", 1, (F.col("stop") - 1).cast("int"))).otherwise(F.col("body"))
    r = cut.select("name", F.explode(rows).alias("line")).select("name", F.from_csv("line", "d string, mkt double, smb double, hml double, rf double").alias("r")).select("name", "r.*")
    day = F.coalesce(F.try_to_timestamp("d", F.lit("yyyyMMdd")), F.try_to_timestamp(F.concat("d", F.lit("01")), F.lit("yyyyMMdd")))
    return r.select("name", day.alias("ts"), *[(F.col(x) / 100.0).alias(x) for x in ("mkt", "smb", "hml", "rf")])


def factor_levels(returns: DataFrame, factor: str, base: float = 100.0) -> DataFrame:
    """Level index from factor returns; the first row keeps the base. One row per series and day."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("ts")
    step = F.when(F.row_number().over(w) == 1, 1.0).otherwise(1.0 + F.col(factor))
    stepped = returns.withColumn("_s", step)
    return stepped.select("series_id", "ts", (F.lit(base) * running_product("_s", w.rowsBetween(Window.unboundedPreceding, 0))).alias("level"))
