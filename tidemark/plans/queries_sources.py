"""Sources: lake operations and payload normalisation. Payload texts are derived from the tables, then parsed back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import journal as jr
from tidemark.operators.scans import numbered, split_large
from tidemark.operators import aggregates as ag
from tidemark.operators import performance as pf
from tidemark.plans.domain import Domain
from tidemark.plans.oracle import VIEWS
from tidemark.plans.queries_performance import priced
from tidemark.plans.queries_reads import intervals, renames, snapshots
from tidemark.plans.registry import query
from tidemark.sources import lake
from tidemark.sources import payloads as pl


def q(name, cols, sql=None):
    return query(f"src_{name}", cols, sql)


BATCH = "TIMESTAMP '2000-01-01'"


def batch():
    return F.lit("2000-01-01").cast("timestamp")


BAR = "security_id:s, ts:t, close:f, adjusted_close:f"
q("01_all_bars", BAR + ", volume:f", "SELECT * FROM bar_revisions")(lambda d: d.bar_revisions)
q("02_bars_of_security", BAR, "SELECT * FROM bar_revisions WHERE security_id = 'Brand#11'")(lambda d: lake.bars_of(d.bar_revisions, "Brand#11"))
VIEWS["keyed_revisions"] = "SELECT DISTINCT security_id, ts, source, data_version FROM bar_revisions"
q(
    "03_append_new",
    "security_id:s, ts:t, source:s, data_version:s",
    "SELECT * FROM keyed_revisions k WHERE (security_id, ts, source, data_version) NOT IN (SELECT (security_id, ts, source, data_version) FROM bar_revisions WHERE volume > 20)",
)(lambda d: _appended(d))


def _appended(d: Domain):
    """What a second load adds to a lake that holds part of the bars; a third load adds nothing."""
    from tidemark.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(d.spark)}/lake-{uuid.uuid4().hex}"
    first = d.bar_revisions.filter(F.col("volume") > 20)
    lake.append_bars(d.spark, first, path)
    for _ in range(2):
        lake.append_bars(d.spark, d.bar_revisions, path)
    return lake.read_bars(d.spark, path).join(first.select(*lake.BAR_KEY), list(lake.BAR_KEY), "left_anti").select(*lake.BAR_KEY)


def written(d: Domain, fmt: str = "parquet"):
    """Round trip through a folder of the checkpoint directory."""
    from tidemark.session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(d.spark)}/roundtrip-{uuid.uuid4().hex}-{fmt}"
    o = d.table("orders")
    if fmt == "parquet":
        bars = o.select(F.col("o_custkey").cast("string").alias("security_id"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice", "o_orderdate")
        lake.write_bars(bars, folder)
        return d.spark.read.schema(bars.schema).parquet(folder)
    lake.write_snapshots({"orders": o}, folder)
    return d.spark.read.schema(o.schema).json(f"{folder}/orders")


OC = "o_orderkey:i, o_totalprice:f, o_orderdate:t"
q("04_write_batch", OC, "SELECT * FROM orders")(lambda d: written(d))
q("44_json_snapshots", OC, "SELECT * FROM orders")(lambda d: written(d, "json"))


def raw(d: Domain):
    e = d.table("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("security_id"), "event_id", "event_type", "ts")
    return lake.raw_payloads(e, "feed", F.date_format("ts", "yyyyMMdd"), F.col("ts"))


q("05_raw_manifest", "batch_id:s, records:i, securities:i", "SELECT strftime(ts, '%Y%m%d') AS batch_id, count(*) AS records, count(DISTINCT user_id) AS securities FROM events GROUP BY 1")(lambda d: lake.batch_manifest(raw(d)))
q("06_raw_payloads", "event_id:i, event_type:s", "SELECT event_id, event_type FROM events WHERE user_id = 7")(lambda d: lake.payloads_of(raw(d), "U7", "event_id bigint, event_type string"))


def _day(p="yyyy-MM-dd"):
    return F.date_format("ts", p)


def csv_lines(d: Domain):
    fields = [_day(), "open", "high", "low", "close", "volume"]
    line = F.concat_ws(",", *fields, F.coalesce(F.col("adjusted_close").cast("string"), F.lit("")))
    return d.bars.select("security_id", line.alias("line"))


NB = "security_id:s, ts:t, open:f, high:f, low:f, close:f, volume:f, adjusted_close:f, available_time:t, ingestion_time:t"


def _bars_sql(adjusted: str) -> str:
    return f"SELECT security_id, ts, open, high, low, close, volume, {adjusted} AS adjusted_close, ts + INTERVAL 20 HOUR AS available_time, greatest({BATCH}, ts + INTERVAL 20 HOUR) AS ingestion_time FROM bars"


q("08_csv_bars", NB, _bars_sql("adjusted_close"))(lambda d: pl.csv_bars(csv_lines(d), batch()))
q("07_csv_in_range", "security_id:s, date:s, close:f", "SELECT security_id, strftime(ts, '%Y-%m-%d') AS date, close FROM bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")(
    lambda d: pl.in_range(csv_lines(d).select("security_id", F.from_csv("line", pl.schema.EOD_CSV).alias("r")).select("security_id", "r.*"), "1997-01-01", "1997-12-31")
)
q("09_csv_issues", "security_id:s, missing:s", "SELECT security_id, CASE WHEN volume > 40 THEN 'high,volume' ELSE 'volume' END AS missing FROM bars WHERE volume > 30")(
    lambda d: pl.csv_issues(
        d.bars.select(
            "security_id",
            F.concat_ws(",", _day(), F.col("open").cast("string"), F.when(F.col("volume") > 40, "").otherwise(F.col("high").cast("string")), "low", "close", F.when(F.col("volume") > 30, " ").otherwise(F.col("volume").cast("string"))).alias("line"),
        )
    )
)


def monthly_json(d: Domain, *fields):
    """One JSON array per security and month: about twenty rows each."""
    g = d.bars.groupBy("security_id", F.date_trunc("month", "ts").alias("m")).agg(F.collect_list(F.struct(*fields)).alias("a"))
    return g.select("security_id", F.to_json("a").alias("payload"))


q("10_json_bars", NB, _bars_sql("adjusted_close"))(
    lambda d: pl.json_bars(monthly_json(d, F.concat(_day(), F.lit("T00:00:00.000Z")).alias("date"), *pl.OHLCV, F.col("adjusted_close").alias("adjClose")), batch())
)
VIEWS["eod_actions"] = "SELECT security_id, ts, CASE WHEN day(ts) = 5 THEN 2.0 WHEN day(ts) = 6 THEN 0.5 ELSE 1.0 END AS f, CASE WHEN day(ts) IN (6, 7) THEN volume / 10 ELSE 0 END AS c FROM bars"
q(
    "11_json_actions",
    "security_id:s, event_time:t, action_type:s, amount:f",
    "SELECT security_id, ts AS event_time, CASE WHEN f > 1 THEN 'SPLIT' ELSE 'REVERSE_SPLIT' END AS action_type, f AS amount FROM eod_actions WHERE f <> 1 UNION ALL SELECT security_id, ts, 'CASH_DIVIDEND', c FROM eod_actions WHERE c > 0",
)(
    lambda d: pl.json_actions(
        monthly_json(
            d,
            _day().alias("date"),
            F.when(F.dayofmonth("ts") == 5, 2.0).when(F.dayofmonth("ts") == 6, 0.5).otherwise(1.0).alias("splitFactor"),
            F.when(F.dayofmonth("ts").isin(6, 7), F.col("volume") / 10).otherwise(0.0).alias("divCash"),
        )
    )
)
q("12_plain_csv_bars", NB, _bars_sql("NULL::DOUBLE"))(
    lambda d: pl.plain_csv_bars(d.bars.select("security_id", F.concat_ws(",", _day("yyyyMMdd"), *[F.col(x).cast("string") for x in pl.OHLCV]).alias("line")), batch())
)


def keyed_json(d: Domain):
    fields = F.create_map(*[y for i, x in enumerate(pl.OHLCV, 1) for y in (F.lit(f"{i}. {x}"), F.col(x).cast("string"))])
    g = d.bars.groupBy("security_id", F.date_trunc("month", "ts").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct(_day().alias("k"), fields.alias("v")))).alias("o"))
    return g.select("security_id", F.to_json("o").alias("payload"))


q("13_keyed_json_bars", NB, _bars_sql("NULL::DOUBLE"))(lambda d: pl.keyed_json_bars(keyed_json(d), batch()))
q("14_tagged_actions", "security_id:s, event_time:t, action_type:s, amount:f", "SELECT security_id, ts AS event_time, CASE WHEN volume > 25 THEN 'CASH_DIVIDEND' WHEN volume % 3 > 1 THEN 'SPLIT' ELSE 'REVERSE_SPLIT' END AS action_type, CASE WHEN volume > 25 THEN volume - 30 ELSE volume % 3 END AS amount FROM bars WHERE CASE WHEN volume > 25 THEN volume > 30 ELSE volume % 3 NOT IN (0, 1) END")(
    lambda d: pl.tagged_actions(
        d.bars.select(
            "security_id", F.col("ts").alias("event_time"), F.when(F.col("volume") > 25, "dividend").otherwise("split").alias("kind"), F.when(F.col("volume") > 25, F.col("volume") - 30).otherwise(F.col("volume") % 3).alias("value")
        )
    )
)
q("15_text_json_bars", NB, _bars_sql("NULL::DOUBLE"))(lambda d: pl.text_json_bars(monthly_json(d, _day().alias("datetime"), *[F.col(x).cast("string").alias(x) for x in pl.OHLCV]), batch()))


def facts_json(d: Domain):
    """One facts document per security and year."""
    f = d.fundamentals.withColumn("filed", F.when(F.abs(F.xxhash64("record_id")) % 1 == 0, F.col("available_time")))
    entry = F.struct(
        F.date_format("period_end", "yyyy-MM-dd").alias("end"), F.col("value").alias("val"), F.when(F.col("fiscal_period") != "FY", F.col("fiscal_year")).alias("fy"), F.col("fiscal_period").alias("fp"),
        F.when(F.col("fiscal_period") == "Q4", "8-K").otherwise(F.col("form_type")).alias("form"), F.when(F.col("fiscal_period") != "Q3", F.date_format("filed", "yyyy-MM-dd")).alias("filed"),
    )
    g = f.groupBy("security_id", "fiscal_year", "concept").agg(F.collect_list(entry).alias("e"))
    unit = F.create_map(F.lit("USD"), F.col("e"))
    m = g.groupBy("security_id", "fiscal_year").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct(unit.alias("units")).alias("u")))).alias("facts"))
    return m.select("security_id", F.to_json("facts").alias("payload"))


q(
    "16_company_facts",
    "security_id:s, concept:s, period_end:t, fiscal_year:i, fiscal_period:s, form_type:s, value:f4, available_time:t",
    "SELECT security_id, concept, period_end, fiscal_year, fiscal_period, form_type, value, CAST(CAST(available_time AS DATE) AS TIMESTAMP) AS available_time FROM fundamentals WHERE fiscal_period NOT IN ('Q3', 'Q4')",
)(lambda d: pl.company_facts(facts_json(d)))


def form4_xml(d: Domain):
    e = d.insider
    shares = F.when(F.col("transaction_code") == "A", "").otherwise(F.col("shares").cast("string"))
    tx = F.concat(
        F.lit("<nonDerivativeTransaction><transactionDate><value>"), F.date_format("transaction_date", "yyyy-MM-dd"), F.lit("</value></transactionDate><transactionCoding><transactionCode>"), F.col("transaction_code"),
        F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), shares, F.lit("</value></transactionShares><transactionPricePerShare><value>1.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"),
    )
    xml = F.concat(
        F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerCik>0000012345</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>false</isOfficer></reportingOwnerRelationship></reportingOwner><aff10b5One>"),
        F.when(F.col("is_10b5_1_plan"), "1").otherwise("0"), F.lit("</aff10b5One><nonDerivativeTable>"), tx, tx, F.lit("</nonDerivativeTable></ownershipDocument>"),
    )
    return e.select("security_id", F.col("record_id").cast("string").alias("accession"), xml.alias("xml"))


q(
    "17_form4_transactions",
    "record_id:s, security_id:s, owner_cik:s, is_director:b, is_10b5_1_plan:b, transaction_date:t, transaction_code:s, shares:f",
    "SELECT CAST(record_id AS VARCHAR) || '-' || k AS record_id, security_id, '0000012345' AS owner_cik, TRUE AS is_director, is_10b5_1_plan, date_trunc('day', transaction_date) AS transaction_date, transaction_code, shares FROM insider, (SELECT unnest(['0', '1']) AS k) WHERE transaction_code <> 'A'",
)(lambda d: pl.form4_transactions(form4_xml(d)))


def filings_json(d: Domain):
    """Recent filings of a user and day as parallel arrays."""
    e = d.table("events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("security_id"), F.to_date("ts").alias("day")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("a"))
    arr = F.struct(
        F.transform("a", lambda x: F.when(x["event_type"] == "purchase", "4").otherwise("10-Q")).alias("form"), F.transform("a", lambda x: x["event_id"].cast("string")).alias("accessionNumber"),
        F.transform("a", lambda x: F.date_format("day", "yyyy-MM-dd")).alias("filingDate"),
    )
    return e.select("security_id", F.to_json(arr).alias("payload"))


q("18_form4_filings", "security_id:s, accession:s, filing_date:s", "SELECT 'U' || CAST(user_id AS VARCHAR) AS security_id, CAST(event_id AS VARCHAR) AS accession, strftime(ts, '%Y-%m-%d') AS filing_date FROM events WHERE event_type = 'purchase'")(
    lambda d: pl.form4_filings(filings_json(d))
)
q("19_profile", "security_id:s, sector:s, exchange:s", "SELECT c_name AS security_id, c_mktsegment AS sector, CASE WHEN c_nationkey % 3 = 0 THEN 'NYSE' WHEN c_nationkey % 3 = 1 THEN 'NASDAQ' END AS exchange FROM customer")(
    lambda d: pl.profile(
        d.table("customer").select(
            F.col("c_name").alias("security_id"),
            F.to_json(F.struct(F.col("c_mktsegment").alias("sicDescription"), F.array(F.lit(""), F.when(F.col("c_nationkey") % 3 == 0, "NYSE").when(F.col("c_nationkey") % 3 == 1, "NASDAQ").otherwise("")).alias("exchanges"))).alias("payload"),
        )
    )
)
q("20_resolve_cik", "ticker:s, cik:s", "SELECT lower(c_name) AS ticker, CASE WHEN c_custkey % 3 > 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer")(
    lambda d: pl.resolve_cik(
        d.table("customer").select(F.lower("c_name").alias("ticker")), d.table("customer").filter(F.col("c_custkey") % 3 > 0).select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("cik"))
    )
)


def info_xml(d: Domain):
    li = d.table("lineitem")
    xml = F.concat(
        F.lit("<infoTable><nameOfIssuer>N"), F.col("l_suppkey").cast("string"), F.lit("</nameOfIssuer><cusip>"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit("</cusip><shrsOrPrnAmt><sshPrnamt>"),
        F.col("l_quantity").cast("string"), F.lit("</sshPrnamt><sshPrnamtType>SH</sshPrnamtType></shrsOrPrnAmt></infoTable>"),
    )
    return li.select(F.col("l_orderkey").alias("accession"), xml.alias("xml"))


q("21_info_table", "accession:i, cusip:s, issuer:s, shares:f", "SELECT l_orderkey AS accession, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, 'N' || CAST(l_suppkey AS VARCHAR) AS issuer, l_quantity AS shares FROM lineitem")(lambda d: pl.info_table(info_xml(d)))


def submission_lines(d: Domain):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.upper(F.date_format(day, "dd-MMM-yyyy"))).when(k % 4 == 1, F.date_format(day, "yyyyMMdd")).when(k % 4 == 2, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    kind = F.when(k % 3 == 0, "13F-NT").when(k % 3 == 1, "13F-HR").otherwise("13F-HR/A")
    return d.table("orders").select(F.concat_ws("\t", F.lpad(k.cast("string"), 12, "0"), F.col("o_custkey").cast("string"), text, F.date_format(day, "yyyy-MM-dd"), kind).alias("line"))


q(
    "22_submission_rows",
    "accession:s, cik:s, period:d, filing_date:d, submission_type:s",
    "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession, CAST(o_custkey AS VARCHAR) AS cik, o_orderdate AS period, o_orderdate AS filing_date, CASE WHEN o_orderkey % 3 = 1 THEN '13F-HR' ELSE '13F-HR/A' END AS submission_type FROM orders WHERE o_orderkey % 3 <> 0",
)(lambda d: pl.submission_rows(submission_lines(d)))
q("23_snapshot_members", "as_of:d, ticker:s", "SELECT CAST(snapshot AS DATE) AS as_of, ticker FROM snapshots")(
    lambda d: pl.snapshot_members(snapshots(d).groupBy(F.date_format("snapshot", "yyyy-MM-dd").alias("date")).agg(F.concat_ws(" ,", F.collect_list("ticker")).alias("t")).select("date", F.concat("t", F.lit(",")).alias("tickers")))
)


def interval_lines(d: Domain):
    return intervals(d).select(F.concat_ws(",", "ticker", F.date_format("start_date", "yyyy-MM-dd"), F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit(""))).alias("line"))


q("24_ticker_intervals", "ticker:s, start_date:t, end_date:t", "SELECT * FROM intervals")(lambda d: pl.ticker_intervals(interval_lines(d)))
q("55_index_memberships", "security_id:s, universe:s, valid_from:t, valid_to:t", "SELECT ticker AS security_id, 'index' AS universe, start_date AS valid_from, end_date AS valid_to FROM intervals")(
    lambda d: pl.index_memberships(pl.ticker_intervals(interval_lines(d)), "index")
)
q("25_ticker_renames", "old_ticker:s, new_ticker:s", "SELECT * FROM renames")(lambda d: pl.ticker_renames(renames(d).select(F.concat_ws(",", "old_ticker", "new_ticker").alias("line"))))
SI = "security_id:s, settlement_date:t, quantity:f, days_to_cover:f, available_time:t"
_SI = "SELECT security_id, settlement_date, quantity, days_to_cover, available_time FROM short_interest"


def short_lines(d: Domain):
    s = d.short_interest
    return s.select(F.concat_ws(",", "security_id", F.date_format("settlement_date", "yyyy-MM-dd"), "quantity", "avg_volume", F.coalesce("days_to_cover", F.lit(999.99))).alias("line"))


q("27_short_interest_csv", SI, _SI)(lambda d: pl.short_interest_rows(short_lines(d)))
q("26_short_interest_symbol", SI, _SI + " WHERE security_id = 'Brand#4'")(lambda d: pl.short_interest_rows(short_lines(d)).filter(F.col("security_id") == "Brand#4"))
q("36_short_interest_json", "security_id:s, settlement_date:t, quantity:f, days_to_cover:f", _SI)(
    lambda d: pl.short_interest_json(
        d.short_interest.select(
            F.to_json(
                F.struct(
                    F.col("security_id").alias("symbolCode"), F.date_format("settlement_date", "yyyy-MM-dd").alias("settlementDate"), F.col("quantity").alias("currentShortPositionQuantity"),
                    F.coalesce("days_to_cover", F.lit(999.99)).alias("daysToCoverQuantity"),
                )
            ).alias("payload")
        )
    )
)
HO = "security_id:s, quarter_end:t, shares:f, num_institutions:i, available_time:t"


def holding_lines(d: Domain):
    return d.holdings.select(F.concat_ws(",", "security_id", F.date_format("quarter_end", "yyyy-MM-dd"), "shares", "num_institutions").alias("line"))


q("28_holdings_csv", HO, "SELECT * FROM holdings")(lambda d: pl.holdings_rows(holding_lines(d)))
q("29_holdings_symbol", HO, "SELECT * FROM holdings WHERE security_id = 'Brand#4'")(lambda d: pl.holdings_rows(holding_lines(d)).filter(F.col("security_id") == "Brand#4"))
q("30_filer_holdings_csv", "security_id:s, filer_cik:s, quarter_end:t, shares:f, available_time:t", "SELECT * FROM filer_holdings")(
    lambda d: pl.holdings_rows(d.filer_holdings.select(F.concat_ws(",", "security_id", "filer_cik", F.date_format("quarter_end", "yyyy-MM-dd"), "shares").alias("line")), filer_level=True)
)


def raw_vintages(d: Domain):
    return d.macro_vintages.withColumn("raw_value", F.coalesce(F.col("value").cast("string"), F.lit(".")))


q("31_macro_value", "series_id:s, observation_date:t, realtime_start:t, v:f2", "SELECT *, value AS v FROM macro_vintages")(lambda d: raw_vintages(d).withColumn("v", pl.macro_value(F.col("raw_value"))))
q(
    "32_vintage_records",
    "record_id:s, value:f2, available_time:t",
    "SELECT concat_ws(':', 'feed', series_id, strftime(observation_date, '%Y-%m-%d'), strftime(realtime_start, '%Y-%m-%d')) AS record_id, value, realtime_start + INTERVAL 30 HOUR AS available_time FROM macro_vintages",
)(lambda d: pl.vintage_records(raw_vintages(d), "feed"))
VIEWS["cut_vintages"] = """SELECT series_id, observation_date, value, realtime_start, CAST(realtime_start + INTERVAL 10 DAY AS DATE) AS realtime_end FROM macro_vintages
 UNION ALL SELECT series_id, observation_date, value, realtime_start + INTERVAL 11 DAY, CAST(realtime_start + INTERVAL 20 DAY AS DATE) FROM macro_vintages"""


def cut_vintages(d: Domain):
    m = d.macro_vintages.select("series_id", "observation_date", "value", "realtime_start")
    def day(n):
        return F.date_add(F.to_date("realtime_start"), n)

    first = m.withColumn("realtime_end", day(10))
    second = m.select("series_id", "observation_date", "value", day(11).cast("timestamp").alias("realtime_start"), day(20).alias("realtime_end"))
    return first.unionByName(second)


q(
    "33_merge_split_vintages",
    "series_id:s, observation_date:t, realtime_start:t, realtime_end:d, value:f2",
    """SELECT series_id, observation_date, min(realtime_start) AS realtime_start, max(realtime_end) AS realtime_end, max(value) AS value FROM (SELECT *, sum(b) OVER (PARTITION BY series_id, observation_date ORDER BY realtime_start, realtime_end) AS island FROM (
 SELECT *, CASE WHEN lag(value) OVER w IS NOT DISTINCT FROM value AND realtime_start <= lag(realtime_end) OVER w + 1 THEN 0 ELSE 1 END AS b FROM cut_vintages WINDOW w AS (PARTITION BY series_id, observation_date ORDER BY realtime_start, realtime_end))) GROUP BY series_id, observation_date, island""",
)(lambda d: pl.merge_split_vintages(cut_vintages(d)))


def factor_files(d: Domain):
    """One factor file per year of the benchmark: preamble, header, daily rows, blank line, footer."""
    row = F.concat_ws(",", F.date_format("ts", "yyyyMMdd"), *[F.round(F.col("level") / k + 1.23e-7, 4).cast("string") for k in (100, 200, 300, 400)])
    g = d.benchmark.groupBy(F.year("ts").alias("y")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = F.concat(F.lit("made from levels\n\n,Mkt-RF,SMB,HML,RF\n"), F.array_join("rows", "\n"), F.lit("\n\nannual\n1999,1,2,3,4\n"))
    return g.select(F.col("y").cast("string").alias("name"), text.alias("text"))


q("34_factor_csv", "name:s, ts:t, mkt:f, rf:f", "SELECT CAST(year(ts) AS VARCHAR) AS name, ts, round(level / 100 + 1.23e-7, 4) / 100 AS mkt, round(level / 400 + 1.23e-7, 4) / 100 AS rf FROM benchmark_levels")(lambda d: pl.factor_csv(factor_files(d)))
q(
    "35_factor_levels",
    "series_id:s, ts:t, level:f6",
    "SELECT series_id, ts, 100 * exp(sum(s) OVER (PARTITION BY series_id ORDER BY ts)) AS level FROM (SELECT 'mkt' AS series_id, ts, CASE WHEN row_number() OVER (ORDER BY ts) = 1 THEN 0 ELSE ln(1 + (level - 104) / 1000) END AS s FROM benchmark_levels)",
)(lambda d: pl.factor_levels(d.benchmark.select(F.lit("mkt").alias("series_id"), "ts", ((F.col("level") - 104) / 1000).alias("mkt")), "mkt"))
VIEWS["price_rows"] = "SELECT security_id AS ticker, strftime(ts, '%Y-%m-%d') AS date, open, high, low, close, CASE WHEN day(ts) = 9 THEN 0 ELSE volume END AS volume FROM bars"


def price_rows(d: Domain):
    return d.bars.select(F.col("security_id").alias("ticker"), _day().alias("date"), "open", "high", "low", "close", F.when(F.dayofmonth("ts") == 9, 0.0).otherwise(F.col("volume")).alias("volume"))


q("37_requested_prices", "ticker:s, date:s, close:f", "SELECT ticker, date, close FROM price_rows WHERE volume <> 0 AND ticker IN (SELECT old_ticker FROM renames)")(
    lambda d: _price_files(d)
)


def _price_files(d: Domain):
    from tidemark.session import ensure_checkpoint_dir

    folder = f"{ensure_checkpoint_dir(d.spark)}/prices-{uuid.uuid4().hex}"
    rows = price_rows(d)
    lake.write_price_files(rows, renames(d).select(F.col("old_ticker").alias("ticker")), folder)
    return d.spark.read.schema(rows.schema).option("header", True).option("enforceSchema", False).csv(folder)
q("38_real_rows", "ticker:s, date:s, volume:f", "SELECT * FROM price_rows WHERE volume <> 0")(lambda d: lake.real_rows(price_rows(d)))
q("39_import_layout", "date:s, close:f, volume:f, adj_close:s", "SELECT date, close, volume, '' AS adj_close FROM price_rows")(lambda d: lake.import_layout(price_rows(d)))
_PATTERNS = [r"price[^0-9]{0,20}([0-9][0-9,]*\.?[0-9]*)", r"\$\s?([0-9][0-9,]*\.?[0-9]*)", r">([0-9][0-9,]*\.[0-9]+)<", r"([0-9]{2,})"]
q("40_html_price", "page_id:i, price:f", "SELECT page_id, TRY_CAST(replace(coalesce(" + ", ".join(f"nullif(regexp_extract(html, '{p}', 1), '')" for p in _PATTERNS) + "), ',', '') AS DOUBLE) AS price FROM pages")(
    lambda d: d.table("pages").select("page_id", pl.html_price("html", _PATTERNS).alias("price"))
)
q("41_usd_stocks", "ticker:s", "SELECT c_name AS ticker FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment = 'MACHINERY'")(
    lambda d: pl.usd_stocks(
        d.table("customer").select(F.col("c_name").alias("ticker"), F.when(F.col("c_nationkey") % 2 == 0, "usd").otherwise("EUR").alias("currency"), F.when(F.col("c_mktsegment") == "MACHINERY", "Stock").otherwise("ETF").alias("asset_type"))
    )
)
q("42_cusip_tickers", "cusip:s, ticker:s", "SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS cusip, p_brand AS ticker FROM part")(
    lambda d: pl.cusip_tickers(
        d.table("part").groupBy("p_brand", (F.col("p_partkey") % 16).alias("g")).agg(F.collect_list(F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("c")).select(F.to_json(F.create_map("p_brand", "c")).alias("payload"))
    )
)
q("43_overrides", "ticker:s, kind:s, values:s", "SELECT p_brand AS ticker, p_type AS kind, string_agg(DISTINCT CAST(p_size AS VARCHAR), '|' ORDER BY CAST(p_size AS VARCHAR)) AS values FROM part GROUP BY 1, 2")(
    lambda d: pl.overrides(d.table("part").select(F.col("p_brand").alias("ticker"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("value")))
)
q("47_incremental_start", "start:d", "SELECT greatest(CAST(min(m) AS DATE) - 7, DATE '1999-01-01') AS start FROM (SELECT security_id, max(ts) AS m FROM bars GROUP BY 1)")(
    lambda d: lake.incremental_start(d.bars, d.sector.select("security_id"), F.lit("1999-01-01").cast("date"))
)
VIEWS["run_manifest"] = "SELECT 'U' || CAST(user_id AS VARCHAR) AS security_id, CAST(ts AS DATE) AS run, CASE WHEN max(value) > 60 AND count(*) > 2 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events GROUP BY 1, 2"


def run_manifest(d: Domain):
    g = d.table("events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("security_id"), F.to_date("ts").alias("run")).agg(F.max("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.select("security_id", "run", F.when((F.col("v") > 60) & (F.col("n") > 2), "FAILED").otherwise("SUCCESS").alias("status"))


q(
    "48_run_status",
    "run:d, run_status:s, symbols:i",
    "SELECT run, CASE WHEN count(*) FILTER (WHERE status = 'SUCCESS') = count(*) THEN 'SUCCESS' WHEN count(*) FILTER (WHERE status = 'SUCCESS') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS run_status, count(*) AS symbols FROM run_manifest GROUP BY 1",
)(lambda d: lake.run_status(run_manifest(d), "run"))
q("49_first_answer", "security_id:s, source:s, priority:i", "SELECT security_id, arg_min(source, priority) AS source, min(priority) AS priority FROM (SELECT 'U' || CAST(user_id AS VARCHAR) AS security_id, event_type AS source, length(event_type) * 100 + ascii(event_type) AS priority FROM events WHERE value > 30) GROUP BY 1")(
    lambda d: lake.first_answer(
        d.table("events").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("security_id"), F.col("event_type").alias("source"), (F.length("event_type") * 100 + F.ascii("event_type")).alias("priority"),
            F.when(F.col("value") > 30, "OK").otherwise("ERROR").alias("status"),
        )
    )
)
q("50_content_version", "o_orderkey:i, version:s", "SELECT o_orderkey, sha256(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority})) AS version FROM orders")(
    lambda d: d.table("orders").select("o_orderkey", lake.content_version("o_orderpriority", "o_custkey", "o_orderkey").alias("version"))
)
q(
    "51_changed_only",
    "security_id:s, ts:t, regime:s",
    "SELECT security_id, ts, regime FROM (SELECT *, lag(regime) OVER (PARTITION BY security_id ORDER BY ts) AS b FROM (SELECT security_id, ts, CASE WHEN close > 105 THEN 'UP' ELSE 'DOWN' END AS regime FROM bars)) WHERE b IS NULL OR b <> regime",
)(lambda d: ag.changed_only(d.bars.select("security_id", "ts", F.when(F.col("close") > 105, "UP").otherwise("DOWN").alias("regime")), ["security_id"], ["ts"], "regime"))
q(
    "52_risk_log",
    "security_id:s, month:t, state:s",
    "SELECT security_id, month, CASE WHEN price > mean THEN 'RISK_ON' ELSE 'RISK_OFF' END AS state FROM (SELECT *, avg(price) OVER w AS mean, count(*) OVER w AS n FROM month_ends WINDOW w AS (PARTITION BY security_id ORDER BY month ROWS 9 PRECEDING)) WHERE n = 10",
)(lambda d: pf.sma_exposure(priced(d)).filter(F.col("exposure").isNotNull()).select("security_id", "month", F.when(F.col("exposure") > 0, "RISK_ON").otherwise("RISK_OFF").alias("state")))
q("53_older_filing_files", "security_id:s, name:s", "SELECT c_name AS security_id, 'CIK' || CAST(c_custkey AS VARCHAR) || '-' || k AS name FROM customer, (SELECT unnest(['001', '002']) AS k)")(
    lambda d: pl.older_filing_files(
        d.table("customer").select(
            F.col("c_name").alias("security_id"),
            F.to_json(F.struct(F.array(*[F.struct(F.concat(F.lit("CIK"), F.col("c_custkey").cast("string"), F.lit(f"-{k}")).alias("name")) for k in ("001", "002")]).alias("files"))).alias("payload"),
        )
    )
)
q("54_mapping_answers", "cusip:s, ticker:s", "SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS cusip, CASE WHEN p_size % 2 = 0 THEN p_brand END AS ticker FROM part")(lambda d: pl.mapping_answers(_answers(d)))


def _answers(d: Domain):
    """Answer batches: cusips and positional answers of one brand and residue."""
    hit = F.when(F.col("p_size") % 2 == 0, F.struct(F.array(F.struct(F.col("p_brand").alias("ticker"))).alias("data")))
    miss = F.struct(F.array().cast("array<struct<ticker:string>>").alias("data"))
    g = d.table("part").groupBy("p_brand", (F.col("p_partkey") % 16).alias("g")).agg(F.collect_list(F.struct(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("c"), F.coalesce(hit, miss).alias("r"))).alias("x"))
    return g.select(F.transform("x", lambda e: e["c"]).alias("cusips"), F.to_json(F.transform("x", lambda e: e["r"])).alias("response"))


# a cycle of eight fills that ends flat: quantity bought, or sold where negative
CYCLE = (10, 20, -12, 7, -5, 11, -1, -30)
VIEWS["replay_fills"] = f"""SELECT fill_id, order_id, security_id, CASE WHEN step > 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(abs(step) AS DOUBLE) AS quantity, price, commission, execution_time, place FROM (
 SELECT *, list_extract({list(CYCLE)}, CAST((place - 1) % {len(CYCLE)} + 1 AS INT)) AS step FROM (
 SELECT l_orderkey * 8 + l_linenumber AS fill_id, l_orderkey AS order_id, 'S' || CAST(l_suppkey AS VARCHAR) AS security_id, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS price, CAST(l_tax AS DOUBLE) AS commission, CAST(l_shipdate AS TIMESTAMP) AS execution_time,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 8 + l_linenumber) AS place FROM lineitem))"""


def replay_fills(d: Domain):
    """Fills of each supplier as one security, the sides and quantities by the cycle."""
    line = d.table("lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fill_id"), F.col("l_orderkey").alias("order_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("security_id"),
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"), F.col("l_tax").cast("double").alias("commission"), F.col("l_shipdate").cast("timestamp").alias("execution_time"),
    )
    order = ["execution_time", "fill_id"]
    step = F.element_at(F.array(*[F.lit(x) for x in CYCLE]), ((F.col("place") - 1) % len(CYCLE) + 1).cast("int"))
    parts = [numbered(part, ["security_id"], order, "place").drop("_piece") for part in split_large(line, ["security_id"], order)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("side", F.when(step > 0, "BUY").otherwise("SELL")).withColumn("quantity", F.abs(step).cast("double")).drop("place")


q(
    "56_replayed_fills",
    "fill_id:i, decision_id:i, side:s, position_after:f, average_cost:f4, realized_pnl:f3, realized_return:f4, holding_seconds:i",
    """WITH RECURSIVE s(security_id, place, fill_id, order_id, side, position_after, cost, average_cost, realized_pnl, realized_return, execution_time, opened_at) AS (
 SELECT security_id, place, fill_id, order_id, side, quantity, price, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), execution_time, execution_time FROM replay_fills WHERE place = 1
 UNION ALL
 SELECT f.security_id, f.place, f.fill_id, f.order_id, f.side, CASE WHEN f.side = 'BUY' THEN position_after + f.quantity ELSE position_after - f.quantity END,
  CASE WHEN f.side = 'BUY' THEN (cost * position_after + f.price * f.quantity) / (position_after + f.quantity) WHEN position_after = f.quantity THEN 0.0 ELSE cost END,
  CASE WHEN f.side = 'SELL' THEN cost END, CASE WHEN f.side = 'SELL' THEN (f.price - cost) * f.quantity - f.commission END,
  CASE WHEN f.side = 'SELL' THEN ((f.price - cost) * f.quantity - f.commission) / (cost * f.quantity) END, f.execution_time, CASE WHEN position_after = 0 THEN f.execution_time ELSE opened_at END
 FROM s JOIN replay_fills f ON f.security_id = s.security_id AND f.place = s.place + 1)
 SELECT fill_id, order_id AS decision_id, side, position_after, average_cost, realized_pnl, realized_return, CASE WHEN side = 'SELL' THEN epoch(execution_time) - epoch(opened_at) END AS holding_seconds FROM s WHERE order_id % 5 <> 0""",
)(
    lambda d: jr.replayed_trades(
        replay_fills(d), d.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("decision_id")),
        d.table("lineitem").where("l_orderkey % 5 = 0").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fill_id")),
    )
)
