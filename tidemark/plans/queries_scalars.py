"""Column functions over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.functions.numeric import fallback_null, fallback_zero
from tidemark.operators import holdings as hd
from tidemark.operators.scoring import weekdays_between
from tidemark.plans.domain import Domain
from tidemark.plans.oracle import VIEWS
from tidemark.plans.queries_aggregates import info
from tidemark.plans.queries_fundamental import tracked_filers
from tidemark.plans.queries_performance import spans
from tidemark.plans.queries_reads import intervals
from tidemark.plans.registry import query


def q(name, cols, sql=None):
    return query(f"scl_{name}", cols, sql)


AT = "TIMESTAMP '1998-07-01'"


def at():
    return F.lit("1998-07-01").cast("timestamp")


B = "security_id:s, ts:t, x:t"
q("01_bar_available", B, "SELECT security_id, ts, ts + INTERVAL 20 HOUR AS x FROM bars")(lambda d: d.bars.withColumn("x", sc.bar_available("ts")))
q("02_action_available", "record_id:s, x:t", "SELECT record_id, least(ingestion_time, event_time + INTERVAL 20 HOUR) AS x FROM actions")(
    lambda d: d.actions.withColumn("x", sc.action_available("event_time", "ingestion_time"))
)
q("03_clamp_ingestion", "record_id:s, x:t", "SELECT record_id, greatest(ingestion_time, available_time) AS x FROM actions")(
    lambda d: d.actions.withColumn("x", sc.clamp_ingestion("ingestion_time", "available_time"))
)
q("04_holding_available", "security_id:s, quarter_end:t, x:t", "SELECT security_id, quarter_end, quarter_end + INTERVAL 45 DAY AS x FROM holdings")(lambda d: d.holdings.withColumn("x", sc.holding_available("quarter_end")))
q("05_short_interest_available", "security_id:s, settlement_date:t, x:t", "SELECT security_id, settlement_date, settlement_date + INTERVAL 11 DAY AS x FROM short_interest")(
    lambda d: d.short_interest.withColumn("x", sc.short_interest_available("settlement_date"))
)
q("06_vintage_available", "series_id:s, observation_date:t, x:t", "SELECT series_id, observation_date, realtime_start + INTERVAL 30 HOUR AS x FROM macro_vintages")(
    lambda d: d.macro_vintages.withColumn("x", sc.vintage_available("realtime_start"))
)
_V = "{} >= valid_from AND (valid_to IS NULL OR {} < valid_to)"
q("07_master_valid_at", "security_id:s, ticker:s, ok:b", f"SELECT security_id, ticker, {_V.format(AT, AT)} AS ok FROM security_master")(lambda d: d.security_master.withColumn("ok", sc.valid_at(at())))
q("08_member_at", "security_id:s, ok:b", f"SELECT security_id, {_V.format(AT, AT)} AS ok FROM membership")(lambda d: d.membership.withColumn("ok", sc.valid_at(at())))
q("09_closed_interval", "ticker:s, start_date:t, ok:b", f"SELECT ticker, start_date, {AT} >= start_date AND (end_date IS NULL OR {AT} <= end_date) AS ok FROM intervals")(
    lambda d: intervals(d).withColumn("ok", sc.inside_closed(at(), "start_date", "end_date"))
)
q("10_active_filers", "filer_cik:s", "SELECT filer_cik FROM tracked_filers WHERE TIMESTAMP '2000-01-01' >= tracked_from AND (tracked_to IS NULL OR TIMESTAMP '2000-01-01' <= tracked_to)")(
    lambda d: tracked_filers(d).filter(sc.inside_closed(F.lit("2000-01-01").cast("timestamp"), "tracked_from", "tracked_to"))
)
q("11_add_months", "event_id:i, x:t", "SELECT event_id, date_trunc('second', ts + INTERVAL 1 MONTH) AS x FROM events")(
    lambda d: d.table("events").select("event_id", sc.add_months_keep_time("ts", 1).alias("x"))
)
q("12_trim_to_lookback", "security_id:s, ts:t", "SELECT security_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY ts DESC) AS k FROM bars) WHERE k <= 22")(
    lambda d: d.bars.withColumn("k", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("ts")))).filter(F.col("k") <= 22)
)
q(
    "13_rebalance_dates",
    "grp:s, x:t",
    """WITH RECURSIVE ch(grp, fin, x) AS (SELECT grp, "end", start + INTERVAL 29 DAY FROM spans UNION ALL SELECT grp, fin, x + INTERVAL 1 MONTH FROM ch WHERE x + INTERVAL 1 MONTH < fin) SELECT grp, x FROM ch""",
)(lambda d: spans(d).select("grp", F.explode(sc.chained_months(F.col("start") + F.expr("INTERVAL '29' DAY"), F.col("end"), 1)).alias("x")))


def years(d: Domain):
    """Years of the events and of the orders, 1990s to 2020s."""
    o = d.table("orders").select(F.year("o_orderdate").alias("year"))
    return o.unionByName(d.table("events").select(F.year("ts").alias("year"))).distinct()


VIEWS["years"] = "SELECT DISTINCT year(o_orderdate) AS year FROM orders UNION SELECT DISTINCT year(ts) FROM events"
VIEWS["holidays"] = """SELECT year, CAST(holiday AS DATE) AS holiday FROM (SELECT year, unnest([ny, mlk, pres, good, mem, CASE WHEN year >= 2022 THEN jun END, ind, lab, thx, xmas]) AS holiday FROM (
 SELECT year, CASE dayofweek(make_date(year, 1, 1)) WHEN 6 THEN make_date(year, 1, 1) - 1 WHEN 0 THEN make_date(year, 1, 1) + 1 ELSE make_date(year, 1, 1) END AS ny,
 (SELECT list_sort(list(d))[3] FROM (SELECT make_date(y.year, 1, k) AS d FROM range(1, 32) t(k)) WHERE isodow(d) = 1) AS mlk, (SELECT list_sort(list(d))[3] FROM (SELECT make_date(y.year, 2, k) AS d FROM range(1, 29) t(k)) WHERE isodow(d) = 1) AS pres,
 make_date(year, mo, dy) - 2 AS good, (SELECT max(d) FROM (SELECT make_date(y.year, 5, k) AS d FROM range(1, 32) t(k)) WHERE isodow(d) = 1) AS mem,
 CASE dayofweek(make_date(year, 6, 19)) WHEN 6 THEN make_date(year, 6, 18) WHEN 0 THEN make_date(year, 6, 20) ELSE make_date(year, 6, 19) END AS jun,
 CASE dayofweek(make_date(year, 7, 4)) WHEN 6 THEN make_date(year, 7, 3) WHEN 0 THEN make_date(year, 7, 5) ELSE make_date(year, 7, 4) END AS ind,
 (SELECT min(d) FROM (SELECT make_date(y.year, 9, k) AS d FROM range(1, 31) t(k)) WHERE isodow(d) = 1) AS lab, (SELECT list_sort(list(d))[4] FROM (SELECT make_date(y.year, 11, k) AS d FROM range(1, 31) t(k)) WHERE isodow(d) = 4) AS thx,
 CASE dayofweek(make_date(year, 12, 25)) WHEN 6 THEN make_date(year, 12, 24) WHEN 0 THEN make_date(year, 12, 26) ELSE make_date(year, 12, 25) END AS xmas
 FROM (SELECT *, (h + l - 7 * m + 114) // 31 AS mo, (h + l - 7 * m + 114) % 31 + 1 AS dy FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM (SELECT *, (19 * a + b - dd - g + 15) % 30 AS h FROM (
 SELECT *, (b - f + 1) // 3 AS g, b // 4 AS dd, b % 4 AS e, cc // 4 AS i, cc % 4 AS k FROM (SELECT year, year % 19 AS a, year // 100 AS b, year % 100 AS cc, (year // 100 + 8) // 25 AS f FROM years)))))) y)) WHERE holiday IS NOT NULL"""
q("15_exchange_holidays", "year:i, holiday:d", "SELECT * FROM holidays")(lambda d: sc.holiday_table(years(d)))
VIEWS["cal_days"] = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT DISTINCT CAST(ts AS DATE) FROM events"
VIEWS["open_days"] = "SELECT day FROM cal_days WHERE isodow(day) < 6 AND day NOT IN (SELECT holiday FROM holidays)"


def open_days(d: Domain):
    days = d.table("orders").select(F.to_date("o_orderdate").alias("day")).unionByName(d.table("events").select(F.to_date("ts").alias("day"))).distinct()
    return sc.trading_days(days, sc.holiday_table(years(d)))


q("16_trading_days", "day:d", "SELECT * FROM open_days")(open_days)
q("14_daily_checkpoints", "day:d, checkpoint:t", "SELECT day, CAST(day AS TIMESTAMP) + INTERVAL 20 HOUR AS checkpoint FROM open_days")(lambda d: sc.checkpoints(open_days(d)))
q("17_session_hours", "day:d, open:s, close:s", "SELECT day, CASE WHEN day(day) = 3 THEN '10:30' ELSE '09:30' END AS open, CASE WHEN day(day) = 3 THEN '16:00' WHEN day(day) = 24 THEN '13:00' ELSE '16:00' END AS close FROM open_days")(
    lambda d: sc.session_hours(
        open_days(d),
        open_days(d)
        .filter(F.dayofmonth("day").isin(3, 24))
        .select("day", F.when(F.dayofmonth("day") == 3, "10:30").alias("open"), F.when(F.dayofmonth("day") == 24, "13:00").alias("close")),
    )
)
q(
    "18_weekdays_elapsed",
    "order_id:i, n:i",
    """SELECT l_orderkey * 100 + l_linenumber AS order_id, greatest(0, (SELECT count(*) FROM range(0, 4000) t(k) WHERE CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT) <= CAST(l_shipdate AS DATE) AND isodow(CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT)) < 6)) AS n
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""".replace(
        "(SELECT count(*) FROM range(0, 4000) t(k) WHERE CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT) <= CAST(l_shipdate AS DATE) AND isodow(CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT)) < 6)",
        """(date_diff('day', o_orderdate, l_shipdate) // 7 * 5 + list_aggregate(list_transform(range(date_diff('day', o_orderdate, l_shipdate) // 7 * 7, greatest(date_diff('day', o_orderdate, l_shipdate), 0)), lambda k: CASE WHEN isodow(CAST(o_orderdate AS DATE) + CAST(k + 1 AS INT)) < 6 THEN 1 ELSE 0 END), 'sum'))""",
    ).replace("greatest(0, (date_diff", "greatest(0, coalesce((date_diff").replace("'sum'))) AS n", "'sum')), date_diff('day', o_orderdate, l_shipdate) // 7 * 5)) AS n"),
)(
    lambda d: d.table("lineitem")
    .join(d.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    .select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("order_id"), weekdays_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("n"))
)
VIEWS["ratio_texts"] = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '2:1' WHEN 1 THEN CAST(p_size AS VARCHAR) || ':' || CAST(p_size % 7 AS VARCHAR) WHEN 2 THEN CAST(p_size / 8 AS VARCHAR) WHEN 3 THEN 'three' WHEN 4 THEN 'a:b' END AS txt FROM part"


def ratio_texts(d: Domain):
    k, s = F.col("p_partkey"), F.col("p_size")
    txt = (
        F.when(k % 6 == 0, "2:1").when(k % 6 == 1, F.concat(s.cast("string"), F.lit(":"), (s % 7).cast("string"))).when(k % 6 == 2, (s / 8).cast("string")).when(k % 6 == 3, "three").when(k % 6 == 4, "a:b")
    )
    return d.table("part").select(k.alias("id"), txt.alias("txt"))


q("19_parse_ratio", "id:i, r:f", "SELECT id, coalesce(TRY_CAST(txt AS DOUBLE), TRY_CAST(split_part(txt, ':', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(txt, ':', 2) AS DOUBLE), 0)) AS r FROM ratio_texts")(
    lambda d: ratio_texts(d).select("id", hd.parse_ratio("txt").alias("r"))
)
q(
    "20_share_count_split",
    "id:i, ok:b",
    """SELECT id, list_bool_or([round_even(up * k, 0) > k AND abs(up - round_even(up * k, 0) / k) <= 0.001 * up FOR k IN [1, 2, 3, 4]]) AS ok FROM (SELECT p_partkey AS id, CASE WHEN x >= 1 THEN x ELSE 1 / x END AS up FROM (SELECT p_partkey, (p_size % 13 + 1) / (p_partkey % 9 + 1) AS x FROM part))""",
)(lambda d: d.table("part").select(F.col("p_partkey").alias("id"), hd.is_share_count_split((F.col("p_size") % 13 + 1) / (F.col("p_partkey") % 9 + 1)).alias("ok")))
q("21_adjusted_close", "security_id:s, ts:t, a:f, b:f", "SELECT security_id, ts, coalesce(adjusted_close, close) AS a, coalesce(nullif(adjusted_close, 0), close) AS b FROM bars")(
    lambda d: d.bars.select("security_id", "ts", fallback_null("adjusted_close", "close").alias("a"), fallback_zero("adjusted_close", "close").alias("b"))
)
VIEWS["titles"] = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'The ' ELSE '' END || p_name || CASE p_partkey % 7 WHEN 0 THEN ' & Co., Inc.' WHEN 1 THEN ' Holdings Corp/DE' WHEN 2 THEN ' Group plc' WHEN 3 THEN '' WHEN 4 THEN ' New-York' ELSE ' LTD' END AS title FROM part"


def titles(d: Domain):
    k = F.col("p_partkey")
    tail = F.when(k % 7 == 0, " & Co., Inc.").when(k % 7 == 1, " Holdings Corp/DE").when(k % 7 == 2, " Group plc").when(k % 7 == 3, "").when(k % 7 == 4, " New-York").otherwise(" LTD")
    return d.table("part").select(k.alias("id"), F.concat(F.when(k % 5 == 0, "The ").otherwise(""), "p_name", tail).alias("title"))


_NORM = "trim(regexp_replace(replace(upper({}), '&', ''), '[^A-Z0-9]+', ' ', 'g'))"
_WORDS = "|".join(sc.LEGAL_WORDS)
_CORE = f"trim(regexp_replace(' ' || regexp_replace({_NORM}, '^THE ', ''), '( ({_WORDS}))+$', ''))"
q("22_normalize_name", "id:i, name:s", f"SELECT id, {_NORM.format('title')} AS name FROM titles")(lambda d: titles(d).select("id", sc.normalize_name("title").alias("name")))
q("23_core_name", "id:i, name:s", f"SELECT id, {_CORE.format('title')} AS name FROM titles")(lambda d: titles(d).select("id", sc.core_name("title").alias("name")))
q("24_name_matches", "id:i, ok:b", f"SELECT id, contains(' ' || {_NORM.format('title')} || ' ', ' RED ') OR contains(' ' || {_NORM.format('title')} || ' ', ' RING ') AS ok FROM titles")(
    lambda d: titles(d).select("id", sc.name_matches("title", F.array(F.lit("RED"), F.lit("RING"))).alias("ok"))
)
q(
    "25_cusip_check",
    "cusip:s, ok:b",
    """SELECT DISTINCT cusip, (10 - list_sum([(v * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) // 10 + (v * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) % 10 FOR v, i IN vs]) % 10) % 10 = CAST(substr(cusip, 9, 1) AS INT) AS ok FROM (
 SELECT cusip, [instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', substr(cusip, k, 1)) - 1 FOR k IN [1, 2, 3, 4, 5, 6, 7, 8]] AS vs FROM alpha_cusips)""",
)(lambda d: alpha_cusips(d).select("cusip", sc.cusip_check_ok("cusip").alias("ok")).distinct())
VIEWS["alpha_cusips"] = "SELECT substr('AB0C*9@Z#', CAST(accession % 9 AS INT) + 1, 1) || substr(cusip, 2) AS cusip FROM info"


def alpha_cusips(d: Domain):
    lead = F.substr(F.lit("AB0C*9@Z#"), (F.col("accession") % 9 + 1).cast("int"), F.lit(1))
    return info(d).select(F.concat(lead, F.substring("cusip", 2, 8)).alias("cusip"))


q("26_equity_issue", "id:i, ok:b", "SELECT p_partkey AS id, regexp_matches(substr(p_name || '12345678', 7, 2), '^[0-9]{2}$') AS ok FROM part")(
    lambda d: d.table("part").select(F.col("p_partkey").alias("id"), sc.is_equity_issue(F.concat("p_name", F.lit("12345678"))).alias("ok"))
)
_CP = "SELECT accession, cusip, put_call = '' AND shares_type IN ('SH', '') AS ok, count(*) AS n FROM info GROUP BY 1, 2, 3"


def _common(d: Domain):
    return info(d).groupBy("accession", "cusip", sc.is_common_position("shares_type", "put_call").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


q("27_common_position", "accession:i, cusip:s, ok:b, n:i", _CP)(_common)
q("38_share_row", "accession:i, cusip:s, ok:b, n:i", _CP)(_common)
q(
    "28_filing_windows",
    "year:i, first:d, last:d",
    """SELECT year, s AS first, CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS last FROM (SELECT year, make_date(year, m, 1) AS s FROM years, (SELECT unnest([1, 4, 7, 10]) AS m) UNION SELECT year, make_date(year, m, 1) FROM years, (SELECT unnest([3, 6, 9, 12]) AS m))
 WHERE (s < DATE '2024-03-01' AND month(s) % 3 = 1) OR (s >= DATE '2024-03-01' AND month(s) % 3 = 0)""",
)(lambda d: years(d).select("year", F.inline(sc.filing_windows("year"))).toDF("year", "first", "last"))
VIEWS["event_shares"] = "SELECT user_id, list(v ORDER BY event_type) AS p FROM (SELECT user_id, event_type, round(sum(value), 2) AS v FROM events GROUP BY 1, 2) GROUP BY 1"


def event_shares(d: Domain):
    """Value per event type and user: five numbers at most."""
    g = d.table("events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    return g.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "v"))), lambda x: x["v"]).alias("p"))


q("31_entropy", "user_id:i, h:f", "SELECT user_id, -list_sum([x / s * ln(greatest(x / s, 1e-12)) FOR x IN p]) / ln(greatest(len(p), 2)) AS h FROM (SELECT *, list_sum(p) AS s FROM event_shares)")(
    lambda d: event_shares(d).select("user_id", sc.normalized_entropy("p").alias("h"))
)
q("32_matches_evidence", "user_id:i, ok:b", "SELECT user_id, len([x FOR x IN p IF abs(400 - x) <= greatest(abs(x) * 0.05::DOUBLE, 1e-9)]) > 0 AS ok FROM event_shares")(
    lambda d: event_shares(d).select("user_id", sc.matches_evidence(F.lit(400.0), "p", 0.05).alias("ok"))
)
q("33_mask_text", "news_id:i, masked:s")(
    lambda d: d.news.select("news_id", sc.mask_text("headline", F.array(F.lit("the"), F.lit("data")), F.upper("lang")).alias("masked"))
)
VIEWS["time_texts"] = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE 'on ' || strftime(ts, '%Y') END AS raw, ts FROM events"""


def time_texts(d: Domain):
    k = F.col("event_id") % 5
    f = lambda p: F.date_format("ts", p)
    raw = (
        F.when(k == 0, F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).when(k == 1, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 2, f("yyyy-MM-dd HH:mm")).when(k == 3, f("yyyy-MM-dd")).otherwise(F.concat(F.lit("on "), f("yyyy")))
    )
    return d.table("events").select("event_id", raw.alias("raw"))


_PARSED = "CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts) END"
q("34_parse_news_time", "event_id:i, t:t", f"SELECT event_id, {_PARSED} AS t FROM time_texts")(lambda d: time_texts(d).select("event_id", sc.parse_news_time("raw").alias("t")))
q("35_event_day", "event_id:i, day:d", f"SELECT event_id, CASE WHEN hour(t) >= 20 THEN CAST(t AS DATE) + 1 ELSE CAST(t AS DATE) END AS day FROM (SELECT event_id, {_PARSED} AS t FROM time_texts)")(
    lambda d: time_texts(d).select("event_id", sc.event_day(sc.parse_news_time("raw")).alias("day"))
)
VIEWS["locked"] = "SELECT security_id AS window_name, min(ts) + INTERVAL 900 DAY AS window_start, min(ts) + INTERVAL 1200 DAY AS window_end FROM bars WHERE CAST(regexp_extract(security_id, '([0-9]+)$', 1) AS INT) % 3 = 0 GROUP BY 1"


def locked(d: Domain):
    n = F.regexp_extract("security_id", r"(\d+)$", 1).cast("int")
    g = d.bars.filter(n % 3 == 0).groupBy(F.col("security_id").alias("window_name")).agg(F.min("ts").alias("a"))
    return g.select("window_name", (F.col("a") + F.expr("INTERVAL '900' DAY")).alias("window_start"), (F.col("a") + F.expr("INTERVAL '1200' DAY")).alias("window_end"))


q("36_locked_windows", "grp:s, window_start:t", "SELECT grp, window_start FROM spans JOIN locked ON window_name = grp AND start < window_end AND \"end\" > window_start")(lambda d: sc.overlapping(spans(d), locked(d)))
q("41_earliest_lock", "first:t", "SELECT min(window_start) AS first FROM locked")(lambda d: locked(d).agg(F.min("window_start").alias("first")))
q("37_company_names", "id:i, names:s", f"SELECT a.id, CASE WHEN {_CORE.format('a.title')} = {_CORE.format('b.title')} THEN {_CORE.format('a.title')} ELSE {_CORE.format('a.title')} || '|' || {_CORE.format('b.title')} END AS names FROM titles a JOIN titles b ON b.id = a.id + 7")(
    lambda d: titles(d)
    .join(titles(d).select((F.col("id") - 7).alias("id"), F.col("title").alias("former")), "id")
    .select("id", F.array_join(sc.company_names(F.array("title", "former")), "|").alias("names"))
)
q(
    "39_macro_record_id",
    "k:s",
    "SELECT concat_ws(':', 'feed', series_id, strftime(observation_date, '%Y-%m-%d'), strftime(realtime_start, '%Y-%m-%d')) AS k FROM macro_vintages",
)(lambda d: d.macro_vintages.select(sc.record_key(F.lit("feed"), "series_id", F.date_format("observation_date", "yyyy-MM-dd"), F.date_format("realtime_start", "yyyy-MM-dd")).alias("k")))
q("40_fresh", "series_id:s, as_of:t, ok:b", "SELECT series_id, as_of, date_diff('day', observation_date, as_of) <= 50 AS ok FROM macro_latest")(lambda d: _fresh(d))


def _fresh(d: Domain):
    from tidemark.operators import reads as rd
    from tidemark.plans.domain import QUARTERS

    latest = rd.latest_on_grid(rd.series_on_grid(d.macro_vintages, QUARTERS))
    return latest.select("series_id", "as_of", sc.fresh("observation_date", "as_of", 50).alias("ok"))
