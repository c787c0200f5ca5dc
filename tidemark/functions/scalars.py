"""Column functions on time, names, identifiers and small arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import c

# fixed lag of each kind of record
BAR_HOURS, HOLDING_DAYS, SHORT_INTEREST_DAYS = 20, 45, 11


def plus(ts, days: int = 0, hours: int = 0) -> Column:
    return c(ts) + F.make_dt_interval(F.lit(days), F.lit(hours))


def bar_available(ts) -> Column:
    return plus(ts, hours=BAR_HOURS)


def action_available(event, ingestion) -> Column:
    return F.least(c(ingestion), plus(event, hours=BAR_HOURS))


def clamp_ingestion(batch, available) -> Column:
    return F.greatest(c(batch), c(available))


def holding_available(quarter_end) -> Column:
    return plus(quarter_end, days=HOLDING_DAYS)


def short_interest_available(settlement) -> Column:
    return plus(settlement, days=SHORT_INTEREST_DAYS)


def vintage_available(realtime_start) -> Column:
    return plus(realtime_start, days=1, hours=6)


def valid_at(at, start="valid_from", end="valid_to") -> Column:
    """Half-open validity; an open end is NULL."""
    return (c(at) >= c(start)) & (c(end).isNull() | (c(at) < c(end)))


def inside_closed(at, start, end) -> Column:
    """Closed interval: the end date still counts."""
    return (c(at) >= c(start)) & (c(end).isNull() | (c(at) <= c(end)))


def add_months_keep_time(ts, months) -> Column:
    """Calendar months added, the day clamped to the month end, the time of day kept."""
    rest = F.unix_micros(c(ts)) - F.unix_micros(F.date_trunc("day", c(ts)))
    return F.timestamp_micros(F.unix_micros(F.add_months(c(ts), months).cast("timestamp")) + rest)


def chained_months(start, end, step: int) -> Column:
    """start, then step by step while before end; every step clamps the day of the one before."""
    chain = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.ceil(F.months_between(c(end), c(start)) / step).cast("int") + 1, F.lit(1))),
        F.array(c(start)),
        lambda acc, _i: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), step).cast("timestamp"))),
    )
    return F.filter(chain, lambda d: d < c(end))


# ---- trading calendar ---------------------------------------------------------------------------


def _nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    before = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before, weekday), 7 * (n - 1))


def _last_monday_of_may(year: Column) -> Column:
    return F.next_day(F.make_date(year, F.lit(5), F.lit(24)), "Mon")


def _observed(day: Column) -> Column:
    dow = F.dayofweek(day)
    return F.when(dow == 7, F.date_sub(day, 1)).when(dow == 1, F.date_add(day, 1)).otherwise(day)


def easter(year) -> Column:
    """Gregorian Easter: the Sunday after the full moon on or after 21 March, by epact and golden number."""
    y = c(year)
    golden = y % 19 + 1
    century = F.floor(y / 100) + 1
    skipped = F.floor(3 * century / 4) - 12
    moon = F.floor((8 * century + 5) / 25) - 5
    sunday = F.floor(5 * y / 4) - skipped - 10
    epact0 = F.pmod(11 * golden + 20 + moon - skipped, F.lit(30))
    epact = F.when(((epact0 == 25) & (golden > 11)) | (epact0 == 24), epact0 + 1).otherwise(epact0)
    full0 = 44 - epact
    full = F.when(full0 < 21, full0 + 30).otherwise(full0)
    day = full + 7 - F.pmod(sunday + full, F.lit(7))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(1)), (day - 1).cast("int"))


def exchange_holidays(year) -> Column:
    """Exchange holidays of a year as an array of dates; Juneteenth from 2022."""
    y = c(year).cast("int")
    fixed = [
        _observed(F.make_date(y, F.lit(1), F.lit(1))),
        _nth_weekday(y, 1, "Mon", 3),
        _nth_weekday(y, 2, "Mon", 3),
        F.date_sub(easter(y), 2),
        _last_monday_of_may(y),
        F.when(y >= 2022, _observed(F.make_date(y, F.lit(6), F.lit(19)))),
        _observed(F.make_date(y, F.lit(7), F.lit(4))),
        _nth_weekday(y, 9, "Mon", 1),
        _nth_weekday(y, 11, "Thu", 4),
        _observed(F.make_date(y, F.lit(12), F.lit(25))),
    ]
    return F.array_compact(F.array(*fixed))


def holiday_table(years: DataFrame) -> DataFrame:
    return years.select("year", F.explode(exchange_holidays("year")).alias("holiday"))


def trading_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Weekdays that are no holiday."""
    h = holidays.select(F.col("holiday").alias("day"))
    return days.filter(F.dayofweek("day").between(2, 6)).join(h, "day", "left_anti")


def checkpoints(days: DataFrame, hour: int = 20) -> DataFrame:
    return days.select("day", (F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour))).alias("checkpoint"))


def session_hours(days: DataFrame, special: DataFrame) -> DataFrame:
    """Open and close per trading day with overrides: special(day, open, close), NULL = ordinary."""
    j = days.join(special, "day", "left")
    return j.select("day", F.coalesce("open", F.lit("09:30")).alias("open"), F.coalesce("close", F.lit("16:00")).alias("close"))


# ---- names and identifiers ---------------------------------------------------------------------------

# fixed trailing words of a company title: legal forms, then state suffixes
LEGAL_WORDS = (
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "LLC", "PLC", "GROUP", "HOLDINGS", "HOLDING", "COM", "NEW", "DEL",
    "DE", "MD", "MN", "NJ", "NY", "PA", "OH", "TX", "CA", "VA", "NC", "GA", "IL", "MA", "WA",
)


def normalize_name(text) -> Column:
    """Upper case, & dropped, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c(text)), "&", ""), r"[^\p{L}\p{N}]+", " "))


def core_name(text) -> Column:
    """Normalised name without a leading THE and trailing legal or state words."""
    body = F.regexp_replace(normalize_name(text), "^THE ", "")
    words = "|".join(LEGAL_WORDS)
    return F.regexp_replace(body, rf"(^|( ))((({words})( |$))+)$", "")


def company_names(titles) -> Column:
    """Distinct non-empty core names in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(c(titles), core_name), lambda x: x != ""))


def name_matches(issuer, cores) -> Column:
    padded = F.concat(F.lit(" "), normalize_name(issuer), F.lit(" "))
    return F.exists(c(cores), lambda core: F.contains(padded, F.concat(F.lit(" "), core, F.lit(" "))))


def cusip_check_ok(cusip) -> Column:
    """Mod-10 double-add-double check over the first eight characters."""
    x = c(cusip)
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#")

    def weight(i):
        v = (F.position(F.substr(x, i, F.lit(1)), alphabet) - 1) * F.when(i % 2 == 0, 2).otherwise(1)
        return F.floor(v / 10) + v % 10

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(8)), weight), F.lit(0).cast("bigint"), lambda a, v: a + v)
    shape = x.rlike(r"^[0-9A-Z*@#]{8}[0-9]$")
    return F.when(shape, F.pmod(10 - total % 10, F.lit(10)) == F.substring(x, 9, 1).cast("int")).otherwise(False)


def is_equity_issue(cusip) -> Column:
    return F.substring(c(cusip), 7, 2).rlike("^[0-9]{2}$")


def is_common_position(shares_type, put_call) -> Column:
    """No put or call, and type SH or blank."""
    return (F.trim(F.coalesce(c(put_call), F.lit(""))) == "") & F.upper(F.trim(F.coalesce(c(shares_type), F.lit("")))).isin("", "SH")


def filing_windows(year) -> Column:
    """Filing windows that start in a year: quarters before March 2024, then Mar, Jun, Sep, Dec windows of three months."""
    y = c(year).cast("int")
    quarters = F.transform(F.array(*[F.lit(m) for m in (1, 4, 7, 10)]), lambda m: F.make_date(y, m, F.lit(1)))
    seasons = F.transform(F.array(*[F.lit(m) for m in (3, 6, 9, 12)]), lambda m: F.make_date(y, m, F.lit(1)))
    switch = F.lit("2024-03-01").cast("date")
    starts = F.concat(F.filter(quarters, lambda d: d < switch), F.filter(seasons, lambda d: d >= switch))
    return F.transform(starts, lambda d: F.struct(d.alias("start"), F.date_sub(F.add_months(d, 3), 1).alias("end")))


def normalized_entropy(probabilities) -> Column:
    """Shannon entropy of the normalised probabilities over ln(max(n, 2)); p floored at 1e-12 inside the log."""
    p = c(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    raw = F.aggregate(p, F.lit(0.0), lambda a, x: a - x / total * F.ln(F.greatest(x / total, F.lit(1e-12))))
    return F.when(total > 0, raw / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double")))


def matches_evidence(value, evidence, tolerance: float = 0.005) -> Column:
    return F.exists(c(evidence), lambda e: F.abs(c(value) - e) <= F.greatest(F.abs(e) * tolerance, F.lit(1e-9)))


# fixed values: names of exchanges before a ticker, and endings of a possessive
EXCHANGES = ("NYSE", "NASDAQ", "Nasdaq", "NasdaqGS", "NYSEARCA")
POSSESSIVES = ("'s", "’s", "s")
NOT_AFTER_LETTER, NOT_BEFORE_LETTER = "(?<![A-Za-z])", "(?![A-Za-z])"


def _any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def mask_text(text, aliases, ticker) -> Column:
    """A company's names and ticker made anonymous in a whole text: one pattern finds the names, one the ticker.

    A name may carry a possessive. A ticker counts after an exchange's name or a dollar sign, and on its own from three letters on.
    """
    literal = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    by_length = F.array_sort(c(aliases), lambda a, b: F.length(b) - F.length(a))
    names = F.concat(F.lit(NOT_AFTER_LETTER + "(?:"), F.array_join(F.transform(by_length, literal), "|"), F.lit(f"){_any_of(POSSESSIVES)}?{NOT_BEFORE_LETTER}"))
    symbol = literal(c(ticker))
    marked = F.concat(F.lit(rf"(?:\b{_any_of(EXCHANGES)}\s*:\s*|\$)"), symbol, F.lit(r"\b"))
    alone = F.concat(F.lit("|" + NOT_AFTER_LETTER), symbol, F.lit(NOT_BEFORE_LETTER))
    symbols = F.when(F.length(c(ticker)) >= 3, F.concat(marked, alone)).otherwise(marked)
    unnamed = F.when(F.size(c(aliases)) > 0, F.regexp_replace(c(text), names, F.lit("the company"))).otherwise(c(text))
    return F.regexp_replace(unnamed, symbols, F.lit("the company's ticker"))


NEWS_TIME = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?)?\s*(?:UTC|Z+)?([+-]\d{2})?:?(\d{2})?\s*$"


def parse_news_time(raw) -> Column:
    """A date with or without time, seconds and offset (UTC where none is given); NULL for anything else."""
    part = lambda i, missing: F.coalesce(F.nullif(F.regexp_extract(c(raw), NEWS_TIME, i), F.lit("")), F.lit(missing))
    whole = F.concat(part(1, ""), F.lit(" "), part(2, "00:00"), part(3, ":00"), part(4, "+00"), F.lit(":"), part(5, "00"))
    return F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def event_day(ts, close_hour: int = 20) -> Column:
    """Day a text counts for: from the close on, with a time of day, the next day."""
    t = c(ts)
    timed = (F.hour(t) + F.minute(t) + F.second(t)) > 0
    return F.when(timed & (F.hour(t) >= close_hour), F.date_add(F.to_date(t), 1)).otherwise(F.to_date(t))


def overlapping(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """Ranges (grp, start, end) that overlap a protected window named after their group, half-open."""
    w = windows.select(F.col("window_name"), F.col("window_start"), F.col("window_end"))
    return ranges.join(w, (F.col("start") < F.col("window_end")) & (F.col("end") > F.col("window_start")) & (F.col("grp") == F.col("window_name")))


def guard_locked(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of ``ranges`` unchanged; any overlap with a protected window raises when evaluated."""
    hit = overlapping(ranges, windows).select("grp").distinct().withColumn("_hit", F.lit(True))
    j = ranges.join(hit, "grp", "left")
    ok = F.assert_true(F.col("_hit").isNull(), F.lit("the range overlaps a locked window"))
    return j.filter(ok.isNull()).drop("_hit")


def fresh(observed, as_of, days: int) -> Column:
    return F.datediff(c(as_of), c(observed)) <= days


def record_key(*parts) -> Column:
    """Parts joined by a colon; timestamps as dates."""
    return F.concat_ws(":", *[c(p) for p in parts])

