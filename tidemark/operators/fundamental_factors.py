"""Company-fact factors: yearly facts as known at each moment, one column per concept, then plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import average_rank, change, positive_ratio, ratio
from tidemark.operators.asof import bars_on_grid, facts_on_grid, history_on_grid
from tidemark.operators.price_factors import score_factors

KEY = ("security_id", "as_of")

REV = "Revenues"
COGS = "CostOfGoodsAndServicesSold"
NI = "NetIncomeLoss"
ASSETS = "Assets"
LIAB = "Liabilities"
EQUITY = "StockholdersEquity"
SHARES = "CommonStockSharesOutstanding"
CUR_ASSETS = "AssetsCurrent"
CUR_LIAB = "LiabilitiesCurrent"
CFO = "NetCashProvidedByUsedInOperatingActivities"
LTD = "LongTermDebtNoncurrent"
DIVIDENDS = "PaymentsOfDividends"
BUYBACKS = "PaymentsForRepurchaseOfCommonStock"
ISSUANCE = "ProceedsFromIssuanceOfCommonStock"
RETAINED = "RetainedEarningsAccumulatedDeficit"
EBIT = "OperatingIncomeLoss"
RND = "ResearchAndDevelopmentExpense"
CASH = "CashAndCashEquivalentsAtCarryingValue"
SGA = "SellingGeneralAndAdministrativeExpense"
CAPEX = "PaymentsToAcquirePropertyPlantAndEquipment"
EPS = "EarningsPerShareDiluted"


def fiscal_records(facts: DataFrame, grid: Sequence[datetime], concepts: Sequence[str] | None = None, quarterly: bool = False) -> DataFrame:
    """Newest known filing per period end, with ``age`` 1 for the newest period of each concept."""
    periods = ("Q1", "Q2", "Q3", "Q4") if quarterly else ("FY",)
    rows = facts.filter(F.col("fiscal_period").isin(*periods))
    if concepts is not None:
        rows = rows.filter(F.col("concept").isin(*concepts))
    rows = rows.select("security_id", "concept", "period_end", "available_time", "record_id", "value")
    known = facts_on_grid(rows, grid, ["security_id", "concept", "period_end"], ["available_time", "record_id"])
    newest = Window.partitionBy("security_id", "concept", "as_of").orderBy(F.desc("period_end"))
    return known.withColumn("age", F.row_number().over(newest))


def fiscal_wide(facts: DataFrame, grid: Sequence[datetime], concepts: Sequence[str], prior: Sequence[str] = ()) -> DataFrame:
    """One row per (security, moment): a column per concept, ``<concept>_prior`` for the year before it."""
    records = fiscal_records(facts, grid, sorted({*concepts, *prior})).filter(F.col("age") <= 2)
    value, concept, age = F.col("value"), F.col("concept"), F.col("age")
    columns = [F.max(F.when((concept == x) & (age == 1), value)).alias(x) for x in sorted({*concepts, *prior})]
    columns += [F.max(F.when((concept == x) & (age == 2), value)).alias(f"{x}_prior") for x in sorted(set(prior))]
    return records.groupBy(*KEY).agg(*columns)


def latest_fiscal_value(facts: DataFrame, grid: Sequence[datetime], concept: str) -> DataFrame:
    return fiscal_wide(facts, grid, [concept]).withColumnRenamed(concept, "value")


def latest_price(revisions: DataFrame, grid: Sequence[datetime], days: int = 10) -> DataFrame:
    """Last raw close of the final days before the moment; only positive prices count."""
    seen = bars_on_grid(revisions, grid, days)
    last = seen.groupBy(*KEY).agg(F.max_by("close", "ts").alias("price"))
    return last.filter(F.col("price") > 0)


# ---- factors on yearly facts -------------------------------------------------------------------


@dataclass(frozen=True)
class FactFactor:
    concepts: tuple[str, ...]
    prior: tuple[str, ...]
    priced: bool
    score: Callable[[], Column]


FACTORS: dict[str, FactFactor] = {}


def fact_factor(name: str, concepts: Sequence[str], prior: Sequence[str] = (), priced: bool = False):
    def add(score):
        needed = (*concepts, SHARES) if priced else tuple(concepts)
        FACTORS[name] = FactFactor(needed, tuple(prior), priced, score)
        return score

    return add


def v(concept: str) -> Column:
    return F.col(concept)


def before(concept: str) -> Column:
    return F.col(f"{concept}_prior")


def or_zero(concept: str) -> Column:
    """A flow that counts as 0 when it was never filed."""
    return F.coalesce(F.col(concept), F.lit(0.0))


def market_cap() -> Column:
    cap = F.col("price") * F.when(v(SHARES) > 0, v(SHARES))
    return F.when(cap > 0, cap)


def fact_scores(facts: DataFrame, grid: Sequence[datetime], names: Sequence[str], revisions: DataFrame | None = None) -> DataFrame:
    """``(security_id, as_of, <name>...)`` from one pivot of the facts."""
    chosen = {n: FACTORS[n] for n in names}
    concepts = {c for f in chosen.values() for c in f.concepts}
    prior = {c for f in chosen.values() for c in f.prior}
    wide = fiscal_wide(facts, grid, sorted(concepts), sorted(prior))
    if any(f.priced for f in chosen.values()):
        wide = wide.join(latest_price(revisions, grid), list(KEY), "left")
    return wide.select(*KEY, *[f.score().alias(n) for n, f in chosen.items()])


@fact_factor("roe", [NI, EQUITY])
def _roe():
    return positive_ratio(NI, EQUITY)


@fact_factor("roa", [NI, ASSETS])
def _roa():
    return positive_ratio(NI, ASSETS)


@fact_factor("net_margin", [NI, REV])
def _net_margin():
    return positive_ratio(NI, REV)


@fact_factor("gross_profitability", [REV, COGS, ASSETS])
def _gross():
    return positive_ratio(v(REV) - v(COGS), ASSETS)


@fact_factor("leverage", [LIAB, EQUITY])
def _leverage():
    return -positive_ratio(LIAB, EQUITY)


@fact_factor("asset_growth", [], [ASSETS])
def _asset_growth():
    return F.when(before(ASSETS) > 0, -change(v(ASSETS), before(ASSETS)))


@fact_factor("piotroski_f", [CFO], [NI, ASSETS, LTD, CUR_ASSETS, CUR_LIAB, SHARES, REV, COGS])
def _piotroski():
    def both(top, bottom):
        return ratio(v(top), v(bottom)), ratio(before(top), before(bottom))

    roa, roa0 = both(NI, ASSETS)
    debt, debt0 = both(LTD, ASSETS)
    liquid, liquid0 = both(CUR_ASSETS, CUR_LIAB)
    margin, margin0 = ratio(v(REV) - v(COGS), REV), ratio(before(REV) - before(COGS), before(REV))
    turn, turn0 = both(REV, ASSETS)
    tests = [
        roa > 0,
        v(CFO) > 0,
        roa > roa0,
        v(CFO) > v(NI),
        debt < debt0,
        liquid > liquid0,
        v(SHARES) <= before(SHARES),
        margin > margin0,
        turn > turn0,
    ]
    sound = F.lit(True)
    for x in (ASSETS, CUR_LIAB, REV):
        sound = sound & (v(x) > 0) & (before(x) > 0)
    total = sum((t.cast("double") for t in tests), F.lit(0.0))
    return F.when(sound, total)


@fact_factor("shareholder_yield", [DIVIDENDS, BUYBACKS, ISSUANCE], priced=True)
def _shareholder_yield():
    return ratio(or_zero(DIVIDENDS) + or_zero(BUYBACKS) - or_zero(ISSUANCE), market_cap())


@fact_factor("sloan_accruals", [NI, CFO], [ASSETS])
def _accruals():
    return -positive_ratio(v(NI) - v(CFO), (before(ASSETS) + v(ASSETS)) / 2.0)


@fact_factor("ohlson_o", [LIAB, CUR_ASSETS, CUR_LIAB, CFO, ASSETS], [NI])
def _ohlson():
    swing = F.abs(v(NI)) + F.abs(before(NI))
    o = (
        F.lit(-1.32)
        - 0.407 * F.ln(F.when(v(ASSETS) > 0, v(ASSETS)))
        + 6.03 * ratio(LIAB, ASSETS)
        - 1.43 * ratio(v(CUR_ASSETS) - v(CUR_LIAB), ASSETS)
        + 0.0757 * ratio(CUR_LIAB, CUR_ASSETS)
        - 1.72 * (v(LIAB) > v(ASSETS)).cast("double")
        - 2.37 * ratio(NI, ASSETS)
        - 1.83 * ratio(CFO, LIAB)
        + 0.285 * ((v(NI) < 0) & (before(NI) < 0)).cast("double")
        - 0.521 * ratio(v(NI) - before(NI), swing)
    )
    return -o


@fact_factor("dividend_growth", [], [DIVIDENDS])
def _dividend_growth():
    return F.when(before(DIVIDENDS) > 0, change(v(DIVIDENDS), before(DIVIDENDS)))


@fact_factor("earnings_yield", [NI], priced=True)
def _earnings_yield():
    return ratio(NI, market_cap())


@fact_factor("book_to_market", [EQUITY], priced=True)
def _book():
    return ratio(EQUITY, market_cap())


@fact_factor("sales_yield", [REV], priced=True)
def _sales():
    return F.when(v(REV) > 0, ratio(REV, market_cap()))


@fact_factor("cashflow_yield", [CFO], priced=True)
def _cash_yield():
    return ratio(CFO, market_cap())


@fact_factor("size", [], priced=True)
def _size():
    return -market_cap()


@fact_factor("altman_z", [ASSETS, CUR_ASSETS, CUR_LIAB, RETAINED, EBIT, LIAB, REV], priced=True)
def _altman():
    z = (
        1.2 * positive_ratio(v(CUR_ASSETS) - v(CUR_LIAB), ASSETS)
        + 1.4 * positive_ratio(RETAINED, ASSETS)
        + 3.3 * positive_ratio(EBIT, ASSETS)
        + 0.6 * positive_ratio(market_cap(), LIAB)
        + 1.0 * positive_ratio(REV, ASSETS)
    )
    return z


@fact_factor("rd_expenditure", [RND], priced=True)
def _rnd():
    return ratio(or_zero(RND), market_cap())


@fact_factor("net_operating_assets", [EQUITY, CASH, ASSETS, LTD])
def _noa():
    return -positive_ratio(v(EQUITY) - v(CASH) + or_zero(LTD), ASSETS)


@fact_factor("operating_leverage", [COGS, SGA, ASSETS])
def _operating_leverage():
    return positive_ratio(v(COGS) + v(SGA), ASSETS)


@fact_factor("cash_holdings", [CASH, ASSETS])
def _cash_holdings():
    return positive_ratio(CASH, ASSETS)


# ---- factors that need more than the pivot -------------------------------------------------------


def share_turnover(facts: DataFrame, revisions: DataFrame, grid: Sequence[datetime], lookback: int = 252) -> DataFrame:
    """Negative mean of volume over shares outstanding, at least 20 bars."""
    from tidemark.operators.panel import bar_panel, padded

    shares = latest_fiscal_value(facts, grid, SHARES).filter(F.col("value") > 0)
    good = F.when(F.col("volume") >= 0, F.col("volume"))
    volume = bar_panel(revisions, grid, padded(lookback), lookback + 1).groupBy(*KEY).agg(
        F.count(good).alias("n"), F.avg(good).alias("mean_volume")
    )
    return shares.join(volume, list(KEY)).select(*KEY, F.when(F.col("n") >= 20, -ratio("mean_volume", "value")).alias("score"))


def merton_distance(facts: DataFrame, revisions: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    """Naive distance to default from equity volatility, debt and the trailing return."""
    from tidemark.functions.numeric import volatility
    from tidemark.operators.panel import bar_panel, padded

    bars = bar_panel(revisions, grid, padded(252), 253).groupBy(*KEY).agg(
        F.count("ret").alias("n"), volatility("ret").alias("vol"), change(F.max_by("px", "ts"), F.min_by("px", "ts")).alias("gain")
    )
    wide = fiscal_wide(facts, grid, [LIAB, SHARES]).join(latest_price(revisions, grid), list(KEY), "left").join(bars, list(KEY), "left")
    debt, equity, vol = F.when(v(LIAB) > 0, v(LIAB)), market_cap(), F.col("vol")
    total = equity + debt
    asset_vol = ratio(equity, total) * vol + ratio(debt, total) * (F.lit(0.05) + 0.25 * vol)
    top = F.ln(total / debt) + (F.col("gain") - 0.5 * asset_vol * asset_vol)
    ok = (F.col("n") >= 20) & (vol > 0) & (asset_vol > 0)
    return wide.select(*KEY, F.when(ok, ratio(top, asset_vol)).alias("score"))


def composite(scores: DataFrame, legs: Sequence[str]) -> DataFrame:
    """Mean of the average ranks of the legs over names that have all of them; two names at least."""
    full = scores.dropna(subset=list(legs))
    ranked = full.select(*KEY, *[average_rank(x, "as_of").alias(x) for x in legs], F.count(F.lit(1)).over(Window.partitionBy("as_of")).alias("n"))
    total = sum((F.col(x) for x in legs), F.lit(0.0))
    return ranked.filter(F.col("n") >= 2).select(*KEY, (total / len(legs)).alias("score"))


QUALITY_LEGS = ("roe", "leverage", "sloan_accruals")
VALUE_LEGS = ("earnings_yield", "book_to_market", "sales_yield", "cashflow_yield", "shareholder_yield")
COMBINED_FACT_LEGS = ("piotroski_f", "dividend_growth", "sloan_accruals", "size", "altman_z", "shareholder_yield")


def quality_minus_junk(facts, grid) -> DataFrame:
    return composite(fact_scores(facts, grid, QUALITY_LEGS), QUALITY_LEGS)


def value_composite(facts, revisions, grid) -> DataFrame:
    return composite(fact_scores(facts, grid, VALUE_LEGS, revisions), VALUE_LEGS)


def masked_composite(legs: Sequence[str]) -> Column:
    """The composite as a window expression: names that lack a leg are ranked apart from the others and get NULL."""
    full = F.lit(True)
    for x in legs:
        full = full & F.col(x).isNotNull()
    total = sum((average_rank(x, "as_of", full) for x in legs), F.lit(0.0))
    n = F.count(F.lit(1)).over(Window.partitionBy("as_of", full))
    return F.when(full & (n >= 2), total / len(legs))


def combined_factor(facts, revisions, grid) -> DataFrame:
    """Nine legs: two price factors, six fact factors and the quality composite.

    Quality is ranked over all names with facts, with or without prices. Both rankings are windows over one cross-section,
    so the fact side is planned once and dealt out by moment once.
    """
    wanted = sorted({*COMBINED_FACT_LEGS, *QUALITY_LEGS})
    price_side = score_factors(revisions, grid, ["short_term_reversal", "illiquidity"])
    both = fact_scores(facts, grid, wanted, revisions).join(price_side, list(KEY), "left").repartition("as_of")
    legs = ["short_term_reversal", "illiquidity", *COMBINED_FACT_LEGS, "quality"]
    return composite(both.withColumn("quality", masked_composite(QUALITY_LEGS)), legs)


def standardized_surprise(facts, grid) -> DataFrame:
    """Latest year-over-year EPS change over the deviation of the last eight; twelve quarters needed."""
    q = fiscal_records(facts, grid, [EPS], quarterly=True)
    w = Window.partitionBy(*KEY).orderBy("period_end")
    diff = q.withColumn("d", F.col("value") - F.lag("value", 4).over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    last8 = F.when(F.col("age") <= 8, F.col("d"))
    newest = F.max(F.when(F.col("age") == 1, F.col("d")))
    ok = (F.max("n") >= 12) & (F.stddev_samp(last8) > 0)
    return diff.groupBy(*KEY).agg(F.when(ok, ratio(newest, F.stddev_samp(last8))).alias("score"))


def insider_buying(insider: DataFrame, grid, months: int = 6) -> DataFrame:
    """(bought - sold) / (bought + sold) shares, plan trades left out."""
    # month ends clamp, hence a few days more than the months; the filter is exact
    seen = history_on_grid(insider, grid, until=F.add_months("transaction_date", months).cast("timestamp") + F.expr("INTERVAL '5' DAY"))
    recent = seen.filter((F.col("transaction_date") >= F.add_months("as_of", -months)) & (F.col("transaction_date") <= F.col("as_of")))
    own = ~F.col("is_10b5_1_plan")
    buy = F.sum(F.when(own & (F.col("transaction_code") == "P"), F.col("shares")).otherwise(0.0))
    sell = F.sum(F.when(own & (F.col("transaction_code") == "S"), F.col("shares")).otherwise(0.0))
    return recent.groupBy(*KEY).agg(ratio(buy - sell, buy + sell).alias("score"))


def short_interest_score(short_interest: DataFrame, grid) -> DataFrame:
    latest = facts_on_grid(short_interest, grid, ["security_id"], ["settlement_date", "available_time"])
    return latest.select(*KEY, (-F.col("days_to_cover")).alias("score"))


def net_stock_issuance(facts, actions: DataFrame, grid) -> DataFrame:
    """-ln(shares / prior shares), the prior count brought to today's split basis."""
    two = fiscal_records(facts, grid, [SHARES]).filter(F.col("age") <= 2).groupBy(*KEY).agg(
        F.max(F.when(F.col("age") == 1, F.col("value"))).alias("now"),
        F.max(F.when(F.col("age") == 2, F.col("value"))).alias("then"),
        F.max(F.when(F.col("age") == 1, F.col("period_end"))).alias("now_end"),
        F.max(F.when(F.col("age") == 2, F.col("period_end"))).alias("then_end"),
    )
    from tidemark.operators.holdings import split_product

    factor = split_product(two.filter(F.col("then_end").isNotNull()), actions, "then_end", "now_end", [*KEY])
    both = two.join(factor, list(KEY), "left")
    ok = (F.col("now") > 0) & (F.col("then") > 0)
    adjusted = F.col("then") * F.coalesce("split_factor", F.lit(1.0))
    return both.select(*KEY, F.when(ok, -F.ln(F.col("now") / adjusted)).alias("score"))


def _common_periods(facts, grid, top: str, bottom: str) -> DataFrame:
    """Both concepts on the period ends they share, newest first by ``age``."""
    r = fiscal_records(facts, grid, [top, bottom])
    both = r.groupBy(*KEY, "period_end").agg(
        F.max(F.when(F.col("concept") == top, F.col("value"))).alias("top"),
        F.max(F.when(F.col("concept") == bottom, F.col("value"))).alias("bottom"),
    )
    return both.filter(F.col("top").isNotNull() & F.col("bottom").isNotNull())


def asset_turnover_change(facts, grid) -> DataFrame:
    pairs = _common_periods(facts, grid, REV, ASSETS).filter(F.col("bottom") > 0)
    age = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("period_end")))
    t = pairs.withColumn("turn", ratio("top", "bottom")).withColumn("age", age)
    one = F.max(F.when(F.col("age") == 1, F.col("turn")))
    two = F.max(F.when(F.col("age") == 2, F.col("turn")))
    return t.groupBy(*KEY).agg((one - two).alias("score"))


def abnormal_investment(facts, grid) -> DataFrame:
    """-(capex/sales over the mean of the three years before - 1); all four years need sales."""
    pairs = _common_periods(facts, grid, CAPEX, REV)
    age = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("period_end")))
    t = pairs.withColumn("age", age).filter(F.col("age") <= 4).withColumn("r", positive_ratio("top", "bottom"))
    now = F.max(F.when(F.col("age") == 1, F.col("r")))
    past = F.avg(F.when(F.col("age") > 1, F.col("r")))
    return t.groupBy(*KEY).agg(F.when(F.count("r") == 4, -change(now, past)).alias("score"))


def ownership_change(holdings: DataFrame, grid) -> DataFrame:
    """ln(shares / shares of the quarter before) as known."""
    known = facts_on_grid(holdings, grid, ["security_id", "quarter_end"], ["available_time"])
    age = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("quarter_end")))
    t = known.withColumn("age", age).filter(F.col("age") <= 2)
    now = F.max(F.when(F.col("age") == 1, F.col("shares")))
    then = F.max(F.when(F.col("age") == 2, F.col("shares")))
    return t.groupBy(*KEY).agg(F.when((now > 0) & (then > 0), F.ln(now / then)).alias("score"))


def tracked_consensus(filer_holdings: DataFrame, tracked: DataFrame, grid) -> DataFrame:
    """How many tracked filers (closed tracking interval around the moment) hold the name."""
    latest = facts_on_grid(filer_holdings, grid, ["security_id", "filer_cik"], ["quarter_end", "available_time"])
    t = tracked.select(F.col("filer_cik"), "tracked_from", "tracked_to")
    active = latest.join(t, "filer_cik").filter(
        (F.col("as_of") >= F.col("tracked_from")) & (F.col("tracked_to").isNull() | (F.col("as_of") <= F.col("tracked_to")))
    )
    return active.groupBy(*KEY).agg(F.count_if(F.col("shares") > 0).cast("double").alias("score"))
