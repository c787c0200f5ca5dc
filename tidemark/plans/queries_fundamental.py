"""Company-fact factors on the quarterly grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fundamental_factors as ff
from tidemark.operators.panel import padded
from tidemark.plans.domain import QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, panel_sql
from tidemark.plans.registry import query

COLS = "security_id:s, as_of:t, score:f"

VIEWS["fact_records"] = """SELECT *, row_number() OVER (PARTITION BY security_id, concept, as_of, fiscal_period = 'FY' ORDER BY period_end DESC) AS age FROM (
 SELECT g.as_of, f.*, row_number() OVER (PARTITION BY security_id, concept, period_end, fiscal_period = 'FY', as_of ORDER BY available_time DESC, record_id DESC) AS rv
 FROM grid_q g JOIN fundamentals f ON f.available_time <= g.as_of) WHERE rv = 1"""
VIEWS["fy"] = "SELECT security_id, as_of, " + ", ".join(
    f"max(CASE WHEN concept = '{name}' AND age = {age} THEN value END) AS {short}{'0' if age == 2 else ''}"
    for name, short in (
        (ff.REV, "rev"), (ff.COGS, "cogs"), (ff.NI, "ni"), (ff.ASSETS, "assets"), (ff.LIAB, "liab"), (ff.EQUITY, "equity"),
        (ff.SHARES, "shares"), (ff.CUR_ASSETS, "ca"), (ff.CUR_LIAB, "cl"), (ff.CFO, "cfo"), (ff.LTD, "ltd"), (ff.DIVIDENDS, "divs"),
        (ff.BUYBACKS, "buy"), (ff.ISSUANCE, "iss"), (ff.RETAINED, "ret_e"), (ff.EBIT, "ebit"), (ff.RND, "rnd"), (ff.CASH, "cash"), (ff.SGA, "sga"),
    )
    for age in (1, 2)
) + " FROM fact_records WHERE fiscal_period = 'FY' AND age <= 2 GROUP BY 1, 2"
VIEWS["last_price"] = f"SELECT security_id, as_of, close AS price FROM {panel_sql('bar_revisions', 'grid_q', 10, 1)}"
VIEWS["fyp"] = "SELECT fy.*, price, price * shares AS cap FROM fy LEFT JOIN last_price USING (security_id, as_of)"

# one SQL expression per factor over the view fyp
_SQL = {
    "roe": "ni / equity",
    "roa": "ni / assets",
    "net_margin": "ni / rev",
    "gross_profitability": "(rev - cogs) / assets",
    "leverage": "-liab / equity",
    "asset_growth": "-(assets / assets0 - 1)",
    "piotroski_f": """CAST(ni / assets > 0 AS INT) + CAST(cfo > 0 AS INT) + CAST(ni / assets > ni0 / assets0 AS INT) + CAST(cfo > ni AS INT)
 + CAST(ltd / assets < ltd0 / assets0 AS INT) + CAST(ca / cl > ca0 / cl0 AS INT) + CAST(shares <= shares0 AS INT)
 + CAST((rev - cogs) / rev > (rev0 - cogs0) / rev0 AS INT) + CAST(rev / assets > rev0 / assets0 AS INT)""",
    "shareholder_yield": "(divs + buy - iss) / cap",
    "sloan_accruals": "-((ni - cfo) / ((assets + assets0) / 2))",
    "ohlson_o": """-(-1.32::DOUBLE - 0.407::DOUBLE * ln(assets) + 6.03::DOUBLE * liab / assets - 1.43::DOUBLE * (ca - cl) / assets + 0.0757::DOUBLE * cl / ca
 - 1.72::DOUBLE * CAST(liab > assets AS INT) - 2.37::DOUBLE * ni / assets - 1.83::DOUBLE * cfo / liab
 + 0.285::DOUBLE * CAST(ni < 0 AND ni0 < 0 AS INT) - 0.521::DOUBLE * (ni - ni0) / (abs(ni) + abs(ni0)))""",
    "dividend_growth": "CASE WHEN divs0 > 0 THEN divs / divs0 - 1 END",
    "earnings_yield": "ni / cap",
    "book_to_market": "equity / cap",
    "sales_yield": "rev / cap",
    "cashflow_yield": "cfo / cap",
    "size": "-cap",
    "altman_z": "1.2::DOUBLE * (ca - cl) / assets + 1.4::DOUBLE * ret_e / assets + 3.3::DOUBLE * ebit / assets + 0.6::DOUBLE * cap / liab + rev / assets",
    "rd_expenditure": "coalesce(rnd, 0) / cap",
    "net_operating_assets": "-(equity - cash + coalesce(ltd, 0)) / assets",
    "operating_leverage": "(cogs + sga) / assets",
    "cash_holdings": "cash / assets",
}
_KEYS = {
    "roe": "07_roe", "roa": "08_roa", "net_margin": "09_net_margin", "gross_profitability": "10_gross_profitability", "leverage": "11_leverage",
    "asset_growth": "12_asset_growth", "piotroski_f": "13_piotroski_f", "shareholder_yield": "14_shareholder_yield",
    "sloan_accruals": "15_sloan_accruals", "ohlson_o": "16_ohlson_o", "dividend_growth": "17_dividend_growth",
    "earnings_yield": "18_earnings_yield", "book_to_market": "19_book_to_market", "sales_yield": "20_sales_yield",
    "cashflow_yield": "21_cashflow_yield", "size": "23_size", "altman_z": "24_altman_z", "rd_expenditure": "31_rd_expenditure",
    "net_operating_assets": "35_net_operating_assets", "operating_leverage": "36_operating_leverage", "cash_holdings": "38_cash_holdings",
}


def _fact(name: str):
    digits = "f2" if name == "size" else "f"

    @query(f"ffn_{_KEYS[name]}", f"security_id:s, as_of:t, score:{digits}", f"SELECT security_id, as_of, {_SQL[name]} AS score FROM fyp")
    def build(d: Domain):
        return ff.fact_scores(d.fundamentals, QUARTERS, [name], d.bar_revisions).withColumnRenamed(name, "score")


for _name in _KEYS:
    _fact(_name)


@query(
    "ffn_01_fy_records",
    "security_id:s, concept:s, as_of:t, period_end:t, record_id:s, value:f6, age:i",
    "SELECT * FROM fact_records WHERE fiscal_period = 'FY'",
)
def _fy_records(d: Domain):
    return ff.fiscal_records(d.fundamentals, QUARTERS)


@query(
    "ffn_02_quarterly_records",
    "security_id:s, as_of:t, period_end:t, record_id:s, value:f, age:i",
    f"SELECT * FROM fact_records WHERE fiscal_period <> 'FY' AND concept = '{ff.EPS}'",
)
def _q_records(d: Domain):
    return ff.fiscal_records(d.fundamentals, QUARTERS, [ff.EPS], quarterly=True)


@query("ffn_03_latest_fiscal_year_value", "security_id:s, as_of:t, value:f2", "SELECT security_id, as_of, assets AS value FROM fy")
def _latest(d: Domain):
    return ff.latest_fiscal_value(d.fundamentals, QUARTERS, ff.ASSETS)


@query(
    "ffn_04_fy_ratio",
    COLS,
    "SELECT security_id, as_of, CASE WHEN cl > 0 THEN ca / cl END AS score FROM fy",
)
def _fy_ratio(d: Domain):
    w = ff.fiscal_wide(d.fundamentals, QUARTERS, [ff.CUR_ASSETS, ff.CUR_LIAB])
    return w.select(*ff.KEY, ff.positive_ratio(ff.CUR_ASSETS, ff.CUR_LIAB).alias("score"))


@query(
    "ffn_05_fy_flow_or_zero",
    "security_id:s, as_of:t, value:f2",
    "SELECT b.security_id, g.as_of, coalesce(divs, 0) AS value FROM (SELECT DISTINCT security_id, as_of FROM last_price) b JOIN grid_q g USING (as_of) LEFT JOIN fy ON b.security_id = fy.security_id AND g.as_of = fy.as_of",
)
def _flow(d: Domain):
    priced = ff.latest_price(d.bar_revisions, QUARTERS).select(*ff.KEY)
    w = ff.fiscal_wide(d.fundamentals, QUARTERS, [ff.DIVIDENDS])
    return priced.join(w, list(ff.KEY), "left").select(*ff.KEY, ff.or_zero(ff.DIVIDENDS).alias("value"))


@query("ffn_06_latest_price", "security_id:s, as_of:t, price:f", "SELECT * FROM last_price")
def _price(d: Domain):
    return ff.latest_price(d.bar_revisions, QUARTERS)


@query(
    "ffn_22_share_turnover",
    "security_id:s, as_of:t, score:f9",
    f"""SELECT security_id, as_of, CASE WHEN n >= 20 THEN -(mv / shares) END AS score FROM fy JOIN (
 SELECT security_id, as_of, count(volume) AS n, avg(volume) AS mv FROM {panel_sql('bar_revisions', 'grid_q', padded(252), 253)} GROUP BY 1, 2) USING (security_id, as_of)
 WHERE shares > 0""",
)
def _turnover(d: Domain):
    return ff.share_turnover(d.fundamentals, d.bar_revisions, QUARTERS)


@query(
    "ffn_25_merton_distance",
    COLS,
    f"""SELECT security_id, as_of, CASE WHEN n >= 20 THEN (ln((cap + liab) / liab) + gain - 0.5::DOUBLE * av * av) / av END AS score FROM (
 SELECT *, cap / (cap + liab) * vol + liab / (cap + liab) * (0.05::DOUBLE + 0.25::DOUBLE * vol) AS av FROM fyp LEFT JOIN (
 SELECT security_id, as_of, count(ret) AS n, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol, arg_max(px, ts) / arg_min(px, ts) - 1 AS gain
 FROM {panel_sql('bar_revisions', 'grid_q', padded(252), 253)} GROUP BY 1, 2) USING (security_id, as_of))""",
)
def _merton(d: Domain):
    return ff.merton_distance(d.fundamentals, d.bar_revisions, QUARTERS)


def _composite_sql(source: str, legs: dict[str, str]) -> str:
    ranks = " + ".join(
        f"rank() OVER (PARTITION BY as_of ORDER BY {x}) + (count(*) OVER (PARTITION BY as_of, {x}) - 1) / 2.0::DOUBLE" for x in legs
    )
    cols = ", ".join(f"{sql} AS {x}" for x, sql in legs.items())
    full = " AND ".join(f"{x} IS NOT NULL" for x in legs)
    return f"""SELECT security_id, as_of, score FROM (SELECT security_id, as_of, ({ranks}) / {len(legs)} AS score, count(*) OVER (PARTITION BY as_of) AS names
 FROM (SELECT security_id, as_of, {cols} FROM {source}) WHERE {full}) WHERE names >= 2"""


_QUALITY = _composite_sql("fyp", {x: _SQL[x] for x in ff.QUALITY_LEGS})


@query("ffn_26_quality_minus_junk", COLS, _QUALITY)
def _qmj(d: Domain):
    return ff.quality_minus_junk(d.fundamentals, QUARTERS)


@query("ffn_27_value_composite", COLS, _composite_sql("fyp", {x: _SQL[x] for x in ff.VALUE_LEGS}))
def _value(d: Domain):
    return ff.value_composite(d.fundamentals, d.bar_revisions, QUARTERS)


_STR = f"SELECT security_id, as_of, CASE WHEN count(*) >= 2 THEN -(arg_max(px, ts) / arg_min(px, ts) - 1) END AS str_x FROM {panel_sql('bar_revisions', 'grid_q', padded(21), 22)} GROUP BY 1, 2"
_ILL = f"""SELECT security_id, as_of, CASE WHEN count(CASE WHEN close * volume > 0 THEN ret END) >= 20 THEN avg(CASE WHEN close * volume > 0 THEN abs(ret) / (close * volume) END) END AS ill_x
 FROM {panel_sql('bar_revisions', 'grid_q', padded(252), 253)} GROUP BY 1, 2"""


@query(
    "ffn_28_combined_factor",
    COLS,
    _composite_sql(
        f"(SELECT * FROM fyp JOIN ({_QUALITY}) USING (security_id, as_of) JOIN ({_STR}) USING (security_id, as_of) JOIN ({_ILL}) USING (security_id, as_of))",
        {"l1": "str_x", "l2": "ill_x", **{x: _SQL[x] for x in ff.COMBINED_FACT_LEGS}, "quality": "score"},
    ),
)
def _combined(d: Domain):
    return ff.combined_factor(d.fundamentals, d.bar_revisions, QUARTERS)


@query(
    "ffn_29_sue",
    COLS,
    f"""SELECT security_id, as_of, CASE WHEN max(n) >= 12 THEN max(CASE WHEN age = 1 THEN d END) / stddev_samp(CASE WHEN age <= 8 THEN d END) END AS score FROM (
 SELECT *, value - lag(value, 4) OVER (PARTITION BY security_id, as_of ORDER BY period_end) AS d, count(*) OVER (PARTITION BY security_id, as_of) AS n
 FROM fact_records WHERE fiscal_period <> 'FY' AND concept = '{ff.EPS}') GROUP BY 1, 2""",
)
def _sue(d: Domain):
    return ff.standardized_surprise(d.fundamentals, QUARTERS)


# insider rows are dated 2024, so their moments are later than the price grid
VIEWS["grid_i"] = "SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-10', INTERVAL 5 DAY)) AS as_of"


def insider_grid():
    from datetime import datetime, timedelta

    return [datetime(2024, 1, 5) + timedelta(days=5 * k) for k in range(8)]


@query(
    "ffn_30_insider_buying",
    COLS,
    """SELECT security_id, as_of, (b - s) / nullif(b + s, 0) AS score FROM (SELECT security_id, as_of,
 sum(CASE WHEN transaction_code = 'P' AND NOT is_10b5_1_plan THEN shares ELSE 0 END) AS b,
 sum(CASE WHEN transaction_code = 'S' AND NOT is_10b5_1_plan THEN shares ELSE 0 END) AS s
 FROM grid_i JOIN insider ON available_time <= as_of AND transaction_date >= as_of - INTERVAL 6 MONTH AND transaction_date <= as_of GROUP BY 1, 2)""",
)
def _insider(d: Domain):
    return ff.insider_buying(d.insider, insider_grid())


@query(
    "ffn_32_short_interest",
    COLS,
    """SELECT security_id, as_of, -arg_max(coalesce(days_to_cover, -1), settlement_date) AS raw, CASE WHEN raw <> 1 THEN raw END AS score
 FROM grid_q JOIN short_interest ON available_time <= as_of GROUP BY 1, 2""",
)
def _short(d: Domain):
    return ff.short_interest_score(d.short_interest, QUARTERS)


VIEWS["split_rows"] = """SELECT security_id, coalesce(effective_time, event_time) AS effective, available_time AS known,
 CASE WHEN contains(ratio_text, ':') THEN CAST(split_part(ratio_text, ':', 1) AS DOUBLE) / CAST(split_part(ratio_text, ':', 2) AS DOUBLE) ELSE CAST(ratio_text AS DOUBLE) END AS split_ratio
 FROM actions WHERE action_type <> 'CASH_DIVIDEND'"""


@query(
    "ffn_33_net_stock_issuance",
    COLS,
    f"""SELECT t.security_id, t.as_of, -ln(max(now_v) / (max(then_v) * coalesce(exp(sum(ln(split_ratio))), 1))) AS score FROM (
 SELECT security_id, as_of, max(CASE WHEN age = 1 THEN value END) AS now_v, max(CASE WHEN age = 2 THEN value END) AS then_v,
 max(CASE WHEN age = 1 THEN period_end END) AS now_end, max(CASE WHEN age = 2 THEN period_end END) AS then_end
 FROM fact_records WHERE fiscal_period = 'FY' AND concept = '{ff.SHARES}' GROUP BY 1, 2) t
 LEFT JOIN split_rows r ON r.security_id = t.security_id AND effective > then_end AND effective <= now_end GROUP BY 1, 2""",
)
def _issuance(d: Domain):
    return ff.net_stock_issuance(d.fundamentals, d.actions, QUARTERS)


_COMMON = """SELECT *, row_number() OVER (PARTITION BY security_id, as_of ORDER BY period_end DESC) AS k FROM (
 SELECT a.security_id, a.as_of, a.period_end, a.value / b.value AS r FROM fact_records a JOIN fact_records b USING (security_id, as_of, period_end)
 WHERE a.fiscal_period = 'FY' AND b.fiscal_period = 'FY' AND a.concept = '{}' AND b.concept = '{}' AND b.value > 0)"""


@query(
    "ffn_34_asset_turnover_change",
    COLS,
    f"SELECT security_id, as_of, max(CASE WHEN k = 1 THEN r END) - max(CASE WHEN k = 2 THEN r END) AS score FROM ({_COMMON.format(ff.REV, ff.ASSETS)}) GROUP BY 1, 2",
)
def _turnover_change(d: Domain):
    return ff.asset_turnover_change(d.fundamentals, QUARTERS)


@query(
    "ffn_37_abnormal_investment",
    COLS,
    f"""SELECT security_id, as_of, CASE WHEN count(*) = 4 THEN -(max(CASE WHEN k = 1 THEN r END) / nullif(avg(CASE WHEN k > 1 THEN r END), 0) - 1) END AS score
 FROM ({_COMMON.format(ff.CAPEX, ff.REV)}) WHERE k <= 4 GROUP BY 1, 2""",
)
def _abnormal(d: Domain):
    return ff.abnormal_investment(d.fundamentals, QUARTERS)


@query(
    "ffn_39_ownership_change",
    COLS,
    """SELECT security_id, as_of, ln(max(CASE WHEN k = 1 THEN shares END) / max(CASE WHEN k = 2 THEN shares END)) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY security_id, as_of ORDER BY quarter_end DESC) AS k FROM grid_q JOIN holdings ON available_time <= as_of) GROUP BY 1, 2""",
)
def _ownership(d: Domain):
    return ff.ownership_change(d.holdings, QUARTERS)


VIEWS["tracked_filers"] = """SELECT CAST(o_custkey % 10 AS VARCHAR) AS filer_cik, min(o_orderdate) AS tracked_from,
 CASE WHEN o_custkey % 10 < 3 THEN max(o_orderdate) - INTERVAL 900 DAY END AS tracked_to FROM orders GROUP BY o_custkey % 10"""


def tracked_filers(d: Domain):
    """Tracking interval per filer, derived from its order dates; three filers stop early."""
    cik = F.col("o_custkey") % 10
    g = d.table("orders").groupBy(cik.alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return g.select(
        F.col("k").cast("string").alias("filer_cik"),
        F.col("a").alias("tracked_from"),
        F.when(F.col("k") < 3, F.col("b") - F.make_dt_interval(F.lit(900))).alias("tracked_to"),
    )


@query(
    "ffn_40_tracked_consensus",
    COLS,
    """SELECT security_id, as_of, count(*) FILTER (WHERE shares > 0) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY security_id, filer_cik, as_of ORDER BY quarter_end DESC) AS k FROM grid_q JOIN filer_holdings ON available_time <= as_of)
 JOIN tracked_filers USING (filer_cik) WHERE k = 1 AND as_of >= tracked_from AND (tracked_to IS NULL OR as_of <= tracked_to) GROUP BY 1, 2""",
)
def _consensus(d: Domain):
    return ff.tracked_consensus(d.filer_holdings, tracked_filers(d), QUARTERS)
