"""The domain tables of ``domain.py`` written once more as SQL views for the cross-check."""

from __future__ import annotations

import re

from tidemark.functions import normal as nm
from tidemark.operators.panel import padded


def _revisions(source: str, security: str) -> str:
    return f"""
SELECT {security} AS security_id, l_shipdate AS ts,
 (100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax) - l_discount AS open,
 (100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax) + 1.0::DOUBLE AS high,
 (100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax) - 1.0::DOUBLE - l_discount AS low,
 100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax AS close,
 l_quantity AS volume,
 CASE WHEN l_tax = 0 THEN NULL WHEN l_tax = 0.08 AND l_discount = 0.1 THEN 0.0::DOUBLE
  ELSE (100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax) * (1.0::DOUBLE - 0.1::DOUBLE * l_tax) END AS adjusted_close,
 CASE WHEN l_tax <> 0 THEN ((100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax) + 1.0::DOUBLE) * (1.0::DOUBLE - 0.1::DOUBLE * l_tax) END AS adjusted_high,
 CASE WHEN l_tax <> 0 THEN ((100.0::DOUBLE + 200.0::DOUBLE * l_discount - 100.0::DOUBLE * l_tax) - 1.0::DOUBLE - l_discount) * (1.0::DOUBLE - 0.1::DOUBLE * l_tax) END AS adjusted_low,
 l_shipdate + INTERVAL 20 HOUR + greatest(l_linenumber - 3, 0) * INTERVAL 1 DAY AS available_time,
 l_shipdate + INTERVAL 20 HOUR + greatest(l_linenumber - 3, 0) * INTERVAL 1 DAY + l_linenumber * INTERVAL 1 HOUR AS ingestion_time,
 lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS data_version,
 'feed-' || l_returnflag AS source, l_orderkey * 8 + l_linenumber AS seq
FROM {source}"""


_NEWEST = "row_number() OVER (PARTITION BY security_id, ts ORDER BY ingestion_time DESC, data_version DESC, close DESC, volume DESC)"

_CONCEPTS = {
    "Revenues": "e",
    "CostOfGoodsAndServicesSold": "0.6::DOUBLE * e + ed",
    "NetIncomeLoss": "ed - 0.04::DOUBLE * e",
    "Assets": "2 * e",
    "Liabilities": "10 * et",
    "StockholdersEquity": "2 * e - 10 * et",
    "CommonStockSharesOutstanding": "q",
    "AssetsCurrent": "1.1::DOUBLE * ea + 0.4::DOUBLE * e",
    "LiabilitiesCurrent": "5 * et + 0.1::DOUBLE * e",
    "NetCashProvidedByUsedInOperatingActivities": "ed - 0.03::DOUBLE * e",
    "LongTermDebtNoncurrent": "0.5::DOUBLE * er",
    "PaymentsOfDividends": "0.02::DOUBLE * en",
    "PaymentsForRepurchaseOfCommonStock": "0.01::DOUBLE * ea",
    "ProceedsFromIssuanceOfCommonStock": "0.005::DOUBLE * er",
    "RetainedEarningsAccumulatedDeficit": "0.3::DOUBLE * ea",
    "OperatingIncomeLoss": "ed - 0.035::DOUBLE * e",
    "ResearchAndDevelopmentExpense": "0.04::DOUBLE * ea",
    "CashAndCashEquivalentsAtCarryingValue": "0.2::DOUBLE * en",
    "SellingGeneralAndAdministrativeExpense": "0.15::DOUBLE * er",
    "PaymentsToAcquirePropertyPlantAndEquipment": "0.1::DOUBLE * en",
    "EarningsPerShareDiluted": "(ed - 0.04::DOUBLE * e) / q",
}


def _fact_sums(period: str, early: bool, fiscal: str, lag: int) -> str:
    return f"""
SELECT security_id, {period} AS period_end, {fiscal} AS fiscal_period,
 {period} + INTERVAL {lag} DAY AS available_time, {1 if early else 2} AS filing_no,
 round(sum(l_extendedprice), 2) AS e, round(sum(l_quantity), 0) AS q,
 round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END), 2) AS ea,
 round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END), 2) AS en,
 round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS er,
 round(sum(l_extendedprice * l_discount), 4) AS ed, round(sum(l_extendedprice * l_tax), 4) AS et
FROM line_brand {"WHERE l_linenumber <= 3" if early else ""} GROUP BY 1, 2, 3, 4"""


_YEAR_END = "make_timestamp(CAST(year(l_shipdate) AS BIGINT), 12, 31, 0, 0, 0.0)"
_QUARTER_END = "CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS TIMESTAMP)"
_QNAME = "'Q' || CAST(quarter(l_shipdate) AS VARCHAR)"

VIEWS: dict[str, str] = {
    "grid_q": "SELECT unnest(generate_series(TIMESTAMP '1996-03-15', TIMESTAMP '2001-09-30', INTERVAL 3 MONTH)) AS as_of",
    "grid_m": "SELECT unnest(generate_series(TIMESTAMP '1996-03-15', TIMESTAMP '2001-09-30', INTERVAL 1 MONTH)) AS as_of",
    "line_brand": "SELECT l.*, p_brand AS security_id FROM lineitem l JOIN part ON l_partkey = p_partkey",
    "line_region": """SELECT l.*, r_name AS security_id FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bar_revisions": _revisions("line_brand", "security_id"),
    "region_revisions": _revisions("line_region", "security_id"),
    "bars": f"SELECT * EXCLUDE (rv) FROM (SELECT *, {_NEWEST} AS rv FROM bar_revisions) WHERE rv = 1",
    "bars_region": f"SELECT * EXCLUDE (rv) FROM (SELECT *, {_NEWEST} AS rv FROM region_revisions) WHERE rv = 1",
    "benchmark_levels": "SELECT ts, round(avg(close), 8) AS level FROM bars GROUP BY ts",
    "benchmark_bars": """SELECT 'BENCH' AS security_id, ts, level AS open, level AS high, level AS low, level AS close,
 0.0::DOUBLE AS volume, NULL::DOUBLE AS adjusted_close, NULL::DOUBLE AS adjusted_high, NULL::DOUBLE AS adjusted_low,
 ts + INTERVAL 20 HOUR AS available_time, ts + INTERVAL 20 HOUR AS ingestion_time, '1' AS data_version, 'calc' AS source
 FROM benchmark_levels""",
    "sector": "SELECT DISTINCT p_brand AS security_id, 'S' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 5 AS VARCHAR) AS sector FROM part",
    "flags": """SELECT security_id, ts, 'ohlc_consistency' AS check_name,
 CASE WHEN volume > 25 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM bars WHERE close > 118.0::DOUBLE""",
    "fact_sums": " UNION ALL ".join(
        [
            _fact_sums(_YEAR_END, True, "'FY'", 60),
            _fact_sums(_YEAR_END, False, "'FY'", 400),
            _fact_sums(_QUARTER_END, True, _QNAME, 60),
            _fact_sums(_QUARTER_END, False, _QNAME, 400),
        ]
    ),
    "fundamentals": " UNION ALL ".join(
        f"""SELECT concat_ws(':', security_id, '{k}', fiscal_period, strftime(period_end, '%Y%m%d'), filing_no) AS record_id,
 security_id, '{k}' AS concept, period_end, fiscal_period, year(period_end) AS fiscal_year,
 CASE WHEN fiscal_period = 'FY' THEN '10-K' ELSE '10-Q' END AS form_type,
 CAST({v} AS DOUBLE) AS value, available_time FROM fact_sums"""
        for k, v in _CONCEPTS.items()
    ),
    "insider": """SELECT event_id AS record_id, 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS security_id, ts AS transaction_date,
 CASE event_type WHEN 'purchase' THEN 'P' WHEN 'click' THEN 'S' ELSE 'A' END AS transaction_code, value AS shares,
 CAST(json_extract_string(props, '$.k') AS INT) % 7 = 0 AS is_10b5_1_plan, ts + INTERVAL 2 DAY AS available_time FROM events""",
    "short_interest": """SELECT *, quantity / n AS avg_volume, CASE WHEN n > 2 THEN CAST(n AS DOUBLE) END AS days_to_cover,
 settlement_date + INTERVAL 11 DAY AS available_time FROM (
 SELECT security_id, CAST(CASE WHEN day(l_shipdate) <= 15 THEN date_trunc('month', l_shipdate) + INTERVAL 14 DAY
  ELSE last_day(l_shipdate) END AS TIMESTAMP) AS settlement_date, sum(l_quantity) AS quantity, count(*) AS n FROM line_brand GROUP BY 1, 2)""",
    "filer_holdings": f"""SELECT *, quarter_end + INTERVAL 45 DAY AS available_time FROM (
 SELECT security_id, CAST(o_custkey % 10 AS VARCHAR) AS filer_cik, {_QUARTER_END} AS quarter_end, sum(l_quantity) AS shares
 FROM line_brand JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)""",
    "holdings": """SELECT security_id, quarter_end, sum(shares) AS shares, count(DISTINCT filer_cik) AS num_institutions,
 quarter_end + INTERVAL 45 DAY AS available_time FROM filer_holdings GROUP BY 1, 2""",
    "actions": """SELECT *, CASE WHEN n % 5 <> 0 THEN event_time + INTERVAL 3 DAY END AS effective_time,
 event_time + (n % 10) * INTERVAL 1 DAY AS available_time, event_time + (n % 12) * INTERVAL 1 DAY AS ingestion_time FROM (
 SELECT p_partkey AS n, CAST(p_partkey AS VARCHAR) AS record_id, p_brand AS security_id,
 CASE p_partkey % 3 WHEN 0 THEN 'SPLIT' WHEN 1 THEN 'CASH_DIVIDEND' ELSE 'REVERSE_SPLIT' END AS action_type,
 TIMESTAMP '1995-06-01' + (p_partkey * 37 % 2300) * INTERVAL 1 DAY AS event_time,
 CASE p_partkey % 3 WHEN 0 THEN CAST(p_size % 3 + 2 AS VARCHAR) || ':' || CAST(p_size % 2 + 1 AS VARCHAR) WHEN 2 THEN '0.5' END AS ratio_text,
 CASE WHEN p_partkey % 3 = 1 THEN round(p_retailprice / 100, 4) END AS amount FROM part)""",
    "macro_vintages": " UNION ALL ".join(
        f"""SELECT series_id, observation_date,
 CASE WHEN month(observation_date) = 7 AND {n} = 1 THEN NULL ELSE value END AS value,
 CAST(last_day(observation_date) AS TIMESTAMP) + INTERVAL {lag} DAY AS realtime_start,
 {"CAST(last_day(observation_date) AS TIMESTAMP) + INTERVAL 34 DAY" if n == 1 else "NULL::TIMESTAMP"} AS realtime_end,
 CAST(last_day(observation_date) AS TIMESTAMP) + INTERVAL {lag + 1} DAY + INTERVAL 6 HOUR AS available_time FROM (
 SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS observation_date,
 round(sum(o_totalprice), 2) AS value FROM orders {"WHERE o_orderstatus = 'F'" if n == 1 else ""} GROUP BY 1, 2)"""
        for n, lag in ((1, 5), (2, 35))
    ),
    "membership": """SELECT security_id, 'core' AS universe, min(ts) AS valid_from,
 CASE WHEN CAST(regexp_extract(security_id, '([0-9]+)$', 1) AS INT) % 2 = 1 THEN max(ts) END AS valid_to
 FROM bars WHERE month(ts) = 1 GROUP BY security_id""",
    "brand_span": """SELECT security_id, CAST(regexp_extract(security_id, '([0-9]+)$', 1) AS INT) AS number, min(ts) AS a, max(ts) AS b
 FROM bars GROUP BY security_id""",
    "security_master": """SELECT security_id, 'TK' || CAST(number % 20 AS VARCHAR) AS ticker, 'ACTIVE' AS status, a AS valid_from,
 CASE WHEN number % 2 = 0 THEN TIMESTAMP '1998-07-01' ELSE b END AS valid_to FROM brand_span
 UNION ALL SELECT security_id, 'TK' || CAST((number + 1) % 20 AS VARCHAR), CASE WHEN number % 4 = 0 THEN 'DELISTED' ELSE 'ACTIVE' END,
 TIMESTAMP '1998-07-01', CASE WHEN number % 4 = 0 THEN b END FROM brand_span WHERE number % 2 = 0""",
    "fold_returns": """SELECT security_id AS candidate, CAST(year(ts) * 4 + quarter(ts) - 1 AS INT) AS fold,
 arg_max(close, ts) / arg_min(close, ts) - 1.0::DOUBLE AS net_return FROM bars GROUP BY 1, 2""",
    "decisions": """SELECT o_orderkey AS decision_id, o_orderdate AS decision_time, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS security_id,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BUY' WHEN '2' THEN 'SELL' WHEN '3' THEN 'NO_TRADE' ELSE 'HOLD' END AS action,
 CASE WHEN o_orderstatus = 'F' THEN 'REAL' ELSE 'SYNTHETIC' END AS provenance,
 round(o_totalprice / 600000.0::DOUBLE, 4) AS confidence, o_totalprice AS notional FROM orders""",
    "trades": """SELECT l_orderkey AS trade_id, l_orderkey AS decision_id, 'Brand#' || CAST(l_partkey % 25 + 1 AS VARCHAR) AS security_id,
 l_shipdate AS fill_time, l_quantity AS quantity, l_extendedprice / l_quantity AS fill_price,
 round(l_discount - l_tax, 4) AS realized_return, round(l_extendedprice * (l_discount - l_tax), 4) AS realized_pnl FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice, l_shipdate) AS k
 FROM lineitem) WHERE k = 1""",
    "news": """SELECT doc_id AS news_id, text AS headline, 'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR) AS security_id,
 DATE '1995-01-02' + CAST(doc_id % 2000 AS INT) AS day, lang, source, n_chars FROM documents""",
}


def panel_sql(revisions: str, grid: str, pad: int, keep: int | None, where: str = "") -> str:
    """Bars per (security, as_of): newest known revision, last ``keep`` bars, price and return columns."""
    limit = f"WHERE rn <= {keep}" if keep is not None else ""
    return f"""(SELECT *, CASE WHEN lag(px) OVER w <> 0 THEN px / lag(px) OVER w - 1 END AS ret FROM (
SELECT *, coalesce(nullif(adjusted_close, 0), close) AS px, coalesce(adjusted_close, close) AS px_null FROM (
SELECT *, row_number() OVER (PARTITION BY security_id, as_of ORDER BY ts DESC) AS rn FROM (
SELECT g.as_of, b.*, row_number() OVER (PARTITION BY b.security_id, g.as_of, b.ts
 ORDER BY ingestion_time DESC, data_version DESC, close DESC, volume DESC) AS rv
FROM {grid} g JOIN {revisions} b ON b.ts >= g.as_of - INTERVAL {pad} DAY AND b.ts <= g.as_of AND b.available_time <= g.as_of {where})
WHERE rv = 1) {limit}) WINDOW w AS (PARTITION BY security_id, as_of ORDER BY ts))"""


def market_sql(revisions: str, grid: str, lookback: int) -> str:
    """Joined security and benchmark dates with both returns."""
    own = panel_sql(revisions, grid, padded(lookback), lookback + 1)
    market = panel_sql("benchmark_bars", grid, padded(lookback), lookback + 1)
    return f"""(SELECT *, px / lag(px) OVER w - 1 AS s, mpx / lag(mpx) OVER w - 1 AS m, row_number() OVER w AS day_no FROM (
SELECT o.security_id, o.as_of, o.ts, o.px, k.px AS mpx FROM {own} o JOIN {market} k ON o.as_of = k.as_of AND o.ts = k.ts)
WINDOW w AS (PARTITION BY security_id, as_of ORDER BY ts))"""


def forward_sql(revisions: str, grid: str, days: int) -> str:
    """First-to-last return over [as_of, as_of + days] as known at the end of that range."""
    return f"""(SELECT security_id, as_of, CASE WHEN count(*) >= 2 AND arg_min(px, ts) > 0 THEN arg_max(px, ts) / arg_min(px, ts) - 1 END AS fwd FROM (
SELECT *, coalesce(nullif(adjusted_close, 0), close) AS px FROM (
SELECT g.as_of, b.*, row_number() OVER (PARTITION BY b.security_id, g.as_of, b.ts
 ORDER BY ingestion_time DESC, data_version DESC, close DESC, volume DESC) AS rv
FROM {grid} g JOIN {revisions} b ON b.ts >= g.as_of AND b.ts <= g.as_of + INTERVAL {days} DAY AND b.available_time <= g.as_of + INTERVAL {days} DAY)
WHERE rv = 1) GROUP BY 1, 2)"""


def solve_sql(source: str, y: str, xs: list[str], group: str = "", ridge: str = "0.0::DOUBLE", where: str = "TRUE") -> str:
    """Least squares of ``y`` on 1 and ``xs`` by group: (group, n, b0, b1, ..., r2), elimination written out step by step.

    ``group`` lists columns of ``source``, ``ridge`` is one of them or a number. Coefficients are NULL where a pivot vanishes.
    """
    cols = ["1.0::DOUBLE", *xs, y]
    k, m = len(cols), len(cols) - 1
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    lead = f"{group}, " if group else ""
    sums = ", ".join(f"sum(({cols[i]}) * ({cols[j]})) AS a{i}_{j}" for i, j in cells)
    text = f"SELECT {lead}count(*) AS n, {sums} FROM {source} WHERE {where} {'GROUP BY ' + group if group else ''}"
    ridged = ", ".join(f"a{i}_{j}{' + ' + ridge if i == j < m else ''} AS a{i}_{j}" for i, j in cells)
    text = f"SELECT {lead}n, TRUE AS ok, a{m}_{m} - a0_{m} * a0_{m} / a0_0 AS total, {', '.join(f'a{i}_{i} + {ridge} AS d{i}' for i in range(m))}, {ridged} FROM ({text})"
    for p in range(m):
        after = ", ".join(f"a{i}_{j} - a{p}_{i} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" if i > p else f"a{i}_{j}" for i, j in cells)
        text = f"SELECT {lead}n, ok AND a{p}_{p} > 1e-13 * d{p} AS ok, total, {', '.join(f'd{i}' for i in range(m))}, {after} FROM ({text})"
    for i in reversed(range(m)):
        known = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, m))
        text = f"SELECT *, (a{i}_{m}{known}) / a{i}_{i} AS b{i} FROM ({text})"
    betas = ", ".join(f"CASE WHEN ok THEN b{i} END AS b{i}" for i in range(m))
    return f"(SELECT {lead}n, {betas}, CASE WHEN ok AND total <> 0 THEN 1 - a{m}_{m} / total END AS r2 FROM ({text}))"


def _poly_sql(factors: tuple[float, ...], x: str) -> str:
    out = f"{factors[0]:.17e}"
    for f in factors[1:]:
        out = f"({out} * {x} + {f:.17e})"
    return out


def normal_cdf_sql(z: str) -> str:
    far = "(cdf_x + 0.65e0)"
    for k in (4, 3, 2, 1):
        far = f"(cdf_x + {k}e0 / {far})"
    near = f"{_poly_sql(nm.CDF_TOP, 'cdf_x')} / {_poly_sql(nm.CDF_BOTTOM, 'cdf_x')}"
    upper = f"exp(-cdf_x * cdf_x / 2) * CASE WHEN cdf_x < {nm.CDF_FAR}e0 THEN {near} ELSE 1 / ({far} * sqrt(2 * pi())) END"
    return f"(SELECT CASE WHEN cdf_z > 0 THEN 1 - cdf_u ELSE cdf_u END FROM (SELECT cdf_z, {upper} AS cdf_u FROM (SELECT CAST({z} AS DOUBLE) AS cdf_z, abs(CAST({z} AS DOUBLE)) AS cdf_x)))"


def normal_quantile_sql(p: str) -> str:
    tail = f"{_poly_sql(nm.TAIL_TOP, 'inv_t')} / {_poly_sql(nm.TAIL_BOTTOM, 'inv_t')}"
    middle = f"(inv_p - 0.5e0) * {_poly_sql(nm.MIDDLE_TOP, 'inv_r')} / {_poly_sql(nm.MIDDLE_BOTTOM, 'inv_r')}"
    first = f"CASE WHEN inv_p < {nm.TAIL} THEN {tail} WHEN inv_p > 1 - {nm.TAIL} THEN -({tail}) ELSE {middle} END"
    below = "least(inv_p, 1 - inv_p)"
    parts = f"(inv_p - 0.5e0) * (inv_p - 0.5e0) AS inv_r, CASE WHEN {below} > 0 THEN sqrt(-2 * ln(CASE WHEN {below} > 0 THEN {below} END)) END AS inv_t"
    inner = f"SELECT inv_p, {first} AS inv_y FROM (SELECT inv_p, {parts} FROM (SELECT CAST({p} AS DOUBLE) AS inv_p))"
    return f"(SELECT CASE WHEN inv_p > 0 AND inv_p < 1 THEN inv_y - ({normal_cdf_sql('inv_y')} - inv_p) * sqrt(2 * pi()) * exp(inv_y * inv_y / 2) END FROM ({inner}))"


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def with_views(sql: str) -> str:
    """Prefix the query with the views it uses, directly or through others."""
    wanted: set[str] = set()
    todo = _needs(sql)
    while todo:
        v = todo.pop()
        if v not in wanted:
            wanted.add(v)
            todo.extend(_needs(VIEWS[v]))
    if not wanted:
        return sql
    placed: list[str] = []

    def place(v: str) -> None:
        if v not in placed:
            for below in _needs(VIEWS[v]):
                if below != v:
                    place(below)
            placed.append(v)

    for v in sorted(wanted):
        place(v)
    heads = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v].strip()})" for v in placed)
    return f"WITH {heads}\n{sql}"
