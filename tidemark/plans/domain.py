"""Research tables derived from the star-schema test tables.

Prices of a security are damped on purpose (a raw price per unit jumps too much); revisions arrive late.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import newest_revision, rebalance_grid
from tidemark.session import prepare

# fixed probe moments of the registered queries
QUARTERS = rebalance_grid(datetime(1996, 3, 15), datetime(2001, 10, 1), 3)
MONTHS = rebalance_grid(datetime(1996, 3, 15), datetime(2001, 10, 1), 1)


class Domain:
    """Lazy access to the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        casts = [
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
        return df.select(*casts)

    def _revisions(self, keyed: DataFrame) -> DataFrame:
        """keyed: lineitem with a security_id column."""
        disc, tax = F.col("l_discount"), F.col("l_tax")
        close = F.lit(100.0) + F.lit(200.0) * disc - F.lit(100.0) * tax
        factor = F.lit(1.0) - F.lit(0.1) * tax
        known = (
            F.col("l_shipdate")
            + F.expr("INTERVAL '20' HOUR")
            + F.make_dt_interval(F.greatest(F.col("l_linenumber") - 3, F.lit(0)))
        )
        none = tax == 0.0
        base = keyed.select(
            "security_id",
            F.col("l_shipdate").alias("ts"),
            (close - disc).alias("open"),
            (close + F.lit(1.0)).alias("high"),
            (close - F.lit(1.0) - disc).alias("low"),
            close.alias("close"),
            F.col("l_quantity").alias("volume"),
            F.when(none, None).when((tax == 0.08) & (disc == 0.1), F.lit(0.0)).otherwise(close * factor).alias("adjusted_close"),
            F.when(~none, (close + F.lit(1.0)) * factor).alias("adjusted_high"),
            F.when(~none, (close - F.lit(1.0) - disc) * factor).alias("adjusted_low"),
            known.alias("available_time"),
            (known + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("ingestion_time"),
            F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("data_version"),
            F.concat(F.lit("feed-"), F.col("l_returnflag")).alias("source"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        )
        return base

    @cached_property
    def line_brand(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("security_id"))
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def bar_revisions(self) -> DataFrame:
        return self._revisions(self.line_brand)

    @cached_property
    def region_revisions(self) -> DataFrame:
        place = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("r_name").alias("security_id"))
        )
        return self._revisions(self.table("lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey")))

    @cached_property
    def bars(self) -> DataFrame:
        return newest_revision(self.bar_revisions, "security_id", "ts")

    @cached_property
    def bars_region(self) -> DataFrame:
        return newest_revision(self.region_revisions, "security_id", "ts")

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.bars.groupBy("ts").agg(F.round(F.avg("close"), 8).alias("level"))

    @cached_property
    def benchmark_bars(self) -> DataFrame:
        """The benchmark in the shape of bars, one security named BENCH."""
        known = F.col("ts") + F.expr("INTERVAL '20' HOUR")
        return self.benchmark.select(
            F.lit("BENCH").alias("security_id"),
            "ts",
            F.col("level").alias("open"),
            F.col("level").alias("high"),
            F.col("level").alias("low"),
            F.col("level").alias("close"),
            F.lit(0.0).alias("volume"),
            F.lit(None).cast("double").alias("adjusted_close"),
            F.lit(None).cast("double").alias("adjusted_high"),
            F.lit(None).cast("double").alias("adjusted_low"),
            known.alias("available_time"),
            known.alias("ingestion_time"),
            F.lit("1").alias("data_version"),
            F.lit("calc").alias("source"),
        )

    @cached_property
    def sector(self) -> DataFrame:
        number = F.regexp_extract("security_id", r"(\d+)$", 1).cast("int")
        brands = self.table("part").select(F.col("p_brand").alias("security_id")).distinct()
        return brands.select("security_id", F.concat(F.lit("S"), (number % 5).cast("string")).alias("sector"))

    @cached_property
    def flags(self) -> DataFrame:
        """Quality flags: CRITICAL where the newest bar has the highest discount and no tax."""
        b = self.bars
        return b.filter((F.col("close") > 118.0)).select(
            "security_id",
            "ts",
            F.lit("ohlc_consistency").alias("check_name"),
            F.when(F.col("volume") > 25, "CRITICAL").otherwise("WARNING").alias("severity"),
        )

    # ---- company facts -------------------------------------------------------------------------

    def _fact_sums(self, period, early: bool) -> DataFrame:
        flag = F.col("l_returnflag")
        e = F.col("l_extendedprice")
        rows = self.line_brand
        if early:
            rows = rows.filter(F.col("l_linenumber") <= 3)
        return rows.groupBy("security_id", period.alias("period_end")).agg(
            F.round(F.sum(e), 2).alias("e"),
            F.round(F.sum("l_quantity"), 0).alias("q"),
            F.round(F.sum(F.when(flag == "A", e).otherwise(0.0)), 2).alias("ea"),
            F.round(F.sum(F.when(flag == "N", e).otherwise(0.0)), 2).alias("en"),
            F.round(F.sum(F.when(flag == "R", e).otherwise(0.0)), 2).alias("er"),
            F.round(F.sum(e * F.col("l_discount")), 4).alias("ed"),
            F.round(F.sum(e * F.col("l_tax")), 4).alias("et"),
        )

    @cached_property
    def fundamentals(self) -> DataFrame:
        """Yearly and quarterly facts, each filed early from part of the lines and restated later."""
        day = F.col("l_shipdate")
        year_end = F.make_timestamp(F.year(day), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
        quarter_end = F.date_add(F.add_months(F.date_trunc("quarter", day), 3), -1).cast("timestamp")
        concepts = {
            "Revenues": "e",
            "CostOfGoodsAndServicesSold": "0.6 * e + ed",
            "NetIncomeLoss": "ed - 0.04 * e",
            "Assets": "2 * e",
            "Liabilities": "10 * et",
            "StockholdersEquity": "2 * e - 10 * et",
            "CommonStockSharesOutstanding": "q",
            "AssetsCurrent": "1.1 * ea + 0.4 * e",
            "LiabilitiesCurrent": "5 * et + 0.1 * e",
            "NetCashProvidedByUsedInOperatingActivities": "ed - 0.03 * e",
            "LongTermDebtNoncurrent": "0.5 * er",
            "PaymentsOfDividends": "0.02 * en",
            "PaymentsForRepurchaseOfCommonStock": "0.01 * ea",
            "ProceedsFromIssuanceOfCommonStock": "0.005 * er",
            "RetainedEarningsAccumulatedDeficit": "0.3 * ea",
            "OperatingIncomeLoss": "ed - 0.035 * e",
            "ResearchAndDevelopmentExpense": "0.04 * ea",
            "CashAndCashEquivalentsAtCarryingValue": "0.2 * en",
            "SellingGeneralAndAdministrativeExpense": "0.15 * er",
            "PaymentsToAcquirePropertyPlantAndEquipment": "0.1 * en",
            "EarningsPerShareDiluted": "(ed - 0.04 * e) / q",
        }
        parts = []
        for period, label in ((year_end, "FY"), (quarter_end, "Q")):
            for early, lag in ((True, 60), (False, 400)):
                name = F.lit("FY") if label == "FY" else F.concat(F.lit("Q"), F.quarter("period_end").cast("string"))
                parts.append(
                    self._fact_sums(period, early).select(
                        "*",
                        name.alias("fiscal_period"),
                        (F.col("period_end") + F.make_dt_interval(F.lit(lag))).alias("available_time"),
                        F.lit(1 if early else 2).alias("filing_no"),
                    )
                )
        wide = parts[0]
        for p in parts[1:]:
            wide = wide.unionByName(p)
        pairs = F.array(*[F.struct(F.lit(k).alias("concept"), F.expr(v).cast("double").alias("value")) for k, v in concepts.items()])
        return wide.select(
            "security_id", "period_end", "fiscal_period", "available_time", "filing_no", F.explode(pairs).alias("p")
        ).select(
            F.concat_ws(":", "security_id", "p.concept", "fiscal_period", F.date_format("period_end", "yyyyMMdd"), "filing_no").alias(
                "record_id"
            ),
            "security_id",
            F.col("p.concept").alias("concept"),
            "period_end",
            "fiscal_period",
            F.year("period_end").alias("fiscal_year"),
            F.when(F.col("fiscal_period") == "FY", "10-K").otherwise("10-Q").alias("form_type"),
            F.col("p.value").alias("value"),
            "available_time",
        )

    @cached_property
    def insider(self) -> DataFrame:
        e = self.table("events")
        code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "click", "S").otherwise("A")
        return e.select(
            F.col("event_id").alias("record_id"),
            F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("security_id"),
            F.col("ts").alias("transaction_date"),
            code.alias("transaction_code"),
            F.col("value").alias("shares"),
            (F.get_json_object("props", "$.k").cast("int") % 7 == 0).alias("is_10b5_1_plan"),
            (F.col("ts") + F.make_dt_interval(F.lit(2))).alias("available_time"),
        )

    @cached_property
    def short_interest(self) -> DataFrame:
        day = F.col("l_shipdate")
        half = F.when(F.dayofmonth(day) <= 15, F.make_timestamp(F.year(day), F.month(day), F.lit(15), F.lit(0), F.lit(0), F.lit(0))).otherwise(
            F.last_day(day).cast("timestamp")
        )
        g = self.line_brand.groupBy("security_id", half.alias("settlement_date")).agg(
            F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n")
        )
        return g.select(
            "security_id",
            "settlement_date",
            "quantity",
            (F.col("quantity") / F.col("n")).alias("avg_volume"),
            F.when(F.col("n") > 2, F.col("n").cast("double")).alias("days_to_cover"),
            (F.col("settlement_date") + F.make_dt_interval(F.lit(11))).alias("available_time"),
        )

    @cached_property
    def filer_holdings(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey")
        quarter_end = F.date_add(F.add_months(F.date_trunc("quarter", F.col("l_shipdate")), 3), -1).cast("timestamp")
        g = (
            self.line_brand.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(
                "security_id", (F.col("o_custkey") % 10).cast("string").alias("filer_cik"), quarter_end.alias("quarter_end")
            )
            .agg(F.sum("l_quantity").alias("shares"))
        )
        return g.withColumn("available_time", F.col("quarter_end") + F.make_dt_interval(F.lit(45)))

    @cached_property
    def holdings(self) -> DataFrame:
        return (
            self.filer_holdings.groupBy("security_id", "quarter_end")
            .agg(F.sum("shares").alias("shares"), F.countDistinct("filer_cik").alias("num_institutions"))
            .withColumn("available_time", F.col("quarter_end") + F.make_dt_interval(F.lit(45)))
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Corporate actions: some parts split, some pay; half of the splits written as a:b text."""
        p = self.table("part")
        n = F.col("p_partkey")
        kind = F.when(n % 3 == 0, "SPLIT").when(n % 3 == 1, "CASH_DIVIDEND").otherwise("REVERSE_SPLIT")
        size = F.col("p_size")
        text = (
            F.when(n % 3 == 0, F.concat((size % 3 + 2).cast("string"), F.lit(":"), (size % 2 + 1).cast("string")))
            .when(n % 3 == 2, F.lit("0.5"))
        )
        event = F.lit("1995-06-01").cast("timestamp") + F.make_dt_interval((n * 37 % 2300).cast("int"))
        return p.select(
            n.cast("string").alias("record_id"),
            F.col("p_brand").alias("security_id"),
            kind.alias("action_type"),
            event.alias("event_time"),
            F.when(n % 5 != 0, event + F.make_dt_interval(F.lit(3))).alias("effective_time"),
            (event + F.make_dt_interval((n % 10).cast("int"))).alias("available_time"),
            (event + F.make_dt_interval((n % 12).cast("int"))).alias("ingestion_time"),
            text.alias("ratio_text"),
            F.when(n % 3 == 1, F.round(F.col("p_retailprice") / 100, 4)).alias("amount"),
        )

    # ---- macro, membership, journal ------------------------------------------------------------

    @cached_property
    def macro_vintages(self) -> DataFrame:
        o = self.table("orders").withColumn("observation_date", F.date_trunc("month", F.col("o_orderdate")))
        month_end = F.last_day("observation_date").cast("timestamp")

        def one(rows, lag, number):
            g = rows.groupBy(F.col("o_orderpriority").alias("series_id"), "observation_date").agg(
                F.round(F.sum("o_totalprice"), 2).alias("value")
            )
            start = month_end + F.make_dt_interval(F.lit(lag))
            return g.select(
                "series_id",
                "observation_date",
                F.when((F.month("observation_date") == 7) & (F.lit(number) == 1), None).otherwise(F.col("value")).alias("value"),
                start.alias("realtime_start"),
                F.when(F.lit(number) == 1, month_end + F.make_dt_interval(F.lit(34))).alias("realtime_end"),
                (start + F.make_dt_interval(F.lit(1), F.lit(6))).alias("available_time"),
            )

        return one(o.filter(F.col("o_orderstatus") == "F"), 5, 1).unionByName(one(o, 35, 2))

    @cached_property
    def membership(self) -> DataFrame:
        jan = self.bars.filter(F.month("ts") == 1)
        number = F.regexp_extract("security_id", r"(\d+)$", 1).cast("int")
        return jan.groupBy("security_id").agg(F.min("ts").alias("valid_from"), F.max("ts").alias("last_seen")).select(
            "security_id",
            F.lit("core").alias("universe"),
            "valid_from",
            F.when(number % 2 == 1, F.col("last_seen")).alias("valid_to"),
        )

    @cached_property
    def security_master(self) -> DataFrame:
        """Two validity rows per brand with the ticker changing hands between neighbours."""
        number = F.regexp_extract("security_id", r"(\d+)$", 1).cast("int")
        span = self.bars.groupBy("security_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        cut = F.lit("1998-07-01").cast("timestamp")
        first = span.select(
            "security_id",
            F.concat(F.lit("TK"), (number % 20).cast("string")).alias("ticker"),
            F.lit("ACTIVE").alias("status"),
            F.col("a").alias("valid_from"),
            F.when(number % 2 == 0, cut).otherwise(F.col("b")).alias("valid_to"),
        )
        second = span.filter(number % 2 == 0).select(
            "security_id",
            F.concat(F.lit("TK"), ((number + 1) % 20).cast("string")).alias("ticker"),
            F.when(number % 4 == 0, "DELISTED").otherwise("ACTIVE").alias("status"),
            cut.alias("valid_from"),
            F.when(number % 4 == 0, F.col("b")).alias("valid_to"),
        )
        return first.unionByName(second)

    @cached_property
    def fold_returns(self) -> DataFrame:
        quarter = F.year("ts") * 4 + F.quarter("ts") - 1
        g = self.bars.groupBy(F.col("security_id").alias("candidate"), quarter.cast("int").alias("fold")).agg(
            F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b")
        )
        return g.select("candidate", "fold", (F.col("b") / F.col("a") - 1.0).alias("net_return"))

    @cached_property
    def decisions(self) -> DataFrame:
        o = self.table("orders")
        action = (
            F.when(F.col("o_orderpriority").startswith("1"), "BUY")
            .when(F.col("o_orderpriority").startswith("2"), "SELL")
            .when(F.col("o_orderpriority").startswith("3"), "NO_TRADE")
            .otherwise("HOLD")
        )
        return o.select(
            F.col("o_orderkey").alias("decision_id"),
            F.col("o_orderdate").alias("decision_time"),
            F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("security_id"),
            action.alias("action"),
            F.when(F.col("o_orderstatus") == "F", "REAL").otherwise("SYNTHETIC").alias("provenance"),
            F.round(F.col("o_totalprice") / F.lit(600000.0), 4).alias("confidence"),
            F.col("o_totalprice").alias("notional"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        """First line of an order as the fill of its decision."""
        li = self.table("lineitem")
        order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_shipdate")
        f = li.groupBy("l_orderkey").agg(F.min(order).alias("x"))
        return f.select(
            F.col("l_orderkey").alias("trade_id"),
            F.col("l_orderkey").alias("decision_id"),
            F.concat(F.lit("Brand#"), (F.col("x.l_partkey") % 25 + 1).cast("string")).alias("security_id"),
            F.col("x.l_shipdate").alias("fill_time"),
            F.col("x.l_quantity").alias("quantity"),
            (F.col("x.l_extendedprice") / F.col("x.l_quantity")).alias("fill_price"),
            F.round(F.col("x.l_discount") - F.col("x.l_tax"), 4).alias("realized_return"),
            F.round(F.col("x.l_extendedprice") * (F.col("x.l_discount") - F.col("x.l_tax")), 4).alias("realized_pnl"),
        )

    @cached_property
    def news(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("news_id"),
            F.col("text").alias("headline"),
            F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("security_id"),
            F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2000).cast("int")).alias("day"),
            "lang",
            "source",
            "n_chars",
        )
