"""Models, news study and streaming jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import models as ml
from tidemark.operators import news as nw
from tidemark.operators import signals as sg
from tidemark.operators import trees as tr
from tidemark.plans.domain import QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, forward_sql, panel_sql, solve_sql
from tidemark.plans.queries_fundamental import _SQL as FACT_SQL
from tidemark.plans.queries_signals import ic_sql
from tidemark.plans.registry import query
from tidemark.session import ensure_checkpoint_dir
from tidemark.streaming import jobs

FC = ", ".join(f"{x}:f" for x in ml.FEATURES)
_MOM = "SELECT security_id, as_of, CASE WHEN count(*) >= 2 THEN arg_max(px, ts) / arg_min(px, ts) - 1 END AS momentum FROM " + panel_sql("bar_revisions", "grid_q", 504, 253) + " GROUP BY 1, 2"
_VOL = "SELECT security_id, as_of, -(stddev_samp(ret) * sqrt(252.0::DOUBLE)) AS low_volatility FROM " + panel_sql("bar_revisions", "grid_q", 201, 127) + " GROUP BY 1, 2"
VIEWS["features"] = f"SELECT * FROM ({_MOM}) JOIN ({_VOL}) USING (security_id, as_of) JOIN (SELECT security_id, as_of, " + ", ".join(f"{FACT_SQL[x]} AS {x}" for x in ml.FACT_FEATURES) + ") USING (security_id, as_of) WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in ml.FEATURES)
VIEWS["features"] = VIEWS["features"].replace(") USING (security_id, as_of) WHERE", " FROM fy) USING (security_id, as_of) WHERE")
VIEWS["ml_rows"] = f"SELECT f.*, fwd AS target, as_of + INTERVAL 60 DAY AS target_end FROM features f JOIN {forward_sql('bar_revisions', 'grid_q', 60)} USING (security_id, as_of) WHERE fwd IS NOT NULL"


def rows(d: Domain):
    return ml.dataset(d.bar_revisions, d.fundamentals, QUARTERS)


query("ml_01_features", f"security_id:s, as_of:t, {FC}", "SELECT * FROM features")(lambda d: ml.feature_vectors(d.bar_revisions, d.fundamentals, QUARTERS))
query("ml_02_targets", "security_id:s, as_of:t, target:f", f"SELECT security_id, as_of, fwd AS target FROM {forward_sql('bar_revisions', 'grid_q', 60)}")(lambda d: ml.targets(d.bar_revisions, QUARTERS))
query("ml_03_dataset", f"security_id:s, as_of:t, {FC}, target:f, target_end:t", "SELECT * FROM ml_rows")(rows)
_X = list(ml.FEATURES)
VIEWS["ml_fit"] = f"SELECT * FROM {solve_sql('ml_rows', 'target', _X, ridge='1e-6')}"
_DOT = "b0" + "".join(f" + b{i} * {x}" for i, x in enumerate(_X, 1))
_CUTS = [QUARTERS[len(QUARTERS) * (i + 1) // 4] for i in range(3)]
_BLOCK = " + ".join(f"CAST(as_of >= TIMESTAMP '{x}' AS INT)" for x in _CUTS)
_FOLDS = f"(SELECT m.*, fold, CAST(ridge AS DOUBLE) AS ridge FROM (SELECT *, {_BLOCK} AS block FROM ml_rows) m JOIN range(1, 4) f(fold) ON block < fold, (SELECT unnest([{', '.join(map(str, ml.RIDGES))}]) AS ridge))"


def kept(d: Domain):
    """The dataset, written once for a query that reads it for the fit and again for the answer."""
    ensure_checkpoint_dir(d.spark)
    return rows(d).checkpoint()


def _predicted(d: Domain):
    found = kept(d)
    return ml.predict_linear(found, ml.fit_linear(found))


def graded(d: Domain):
    """The dataset with features at nine digits, so that sums taken in another order leave the same distinct values."""
    return kept(d).select("security_id", "as_of", *[F.round(x, 9).alias(x) for x in ml.FEATURES], "target")


def _by_tree(d: Domain):
    found = graded(d)
    return tr.predict(found, tr.fit_tree(found, ml.FEATURES))


def _by_forest(d: Domain):
    found = graded(d)
    return tr.predict(found, tr.fit_forest(found, ml.FEATURES, ["security_id", "as_of"]))


def _level(k: int) -> str:
    """Best split of each node reached by ``path{k}``, and the rows sent on along it."""
    return f"""cells{k} AS (SELECT tree, node, k, feature, x, sum(w) AS w, sum(w * y) AS s FROM path{k} JOIN menu USING (tree) JOIN wide USING (i, feature) WHERE w > 0 AND node >= {2**k} GROUP BY ALL),
 cuts{k} AS (SELECT tree, node, k, feature, x, lag(x) OVER o AS before, sum(w) OVER o - w AS nl, sum(s) OVER o - s AS sl, sum(w) OVER p AS n, sum(s) OVER p AS t FROM cells{k}
  WINDOW p AS (PARTITION BY tree, node, k), o AS (PARTITION BY tree, node, k ORDER BY x ROWS UNBOUNDED PRECEDING)),
 tried{k} AS (SELECT tree, node, k, feature, (before + x) / 2 AS threshold, CAST(nl AS DOUBLE) * (n - nl) / n * pow(CAST(sl AS DOUBLE) / nl - CAST(t - sl AS DOUBLE) / (n - nl), 2) AS gain FROM cuts{k}
  WHERE before IS NOT NULL AND nl >= (SELECT m FROM least) AND n - nl >= (SELECT m FROM least)),
 split{k} AS (SELECT * FROM tried{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, k, threshold) = 1),
 path{k + 1} AS (SELECT a.i, a.tree, a.w, y, CASE WHEN x > threshold THEN 2 * a.node + 1 WHEN x <= threshold THEN 2 * a.node ELSE a.node END AS node
  FROM path{k} a LEFT JOIN split{k} s ON a.tree = s.tree AND a.node = s.node LEFT JOIN wide v ON a.i = v.i AND v.feature = s.feature)"""


def _grown_sql(menu: str, bags: str) -> str:
    """Predictions of trees over ``ml_rows``: ``menu`` (tree, feature, k), ``bags`` (tree, i, w)."""
    wide = " UNION ALL ".join(f"SELECT i, '{x}' AS feature, {x} AS x FROM base" for x in _X)
    return f"""WITH base AS (SELECT security_id, as_of, row_number() OVER (ORDER BY security_id, as_of) - 1 AS i, CAST(round(target * 1e9) AS BIGINT) AS y, {', '.join(f'round({x}, 9) AS {x}' for x in _X)} FROM ml_rows),
 wide AS MATERIALIZED ({wide}), least AS (SELECT greatest(3, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)) AS m FROM base), menu AS ({menu}), bags AS ({bags}),
 path0 AS MATERIALIZED (SELECT i, tree, coalesce(w, 0) AS w, y, 1 AS node FROM base CROSS JOIN (SELECT DISTINCT tree FROM menu) LEFT JOIN bags USING (tree, i)),
 {', '.join(_level(k) for k in range(tr.DEPTH))},
 leaf AS (SELECT tree, node, CAST(sum(w * y) AS DOUBLE) / sum(w) / 1e9::DOUBLE AS value FROM path{tr.DEPTH} GROUP BY 1, 2),
 answers_of AS (SELECT i, avg(value) AS prediction FROM path{tr.DEPTH} JOIN leaf USING (tree, node) GROUP BY 1)
 SELECT security_id, as_of, prediction FROM base JOIN answers_of USING (i)"""


query("ml_04_fit_linear", "samples:i, intercept:f6, first:f6", "SELECT n AS samples, b0 AS intercept, b1 AS first FROM ml_fit")(lambda d: ml.fit_linear(rows(d)).select("samples", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("first")))
query("ml_05_predict_linear", "security_id:s, as_of:t, prediction:f6", f"SELECT security_id, as_of, {_DOT} AS prediction FROM ml_rows, ml_fit")(_predicted)
query(
    "ml_06_ridge_search",
    "ridge:f, mse:f, n:i",
    f"""SELECT ridge, avg(pow({_DOT} - target, 2)) AS mse, count(*) AS n FROM (SELECT *, {_BLOCK} AS block FROM ml_rows) JOIN {solve_sql(_FOLDS, 'target', _X, 'fold, ridge', 'ridge')} ON block = fold WHERE n >= {len(_X) + 2} GROUP BY 1""",
)(lambda d: ml.ridge_search(kept(d), QUARTERS))
_NAMES = f"unnest([{', '.join(repr(x) for x in _X)}])"
_TREE = _grown_sql(f"SELECT 0 AS tree, {_NAMES} AS feature, unnest(range({len(_X)})) AS k", "SELECT 0 AS tree, i, 1 AS w FROM base")
_FOREST = _grown_sql(
    f"SELECT *, row_number() OVER (PARTITION BY tree ORDER BY md5('{tr.SEED}:' || tree || ':' || feature)) AS k FROM range({tr.TREES}) t(tree), (SELECT {_NAMES} AS feature) QUALIFY k <= {tr.FEATURES_A_TREE}",
    f"SELECT tree, CAST('0x' || substr(md5('{tr.SEED}:' || tree || ':' || j.i), 1, 15) AS BIGINT) % (SELECT count(*) FROM base) AS i, count(*) AS w FROM base j, range({tr.TREES}) t(tree) GROUP BY 1, 2",
)
query("ml_07_tree", "security_id:s, as_of:t, prediction:f6", _TREE)(_by_tree)
query("ml_08_forest", "security_id:s, as_of:t, prediction:f6", _FOREST)(_by_forest)
query("ml_09_forest_mean", "as_of:t, mean_prediction:f6, n:i", f"SELECT as_of, avg(prediction) AS mean_prediction, count(*) AS n FROM ({_FOREST}) GROUP BY 1")(
    lambda d: _by_forest(d).groupBy("as_of").agg(F.avg("prediction").alias("mean_prediction"), F.count(F.lit(1)).alias("n"))
)
TRAIN = ml.training_dates(datetime(2000, 3, 15), 36, 6)
_TRAINSQL = "as_of >= TIMESTAMP '1997-03-15' AND as_of <= TIMESTAMP '2000-03-15' - INTERVAL 60 DAY AND month(as_of) IN (3, 9)"
query("ml_10_training_rows", "security_id:s, as_of:t, target:f", f"SELECT security_id, as_of, target FROM ml_rows WHERE {_TRAINSQL}")(lambda d: ml.dataset(d.bar_revisions, d.fundamentals, TRAIN))


def _model_ic(d: Domain):
    found = _predicted(d)
    return sg.ic_series(found.select("security_id", "as_of", F.round("prediction", 9).alias("score")), found.select("security_id", "as_of", F.col("target").alias("fwd")))


query(
    "ml_11_model_ic",
    "as_of:t, ic:f6, names:i",
    f"SELECT * FROM {ic_sql(f'(SELECT security_id, as_of, round({_DOT}, 9) AS score FROM ml_rows, ml_fit)', '(SELECT security_id, as_of, target AS fwd FROM ml_rows)')} WHERE ic IS NOT NULL",
)(_model_ic)
query("ml_14_fit_on_maps", "samples:i, intercept:f6", f"SELECT n AS samples, b0 AS intercept FROM {solve_sql('ml_rows', 'target', ['roe', 'momentum'], ridge='1e-6', where='roe > -0.5 AND momentum > -0.5')}")(
    lambda d: ml.fit_on_maps(
        rows(d).select(F.col("target").alias("label"), F.map_filter(F.create_map(F.lit("roe"), "roe", F.lit("momentum"), "momentum"), lambda k, v: v > -0.5).alias("features")), ["roe", "momentum"]
    ).select("samples", F.col("beta")[0].alias("intercept"))
)
query("udf_01_r_squared", "as_of:t, r2:f6", f"SELECT as_of, r2 FROM {solve_sql('ml_rows', 'target', ['momentum', 'low_volatility'], 'as_of')}")(lambda d: _r2(d))


def _r2(d: Domain):
    from tidemark.functions.regression import gram_sums, r_squared

    return rows(d).groupBy("as_of").agg(gram_sums("target", ["momentum", "low_volatility"]).alias("g")).select("as_of", r_squared("g").alias("r2"))


# ---- news --------------------------------------------------------------------------------------------------
VIEWS["news_day"] = """SELECT security_id, day, min(news_id) AS news_id FROM news WHERE trim(headline) <> '' GROUP BY 1, 2"""
VIEWS["news_px"] = "SELECT security_id, ts, adjusted_close AS px FROM bars WHERE adjusted_close <> 0"
VIEWS["cal"] = "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM news_px)"
VIEWS["placed"] = "SELECT security_id, pos, px FROM news_px JOIN cal USING (ts)"


def _leg(back: int, ahead: int) -> str:
    return f"(SELECT a.security_id, a.pos - ({back}) AS pos, b.px / a.px - 1 AS r, avg(b.px / a.px - 1) OVER (PARTITION BY a.pos) AS m FROM placed a JOIN placed b ON a.security_id = b.security_id AND b.pos - ({ahead}) = a.pos - ({back}))"


VIEWS["excess"] = f"""SELECT e.security_id, e.day, news_id, CASE WHEN inside AND abs(x.r) <= 0.5 THEN x.r - x.m END AS reaction, CASE WHEN inside AND abs(y.r) <= 0.5 THEN y.r - y.m END AS forward FROM (
 SELECT n.*, pos, coalesce(pos >= 1 AND pos + 6 <= (SELECT max(pos) FROM cal), FALSE) AS inside FROM (SELECT *, CAST(day AS TIMESTAMP) AS d0 FROM news_day) n ASOF LEFT JOIN cal c ON n.d0 <= c.ts) e
 LEFT JOIN {_leg(-1, 1)} x ON x.security_id = e.security_id AND x.pos = e.pos LEFT JOIN {_leg(1, 6)} y ON y.security_id = e.security_id AND y.pos = e.pos"""
VIEWS["answers"] = """SELECT doc_id AS news_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE round((n_chars % 97) / 97, 6) END - round((n_chars % 89) / 89, 6) AS masked, CASE WHEN doc_id % 11 <> 0 THEN round((n_chars % 83) / 83, 6) - 0.5 END AS probe FROM documents"""


def answers(d: Domain):
    """Stored answers per text: class probabilities and a probe value, as JSON."""
    n, k = F.col("n_chars"), F.col("doc_id")
    pos = F.when(k % 13 != 0, F.round((n % 97) / 97, 6))
    neg = F.round((n % 89) / 89, 6)
    prob = F.map_filter(F.create_map(F.lit("positive"), pos, F.lit("negative"), neg), lambda _k, v: v.isNotNull())
    return d.table("documents").select(k.alias("news_id"), F.to_json(F.struct(prob.alias("probabilities"), F.when(k % 11 != 0, F.round((n % 83) / 83, 6)).alias("noul"))).alias("answer"))


def day_news(d: Domain):
    return nw.first_per_day(d.news, d.sector)


def study(d: Domain):
    a = answers(d).select("news_id", nw.sentiment("answer").alias("masked"), nw.probe("answer").alias("probe"))
    whole = nw.excess_returns(day_news(d).drop("headline"), nw.adjusted_closes(d.bars)).join(a, "news_id")
    return nw.materialised(whole)  # the reports read it several times


VIEWS["study"] = "SELECT * FROM excess JOIN answers USING (news_id)"
query(
    "new_01_sample",
    "security_id:s, day:d, news_id:i, year:i",
    """SELECT * FROM (SELECT *, year(day) AS year, row_number() OVER (PARTITION BY year(day) ORDER BY md5('11:' || security_id || ':' || strftime(day, '%Y-%m-%d')), security_id, day) AS k FROM news_day)
 WHERE k <= greatest(1, 300 // (SELECT count(DISTINCT year(day)) FROM news_day))""",
)(lambda d: nw.sample_per_year(day_news(d), 300, 11))
query("new_01_first_per_day", "security_id:s, day:d, news_id:i", "SELECT * FROM news_day")(day_news)
query("new_02_excess_returns", "security_id:s, day:d, reaction:f, forward:f", "SELECT * FROM excess")(lambda d: nw.excess_returns(day_news(d), nw.adjusted_closes(d.bars)))
query("new_03_adjusted_closes", "security_id:s, ts:t, px:f", "SELECT * FROM news_px")(lambda d: nw.adjusted_closes(d.bars))
_RANKIC = """SELECT year, CASE WHEN count(*) >= 3 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS ic, count(*) AS n FROM (SELECT year(day) AS year, rank() OVER (PARTITION BY year(day) ORDER BY masked) + (count(*) OVER (PARTITION BY year(day), masked) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY year(day) ORDER BY forward) + (count(*) OVER (PARTITION BY year(day), forward) - 1) / 2.0::DOUBLE AS b FROM study WHERE masked IS NOT NULL AND forward IS NOT NULL) GROUP BY 1"""
query("new_04_rank_correlation", "year:i, ic:f, n:i", _RANKIC)(lambda d: nw.rank_correlation(study(d).withColumn("year", F.year("day")), "masked", "forward", "year"))
query("new_05_percentile", "grp:s, p:f", "SELECT grp, list_sort(list(ret))[CAST(round_even(0.3::DOUBLE * (count(ret) - 1), 0) AS INT) + 1] AS p FROM path WHERE ret IS NOT NULL GROUP BY 1")(lambda d: _percentile(d))


def _percentile(d: Domain):
    from tidemark.operators.performance import returns
    from tidemark.plans.queries_performance import nav

    return nw.percentile_by_index(returns(nav(d)), "ret", 0.3, "grp")


def _drawn(xs: str, known: str) -> str:
    """Rank correlations ``ic`` of every draw: rows are drawn one by one, ranked and correlated."""
    names = [x.strip() for x in xs.split(",")]
    ranks = ", ".join(f"rank() OVER (PARTITION BY b ORDER BY {x}) + (count(*) OVER (PARTITION BY b, {x}) - 1) / 2.0::DOUBLE AS r_{x}" for x in (*names, "forward"))
    corr = lambda x: f"CASE WHEN count(*) >= 3 AND var_pop(r_{x}) * var_pop(r_forward) > 0 THEN covar_pop(r_{x}, r_forward) / sqrt(var_pop(r_{x}) * var_pop(r_forward)) END"
    return f"""WITH whole AS (SELECT {xs}, forward, row_number() OVER (ORDER BY news_id) - 1 AS i FROM study WHERE {known} AND forward IS NOT NULL),
 picks AS (SELECT b, CAST('0x' || substr(md5('5:' || b || ':' || j.i), 1, 15) AS BIGINT) % (SELECT count(*) FROM whole) AS i FROM whole j, range(200) t(b)),
 drawn AS (SELECT b, {ranks} FROM picks JOIN whole USING (i)),
 stats AS (SELECT b, count(*) AS n, {' - '.join(corr(x) for x in names)} AS ic FROM drawn GROUP BY b)"""


def _interval(enough: str) -> str:
    at = lambda q: f"CASE WHEN {enough} THEN v[CAST(round_even({q}::DOUBLE * (len(v) - 1), 0) AS INT) + 1] END"
    return f"SELECT {at(0.025)} AS low, {at(0.975)} AS high FROM (SELECT list_sort(list(ic) FILTER (WHERE ic IS NOT NULL)) AS v, max(n) AS n FROM stats)"


_BOOT = f"{_drawn('masked', 'masked IS NOT NULL')} {_interval('n >= 30 AND len(v) >= 100')}"
_GAP = f"{_drawn('masked, probe', 'masked IS NOT NULL AND probe IS NOT NULL')} {_interval('n >= 30')}"
query("new_06_bootstrap", "low:f, high:f", _BOOT)(lambda d: nw.bootstrap_interval(study(d), "news_id", "masked", "forward", 200, 5))
query(
    "new_07_signal_report",
    "n:i, spread:f, hit_rate:f, decided:i",
    """SELECT max(n) AS n, avg(CASE WHEN r > n - n // 3 THEN forward END) - avg(CASE WHEN r <= n // 3 THEN forward END) AS spread, count(*) FILTER (WHERE dd AND (masked > 0) = (forward > 0)) / count(*) FILTER (WHERE dd) AS hit_rate, count(*) FILTER (WHERE dd) AS decided FROM (
 SELECT *, row_number() OVER (ORDER BY masked, news_id) AS r, count(*) OVER () AS n, abs(masked) >= 0.2 AND forward <> 0 AS dd FROM (SELECT news_id, forward, masked FROM study) WHERE masked IS NOT NULL AND forward IS NOT NULL)""",
)(lambda d: nw.signal_report(study(d), "news_id", "masked", "forward"))
query("new_08_gap", "low:f, high:f", _GAP)(lambda d: nw.gap_interval(study(d), "news_id", "masked", "probe", "forward", 200, 5))
query("new_09_report", "year:i, ic:f, n:i, low:f, high:f", f"SELECT * FROM ({_RANKIC}), ({_BOOT})")(
    lambda d: sg.attach(nw.rank_correlation(study(d).withColumn("year", F.year("day")), "masked", "forward", "year"), nw.bootstrap_interval(study(d), "news_id", "masked", "forward", 200, 5))
)
query("new_10_sentiment", "news_id:i, masked:f", "SELECT news_id, masked FROM answers")(lambda d: answers(d).select("news_id", nw.sentiment("answer").alias("masked")))
query("new_11_probe", "news_id:i, probe:f", "SELECT news_id, probe FROM answers")(lambda d: answers(d).select("news_id", nw.probe("answer").alias("probe")))

# ---- streaming: run over the whole event table until it is consumed, then read the result -----------------------


def _folder(d: Domain, name: str) -> str:
    import uuid

    return f"{ensure_checkpoint_dir(d.spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(d: Domain):
    """The event table as a file stream, instants instead of local times."""
    schema = d.spark.read.parquet(f"{d.sf_dir}/events.parquet").schema
    s = d.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _ingest(d: Domain):
    lake, key = _folder(d, "stream-lake"), ("user_id", "event_type", "day")
    s = event_stream(d).select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").alias("available_time"))
    jobs.start_ingest(s, lake, _folder(d, "stream-ingest"), key=key, year=F.year("day")).awaitTermination()
    return d.spark.read.parquet(lake).select("user_id", "event_type", "day")


query("str_01_ingest", "user_id:i, event_type:s, day:d", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")(_ingest)


def _newest(d: Domain):
    state = _folder(d, "stream-newest")
    s = event_stream(d).select("user_id", "event_type", "event_id", "value")
    jobs.start_newest(s, state, ["user_id", "event_type"], ["event_id"]).awaitTermination()
    return jobs.read_newest(d.spark, state)


query("str_02_newest", "user_id:i, event_type:s, event_id:i, value:f", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")(_newest)


def _windows(d: Domain):
    counts = _folder(d, "stream-windows")
    jobs.start_quality_windows(event_stream(d), counts, _folder(d, "stream-windows-ck"), "ts", "event_type", F.col("value") > 40).awaitTermination()
    return jobs.quality_windows(jobs.read_counts(d.spark, counts), "event_type").withColumnRenamed("start", "start_time")


query(
    "str_03_quality_windows",
    "start_time:t, event_type:s, n:i, bad_rate:f",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start_time, event_type, count(*) AS n, count(*) FILTER (WHERE value > 40) / count(*) AS bad_rate FROM events GROUP BY 1, 2",
)(_windows)


def _streaks(d: Domain):
    state = _folder(d, "stream-streaks")
    s = event_stream(d).select(F.col("event_type").alias("grp"), "ts", "event_id", (F.col("value") - 20).alias("realized_pnl"))
    jobs.start_streaks(s, state, _folder(d, "stream-streaks-ck"), ["ts", "event_id"]).awaitTermination()
    return jobs.read_streaks(d.spark, state)


query(
    "str_04_streaks",
    "grp:s, max_wins:i, max_losses:i",
    """SELECT grp, coalesce(max(CASE WHEN won THEN n END), 0) AS max_wins, coalesce(max(CASE WHEN NOT won THEN n END), 0) AS max_losses FROM (SELECT grp, won, k, count(*) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_id) - row_number() OVER (PARTITION BY grp, won ORDER BY ts, event_id) AS k FROM (SELECT event_type AS grp, ts, event_id, value > 20 AS won FROM events)) GROUP BY 1, 2, 3) GROUP BY 1""",
)(_streaks)
