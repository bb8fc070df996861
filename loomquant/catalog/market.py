"""Sources, bars, filters, labels, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, filters, labeling, timejoin, weights
from ..sources import domain, ohlcv
from .base import OHLCV, SPANS, TICKS, Catalog, r, rounded

C = Catalog()


def raw_ohlcv(spark, d):
    """Orders as raw bars with repeated keys: one row for each order."""
    return domain.read(spark, d, "orders").select(
        F.col("o_orderdate").alias("Date"),
        F.col("o_orderpriority").alias("Ticker"),
        F.col("o_totalprice").alias("Open"),
        (F.col("o_totalprice") * 1.5).alias("High"),
        (F.col("o_totalprice") * 0.5).alias("Low"),
        (F.col("o_totalprice") + 1).alias("Close"),
        F.col("o_custkey").alias("Volume"),
        F.col("o_orderkey").alias("key"),
    )


RAW = """raw AS (SELECT o_orderdate AS ts, o_orderpriority AS symbol, o_totalprice AS open, o_totalprice * 1.5 AS high,
  o_totalprice * 0.5 AS low, o_totalprice + 1 AS close, CAST(o_custkey AS DOUBLE) AS volume, o_totalprice + 1 AS adj_close, o_orderkey AS key FROM orders)"""
CLEAN = RAW + """, clean AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY key {}) AS rn FROM raw) WHERE rn = 1)"""
COLS = "ts, symbol, open, high, low, close, volume, adj_close"


@C.add("data__clean_ohlcv", f"WITH {CLEAN.format('DESC')} SELECT {COLS} FROM clean")
def clean(spark, d):
    return ohlcv.clean_ohlcv(raw_ohlcv(spark, d), ordinal="key")


@C.add("data__clean_ohlcv_first", f"WITH {CLEAN.format('ASC')} SELECT {COLS} FROM clean")
def clean_first(spark, d):
    return ohlcv.clean_ohlcv(raw_ohlcv(spark, d), dedupe_keep="first", ordinal="key")


@C.add(
    "data__quality_report",
    f"""WITH {RAW}, s AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts, key) AS step FROM raw)
SELECT count(*) AS row_count, count(DISTINCT symbol) AS symbol_count, count(*) FILTER (step = 0) AS duplicate_key_count,
  count(*) FILTER (step > 86400000000) AS gap_interval_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts_min,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts_max, count(*) FILTER (step = 0) AS rows_removed_by_deduplication FROM s""",
)
def report(spark, d):
    return ohlcv.data_quality_report(raw_ohlcv(spark, d), ordinal="key")


@C.add(
    "data__align_calendar",
    f"""WITH {CLEAN.format('DESC')}, g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM clean GROUP BY symbol)
SELECT g.ts, g.symbol, open, high, low, close, volume, adj_close, open IS NULL AS is_missing_bar FROM g LEFT JOIN clean USING (symbol, ts)""",
)
def aligned(spark, d):
    return ohlcv.align_calendar(raw_ohlcv(spark, d), interval="1d", ordinal="key")


BAR_COLUMNS = ["symbol", "bar_id", "ts", "start_ts", "open", "high", "low", "close", "volume", "n_obs", "dollar_value"]
BAR_SQL = f"""SELECT symbol, bar_id, max(ts) AS ts, min(ts) AS start_ts, arg_min(price, (ts, ord)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, ord)) AS close, sum(volume) AS volume, count(*) AS n_obs, {r('sum(price * volume)', 4)} AS dollar_value
FROM marked GROUP BY symbol, bar_id"""
NUMBERED = f"{TICKS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, ord) AS rn FROM ticks)"


def told(df):
    return rounded(df.select(*BAR_COLUMNS), "dollar_value", digits=4)


@C.add(
    "bars__tick",
    f"""WITH {NUMBERED}, marked AS (SELECT *, CAST((rn - 1) // 20 AS BIGINT) AS bar_id FROM t
  QUALIFY (rn - 1) // 20 < count(*) OVER (PARTITION BY symbol) // 20) {BAR_SQL}""",
)
def tick(spark, d):
    return told(bars.tick_bars(domain.ticks(spark, d), 20))


def sum_bars_sql(value: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {NUMBERED}, v AS (SELECT *, {value} AS v FROM t), walk AS (
  SELECT symbol, rn, v AS total, CAST(0 AS BIGINT) AS bar_id FROM v WHERE rn = 1
  UNION ALL SELECT v.symbol, v.rn, CASE WHEN w.total >= {threshold} THEN v.v ELSE w.total + v.v END,
    CASE WHEN w.total >= {threshold} THEN w.bar_id + 1 ELSE w.bar_id END FROM walk w JOIN v ON v.symbol = w.symbol AND v.rn = w.rn + 1
), full_bars AS (SELECT symbol, bar_id FROM walk GROUP BY 1, 2 HAVING max(total) >= {threshold}),
marked AS (SELECT t.*, bar_id FROM walk JOIN full_bars USING (symbol, bar_id) JOIN t USING (symbol, rn)) {BAR_SQL}"""


@C.add("bars__volume", sum_bars_sql("volume", 100))
def volume(spark, d):
    return told(bars.volume_bars(domain.ticks(spark, d), 100))


@C.add("bars__dollar", sum_bars_sql("price * volume", 5000))
def dollar(spark, d):
    return told(bars.dollar_bars(domain.ticks(spark, d), 5000))


@C.add(
    "bars__time",
    f"""WITH RECURSIVE {NUMBERED}, walk AS (
  SELECT symbol, rn, ts AS began, CAST(0 AS BIGINT) AS bar_id, false AS closed FROM t WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, CASE WHEN w.closed THEN t.ts ELSE w.began END, CASE WHEN w.closed THEN w.bar_id + 1 ELSE w.bar_id END,
    NOT w.closed AND t.ts - w.began >= INTERVAL 1 HOUR FROM walk w JOIN t ON t.symbol = w.symbol AND t.rn = w.rn + 1
), marked AS (SELECT t.*, bar_id FROM walk JOIN t USING (symbol, rn)) {BAR_SQL}""",
)
def time(spark, d):
    return told(bars.time_bars(domain.ticks(spark, d), "1h"))


def signed_sql(weight: str, threshold: float, runs: bool) -> str:
    """Run bars count ticks in a row, imbalance bars sum signed weights; both start anew with each bar."""
    sign = "CASE WHEN t.price > w.price THEN 1 WHEN t.price < w.price THEN -1 ELSE w.sgn END"
    total = f"CASE WHEN {sign} = 0 THEN w.total WHEN {sign} = w.sgn THEN w.total + 1 ELSE 1 END" if runs else f"w.total + ({sign}) * ({weight})"
    return f"""WITH RECURSIVE {NUMBERED}, walk AS (
  SELECT symbol, rn, price, 0 AS sgn, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS bar_id FROM t WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, t.price, CASE WHEN abs(w.total) >= {threshold} THEN 0 ELSE {sign} END,
    CASE WHEN abs(w.total) >= {threshold} THEN 0 ELSE {total} END, CASE WHEN abs(w.total) >= {threshold} THEN w.bar_id + 1 ELSE w.bar_id END
  FROM walk w JOIN t ON t.symbol = w.symbol AND t.rn = w.rn + 1
), full_bars AS (SELECT symbol, bar_id FROM walk GROUP BY 1, 2 HAVING max(abs(total)) >= {threshold}),
marked AS (SELECT t.*, bar_id FROM walk JOIN full_bars USING (symbol, bar_id) JOIN t USING (symbol, rn)) {BAR_SQL}"""


@C.add("bars__run", signed_sql("1", 3, True))
def runs(spark, d):
    return told(bars.run_bars(domain.ticks(spark, d), 3))


@C.add("bars__tick_imbalance", signed_sql("1", 4, False))
def tick_imbalance(spark, d):
    return told(bars.imbalance_bars(domain.ticks(spark, d), 4, "tick"))


@C.add("bars__volume_imbalance", signed_sql("t.volume", 25, False))
def volume_imbalance(spark, d):
    return told(bars.imbalance_bars(domain.ticks(spark, d), 25, "volume"))


@C.add("bars__dollar_imbalance", signed_sql("t.price * t.volume", 2000, False))
def dollar_imbalance(spark, d):
    return told(bars.imbalance_bars(domain.ticks(spark, d), 2000, "dollar"))


@C.add(
    "bars__trade_sign",
    f"""WITH {TICKS}, s AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, ord) AS c FROM ticks)
SELECT symbol, ord, CAST(last_value(CASE WHEN c > 0 THEN 1.0 WHEN c < 0 THEN -1.0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS sign FROM s""",
)
def signs(spark, d):
    return bars.trade_sign(domain.ticks(spark, d)).select("symbol", "ord", "sign")


@C.add(
    "bars__diagnostics",
    f"""WITH {OHLCV}, x AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM ohlcv),
y AS (SELECT ret, lag(ret) OVER (ORDER BY symbol, ts) AS prev FROM x WHERE ret IS NOT NULL)
SELECT (SELECT CAST(count(*) AS DOUBLE) FROM ohlcv) AS n_bars, {r('corr(ret, prev)')} AS lag1_return_autocorr,
  {r('corr(ret * ret, prev * prev)')} AS lag1_sq_return_autocorr, {r('stddev_samp(ret)')} AS return_std FROM y""",
)
def diagnostics(spark, d):
    return rounded(bars.bar_diagnostics(domain.ohlcv(spark, d)), "lag1_return_autocorr", "lag1_sq_return_autocorr", "return_std")


def closes(spark, d):
    return domain.ticks(spark, d).withColumnRenamed("price", "close")


@C.add(
    "filters__cusum",
    f"""WITH RECURSIVE {NUMBERED}, lr AS (SELECT symbol, ts, ord, rn, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY rn)) AS r FROM t),
walk AS (SELECT symbol, ts, ord, rn, 0e0 AS up, 0e0 AS dn, false AS fires FROM lr WHERE rn = 1
  UNION ALL SELECT symbol, ts, ord, rn, CASE WHEN NOT dn < -2.0 AND up > 2.0 THEN 0 ELSE up END, CASE WHEN dn < -2.0 THEN 0 ELSE dn END, dn < -2.0 OR up > 2.0 FROM (
    SELECT lr.symbol, lr.ts, lr.ord, lr.rn, greatest(0e0, w.up + lr.r) AS up, least(0e0, w.dn + lr.r) AS dn FROM walk w JOIN lr ON lr.symbol = w.symbol AND lr.rn = w.rn + 1))
SELECT symbol, ts, ord FROM walk WHERE fires""",
)
def cusum(spark, d):
    return filters.cusum_filter(closes(spark, d), 2.0).select("symbol", "ts", "ord")


@C.add(
    "filters__z_score",
    f"""WITH {TICKS}, s AS (SELECT symbol, ts, ord, price, row_number() OVER w AS n,
  avg(price) OVER (w ROWS 49 PRECEDING) AS m, coalesce(stddev_samp(price) OVER (w ROWS 19 PRECEDING), 0) AS sd FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, ord))
SELECT symbol, ts, ord FROM s WHERE n >= 50 AND price >= m + 1.5 * sd""",
)
def z_score(spark, d):
    return filters.z_score_filter(closes(spark, d), 50, 20, 1.5).select("symbol", "ts", "ord")


def every_tick(spark, d):
    return domain.ticks(spark, d).select("symbol", "ts")


EVENTS = f"{TICKS}, ev AS (SELECT symbol, ts, price AS p0 FROM ticks)"
BARRIERS = f"""{EVENTS}, vb AS (SELECT ev.symbol, ev.ts, ev.p0, min(t.ts) AS t1 FROM ev JOIN ticks t ON t.symbol = ev.symbol AND t.ts >= ev.ts + INTERVAL 5 HOUR GROUP BY 1, 2, 3)"""


@C.add("labeling__vertical_barrier", f"WITH {BARRIERS} SELECT symbol, ts, t1 FROM vb")
def vertical(spark, d):
    return labeling.add_vertical_barrier(every_tick(spark, d), domain.ticks(spark, d), hours=5)


def triple(spark, d, side: bool):
    ticks = domain.ticks(spark, d)
    close = ticks.select("symbol", "ts", F.col("price").alias("close"))
    target = ticks.select("symbol", "ts", (F.col("volume") / 10).alias("trgt"))
    sides = ticks.select("symbol", "ts", F.when(F.col("ord") % 2 == 0, 1.0).otherwise(-1.0).alias("side")) if side else None
    barriers = labeling.add_vertical_barrier(every_tick(spark, d), ticks, hours=5)
    events = labeling.triple_barrier_events(
        close, every_tick(spark, d), target, profit_taking=1.0, stop_loss=0.5, min_ret=0.15, barriers=barriers, side=sides, bucket_seconds=6 * 3600
    )
    return events, close


def triple_sql(side: str) -> str:
    s = f"coalesce({side}, 1e0)"
    return f"""{EVENTS}, b AS (SELECT ev.symbol, ev.ts, ev.p0, t.volume / 10 AS trgt, {side} AS side, coalesce((SELECT min(x.ts) FROM ticks x WHERE x.symbol = ev.symbol AND x.ts >= ev.ts + INTERVAL 5 HOUR), (SELECT max(x.ts) FROM ticks x WHERE x.symbol = ev.symbol)) AS v
  FROM ev JOIN ticks t ON t.symbol = ev.symbol AND t.ts = ev.ts WHERE t.volume / 10 > 0.15),
touch AS (SELECT b.symbol, b.ts, min(p.ts) AS touched FROM b JOIN ticks p ON p.symbol = b.symbol AND p.ts > b.ts AND p.ts <= b.v
  WHERE coalesce(b.side, 1e0) * (p.price / b.p0 - 1) >= b.trgt OR coalesce(b.side, 1e0) * (p.price / b.p0 - 1) <= -0.5 * b.trgt GROUP BY 1, 2),
te AS (SELECT b.symbol, b.ts, least(v, coalesce(touched, v)) AS t1, trgt, side, p0 FROM b LEFT JOIN touch USING (symbol, ts))"""


NO_SIDE, SIDE = "CAST(NULL AS DOUBLE)", "CASE WHEN t.ord % 2 = 0 THEN 1e0 ELSE -1e0 END"


@C.add("labeling__triple_barrier_events", f"WITH {triple_sql(NO_SIDE)} SELECT symbol, ts, t1, {r('trgt')} AS trgt FROM te")
def barrier_events(spark, d):
    return rounded(triple(spark, d, False)[0].drop("side"), "trgt")


@C.add(
    "labeling__triple_barrier_labels",
    f"""WITH {triple_sql(NO_SIDE)} SELECT te.symbol, te.ts, {r('p.price / p0 - 1')} AS ret, {r('trgt')} AS trgt, CAST(sign(p.price / p0 - 1) AS INT) AS label
FROM te JOIN ticks p ON p.symbol = te.symbol AND p.ts = te.t1""",
)
def barrier_labels(spark, d):
    return rounded(labeling.triple_barrier_labels(*triple(spark, d, False)).drop("side"), "ret", "trgt")


@C.add(
    "labeling__meta_labels",
    f"""WITH {triple_sql(SIDE)} SELECT te.symbol, te.ts, {r('side * (p.price / p0 - 1)')} AS ret, {r('trgt')} AS trgt, CAST(side * (p.price / p0 - 1) > 0 AS INT) AS label, side
FROM te JOIN ticks p ON p.symbol = te.symbol AND p.ts = te.t1""",
)
def meta(spark, d):
    return rounded(labeling.meta_labels(*triple(spark, d, True)), "ret", "trgt")


@C.add(
    "labeling__drop_labels",
    "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, CAST(l_linenumber AS INT) AS label FROM lineitem WHERE l_linenumber IN (SELECT l_linenumber FROM lineitem GROUP BY 1 HAVING count(*) > 0.05 * (SELECT count(*) FROM lineitem))",
)
def dropped(spark, d):
    rows = domain.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_linenumber").cast("int").alias("label"))
    return labeling.drop_labels(rows, 0.05)


CONC = f"""{TICKS}, {SPANS}, conc AS (SELECT t.symbol, t.ts, t.price, count(s.id) AS c FROM ticks t LEFT JOIN spans s ON s.symbol = t.symbol AND s.start <= t.ts AND t.ts <= s."end" GROUP BY 1, 2, 3)"""


@C.add("weights__num_concurrent_events", f"WITH {CONC} SELECT symbol, ts, CAST(c AS BIGINT) AS concurrent FROM conc")
def concurrent(spark, d):
    return timejoin.concurrency(domain.ticks(spark, d).select("symbol", "ts"), domain.spans(spark, d))


@C.add(
    "weights__by_return",
    f"""WITH {CONC}, lr AS (SELECT symbol, ts, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY ts)) / greatest(c, 1) AS r FROM conc),
w AS (SELECT s.symbol, s.id, coalesce(abs(sum(lr.r)), 0) AS raw FROM spans s LEFT JOIN lr ON lr.symbol = s.symbol AND lr.ts > s.start AND lr.ts <= s."end" GROUP BY 1, 2)
SELECT symbol, id, {r('raw * count(*) OVER (PARTITION BY symbol) / sum(raw) OVER (PARTITION BY symbol)')} AS weight FROM w""",
)
def by_return(spark, d):
    close = domain.ticks(spark, d).select("symbol", "ts", F.col("price").alias("close"))
    return rounded(weights.weights_by_return(domain.spans(spark, d), close), "weight", keep_nan=True)


UNIQUE = f"""{CONC}, uq AS (SELECT s.symbol, s.id, s.start, round(avg(1.0e0 / greatest(c, 1)), 11) AS u FROM spans s JOIN conc ON conc.symbol = s.symbol AND conc.ts BETWEEN s.start AND s."end" GROUP BY 1, 2, 3)"""


@C.add("weights__average_uniqueness", f"WITH {UNIQUE} SELECT symbol, id, {r('u')} AS uniqueness FROM uq")
def uniqueness(spark, d):
    found = weights.average_uniqueness(domain.spans(spark, d), domain.ticks(spark, d))
    return rounded(found.select("symbol", "id", "uniqueness"), "uniqueness")


def decay_sql(decay: float) -> str:
    slope = f"(1 - {decay}) / t" if decay >= 0 else f"1 / (({decay} + 1) * t)"
    return f"""WITH {UNIQUE}, c AS (SELECT symbol, id, sum(u) OVER (PARTITION BY symbol ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS c, sum(u) OVER (PARTITION BY symbol) AS t FROM uq)
SELECT symbol, id, {r(f'greatest(0e0, 1 - ({slope}) * t + ({slope}) * c)')} AS weight FROM c"""


@C.add("weights__by_time_decay", decay_sql(0.5))
def by_decay(spark, d):
    return rounded(weights.weights_by_time_decay(domain.spans(spark, d), domain.ticks(spark, d), 0.5), "weight")


@C.add("weights__by_time_decay_negative", decay_sql(-0.5))
def by_decay_negative(spark, d):
    return rounded(weights.weights_by_time_decay(domain.spans(spark, d), domain.ticks(spark, d), -0.5), "weight")


def bar_spans(spark, d):
    """Integer spans: one for each order."""
    o = domain.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("label"), (F.col("o_orderkey") * 3 % 2500).alias("start"), (F.col("o_orderkey") * 3 % 2500 + F.col("o_custkey") % 20).alias("end"))


IND = """bs AS (SELECT o_orderkey AS label, o_orderkey * 3 % 2500 AS s, o_orderkey * 3 % 2500 + o_custkey % 20 AS e FROM orders),
ind AS (SELECT label, unnest(range(s, e + 1)) AS bar FROM bs), cnt AS (SELECT bar, count(*) AS c FROM ind GROUP BY bar)"""


def indicator(spark, d):
    """Spans over every bar from the first start to the last end."""
    spans = bar_spans(spark, d)
    axis = spans.agg(F.min("start").alias("lo"), F.max("end").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("bar"))
    return weights.indicator(spans, axis)


@C.add("sampling__indicator", f"WITH {IND} SELECT bar, label FROM ind")
def ind(spark, d):
    return indicator(spark, d)


@C.add("sampling__label_uniqueness", f"WITH {IND} SELECT bar, label, {r('1.0e0 / c')} AS uniqueness FROM ind JOIN cnt USING (bar)")
def ind_unique(spark, d):
    return rounded(weights.label_uniqueness(indicator(spark, d)), "uniqueness")


@C.add("sampling__average_uniqueness", f"WITH {IND} SELECT {r('avg(u)')} AS average_uniqueness FROM (SELECT label, avg(1.0e0 / c) AS u FROM ind JOIN cnt USING (bar) GROUP BY label)")
def ind_average(spark, d):
    return rounded(weights.indicator_average_uniqueness(indicator(spark, d)), "average_uniqueness")


@C.add(
    "sampling__bootstrap_step",
    f"""WITH {IND}, p AS (SELECT bar, count(*) AS c FROM ind WHERE label % 50 = 0 GROUP BY bar)
SELECT label, {r('avg(1.0e0 / (1 + coalesce(c, 0)))')} AS average FROM ind LEFT JOIN p USING (bar) GROUP BY label""",
)
def boot_step(spark, d):
    i = indicator(spark, d)
    return rounded(weights.bootstrap_step(i, bar_spans(spark, d).where("label % 50 = 0").select("label")), "average")


@C.add("sampling__sequential_bootstrap")
def boot(spark, d):
    spans = bar_spans(spark, d).select(F.lit("all").alias("symbol"), F.col("label").alias("id"), "start", "end")
    return weights.sequential_bootstrap(spans, replicates=4, seed=7)


QUERIES, ORACLES = C.queries, C.oracles
