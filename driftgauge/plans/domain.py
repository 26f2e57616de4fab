"""The domain objects of the catalogue, made from the star schema and the event table.

Monthly panel: order value in millions by priority. Events: daily counts and values
by type. Real-time store: release k of a month sums the orders whose key modulo 3 is
at most k, and is dated 45 + 30 k days after the month's end. Forecast table:
random-walk, mean and seasonal forecasts of one series, one to three months ahead.
Sums are made in decimals, so they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import panel as P

DELAYS = {"1-URGENT": 30, "2-HIGH": 45, "3-MEDIUM": 45, "4-NOT SPECIFIED": 60, "5-LOW": 75}
SERIES = list(DELAYS)
TARGET = "1-URGENT"
MODELS = ["mean", "rw", "sn"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str):
    return F.col(column).cast("decimal(18,2)")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return P.observed(o, F.col("o_orderpriority"), F.col("day"), F.sum(money("o_totalprice")).cast("double") / 1e6)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.regularise(obs(spark, sf_dir))


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a ragged edge: each series ends by its delay, as of 2000-06-15."""
    p = panel(spark, sf_dir).join(delays(spark), "series")
    seen = F.date_add(C.end_of(F.col("period"), "M"), F.col("delay")) <= F.lit("2000-06-15").cast("date")
    return P.truncate(P.with_slots(p.select("series", "period", F.when(seen, F.col("value")).alias("value"))), None, "2000-06-01")


def delays(spark: SparkSession) -> DataFrame:
    return P.literal(spark, list(DELAYS.items()), "series string, delay int")


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarterly total, stored in the third month of its quarter."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    q = P.observed(o, F.lit("total"), F.col("day"), F.sum(money("o_totalprice")).cast("double") / 1e6, "Q")
    return P.place_at_period_end(q, "M", "Q")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"), F.pmod("o_orderkey", F.lit(3)).alias("r"), money("o_totalprice").alias("v"))
    sums = [F.sum(F.when(F.col("r") <= k, F.col("v"))).cast("double").alias(f"s{k}") for k in range(3)]
    wide = o.groupBy(F.col("o_orderpriority").alias("series"), "period").agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"s{k}") / 1e6).alias("value")) for k in range(3)]))
    return wide.select("series", "period", rows.alias("_x")).select("series", "period", F.date_add(C.end_of(F.col("period"), "M"), 45 + 30 * F.col("_x.k")).alias("vintage"), F.col("_x.value").alias("value"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("series").orderBy("period")
    p = panel(spark, sf_dir).where(F.col("series") == TARGET)
    p = p.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = []
    for h in (1, 2, 3):
        for model, f in (("rw", F.lag("value", h).over(w)), ("mean", F.lag("_m", h).over(w)), ("sn", F.lag("value", 12).over(w))):
            rows.append(F.struct(F.lit(model).alias("model"), F.lag("period", h).over(w).alias("vintage"), F.lit(h).alias("horizon"), f.alias("forecast"), F.lag("value", h).over(w).alias("previous"), F.lag("_i", h).over(w).alias("i")))
    out = p.withColumn("_x", F.array(*rows)).select("period", F.col("value").alias("actual"), F.explode("_x").alias("_x")).select("_x.*", "period", "actual")
    return out.where("i >= 24 AND forecast IS NOT NULL").drop("i")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value")
    return P.observed(e, F.col("event_type"), F.col("day"), F.sum(money("value")).cast("double"), "D")


#: The same objects as common table expressions.
SQL = """
obs AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS value FROM orders GROUP BY 1, 2),
span AS (SELECT min(period) AS lo, max(period) AS hi FROM obs),
months AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM span),
panel AS (SELECT s.series, m.period, o.value FROM (SELECT DISTINCT series FROM obs) s CROSS JOIN months m LEFT JOIN obs o ON o.series = s.series AND o.period = m.period),
delays AS (SELECT * FROM (VALUES ('1-URGENT', 30), ('2-HIGH', 45), ('3-MEDIUM', 45), ('4-NOT SPECIFIED', 60), ('5-LOW', 75)) d(series, delay)),
slotted AS (SELECT p.series, p.period, CASE WHEN last_day(p.period) + delay <= DATE '2000-06-15' THEN value END AS value FROM panel p JOIN delays USING (series) WHERE p.period <= DATE '2000-06-01'),
quarterly AS (SELECT 'total' AS series, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS value FROM orders GROUP BY 2),
store AS (SELECT series, period, CAST(last_day(period) + 45 + 30 * k AS DATE) AS vintage, CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS value FROM
  (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
    CAST(sum(CASE WHEN o_orderkey % 3 <= 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / 1e6 AS s0,
    CAST(sum(CASE WHEN o_orderkey % 3 <= 1 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / 1e6 AS s1,
    CAST(sum(CASE WHEN o_orderkey % 3 <= 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / 1e6 AS s2
   FROM orders GROUP BY 1, 2), (VALUES (0), (1), (2)) t(k)),
base AS (SELECT period, value, row_number() OVER (ORDER BY period) AS i, avg(value) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) AS m FROM panel WHERE series = '1-URGENT'),
fc AS (SELECT * FROM (SELECT model, v.period AS vintage, CAST(t.i - v.i AS INTEGER) AS horizon, CASE model WHEN 'rw' THEN v.value WHEN 'mean' THEN v.m ELSE s.value END AS forecast, v.value AS previous, t.period, t.value AS actual
  FROM base v JOIN base t ON t.i BETWEEN v.i + 1 AND v.i + 3 CROSS JOIN (VALUES ('rw'), ('mean'), ('sn')) mm(model) LEFT JOIN base s ON s.i = t.i - 12 WHERE v.i >= 24) WHERE forecast IS NOT NULL),
err AS (SELECT *, actual - forecast AS error FROM fc WHERE actual - forecast IS NOT NULL),
daily AS (SELECT event_type AS series, CAST(ts AS DATE) AS period, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2)
"""
