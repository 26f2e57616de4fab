"""Queries on panels, transforms, cleaning and aggregation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import aggregation as A
from ..operators import cleaning as K
from ..operators import panel as P
from ..operators import transforms as T
from ..operators import vintages as V
from . import domain as D
from .catalogue import query


def rounded(df, *cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


def values(df):
    return rounded(df.select("series", "period", "value"), "value")


@query("""+ g AS (SELECT p.series, p.period, value, value / nullif(lag(value) OVER w, 0) - 1 AS growth FROM panel p WINDOW w AS (PARTITION BY series ORDER BY period)),
r AS (SELECT g.*, last_day(period) + delay <= DATE '2000-06-15' AS released FROM g JOIN delays USING (series) WHERE period <= DATE '2000-06-01'),
z AS (SELECT series, period, growth, released, (growth - avg(CASE WHEN released THEN growth END) OVER (PARTITION BY series)) / nullif(stddev_samp(CASE WHEN released THEN growth END) OVER (PARTITION BY series), 0) AS z FROM r)
SELECT series, max(CASE WHEN released AND z IS NOT NULL THEN period END) AS last_period, round(arg_max(z, CASE WHEN released AND z IS NOT NULL THEN period END), 9) AS latest_z, CAST(sum(CASE WHEN NOT released THEN 1 ELSE 0 END) AS BIGINT) AS n_ragged FROM z GROUP BY series""")
def asof_panel_growth(spark, sf):
    """The panel as of a date: growth, latest z-score and ragged edge by series."""
    growth = T.apply(D.panel(spark, sf), "pct")
    p = V.schedule(P.truncate(growth, None, "2000-06-01"), D.delays(spark))
    p = p.withColumn("ok", F.col("release_date") <= F.lit("2000-06-15").cast("date"))
    seen = F.when(F.col("ok"), F.col("value"))
    p = p.withColumn("z", (F.col("value") - F.avg(seen).over(P.whole())) / F.nullif(F.stddev_samp(seen).over(P.whole()), F.lit(0.0)))
    at = F.when(F.col("ok") & F.col("z").isNotNull(), F.col("period"))
    return p.groupBy("series").agg(F.max(at).alias("last_period"), F.round(F.max_by("z", at), 9).alias("latest_z"), F.sum((~F.col("ok")).cast("long")).alias("n_ragged"))


@query("SELECT series, period, round(value, 9) AS value FROM panel")
def panel_monthly(spark, sf):
    return values(D.panel(spark, sf))


@query("SELECT series, period, round(value, 9) AS value, CAST(month(period) % 3 = 0 AS BOOLEAN) AS slot FROM (SELECT 'total' AS series, m.period, q.value FROM months m LEFT JOIN quarterly q USING (period))")
def panel_slots_quarterly(spark, sf):
    months = D.panel(spark, sf).select("period").distinct().withColumn("series", F.lit("total"))
    p = months.join(D.quarterly(spark, sf), ["series", "period"], "left").select("series", "period", "value")
    return rounded(P.with_slots(p, "M", {"total": "Q"}), "value")


@query("SELECT series, CAST(sum(CASE WHEN value IS NULL AND (l IS NULL OR period > l) THEN 1 ELSE 0 END) AS BIGINT) AS n_ragged, max(l) AS last_observed FROM (SELECT *, max(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY series) AS l FROM slotted) GROUP BY series")
def ragged_edge(spark, sf):
    m = P.masks(D.slotted(spark, sf))
    return m.groupBy("series").agg(F.sum(F.col("ragged").cast("long")).alias("n_ragged"), F.max(F.when(F.col("observed"), F.col("period"))).alias("last_observed"))


@query("""+ w AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY series) AS f, max(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY series) AS l FROM slotted)
SELECT series, CAST(sum(CASE WHEN value IS NULL AND period < f THEN 1 ELSE 0 END) AS BIGINT) AS n_leading, CAST(sum(CASE WHEN value IS NULL AND period > f AND period < l THEN 1 ELSE 0 END) AS BIGINT) AS n_interior FROM w GROUP BY series""")
def leading_interior_missing(spark, sf):
    m = P.masks(D.slotted(spark, sf))
    return m.groupBy("series").agg(F.sum(F.col("leading").cast("long")).alias("n_leading"), F.sum(F.col("interior").cast("long")).alias("n_interior"))


@query("SELECT series, CAST(count(*) AS BIGINT) AS n_slots, count(value) AS n_observations, min(CASE WHEN value IS NOT NULL THEN period END) AS first_observed, max(CASE WHEN value IS NOT NULL THEN period END) AS last_observed, round(1 - count(value) / count(*), 9) AS missing_share FROM slotted GROUP BY series")
def missing_proportion(spark, sf):
    return rounded(P.summary(D.slotted(spark, sf)), "missing_share")


@query("""+ both_ AS (SELECT series, period, value FROM slotted UNION ALL SELECT series, period, value FROM quarterly)
SELECT series, CASE WHEN count(value) < 2 THEN 'M' WHEN bool_and(month(period) = 12) FILTER (value IS NOT NULL) THEN 'A' WHEN bool_and(month(period) % 3 = 0) FILTER (value IS NOT NULL) THEN 'Q' ELSE 'M' END AS frequency FROM both_ GROUP BY series""")
def infer_frequency(spark, sf):
    p = D.slotted(spark, sf).select("series", "period", "value").union(D.quarterly(spark, sf).select("series", "period", "value"))
    return P.infer_frequency(p)


@query("""+ g AS (SELECT * FROM (VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('3-MEDIUM', 'slow'), ('4-NOT SPECIFIED', 'slow'), ('5-LOW', 'slow'), ('5-LOW', 'last')) t(series, label)),
per AS (SELECT CAST(date_trunc('quarter', period) AS DATE) AS native, series, count(value) AS released, count(*) AS expected FROM slotted GROUP BY 1, 2),
lab AS (SELECT native, label, released, expected FROM per JOIN g USING (series) UNION ALL SELECT native, 'total', released, expected FROM per)
SELECT native, label, CAST(sum(released) AS BIGINT) AS released, CAST(sum(expected) AS BIGINT) AS expected, round(avg(released / expected), 9) AS share FROM lab GROUP BY 1, 2""")
def released_share_by_category(spark, sf):
    groups = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast"), ("3-MEDIUM", "slow"), ("4-NOT SPECIFIED", "slow"), ("5-LOW", "slow"), ("5-LOW", "last")], "series string, label string")
    return rounded(P.released_share(D.slotted(spark, sf), C.start_of(F.col("period"), "Q"), groups), "share")


@query("SELECT series, period, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 9) AS value FROM panel WINDOW w AS (PARTITION BY series)")
def standardize(spark, sf):
    return values(P.standardise(D.panel(spark, sf)))


@query("SELECT series, period, round(value, 9) AS value FROM panel")
def destandardize(spark, sf):
    p = D.panel(spark, sf)
    stats = P.standardise_stats(p)
    return values(P.destandardise(P.standardise(p, stats), stats))


def _transform(name, spec, sql):
    def run(spark, sf):
        return values(T.apply(D.panel(spark, sf), spec))

    run.__name__ = name
    query(sql)(run)


_LAG = "SELECT series, period, round({}, 9) AS value FROM panel WINDOW w AS (PARTITION BY series ORDER BY period)"
_transform("transform_diff", "diff", _LAG.format("value - lag(value) OVER w"))
_transform("transform_pct_change", "pct", _LAG.format("(value - lag(value) OVER w) / nullif(lag(value) OVER w, 0)"))
_transform("transform_log", "log", _LAG.format("ln(value)"))
_transform("transform_scale", "scale:100", _LAG.format("value * 100"))
_transform("transform_dlog", "dlog", _LAG.format("ln(value) - lag(ln(value)) OVER w"))
_transform("transform_yoy", 6, _LAG.format("(value - lag(value, 12) OVER w) / nullif(lag(value, 12) OVER w, 0)"))
_transform("transform_annual_diff", 5, _LAG.format("value - lag(value, 12) OVER w"))
_transform("transform_diff_of_annual_diff", 4, _LAG.format("(value - lag(value, 12) OVER w) - (lag(value) OVER w - lag(value, 13) OVER w)"))
_transform("transform_qoq", 7, _LAG.format("(value - lag(value, 3) OVER w) / nullif(lag(value, 3) OVER w, 0)"))
_transform("transform_diff_of_yoy", 3, _LAG.format("(value - lag(value, 12) OVER w) / nullif(lag(value, 12) OVER w, 0) - (lag(value) OVER w - lag(value, 13) OVER w) / nullif(lag(value, 13) OVER w, 0)"))


def _inverse(name, spec):
    def run(spark, sf):
        p = D.panel(spark, sf)
        first = F.row_number().over(P.by()) <= T.n_lags(spec)
        history = p.withColumn("_f", first).select("series", "period", F.when(F.col("_f"), F.col("value")).alias("value"))
        return values(T.invert(T.apply(K.fill_linear(p), spec), history, spec).where(F.col("series") == D.TARGET))

    run.__name__ = name
    query("""+ n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (ORDER BY i) AS a, min(CASE WHEN value IS NOT NULL THEN i END) OVER (ORDER BY i DESC) AS b FROM base)
SELECT '1-URGENT' AS series, n.period, round(coalesce(n.value, x.value + (y.value - x.value) * (n.i - n.a) / (n.b - n.a)), 9) AS value FROM n LEFT JOIN base x ON x.i = n.a LEFT JOIN base y ON y.i = n.b""")(run)


_inverse("inverse_diff", "diff")
_inverse("inverse_pct_change", "pct")

_Q = "+ q AS (SELECT *, quantile_cont(value, 0.25) OVER s AS lo, quantile_cont(value, 0.5) OVER s AS mid, quantile_cont(value, 0.75) OVER s AS hi, count(value) OVER s AS n FROM panel WINDOW s AS (PARTITION BY series)), o AS (SELECT *, coalesce(n >= 4 AND hi > lo AND abs(value - mid) > 1.5 * (hi - lo), false) AS outlier FROM q)"


@query(_Q + " SELECT series, period, round(value, 9) AS value, outlier FROM o")
def iqr_outliers(spark, sf):
    return rounded(K.outliers(D.panel(spark, sf), 1.5), "value")


@query(_Q + ", r AS (SELECT *, CASE WHEN NOT outlier THEN value END AS rest FROM o) SELECT series, period, outlier, round(CASE WHEN outlier THEN coalesce(quantile_cont(rest, 0.5) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), quantile_cont(rest, 0.5) OVER (PARTITION BY series)) ELSE value END, 9) AS value FROM r")
def replace_outliers_moving_median(spark, sf):
    return rounded(K.replace_outliers(D.panel(spark, sf), 1.5), "value")


@query("SELECT series, period, round(quantile_cont(value, 0.5) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 9) AS value FROM panel")
def moving_median_even(spark, sf):
    return values(K.moving_median(D.panel(spark, sf), 4))


_GAPS = "+ g AS (SELECT series, period, CASE WHEN month(period) % 4 <> 1 THEN value END AS value, row_number() OVER (PARTITION BY series ORDER BY period) AS i FROM panel)"


def _gaps(spark, sf):
    return D.panel(spark, sf).withColumn("value", F.when(F.month("period") % 4 != 1, F.col("value")))


@query(_GAPS + """, n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i) AS a, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i DESC) AS b FROM g)
SELECT n.series, n.period, round(coalesce(n.value, x.value + (y.value - x.value) * (n.i - n.a) / (n.b - n.a)), 9) AS value FROM n LEFT JOIN g x ON x.series = n.series AND x.i = n.a LEFT JOIN g y ON y.series = n.series AND y.i = n.b""")
def fill_linear(spark, sf):
    return values(K.fill_linear(_gaps(spark, sf)))


@query("""+ r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value IS NULL, period DESC) AS k, max(CASE WHEN value IS NOT NULL THEN period END) OVER (PARTITION BY series) AS l FROM slotted)
SELECT series, period, round(coalesce(value, CASE WHEN period > l THEN quantile_cont(CASE WHEN k <= 3 THEN value END, 0.5) OVER (PARTITION BY series) END), 9) AS value FROM r""")
def fill_edge_median(spark, sf):
    return values(K.fill_edges(D.slotted(spark, sf).select("series", "period", "value")))


def _lower(name, how, sql, complete=True):
    def run(spark, sf):
        return values(A.to_lower(D.panel(spark, sf), "M", "Q", how, complete))

    run.__name__ = name
    query(f"SELECT series, CAST(date_trunc('quarter', period) AS DATE) AS period, round({f'CASE WHEN count(value) = 3 THEN {sql} END' if complete else sql}, 9) AS value FROM panel GROUP BY 1, 2")(run)


_lower("month_to_quarter_mean", "mean", "avg(value)")
_lower("month_to_quarter_sum", "sum", "sum(value)")
_lower("month_to_quarter_last", "last", "max(CASE WHEN month(period) % 3 = 0 THEN value END)")
_lower("month_to_quarter_first", "first", "max(CASE WHEN month(period) % 3 = 1 THEN value END)")
_lower("month_to_quarter_middle", "middle", "max(CASE WHEN month(period) % 3 = 2 THEN value END)")
_lower("month_to_quarter_partial", "mean", "avg(value)", complete=False)


@query("""SELECT series, CAST(date_trunc('quarter', period) AS DATE) AS period, round((value + 2 * lag(value) OVER w + 3 * lag(value, 2) OVER w + 2 * lag(value, 3) OVER w + lag(value, 4) OVER w) / 3, 9) AS value FROM panel WINDOW w AS (PARTITION BY series ORDER BY period) QUALIFY month(period) % 3 = 0""")
def mm_filter(spark, sf):
    return values(A.rolling_to_slots(D.panel(spark, sf), "M", "Q"))


def _higher(name, how, sql):
    def run(spark, sf):
        q = D.quarterly(spark, sf).withColumn("period", C.start_of(F.col("period"), "Q"))
        return values(A.to_higher(q, "Q", "M", how))

    run.__name__ = name
    query("+ f AS (SELECT series, CAST(period - to_months(2 - k) AS DATE) AS period, value, k FROM quarterly, (VALUES (0), (1), (2)) t(k)) SELECT series, period, round(" + sql + ", 9) AS value FROM f")(run)


_higher("quarter_to_month_repeat", "repeat", "value")
_higher("quarter_to_month_divide", "divide", "value / 3")
_higher("quarter_to_month_end", "end", "CASE WHEN k = 2 THEN value END")
_higher("quarter_to_month_linear", "linear", "CASE WHEN k = 2 THEN value ELSE lag(value, k + 1) OVER (ORDER BY period) + (value - lag(value, k + 1) OVER (ORDER BY period)) * (k + 1) / 3 END")


@query("""+ w AS (SELECT DISTINCT CAST(date_trunc('week', period) AS DATE) AS period FROM daily),
n AS (SELECT period, CAST(date_trunc('month', period + 6) AS DATE) AS native FROM w),
c AS (SELECT period, native, CAST(floor(date_diff('day', native, period + 6) / 7) AS INTEGER) AS pos, CAST(floor(date_diff('day', DATE '1970-01-04', last_day(native)) / 7) - floor(date_diff('day', DATE '1970-01-04', native - 1) / 7) AS INTEGER) AS len FROM n)
SELECT native, period, round((len - pos) / len, 9) AS weight FROM c UNION ALL SELECT CAST(native + INTERVAL 1 MONTH AS DATE), period, round(pos / len, 9) FROM c WHERE pos > 0""")
def weekly_calendar_weights(spark, sf):
    weeks = D.events_daily(spark, sf).select(F.trunc("period", "week").alias("period")).distinct()
    return rounded(A.calendar_weights(weeks, "W", "M"), "weight")


@query("""+ q AS (SELECT series, CAST(date_trunc('week', period) AS DATE) AS period, count(value) AS n, sum(value) AS s FROM daily GROUP BY 1, 2) SELECT series, period, round(CASE WHEN n = 7 THEN s END, 2) AS value FROM q""")
def daily_to_weekly(spark, sf):
    return rounded(A.to_lower(D.events_daily(spark, sf), "D", "W", "sum").select("series", "period", "value"), "value", n=2)


@query("""+ t AS (SELECT series, period, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS value FROM panel WINDOW w AS (PARTITION BY series ORDER BY period)),
k AS (SELECT * FROM t QUALIFY avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY series) <= 1.0 / 3),
q AS (SELECT *, quantile_cont(value, 0.25) OVER s AS lo, quantile_cont(value, 0.5) OVER s AS mid, quantile_cont(value, 0.75) OVER s AS hi, count(value) OVER s AS n FROM k WINDOW s AS (PARTITION BY series)),
o AS (SELECT *, CASE WHEN NOT coalesce(n >= 4 AND hi > lo AND abs(value - mid) > 4 * (hi - lo), false) THEN value END AS rest FROM q),
m AS (SELECT series, period, row_number() OVER (PARTITION BY series ORDER BY period) AS i, CASE WHEN value IS NOT NULL AND rest IS NULL THEN coalesce(quantile_cont(rest, 0.5) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), quantile_cont(rest, 0.5) OVER (PARTITION BY series)) ELSE value END AS value FROM o),
n AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i) AS a, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i DESC) AS b FROM m)
SELECT n.series, n.period, round(coalesce(n.value, x.value + (y.value - x.value) * (n.i - n.a) / (n.b - n.a)), 9) AS value FROM n LEFT JOIN m x ON x.series = n.series AND x.i = n.a LEFT JOIN m y ON y.series = n.series AND y.i = n.b""")
def prepare_panel(spark, sf):
    return values(K.prepare(D.panel(spark, sf), "pct"))


@query("""SELECT series || CASE WHEN k > 0 THEN '_lag' || k ELSE '' END AS series, period, round(v, 9) AS value FROM (SELECT series, period, 0 AS k, value AS v FROM panel UNION ALL SELECT series, period, 1, lag(value) OVER (PARTITION BY series ORDER BY period) FROM panel UNION ALL SELECT series, period, 2, lag(value, 2) OVER (PARTITION BY series ORDER BY period) FROM panel)""")
def lagged_copies(spark, sf):
    return values(A.lagged(D.panel(spark, sf), [0, 1, 2]))


@query("SELECT CAST(period AS DATE) AS period, " + ", ".join(f"round(max(CASE WHEN series = '{s}' THEN value END), 9) AS \"p{s[0]}\"" for s in D.SERIES) + " FROM panel GROUP BY 1")
def panel_wide(spark, sf):
    wide = P.pivot(D.panel(spark, sf), D.SERIES)
    return wide.select("period", *[F.round(F.col(f"`{s}`"), 9).alias(f"p{s[0]}") for s in D.SERIES])


@query("SELECT series, period, round(value, 9) AS value FROM panel UNION ALL SELECT s.series, CAST(hi + to_months(k) AS DATE), NULL FROM (SELECT DISTINCT series FROM obs) s, span, (VALUES (1), (2), (3)) t(k)")
def extend_panel(spark, sf):
    return values(P.extend(D.panel(spark, sf), 3))


@query("SELECT series, period, round(value, 9) AS value FROM panel WHERE period BETWEEN DATE '1998-01-01' AND DATE '1999-12-01'")
def truncate_panel(spark, sf):
    return values(P.truncate(D.panel(spark, sf), "1998-01-01", "1999-12-01"))


@query("""+ k AS (SELECT event_type, CAST(ts AS DATE) AS period, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type AS series, period, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS lowest, max(k) AS highest FROM k GROUP BY 1, 2""")
def event_props_json_panel(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("period"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("series", "period").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.min("k").alias("lowest"), F.max("k").alias("highest"))


@query("""+ s AS (SELECT c_mktsegment AS series, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, r_name AS region, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT series, region, period, round(value, 9) AS value FROM s""")
def panel_by_segment_and_region(spark, sf):
    """Series with block labels through the star joins; the dimensions are the small sides."""
    o = D.table(spark, sf, "orders").select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("period"), D.money("o_totalprice").alias("v"))
    c = D.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("c_mktsegment").alias("series"), F.col("r_name").alias("region"), "period").agg(F.round(F.sum("v").cast("double") / 1e6, 9).alias("value"))


del Window
