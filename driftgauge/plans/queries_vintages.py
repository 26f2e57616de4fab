"""Queries on release calendars, vintages and revisions."""

from pyspark.sql import functions as F

from ..operators import vintages as V
from . import domain as D
from .catalogue import query
from .queries_panel import rounded, values

_SCHED = "+ sched AS (SELECT p.series, period, value, CAST(CASE WHEN series = '5-LOW' AND month(period) = 12 THEN period + 100 ELSE last_day(period) + delay END AS DATE) AS release_date FROM panel p JOIN delays USING (series)) "


def _scheduled(spark, sf):
    p = D.panel(spark, sf)
    explicit = p.where((F.col("series") == "5-LOW") & (F.month("period") == 12)).select("series", "period", F.date_add("period", 100).alias("date"))
    return V.schedule(p, D.delays(spark), explicit)


@query(_SCHED + "SELECT series, period, release_date FROM sched WHERE value IS NOT NULL")
def release_schedule(spark, sf):
    p = D.panel(spark, sf)
    explicit = p.where((F.col("series") == "5-LOW") & (F.month("period") == 12)).select("series", "period", F.date_add("period", 100).alias("date"))
    return V.schedule(p, D.delays(spark), explicit, observed_only=True).select("series", "period", "release_date")


@query(_SCHED + "SELECT series, period, round(CASE WHEN release_date <= DATE '1999-03-15' THEN value END, 9) AS value FROM sched")
def release_mask(spark, sf):
    return values(V.release_mask(_scheduled(spark, sf), "1999-03-15"))


@query(_SCHED + "SELECT series, period, release_date FROM sched WHERE release_date > DATE '1999-03-15' AND release_date <= DATE '1999-09-15'")
def releases_between(spark, sf):
    return V.releases_between(_scheduled(spark, sf), "1999-03-15", "1999-09-15").select("series", "period", "release_date")


@query(_SCHED + "SELECT series, max(period) AS last_released FROM sched WHERE release_date <= DATE '1999-03-15' GROUP BY 1")
def available_at(spark, sf):
    return V.available_at(_scheduled(spark, sf), "1999-03-15")


@query("SELECT CAST(DATE '1996-01-31' + to_months(k) AS DATE) AS vintage FROM (SELECT unnest(generate_series(0, 59)) AS k)")
def vintage_dates(spark, sf):
    return V.vintage_grid(D.obs(spark, sf).agg(F.count("*").alias("n")), "1996-01-31", "2000-12-31")


@query(_SCHED + """, v AS (SELECT CAST(DATE '1996-01-15' + to_months(k) AS DATE) AS vintage FROM (SELECT unnest(generate_series(0, 59)) AS k))
SELECT vintage, count(*) AS n_cells, max(period) AS last_period, round(sum(value), 6) AS total FROM sched JOIN v ON release_date <= vintage WHERE value IS NOT NULL GROUP BY 1""")
def pseudo_real_time_vintages(spark, sf):
    grid = V.vintage_grid(D.obs(spark, sf).agg(F.count("*").alias("n")), "1996-01-15", "2000-12-15")
    rows = V.masked_vintages(_scheduled(spark, sf), grid)
    return rows.groupBy("vintage").agg(F.count("*").alias("n_cells"), F.max("period").alias("last_period"), F.round(F.sum("value"), 6).alias("total"))


@query(_SCHED + """, v AS (SELECT CAST(DATE '1996-01-15' + to_days(7 * k) AS DATE) AS vintage FROM (SELECT unnest(generate_series(0, 150)) AS k)),
n AS (SELECT vintage, count(*) AS n_cells FROM sched JOIN v ON release_date <= vintage WHERE value IS NOT NULL GROUP BY 1)
SELECT * FROM n QUALIFY lag(n_cells) OVER (ORDER BY vintage) IS DISTINCT FROM n_cells""")
def generate_vintages_skip_unchanged(spark, sf):
    grid = D.obs(spark, sf).agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(150))).alias("k")).select(F.date_add(F.lit("1996-01-15").cast("date"), 7 * F.col("k")).alias("vintage"))
    return V.masked_vintages(_scheduled(spark, sf), grid, True).groupBy("vintage").agg(F.count("*").alias("n_cells"))


@query("+ k AS (SELECT series, period, arg_max_null(value, vintage) AS value, max(vintage) AS vintage FROM store WHERE vintage <= DATE '1999-06-15' GROUP BY 1, 2) SELECT series, period, vintage, round(value, 9) AS value FROM k WHERE value IS NOT NULL")
def as_of_store(spark, sf):
    return rounded(V.as_of(D.store(spark, sf), "1999-06-15"), "value").select("series", "period", "vintage", "value")


@query("""+ s AS (SELECT period, vintage, value FROM store WHERE series = '1-URGENT'), d AS (SELECT DISTINCT vintage FROM s)
SELECT s.period, d.vintage, round(arg_max_null(s.value, s.vintage), 9) AS value FROM s JOIN d ON s.vintage <= d.vintage GROUP BY 1, 2""")
def vintage_matrix(spark, sf):
    return rounded(V.vintage_matrix(D.store(spark, sf), D.TARGET), "value").select("period", "vintage", "value")


_REV = """+ ch AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS k FROM store WINDOW w AS (PARTITION BY series, period ORDER BY vintage)),
rev AS (SELECT series, period, vintage, value, row_number() OVER (PARTITION BY series, period ORDER BY vintage) - 1 AS release_number, before AS previous_value, value - before AS revision FROM ch WHERE k = 1 OR before IS DISTINCT FROM value),
top AS (SELECT *, max(release_number) OVER (PARTITION BY series, period) AS m FROM rev) """


@query(_REV + "SELECT series, period, vintage, release_number, round(value, 9) AS value, round(previous_value, 9) AS previous_value, round(revision, 9) AS revision FROM rev")
def revisions(spark, sf):
    return rounded(V.revisions(D.store(spark, sf)), "value", "previous_value", "revision")


@query(_REV + ", l AS (SELECT series, period, (list({'v': vintage, 'x': value} ORDER BY vintage))[2] AS r FROM rev GROUP BY 1, 2) SELECT series, period, r.v AS vintage, round(r.x, 9) AS value FROM l WHERE r IS NOT NULL")
def nth_release(spark, sf):
    return rounded(V.nth_release(D.store(spark, sf), 1), "value")


@query(_REV + "SELECT series, period, vintage, round(value, 9) AS value FROM top WHERE release_number = m")
def last_release(spark, sf):
    return rounded(V.nth_release(D.store(spark, sf), -1), "value")


@query(_REV + """, d AS (SELECT a.series, a.value AS a, b.value AS b, b.value - a.value AS r FROM top a JOIN top b ON a.series = b.series AND a.period = b.period AND a.release_number = 0 AND b.release_number = b.m)
SELECT series, count(r) AS n_periods, CAST(sum(CASE WHEN r <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_revised, round(avg(r), 10) AS mean_revision, round(avg(abs(r)), 10) AS mean_absolute, round(sqrt(avg(r * r)), 10) AS rms, round(stddev_samp(r), 10) AS std_revision, round(max(abs(r)), 9) AS max_absolute, round(stddev_samp(r) / nullif(stddev_samp(b), 0), 10) AS noise_to_signal FROM d GROUP BY series""")
def revision_summary(spark, sf):
    s = rounded(V.revision_summary(D.store(spark, sf)), "mean_revision", "mean_absolute", "rms", "std_revision", "noise_to_signal", n=10)
    return rounded(s, "max_absolute")


_ASOF = "(SELECT series, period, arg_max_null(value, vintage) AS value FROM store WHERE vintage <= DATE '{}' GROUP BY 1, 2)"


@query(f"""+ o AS (SELECT * FROM {_ASOF.format('1999-06-15')} WHERE value IS NOT NULL), n AS (SELECT * FROM {_ASOF.format('1999-09-15')} WHERE value IS NOT NULL),
j AS (SELECT coalesce(o.series, n.series) AS series, coalesce(o.period, n.period) AS period, o.value AS old, n.value AS new FROM o FULL JOIN n ON o.series = n.series AND o.period = n.period)
SELECT series, period, CASE WHEN old IS NULL THEN 'released' WHEN new IS NULL THEN 'removed' ELSE 'revised' END AS kind, round(old, 9) AS old, round(new, 9) AS new, round(new - old, 9) AS revision FROM j WHERE old IS DISTINCT FROM new""")
def data_revisions(spark, sf):
    s = D.store(spark, sf)
    return rounded(V.compare(V.as_of(s, "1999-06-15"), V.as_of(s, "1999-09-15")), "old", "new", "revision")


@query("""+ v AS (SELECT CAST(DATE '1999-01-31' + to_months(3 * k) AS DATE) AS vintage FROM (SELECT unnest(generate_series(0, 7)) AS k)),
w AS (SELECT v.vintage, s.series, s.period, arg_max_null(s.value, s.vintage) AS value FROM store s JOIN v ON s.vintage <= v.vintage GROUP BY 1, 2, 3),
c AS (SELECT c.series, c.period, v.vintage, w.value FROM (SELECT DISTINCT series, period FROM w) c CROSS JOIN v LEFT JOIN w ON w.series = c.series AND w.period = c.period AND w.vintage = v.vintage)
SELECT series, period, vintage, round(value, 9) AS value FROM c QUALIFY value IS DISTINCT FROM lag(value) OVER (PARTITION BY series, period ORDER BY vintage)""")
def store_from_vintages(spark, sf):
    s = D.store(spark, sf)
    grid = V.vintage_grid(s.agg(F.count("*").alias("n")), "1999-01-31", "2000-10-31", 3)
    rows = V.at_dates(s.select("series", "period", F.col("vintage").alias("_v"), "value"), grid, lambda v: F.col("_v") <= v)
    wide = rows.groupBy("vintage", "series", "period").agg(F.max_by("value", "_v").alias("value"))
    return rounded(V.store_from_vintages(wide), "value")


@query(_SCHED + "SELECT series, period, release_date AS vintage, round(value, 9) AS value FROM sched WHERE value IS NOT NULL")
def store_from_calendar(spark, sf):
    return rounded(V.store_from_calendar(_scheduled(spark, sf)), "value")


@query("SELECT DISTINCT vintage FROM store")
def store_vintage_dates(spark, sf):
    return D.store(spark, sf).select("vintage").distinct()
