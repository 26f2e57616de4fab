"""Relational operators on small hand-made panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftgauge.functions import calendar as C
from driftgauge.operators import aggregation as A
from driftgauge.operators import cleaning as K
from driftgauge.operators import panel as P
from driftgauge.operators import transforms as T
from driftgauge.operators import vintages as V
from driftgauge.sources import files


def month(k):
    return dt.date(2000 + k // 12, k % 12 + 1, 1)


def make(spark, **series):
    rows = [(s, month(k), None if v is None else float(v)) for s, vs in series.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, period date, value double")


def values(df, series):
    return [r.value for r in df.where(F.col("series") == series).orderBy("period").collect()]


def test_regularise_and_check(spark):
    p = make(spark, a=[1, 2, 3, 4]).where(F.col("period") != month(2))
    assert values(P.regularise(p), "a") == [1, 2, None, 4]
    assert P.check(p, "M", {}).isEmpty()
    assert P.check(p, "M", {"a": "Q"}).count() == 3
    assert P.check(p.union(p), "M", {}).count() == 3


def test_masks(spark):
    p = P.with_slots(make(spark, a=[None, 1, None, 2, None], b=[None] * 5))
    rows = {(r.series, r.period): r for r in P.masks(p).collect()}
    assert [rows["a", month(k)].leading for k in range(5)] == [True, False, False, False, False]
    assert [rows["a", month(k)].interior for k in range(5)] == [False, False, True, False, False]
    assert [rows["a", month(k)].ragged for k in range(5)] == [False, False, False, False, True]
    assert all(rows["b", month(k)].ragged and not rows["b", month(k)].leading for k in range(5))


def test_outliers_need_four_values_and_a_range(spark):
    p = make(spark, a=[1, 2, 3, 2, 1, 2, 100], b=[1, 1, 1, 1, 1, 1, 9], c=[1, 50, None, None, None, None, None])
    out = K.replace_outliers(p)
    assert values(out.withColumn("value", F.col("outlier").cast("double")), "a")[-1] == 1
    assert values(out, "a")[-1] == 2 and values(out, "b")[-1] == 9 and values(out, "c")[1] == 50


def test_fills(spark):
    p = make(spark, a=[None, 1, None, None, 4, 6, None])
    assert values(K.fill_linear(p), "a") == [None, 1, 2, 3, 4, 6, None]
    assert values(K.fill_edges(p), "a")[-1] == 4 and values(K.fill_edges(p, method="mean", window=2), "a")[-1] == 5
    assert values(K.fill_edges(p, leading=True), "a")[0] == 4
    assert values(K.fill_nearest_median(p), "a")[2:4] == [1, 4]


def test_moving_average_ignores_zero_weights(spark):
    p = make(spark, a=[1, None, 3, 4])
    assert values(K.weighted_moving_average(p, [1.0, 0.0, 1.0]), "a") == [None, None, 4, None]


def test_transforms(spark):
    p = make(spark, a=[1, 0, 2, 4], b=[1, -1, None, 2])
    assert values(T.apply(p, "pct"), "a") == [None, -1, None, 1]
    assert values(T.apply(p, "log"), "b")[1] is None
    assert values(T.apply_each(p, {"a": "diff"}), "a") == [None, -1, 2, 2] and values(T.apply_each(p, {"a": "diff"}), "b") == [1, -1, None, 2]
    with pytest.raises(ValueError):
        T.parse("nonsense")


def test_aggregation_counts_calendar_length(spark):
    p = make(spark, a=[1, 2, 3, 4, 5])
    assert values(A.to_lower(p, "M", "Q", "mean"), "a") == [2, None]
    assert values(A.to_lower(p, "M", "Q", "mean", complete=False), "a") == [2, 4.5]
    assert values(A.to_lower(p, "M", "Q", 1, complete=False), "a") == [2, 5]


def test_weeks_belong_to_the_month_of_their_last_day(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 29),), (dt.date(2024, 2, 26),)], "w date")
    rows = d.select(C.native_of(F.col("w"), "W", "M").alias("m"), C.position(F.col("w"), "W", "M").alias("p"), C.native_length(F.col("w"), "W", "M").alias("n")).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 2, 1), 0, 4), (dt.date(2024, 3, 1), 0, 5)]


def test_withdrawn_and_repeated_records(spark):
    s = spark.createDataFrame([("a", month(0), dt.date(2000, 2, 1), 1.0), ("a", month(0), dt.date(2000, 3, 1), 1.0), ("a", month(0), dt.date(2000, 4, 1), None), ("a", month(0), dt.date(2000, 5, 1), 2.0)], files.STORE)
    assert V.as_of(s, "2000-03-15").first().value == 1.0 and V.as_of(s, "2000-04-15").isEmpty()
    r = V.revisions(s).orderBy("vintage").collect()
    assert [(x.release_number, x.value) for x in r] == [(0, 1.0), (1, None), (2, 2.0)]
    assert V.nth_release(s, -1).first().value == 2.0 and V.nth_release(s, 1).first().value is None


def test_release_is_inclusive(spark):
    delays = spark.createDataFrame([("a", 10)], "series string, delay int")
    p = V.schedule(make(spark, a=[1, 2]), delays)
    assert values(V.release_mask(p, "2000-02-10"), "a") == [1, None] and values(V.release_mask(p, "2000-02-09"), "a") == [None, None]
    assert V.releases_between(p, "2000-02-10", "2000-03-10").count() == 1


def test_standardise_round_trip(spark):
    p = make(spark, a=[1, 2, 4, 8], b=[5, 5, 5, 5])
    stats = P.standardise_stats(p)
    assert P.equals(P.destandardise(P.standardise(p.where("series = 'a'"), stats), stats), p.where("series = 'a'"), 1e-9)
    assert values(P.standardise(p), "b") == [None] * 4


def test_fingerprint_ignores_order(spark):
    p = make(spark, a=[1, 2, None])
    assert files.fingerprint(p) == files.fingerprint(p.repartition(3).orderBy(F.col("period").desc())) != files.fingerprint(p.limit(2))


def test_spec_runs_from_a_file(spark, tmp_path):
    from driftgauge.plans.nowcasting import run_spec
    from driftgauge.sources.simulate import factor_panel

    wide, _ = factor_panel(3, 0, 60, seed=1)
    wide.iloc[-1, 0] = None
    wide.rename_axis("period").to_csv(tmp_path / "p.csv")
    out = run_spec(spark, {"data": {"path": str(tmp_path / "p.csv")}, "target": "m0 ~ .", "method": "two_step"})
    assert out.where("out_of_sample IS NOT NULL").count() == 2
