"""Connectors, loaders, settings and declarative runs."""

import datetime as dt
import json
import math

import numpy as np
import pytest

from driftgauge.functions import plain as U
from driftgauge.operators import density as X
from driftgauge.operators import vintages as V
from driftgauge.plans import report, spec
from driftgauge.sources import connectors as C
from driftgauge.sources import datasets, files
from driftgauge.sources.simulate import two_step_example


def test_quarters_of_the_statistics_office():
    head = {"D2N": "Variável", "D3C": "Trimestre (Código)", "D3N": "Trimestre", "V": "Valor"}
    rows = [head, {"D2N": "a", "D3C": "202302", "D3N": "2º trimestre 2023", "V": "1.5"}, {"D2N": "a", "D3C": "202303", "D3N": "3º", "V": "-"}]
    assert [r[1:] for r in C.statistics_office("u", lambda u: json.dumps(rows))] == [(dt.date(2023, 4, 1), 1.5), (dt.date(2023, 7, 1), 0.0)]
    rows[0] = head | {"D3C": "Mês (Código)", "D3N": "Mês"}
    assert C.statistics_office("u", lambda u: json.dumps(rows))[0][1] == dt.date(2023, 2, 1)
    assert C.statistics_office_period("202304", "Q") == (dt.date(2023, 10, 1), "Q")
    with pytest.raises(ValueError):
        C.statistics_office_period("202305", "Q")


def test_requests_are_tried_again(tmp_path, monkeypatch):
    waits, answers = [], [C.Status(429, 7.0), OSError("lost"), "busy", '{"a": 1}']

    def get(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert C.get_json("http://h", get, {"api_key": "s", "b": 2}, sleep=waits.append) == {"a": 1} and waits == [7.0, 2.0, 1.0]
    with pytest.raises(RuntimeError, match=r"api_key=%2A%2A%2A|api_key=\*\*\*"):
        C.get_text("http://h", lambda u: (_ for _ in ()).throw(C.Status(404)), {"api_key": "secret"}, sleep=waits.append)
    calls = []
    cached = C.with_cache(lambda u: calls.append(u) or "x", str(tmp_path))
    assert cached("u") == cached("u") == "x" and len(calls) == 1 and C.with_cache(get, None) is get
    monkeypatch.setenv("FRED_API_KEY", "k")
    assert C.api_key() == "k" and C.api_key("own") == "own"
    monkeypatch.delenv("FRED_API_KEY")
    with pytest.raises(ValueError):
        C.api_key()
    assert C.codes_by_name([1, 2]) == {"1": 1, "2": 2} and C.codes_by_name({"a": 5}) == {"a": 5}


def test_series_are_built_from_texts():
    got = C.build_series(["2000Q2", "2000Q1", "2000Q2"], ["1,5", "", "1,5"], freq="Q")
    assert got == [(dt.date(2000, 1, 1), None), (dt.date(2000, 4, 1), 1.5)]
    with pytest.raises(ValueError):
        C.build_series(["2000-01", "2000M1"], [1.0, 2.0])
    assert C.odata_metadata("c", lambda u: json.dumps({"value": [{"SERNOME": "n"}]})) == {"SERNOME": "n"}


def test_single_values_and_delays_refuse_conflicts(spark):
    rows = spark.createDataFrame([("a", dt.date(2000, 1, 1), 1.0), ("a", dt.date(2000, 1, 1), 2.0)], "series string, period date, value double")
    with pytest.raises(Exception, match="several values"):
        files.single_values(rows).collect()
    ok = V.coerce_delays(spark.createDataFrame([("a", "5"), ("b", None)], "series string, delay string")).collect()
    assert {r.series: r.delay for r in ok} == {"a": 5, "b": None}
    with pytest.raises(Exception, match="no delay"):
        V.coerce_delays(spark.createDataFrame([("a", "x")], "series string, delay string")).collect()
    legend = spark.createDataFrame([("a", "M", "hard"), ("a", "zz", "odd")], "series string, frequency string, category string")
    assert {r.problem for r in files.check_legend(legend).collect()} == {"repeated", "unknown category", "unknown frequency"}


def test_dataset_folder(spark, tmp_path):
    (tmp_path / "d.csv").write_text("period,gdp,ip\n2000Q1,1.0,\n2000-02,,2.0\n2000-03,3.0,4.0\n")
    (tmp_path / "l.csv").write_text("series,delay,core\ngdp,60,true\nip,30,false\n")
    (tmp_path / "r.csv").write_text("period,date\n2000Q1,2000-06-01\n")
    (tmp_path / "d.yaml").write_text("panel: d.csv\nlegend: l.csv\nreleases: r.csv\nreleased: [gdp]\n")
    c = datasets.Catalogue(str(tmp_path))
    assert c.names() == ["d"] and c.panel(spark, "d", ["gdp"], start="2000-02-01").count() == 2
    assert {r.series for r in c.panel(spark, "d", flag="core").collect()} == {"gdp"}
    with pytest.raises(ValueError):
        c.panel(spark, "d", ["zz"])
    delays, explicit = c.calendar(spark, "d")
    assert {r.series: r.delay for r in delays.collect()} == {"gdp": 60, "ip": 30}
    assert [tuple(r) for r in explicit.collect()] == [("gdp", dt.date(2000, 1, 1), dt.date(2000, 6, 1))]
    with pytest.raises(ValueError):
        c.vintages(spark, "d")
    (tmp_path / "m.csv").write_text("sasdate,A,B\nTransform:,5,2\n1/1/1959,1.5,\n2/1/1959,2.5,7\n")
    panel, codes = datasets.read_coded_table(spark, str(tmp_path / "m.csv"))
    assert codes == {"A": 5, "B": 2} and panel.where("value IS NOT NULL").count() == 3
    files.write_metadata([{"series": "gdp", "delay": 60}], str(tmp_path / "meta.yaml"))
    assert files.read_metadata(str(tmp_path / "meta.yaml")) == [{"series": "gdp", "delay": 60}]


def test_settings():
    assert U.jsonable({"a": np.float64("nan"), "b": np.arange(2), "d": dt.date(2000, 1, 1)}) == {"a": None, "b": [0, 1], "d": "2000-01-01"}
    assert U.plain({"a": np.int64(1), "b": (1, 2)}) == {"a": 1, "b": [1, 2]}
    assert U.per_series({"a": 1}, ["a", "b"], "x", 0) == {"a": 1, "b": 0} and U.per_series([1, 2], ["a", "b"], "x") == {"a": 1, "b": 2}
    assert U.coerce_delay("45") == 45 and U.coerce_delay(None) is None
    for bad in ("x", 1.5, -400, True):
        with pytest.raises(ValueError):
            U.coerce_delay(bad)
    assert U.configured(dict, {"a__b": 1, "c": 2}, c=3) == {"c": 2, "a": {"b": 1}}

    @U.register_plot("fan")
    def draw(df):
        return df

    assert U.plot("fan") is draw
    with pytest.raises(ValueError):
        U.plot("none")
    U.register_theme(U.Theme("own", grid="#123456"), overwrite=True)
    assert "#123456" in U.THEMES["own"].css()


def test_bands():
    assert X.interval_levels(["q05", "q95", "q50", "lower_68", "upper_68"]) == {68: ("lower_68", "upper_68"), 90: ("q05", "q95")}
    fan = X.fan_chart(X.Mixture.gaussian(0.0, 1.0))
    assert [f["level"] for f in fan] == [0.3, 0.6, 0.9] and math.isclose(fan[-1]["upper"], 1.6448536, rel_tol=1e-6)


def test_specifications_name_all_problems():
    with pytest.raises(spec.SpecError) as e:
        spec.load_spec({"data": {"layout": "odd", "zz": 1}, "model": {"method": "magic", "lags": "two"}, "outputs": {"backtest": True}})
    for part in ("data.zz: unknown key", "model.lags", "data.path", "target: missing", "magic", "outputs.backtest"):
        assert part in str(e.value)
    for name in spec.list_templates():
        assert spec.load_spec(spec.template_path(name)).target == "gdp"
    assert spec.load_spec(spec.template_text("full")).selection.search.space["lags"] == [1, 2]
    with pytest.raises(ValueError):
        spec.template_path("zz")


def test_a_declared_run(spark, tmp_path):
    wide, _ = two_step_example(120, 4, 1, seed=4)
    wide.rename_axis("period").reset_index().assign(period=lambda d: d["period"].dt.strftime("%Y-%m-%d")).to_csv(tmp_path / "p.csv", index=False)
    source = {
        "data": {"path": str(tmp_path / "p.csv"), "delays": {c: 10 for c in wide.columns}},
        "target": "target",
        "vintage": dt.date(2009, 12, 20),
        "selection": {"preselect": {"k": 3}, "search": {"space": {"method": ["rw", "mean"]}}},
        "backtest": {"start": "2009-01-20", "end": "2009-07-20", "step": 3, "models": ["ar"]},
        "outputs": {"density": [0.9], "backtest": True},
    }
    run = spec.run_spec(spark, source)
    assert set(run.tables) == {"panel", "preselection", "search", "backtest", "accuracy", "nowcast", "headline", "in_sample"}
    assert run.tables["preselection"].count() == 3 and run.chosen["method"] in ("rw", "mean")
    assert {r.model for r in run.tables["backtest"].select("model").distinct().collect()} == {"model", "ar"}
    assert run.tables["headline"].first().out_of_sample is not None
    run.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "nowcast")).count() == run.tables["nowcast"].count()
    html = report.page("run", {"headline": run.tables["headline"], "n": spark.range(9)}, rows=None, theme="dark")
    assert html.count("<tr>") == 12 and "#1e1e1e" in html
    assert spec.main(["validate", spec.template_path("minimal")]) == 0
    (tmp_path / "bad.yaml").write_text("target: x\n")
    assert spec.main(["validate", str(tmp_path / "bad.yaml")]) == 2
