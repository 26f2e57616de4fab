"""Searches, reports, snapshots, streams."""

import datetime as dt

from pyspark.sql import functions as F

from driftgauge.operators import vintages as V
from driftgauge.plans import domain as D
from driftgauge.plans import report
from driftgauge.plans.experiments import search
from driftgauge.sources import files
from driftgauge.sources.snapshots import Snapshots
from driftgauge.streaming import store as R

SF = "/root/testdata/sf0.001"


def test_search_resumes_from_its_checkpoint(spark, tmp_path):
    sched = V.schedule(D.panel(spark, SF), D.delays(spark))
    grid = spark.createDataFrame([(dt.date(1999, 3, 15),), (dt.date(1999, 9, 15),)], "vintage date")
    run = lambda specs: search(sched, D.TARGET, D.SERIES[1:], specs, grid, {"h1": 1.0}, str(tmp_path))
    first = run([{"method": "rw"}]).collect()
    both = run([{"method": "rw"}, {"method": "mean"}]).collect()
    assert len(first) == 1 and len(both) == 2
    assert spark.read.parquet(str(next(tmp_path.iterdir()))).select("spec").distinct().count() == 2


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    for run, day, v in (("a1", "2024-01-01", 1.0), ("b2", "2024-01-02", 2.0)):
        s.write(run, day, {"t": spark.createDataFrame([("x", v)], "k string, v double")}, {"p": 1})
    assert s.resolve("latest~1") == "a1" and s.resolve("b") == "b2"
    assert s.diff("t", ["k"], "v").first().change == 1.0
    assert s.history("t").count() == 2


def test_stream_of_late_and_repeated_records(spark, tmp_path):
    d = dt.date
    rows = [("a", d(2000, 1, 1), d(2000, 2, 1), 1.0), ("a", d(2000, 1, 1), d(2000, 3, 1), 1.0), ("a", d(2000, 1, 1), d(2000, 4, 1), None)]
    for k, part in enumerate((rows[:2], rows[2:], [("a", d(2000, 1, 1), d(2000, 2, 15), 9.0), ("a", d(2000, 1, 1), d(2000, 5, 1), 3.0)])):
        spark.createDataFrame(part, files.STORE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = R.revisions(R.read_records(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r.release_number, r.value) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("release_number").collect()]
    assert got == [(0, 1.0), (1, None), (2, 3.0)]  # the record of mid-February came late


def test_report(spark):
    html = report.page("A <run>", {"t": spark.range(3).withColumn("x", F.lit(0.5))})
    assert "A &lt;run&gt;" in html and html.count("<tr>") == 4


def test_catalogue_works_without_the_training_data_part():
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, *rest):
        if name.startswith("driftgauge.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(q.startswith("op1_") or q == "pipeline" for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
