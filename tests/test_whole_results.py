"""Queries that once left out part of their result, against plain versions over all rows."""

import math
import os

from driftgauge.plans import domain as D
from driftgauge.plans.catalogue import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_vintage_matrix_has_every_period(spark):
    own = [r for r in D.store(spark, SF).collect() if r.series == D.TARGET]
    vintages, want = {r.vintage for r in own}, {}
    for r in sorted(own, key=lambda r: r.vintage):
        want |= {(r.period, v): r.value for v in vintages if v >= r.vintage}
    rows = QUERIES["vintage_matrix"](spark, SF).collect()
    have = {(r.period, r.vintage): r.value for r in rows}
    assert len(have) == len(rows) and have.keys() == want.keys()
    assert all(a is b is None or math.isclose(a, b, abs_tol=1e-9) for a, b in ((have[k], want[k]) for k in want))
    assert len({p for p, _ in have}) == len({r.period for r in own})
