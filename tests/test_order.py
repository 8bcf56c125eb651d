"""Queries whose result is an order: rows must come in the order of the check SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, key  # noqa: E402

from trialspark.plans import load_all  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
ORDERS = {"e16_param_impact": "ORDER BY max_abs_delta_vmaf DESC, param"}
KEYS = {"g07_grid_order": ("crf", "aq_strength")}


@pytest.mark.parametrize("name", ["g01_entry_sort", "g01_entry_sort_time", "g02_latest_results", "g04_challenge_order", "g05_catalogue_order", "g07_grid_order", "e16_param_impact"])
def test_order(spark, name):
    q = load_all()[name]
    sql = q.check_sql()
    cur = connect(FOLDER).execute(f"SELECT * FROM ({sql}) AS q {ORDERS[name]}" if name in ORDERS else sql)
    names = [d[0] for d in cur.description]
    want = [key(r) for r in cur.fetchall()]
    got = [key(r) for r in q.frame(spark, FOLDER).select(*names).collect()]
    if name in KEYS:  # rows of equal keys have no order among themselves
        at = [names.index(c) for c in KEYS[name]]
        assert [[r[i] for i in at] for r in got] == [[r[i] for i in at] for r in want]
        got, want = sorted(got), sorted(want)
    assert got == want
