"""Every registered query against its check SQL on the small tables."""

import os

import pytest

import compare
from trialspark.plans import load_all

FOLDER = os.environ.get("TEST_DIR", "/root/testdata/sf0.001")
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, _, note, df = compare.compare(spark, con, QUERIES[name], FOLDER)
    assert note in ("ok", "rows only"), note
    assert len(set(df.columns)) == len(df.columns)


def test_bitrate_takes_whole_frames(spark, con):
    """the clip's length does not depend on the order in which segments are added."""
    want = dict(con.execute("""SELECT o_custkey, any_value(c_acctbal) * 1000 * 8.0 / (sum(5 + o_orderkey % 90) / 30.0::DOUBLE) FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE c_acctbal > 0 GROUP BY 1""").fetchall())
    got = QUERIES["b21_video_segment_catalogue"].frame(spark, FOLDER).filter("bitrate_bps IS NOT NULL").select("video_id", "bitrate_bps").collect()
    assert {r.video_id: r.bitrate_bps for r in got} == want
