"""States of parts of the rows merge to the state of all rows."""

from pyspark.sql import functions as F

import pytest
from paths import SF_SMALL
from chorus.operators.state import COUNTERS, merged, report_of, report_state
from chorus.plans import queries as Q


def test_merged_state_equals_the_whole(spark, tmp_path):
    rows = Q.flagged(spark, SF_SMALL)
    path = str(tmp_path / "state")
    for k in range(3):
        report_state(rows.where(F.col("ord") % 3 == k)).write.mode("append").parquet(path)
    keys = ["app_name", "platform", "day"]
    by_key = lambda df: {tuple(r[k] for k in keys): [r[c] for c in COUNTERS] for r in df.collect()}
    got, want = by_key(merged([spark.read.parquet(path)])), by_key(report_state(rows))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)

    report = report_of(merged([spark.read.parquet(path)], ["app_name"]))
    exact = {r.app_name: r.n for r in rows.groupBy("app_name").agg(F.countDistinct("user_id").alias("n")).collect()}
    assert report.columns[:2] == ["app_name", "total_reviews"]
    assert all(r.users == pytest.approx(exact[r.app_name], rel=0.05) for r in report.collect())
    assert merged([report_state(rows.where("false"))]).count() == 0
