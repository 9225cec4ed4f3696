"""Runs over newly landed files: nothing lost, nothing doubled, also after a batch that failed half-way."""

from pyspark.sql import functions as F

import pytest
from paths import SF_SMALL
from chorus.plans import incremental as I
from chorus.plans import queries as Q


def test_new_files_only_and_restart(spark, tmp_path, monkeypatch):
    landed, out, ck = (str(tmp_path / n) for n in ("landed", "out", "ck"))
    raw = Q.reviews(spark, SF_SMALL)
    third = F.col("ord") % 3
    land = lambda k, rows: rows.coalesce(1).write.mode("append").parquet(landed)
    keys = ["app_name", "platform", "content_hash"]
    want = {tuple(r) for r in Q.valid(spark, SF_SMALL).select(*keys).distinct().collect()}
    go = lambda: I.run_new(spark, landed, raw.schema, out, ck, files_per_batch=1)

    land(0, raw.where(third == 0))
    assert go() == 1
    assert go() == 0  # nothing new
    first = spark.read.parquet(out).count()

    land(1, raw.where(third == 1))
    land(2, raw.where(third == 2))
    land(3, raw.where(third == 1))  # the same rows once more
    whole = I.take_batch

    def fails_after_writing(rows, batch_id, *rest):
        whole(rows, batch_id, *rest)
        if batch_id == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(I, "take_batch", fails_after_writing)
    with pytest.raises(Exception):
        go()
    monkeypatch.setattr(I, "take_batch", whole)
    assert go() == 2  # the failed batch again, and the last
    rows = spark.read.parquet(out)
    assert rows.count() == len(want) > first
    assert {tuple(r) for r in rows.select(*keys).collect()} == want
    assert rows.select("ord").distinct().count() == rows.count()
