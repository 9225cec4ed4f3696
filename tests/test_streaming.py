"""The streaming form gives the same exact-dedup + classification as the batch plan."""

import tempfile

from pyspark.sql import functions as F

from paths import SF_SMALL
from chorus.plans import queries as Q
from chorus.streaming.stream import best_rows_stream, clean_classify_stream, read_review_stream, run_available_now


def test_stream_matches_batch_hash_dedup(spark):
    src = tempfile.mkdtemp(prefix="chorus-stream-src-")
    raw = Q.reviews(spark, SF_SMALL).withColumn("review_ts", F.to_timestamp("review_date"))
    raw.write.mode("overwrite").parquet(src)
    stream = read_review_stream(spark, src, raw.schema)
    out = clean_classify_stream(stream, watermark="3650 days", as_of="2025-01-01T00:00:00")
    sink, ck = tempfile.mkdtemp(prefix="chorus-stream-out-"), tempfile.mkdtemp(prefix="chorus-stream-ck-")
    run_available_now(out.select("ord", "app_name", "platform", "content_hash", "sentiment"), sink, ck)
    got = spark.read.parquet(sink)
    batch = Q.valid(spark, SF_SMALL)
    n_groups = batch.select("app_name", "platform", "content_hash").distinct().count()
    assert got.count() == n_groups


def test_best_row_per_user_ends_as_in_the_batch(spark, tmp_path):
    from chorus.operators.dedup import user_dedup
    src, ck, latest = str(tmp_path / "src"), str(tmp_path / "ck"), {}
    rows = Q.valid(spark, SF_SMALL).select("ord", "app_name", "platform", "user_id", "quality_score")
    for part in (2, 0, 1):
        rows.where(F.col("ord") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    updates = []

    def each(df, batch_id):
        for r in df.collect():
            updates.append(batch_id)
            latest[r.app_name, r.platform, r.user_id] = r.ord

    stream = best_rows_stream(read_review_stream(spark, src, rows.schema, max_files_per_trigger=1))
    (stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", ck)
     .trigger(availableNow=True).start().awaitTermination())
    assert set(latest.values()) == {r.ord for r in user_dedup(rows).select("ord").collect()}
    assert len(set(updates)) == 3
