"""Landed sources (API responses, batch JSON, CSV) and partitioned sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from paths import SF_SMALL
from chorus.sources.landed import first_then_nonempty, flatten_api_responses, read_batch_json, read_csv


def test_api_flatten_first_then_filter(spark):
    review = lambda rid, text, q="https://apps.apple.com/x", rating="4.7 stars": {
        "query": q, "review_id": rid, "review_rating": rating, "review_text": text, "review_timestamp": 5}
    bodies = [
        (0, "a", json.dumps([{"status": "Success", "data": [[review("r1", "")]]}])),
        (1, "a", json.dumps([{"status": "Success", "data": [[review("r1", "late text")]]}])),
        (2, "a", json.dumps([{"status": "Success", "data": [[review("r2", "ok", rating="abc")]]},
                             {"status": "Failed", "data": [[review("r3", "no")]]}])),
        (3, "b", json.dumps({"status": "Success", "data": [[review("r4", "nested", q="https://play.google.com/x")]]})),
        (4, "b", json.dumps({"status": "Success", "data": [review("r5", "flat", q="other")]})),
    ]
    raw = spark.createDataFrame(bodies, ["ord", "app_name", "body"])
    flat = flatten_api_responses(raw)
    got = {r.review_id: r for r in first_then_nonempty(flat).collect()}
    assert set(got) == {"r2", "r4", "r5"}
    assert got["r2"].rating == 0 and got["r4"].platform == "Google Play Store" and got["r5"].platform == "Unknown"


def test_batch_json_and_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="chorus-io-")
    doc = {"metadata": {"app_name": "x", "platform": "reddit"},
           "reviews": [{"review_id": "1", "platform": "reddit", "app_name": "x", "content": "hello there"}]}
    p = os.path.join(d, "batch.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    meta, rows = read_batch_json(spark, p)
    m = meta.first()
    assert (m.app_name, m.total_scraped, m.total_processed) == ("x", 1, 0)
    r = rows.first()
    assert r.content == "hello there" and r.keywords_found == [] and r.raw_data == "{}"
    assert read_csv(spark, os.path.join(d, "missing.csv")).count() == 0


def test_partitioned_csv_export(spark):
    from chorus.plans.pipeline import documents_pipeline
    from chorus.sinks.export import write_reviews_csv
    flagged = documents_pipeline(spark, SF_SMALL, near_dup=False)
    out = tempfile.mkdtemp(prefix="chorus-out-")
    write_reviews_csv(flagged.where(F.col("processed_at").isNotNull()), out, max_rows_per_file=10)
    back = read_csv(spark, out)
    assert back.count() == flagged.where(F.col("processed_at").isNotNull()).count()
    assert {"review_id", "keywords_found", "verified"} <= set(back.columns)


REVIEW = ("this is the review number {k} and it was good for the most part of what we do with the app on the phone "
          "since the day that we got it in the shop")


def _batch_document(path, app, texts):
    reviews = [{"review_id": f"{app}{k}", "platform": "reddit", "app_name": app, "content": t, "rating": 4,
                "user_id": f"u{app}{k}"} for k, t in enumerate(texts)]
    with open(path, "w") as f:
        json.dump({"metadata": {"app_name": app, "platform": "reddit"}, "reviews": reviews}, f)


def test_two_documents_and_a_missing_one_go_through_the_pipeline(spark):
    from chorus.plans.pipeline import run
    d = tempfile.mkdtemp(prefix="chorus-run-")
    texts = [REVIEW.format(k=k) + " " + " ".join(f"{w}{k}" for w in "abcdefghijkl") for k in range(3)]
    _batch_document(f"{d}/one.json", "x", texts)
    _batch_document(f"{d}/two.json", "y", texts)
    meta, rows = read_batch_json(spark, f"{d}/*.json")
    assert rows.count() == 6 and rows.select("ord").distinct().count() == 6 and meta.count() == 2
    flagged = run(spark, [f"{d}/one.json", f"{d}/two.json", f"{d}/none.json"], f"{d}/out", near_dup=False,
                  formats=("csv", "json", "batch", "report"))
    assert flagged.count() == 6 and {r.stage for r in flagged.collect()} == {"kept"}
    # Every export is there and reads back.
    assert read_csv(spark, f"{d}/out/reviews_csv").count() == 6
    assert spark.read.json(f"{d}/out/reviews_json").count() == 6
    meta, again = read_batch_json(spark, f"{d}/out/batches/*.json")
    assert sorted((m.app_name, m.total_scraped, m.total_processed) for m in meta.collect()) == [("x", 3, 3), ("y", 3, 3)]
    assert {(r.review_id, r.content) for r in again.collect()} == {(r.review_id, r.content) for r in flagged.collect()}
    summary, analysis = (json.loads(spark.read.text(f"{d}/out/report/{r}").first().value) for r in ("summary", "analysis"))
    assert list(summary) == ["report_metadata", "overall_stats", "batch_summaries"]
    assert summary["report_metadata"]["total_batches"] == 2 and summary["overall_stats"]["total_reviews"] == 6
    first = summary["batch_summaries"][0]
    assert (first["app_name"], first["total_reviews"], first["rating_distribution"]) == ("x", 3, {"4": 3})
    assert sum(first["category_distribution"].values()) == sum(first["sentiment_distribution"].values()) == 3
    assert list(analysis) == ["report_metadata", "insights", "category_analysis", "sentiment_trends", "quality_metrics"]
    assert analysis["insights"][0] == "Highest rated app: x (4.0/5)" and set(analysis["sentiment_trends"]["by_app"]) == {"x", "y"}
    assert analysis["quality_metrics"]["total_reviews"] == 6
    detail = read_csv(spark, f"{d}/out/report/high_quality")
    assert {r.review_id for r in detail.collect()} == {r.review_id for r in flagged.where("is_high_quality").collect()}
    assert spark.read.option("header", True).csv(f"{d}/out/report/summary_csv").count() == 2


def test_every_source_keeps_its_rows_in_the_pipeline(spark):
    from chorus.plans.pipeline import Settings, process
    from chorus.plans import queries as Q
    from chorus.plans.store import write_table
    from chorus.sources.landed import api_reviews
    from chorus.sources.union import union_reviews
    posts, comments = Q.forum_reviews(spark, SF_SMALL)
    api = api_reviews(Q.api_first(spark, SF_SMALL))
    rows = write_table(union_reviews([posts, comments, api]), "union-test")
    n = rows.count()
    assert n == posts.count() + comments.count() + api.count()
    assert rows.select("ord").distinct().count() == n
    cleaned = {}

    def stage(name, build):
        cleaned[name] = write_table(build(), name)
        return cleaned[name]

    flagged = process(rows, Settings(), near_dup=False, stage=stage)
    assert cleaned["cleaned"].count() == n
    assert flagged.count() == cleaned["cleaned"].where("drop_reason is null").count()


def test_overlay_repeated_keys_and_hashes(spark):
    import hashlib
    from chorus.sources.landed import generic_hash, overlay
    df = spark.createDataFrame([("a", "x", "c", None), ("b", "y", "d", None)],
                               "review_id string, sentiment string, primary_category string, processed_at string")
    updates = spark.createDataFrame([("a", None, "first", 1), ("a", "positive", None, 2), ("a", None, "last", 3)],
                                    "review_id string, sentiment string, primary_category string, ord int")
    got = {r.review_id: r for r in overlay(df, updates, as_of="2025").collect()}
    assert len(got) == 2 and (got["a"].sentiment, got["a"].primary_category, got["a"].processed_at) == ("positive", "last", "2025")
    assert got["b"].processed_at is None
    m = {"b": "1", "a": "é 😀 \"q\""}
    rows = spark.createDataFrame([(m, ["z", None, "é"], "text é", 5)], "m map<string,string>, l array<string>, s string, n int")
    h = rows.select(*[generic_hash(rows, c).alias(c) for c in "mlsn"]).first()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert h.m == md5(json.dumps(m, sort_keys=True)) and h.l == md5(json.dumps(["z", None, "é"]))
    assert h.s == md5("text é") and h.n == md5("5")


def test_landed_app_information(spark):
    from chorus.sources.landed import app_metadata, app_search, records_from_json, records_to_json
    info = spark.createDataFrame([("p", "T", "tools", 4.5, None)], "appId string, title string, genre string, score double, screenshots array<string>")
    m = app_metadata(info, "2025").first()
    assert (m.package_id, m.category, m.rating, m.screenshots, m.version, m.scraped_at) == ("p", "tools", 4.5, [], None, "2025")
    hits = spark.createDataFrame([(k, "q" if k % 2 else "r", f"a{k}") for k in range(20)], "ord int, query string, appId string")
    assert [r.package_id for r in app_search(hits, "q", 3).collect()] == ["a1", "a3", "a5"]
    texts = spark.createDataFrame([(1, '{"review_id": "1", "extra": 5, "rating": 3}'), (2, "no json")], "ord long, json string")
    back = {r.ord: r for r in records_from_json(texts).collect()}
    assert back[1].rating == 3 and back[1].keywords_found == [] and back[1].category_scores == {} and back[2].review_id is None
    again = records_to_json(records_from_json(texts).where("ord = 1")).first().json
    assert json.loads(again)["review_id"] == "1" and json.loads(again)["title"] is None


def test_budgets_timestamps_and_fields(spark):
    from chorus.operators.select import format_timestamp, keyword_budgets, per_group_budget
    from chorus.sources.catalog import registered_fields
    posts = spark.createDataFrame([(k, "s", f"about {'red' if k % 2 else 'blue'} things", "", k % 10) for k in range(40)]
                                  + [(100, "t", "nothing", "", 99), (101, "t", "a RED one", "", 5)],
                                  "ord int, source string, title string, selftext string, score int")
    got = {(r.source, r.ord): r.found_by for r in keyword_budgets(posts, ["red", "blue"], 6).collect()}
    assert {k for k, v in got.items() if v == "red"} == {("s", 1), ("s", 3), ("s", 5), ("t", 101)}
    assert {k for k, v in got.items() if v == "blue"} == {("s", 0), ("s", 2), ("s", 4)}
    assert {k for k, v in got.items() if v == "hot"} == {("s", 9), ("s", 19), ("s", 29)}
    assert per_group_budget(posts, "source", 6).count() == 5
    t = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("x",), (None,)], "t string")
    assert [r.f for r in t.select(format_timestamp("t", "2025-01-01T00:00:00").alias("f")).collect()] == [
        "2024-01-02 03:04:05", "2025-01-01 00:00:00", "2025-01-01 00:00:00"]
    asked = spark.createDataFrame([("spotify", "android"), ("nobody", "reddit"), ("spotify", "reddit")], "app_key string, platform string")
    assert {(r.app_key, r.platform): r.missing for r in registered_fields(asked, spark).collect()}[("nobody", "reddit")] == "app"


def test_corrupt_documents_are_reported_and_the_others_read(spark, caplog):
    from chorus.plans.pipeline import run
    from chorus.sources.landed import batch_rejects
    d = tempfile.mkdtemp(prefix="chorus-run-")
    texts = [REVIEW.format(k=k) + " " + " ".join(f"{w}{k}" for w in "abcdefghijkl") for k in range(3)]
    _batch_document(f"{d}/one.json", "x", texts)
    _batch_document(f"{d}/two.json", "y", texts)
    for name, text in (("broken", '{"metadata": {"app_name": "z"'), ("other", '{"unrelated": 1}')):
        with open(f"{d}/{name}.json", "w") as f:
            f.write(text)
    meta, rows = read_batch_json(spark, f"{d}/*.json")
    assert sorted(m.app_name for m in meta.collect()) == ["x", "y"] and rows.count() == 6
    rejects = {r.file.rsplit("/", 1)[1]: r.reason for r in batch_rejects(spark, f"{d}/*.json").collect()}
    assert rejects == {"broken.json": "corrupt_document", "other.json": "no_batch"}
    with caplog.at_level("WARNING", "chorus.sources"):
        assert run(spark, [f"{d}/*.json"], near_dup=False).count() == 6
    assert "broken.json" in caplog.text and "other.json" in caplog.text


def test_read_json_keeps_corrupt_lines_and_missing_paths(spark):
    from pyspark.sql import types as T
    from chorus.sources.landed import read_json
    d = tempfile.mkdtemp(prefix="chorus-json-")
    with open(f"{d}/a.json", "w") as f:
        f.write('{"a": 1}\nnot json\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    got = read_json(spark, f"{d}/a.json", schema).collect()
    assert sorted((r.a or 0, r._corrupt_record) for r in got if r._corrupt_record is None) == [(1, None), (2, None)]
    assert [r._corrupt_record for r in got if r._corrupt_record] == ["not json"]
    assert read_json(spark, f"{d}/none.json", schema).count() == 0


def test_flatten_json_opens_every_level(spark):
    from chorus.sources.variant import flatten_json
    rows = [(1, '{"a": {"b": {"c": 1.5, "d": null}}, "l": [{"x": 1}], "s": "t", "e": {}}'), (2, '{"z": true}'), (3, "[1]"),
            (4, "broken {"), (5, None), (6, "{}"), (2, '{"z": true}')]
    df = spark.createDataFrame(rows, "id long, json string")
    got = sorted((r.id, r.path or "", r.value or "") for r in flatten_json(df, ["id"], "json").collect())
    assert got == [(1, "a.b.c", "1.5"), (1, "a.b.d", ""), (1, "l", '[{"x":1}]'), (1, "s", "t"), (2, "z", "true"),
                   (2, "z", "true"), (3, "", "[1]"), (4, "", "broken {"), (5, "", "")]
    assert flatten_json(df.where("false"), ["id"], "json").collect() == []


def test_keyword_hits_equal_plain_search(spark):
    import random
    import re
    from chorus.operators.keywords import keyword_hits
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("ab _é.A1") for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(90, None), (91, "")]
    words = ["a", "ab", "b a", "é", "a1", "aa", "ba.", "_", "AB", None, "", "ab"]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    for whole in (True, False):
        want = set()
        for k, t in texts:
            for w in {w.lower() for w in words if w}:
                shape = f"(?={re.escape(w)})" if not whole else f"(?<!\\w)(?={re.escape(w)}(?!\\w))"
                n = len(re.findall(shape, (t or "").lower()))
                if n:
                    want.add((k, w, n))
        for block in (100, 3):  # in one block, and in several
            got = keyword_hits(df, keywords, "id", "t", whole_words=whole, block_keywords=block).collect()
            assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert keyword_hits(df, keywords.where("false"), "id", "t").collect() == []


def test_briefs_through_csv_are_the_same(spark):
    from chorus.plans import queries as Q
    from chorus.plans.brief import app_briefs
    responses = Q.api_responses(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="chorus-brief-")
    direct, through = app_briefs(responses, sample=5), app_briefs(responses, f"{d}/rows", sample=5)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, through.collect()))
