"""Plan-shape invariants for every registered query (small fixture)."""

from paths import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_in_registered_queries(spark):
    from chorus.plans.queries import QUERIES
    bad = []
    for name, fn in QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_date_filter_reaches_parquet_scan(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["date_range_filter"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_every_query_has_oracle_or_is_near_dup():
    from chorus.plans.queries import ORACLE, QUERIES
    missing = set(QUERIES) - set(ORACLE)
    assert missing == {"near_dup_pairs", "near_dup_clusters", "pipeline_full"}


def test_api_flatten_reads_its_source_once(spark):
    from chorus.plans.queries import QUERIES
    plan = _plan(QUERIES["api_flatten_first"](spark, SF_SMALL))
    assert plan.count("FileScan") == 1


def test_flags_scan_the_narrow_table_only(spark):
    """The flag steps read no text: one wide scan, joined once."""
    from chorus.plans.pipeline import Settings, flag_stages, narrow, prepared
    from chorus.plans.queries import cleaned
    from chorus.plans.store import write_table
    s = Settings()
    rows = write_table(narrow(prepared(cleaned(spark, SF_SMALL), s), s.batch), "narrow-test")
    plan = _plan(flag_stages(rows, s))
    assert "content:string" not in plan and "raw_content" not in plan


def test_stage_tables_follow_the_settings(spark):
    from chorus.plans.pipeline import documents_pipeline
    everything = documents_pipeline(spark, SF_SMALL).count()
    longer = documents_pipeline(spark, SF_SMALL, min_length=400).count()
    plain = documents_pipeline(spark, SF_SMALL, materialize=False, min_length=400).count()
    assert longer == plain < everything


def test_a_cluster_must_name_its_folder():
    import pytest
    from chorus.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_flagged_rows_are_written_without_texts_and_cleaning_is_shared(spark):
    """No text is shuffled or written again for a report, and the cleaned rows are one table for all queries."""
    from chorus.plans import store
    from chorus.plans.queries import QUERIES
    store.forget(spark)
    QUERIES["category_hist"](spark, SF_SMALL).collect()
    previews = QUERIES["record_preview"](spark, SF_SMALL)
    QUERIES["clean_text"](spark, SF_SMALL)
    tables = {key.split("|")[0]: path for (_, key), path in store._TABLES.items()}
    assert len(tables) == len(store._TABLES) and set(tables) == {"cleaned", "narrow", "flagged"}
    for name in ("narrow", "flagged"):
        assert not {"content", "raw_content", "cleaned_content"} & set(spark.read.parquet(tables[name]).columns), name
    shuffled = [line for line in _plan(previews).splitlines() if "Exchange" in line]
    assert not [line for line in shuffled if "content#" in line]


def _odd_reviews(spark):
    rows = [(1, "the phone and the app work on it", "a"), (1, "speed and price of the crash on it", "a"), (1, "the phone and the app work on it", "b"),
            (2, "the phone and the app work on it", "a"), (None, "price and support of the thing on it", "a"), (3, None, "b"),
            (4, "  The\nbattery and the price & the speed on it ", None), (4, "  The\nbattery and the price & the speed on it ", None)]
    return spark.createDataFrame([(o, f"r{o}", t and t[:9], t, a, "web", "u", True, "2024-01-01", 4, 2, 1) for o, t, a in rows],
                                 "ord long, review_id string, title string, content string, app_name string, platform string, "
                                 "user_id string, verified boolean, review_date string, rating int, helpful_count int, reply_count int")


def test_stage_tables_change_no_row_even_if_ordinals_repeat_or_are_null(spark):
    from chorus.operators.select import content_preview, record_summary
    from chorus.plans.pipeline import TEST_SETTINGS, Settings, process
    from chorus.plans.store import write_table
    reviews, s = _odd_reviews(spark), Settings(**TEST_SETTINGS)
    flat = lambda row: repr([sorted(v.items()) if isinstance(v, dict) else v for v in row])
    listed = lambda df: sorted(map(flat, df.collect()))
    lazy = process(reviews, s, near_dup=False)
    plain = spark.createDataFrame(lazy.collect(), lazy.schema)
    tables = {}

    def stage(name, build):
        tables[name] = tables[name] if name in tables else write_table(build(), name)
        return tables[name]

    staged = process(reviews, s, near_dup=False, stage=stage)
    assert plain.columns == staged.columns and plain.count() > 6
    assert listed(plain) == listed(staged)
    without = [c for c in plain.columns if c not in ("content", "raw_content", "cleaned_content")]
    assert set(process(reviews, s, near_dup=False, texts={}).columns) == set(without)
    narrow = process(reviews, s, near_dup=False, stage=stage, texts={})
    assert listed(narrow.select(without)) == listed(plain.select(without)) and set(narrow.columns) == set(without)
    previews = process(reviews, s, near_dup=False, stage=stage, texts={"content_preview": content_preview(12)})
    assert listed(record_summary(previews)) == listed(record_summary(plain, 12))
