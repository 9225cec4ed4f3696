"""Gold values for the scalar rules (inputs and expected outputs from FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus import lexicons as LX
from chorus.functions import normalize as N
from chorus.functions.scores import add_classification, cleaner_spam, is_english, is_review_spam
from chorus.operators.clean import clean_text


def one(spark, col_expr, value, dtype=T.StringType()):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", dtype)]))
    return df.select(col_expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [("3", 3), ("3.7", 4), ("4.7", 5), ("0", 1), ("6", 5), (None, None),
                                          ("invalid", None), ("2.5", 2), ("4.5", 4), ("nan", None), (" 3 ", 3)])
def test_normalize_rating(spark, raw, expected):
    assert one(spark, N.normalize_rating, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("2023-01-01T12:00:00", "2023-01-01T12:00:00"), ("2023-01-01 12:00:00", "2023-01-01T12:00:00"),
    ("2023-01-01", "2023-01-01T00:00:00"), ("01/01/2023", "2023-01-01T00:00:00"),
    ("13/02/2023", "2023-02-13T00:00:00"), ("junk", None), ("", None), (None, None),
    ("02/03/2023", "2023-02-03T00:00:00")])
def test_normalize_date(spark, raw, expected):
    assert one(spark, N.normalize_date, raw) == expected


@pytest.mark.parametrize("raw,expected", [("10", 10), ("3.9", 3), ("-4", 0), (None, 0), ("x", 0)])
def test_normalize_count(spark, raw, expected):
    assert one(spark, N.normalize_count, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("  This is a   test\t\nwith extra   whitespace!  ", "This is a test with extra whitespace!"),
    ("Check out https://example.com for more info", "Check out  for more info"),
    ("This &amp; that &lt;tag&gt; &quot;quote&quot;", 'This  that tag "quote"'),
    ("mail me at someone@example.com now!!!", "mail me at  now!"),
    ("ﬁne ＡＢＣ", "fine ABC"),
    ("cafe\u0301 déjà", "café déjà"),
    (None, "")])
def test_clean_text(spark, raw, expected):
    assert one(spark, clean_text, raw) == expected


def test_english_rule(spark):
    assert one(spark, is_english, "This is a reasonable length review content") is False
    assert one(spark, is_english, "the cat and the dog") is True


def test_cleaner_spam(spark):
    assert one(spark, cleaner_spam, "CLICK HERE for FREE MONEY!!! Visit www.scam.com") is True
    assert one(spark, cleaner_spam, "This app works well for my daily tasks") is False
    assert one(spark, cleaner_spam, "sooooooooooooo good") is True


def test_review_spam(spark):
    df = spark.createDataFrame([("", "visit my website and click here"), ("", "buy now"),
                                ("", "a long honest review about the app")], ["title", "content"])
    got = [r[0] for r in df.select(is_review_spam("title", "content")).collect()]
    assert got == [True, True, False]


def test_parse_int_prefix(spark):
    assert one(spark, N.parse_int_prefix, "4.7 stars") == 4
    assert one(spark, N.parse_int_prefix, "abc") == 0


@pytest.mark.parametrize("score,rating", [(0.5, 5), (0.2, 4), (-0.2, 3), (-0.5, 2), (-0.51, 1)])
def test_sentiment_to_rating(spark, score, rating):
    assert one(spark, N.sentiment_to_rating, score, T.DoubleType()) == rating


def test_platform_from_url(spark):
    assert one(spark, N.platform_from_url, "https://apps.apple.com/app/x") == "iOS App Store"
    assert one(spark, N.platform_from_url, "https://play.google.com/store") == "Google Play Store"
    assert one(spark, N.platform_from_url, "https://example.com") == "Unknown"


def test_default_lexicon_classification(spark):
    df = spark.createDataFrame([
        ("Poor UX Design", "The app interface is really confusing and hard to use"),
        ("", "This app is excellent and amazing!"),
        ("", "This app is terrible and awful!"),
        ("", "This app exists and does things."),
        ("", ""),
    ], ["title", "content"])
    rows = add_classification(df).collect()
    assert rows[0]["primary_category"] == "ux_ui"
    assert rows[0]["classification_confidence"] == 1.0
    assert rows[0]["sentiment"] == "negative" and rows[0]["sentiment_score"] == -1.0
    assert (rows[1]["sentiment"], rows[1]["sentiment_score"]) == ("positive", 1.0)
    assert (rows[2]["sentiment"], rows[2]["sentiment_score"]) == ("negative", -1.0)
    assert (rows[3]["sentiment"], rows[3]["sentiment_score"]) == ("neutral", 0.0)
    assert rows[4]["primary_category"] == "unclassified" and rows[4]["keywords_found"] == []
    assert sorted(rows[0]["keywords_found"]) == ["design", "interface", "ux"]


def test_phrase_keywords(spark):
    df = spark.createDataFrame([("", "Great customer care and a user-friendly tool")], ["title", "content"])
    r = add_classification(df).first()
    assert "customer care" in r["keywords_found"] and "user-friendly" in r["keywords_found"]
    assert r["category_scores"]["customer_service"] > 0


def test_classification_summary_gold(spark):
    from chorus.operators.reports import classification_summary
    rows = [("ux_ui", "positive", 0.8), ("ux_ui", "negative", 0.75), ("pricing", "neutral", 0.9),
            ("unclassified", "neutral", 0.1)]
    df = spark.createDataFrame(rows, ["primary_category", "sentiment", "classification_confidence"]) \
        .withColumn("processed_at", F.lit("2025-01-01T00:00:00"))
    r = classification_summary(df, 0.7).first()
    assert (r["total_reviews"], r["high_confidence_count"], r["unclassified_count"]) == (4, 3, 1)


def test_date_range():
    from chorus.operators.select import date_range
    s, e = date_range("last_7_days", "2024-01-31T00:00:00")
    assert (s.isoformat(), e.isoformat()) == ("2024-01-24T00:00:00", "2024-01-31T00:00:00")
    s, e = date_range("2024-01-05", "2024-01-31T00:00:00")
    assert (e - s).days == 1
    with pytest.raises(ValueError):
        date_range("2024-01-01T10:00:00:2024-01-02", "2024-01-31T00:00:00")


def test_lexicon_sizes():
    assert sum(len(v) for v in LX.TOPIC_LEXICON.values()) == 41
    assert len(LX.POSITIVE_WEIGHTS) == 23 and len(LX.NEGATIVE_WEIGHTS) == 24
    assert len(LX.REVIEW_SPAM_PATTERNS) == 16


def test_quality_score_gold(spark):
    from chorus.functions.scores import quality_score
    rows = [("x" * 300, 25, True, "t", "2024-12-02T00:00:00"),   # 1.5 + 2 + 1 + 0.5 + 335/365
            ("short", 3, False, "", None),                       # 0 + 0.3
            ("y" * 60, 0, False, "", "2025-01-11T00:00:00"),     # 0.3 + (365 + 10)/365: future dates exceed 1
            ("z" * 60, 0, False, "", "2023-06-01T00:00:00")]     # 0.3, older than a year
    df = spark.createDataFrame(rows, "content string, helpful_count int, verified boolean, title string, review_date string")
    got = [round(r[0], 6) for r in df.select(quality_score("content", "helpful_count", "verified", "title",
                                                           "review_date", "2025-01-01T00:00:00")).collect()]
    assert got == [round(1.5 + 2 + 1 + 0.5 + 335 / 365, 6), 0.3, round(0.3 + 375 / 365, 6), 0.3]


def test_named_date_ranges():
    from chorus.operators.select import date_range
    now = "2024-03-10T12:30:00"
    shown = {spec: tuple(t.isoformat() for t in date_range(spec, now))
             for spec in ("today", "yesterday", "last_week", "last_month", "last_3_days", "2024-01-01:2024-02-01")}
    assert shown == {
        "today": ("2024-03-10T00:00:00", "2024-03-10T12:30:00"),
        "yesterday": ("2024-03-09T00:00:00", "2024-03-09T23:59:59.999999"),
        "last_week": ("2024-03-03T12:30:00", "2024-03-10T12:30:00"),
        "last_month": ("2024-02-09T12:30:00", "2024-03-10T12:30:00"),
        "last_3_days": ("2024-03-07T12:30:00", "2024-03-10T12:30:00"),
        "2024-01-01:2024-02-01": ("2024-01-01T00:00:00", "2024-02-01T00:00:00")}


def test_text_column_choice(spark):
    from chorus.operators.select import text_key
    def choose(row, schema):
        return text_key(spark.createDataFrame([row], schema), ["pos"]).first().text_key
    assert choose((1, "a", "longest of all"), "pos int, content string, other string") == "content"
    assert choose((1, " ", "longest of all", "mid"), "pos int, content string, other string, x string") == "other"
    assert choose((1, None, ""), "pos int, content string, other string") == "text"


def test_faster_forms_equal_the_plain_ones(spark):
    """Trimming, collapsing, decoding tests, upper-case shares and literal patterns without a regular expression per row."""
    import re
    from pyspark.sql import functions as F
    from chorus.functions import scores as SC
    from chorus.functions import text as T
    texts = ["", " ", "a", "　a  b\x85", "a  b\t\nc d", "a\t", "\x1c \x1dx", "a@b.c d@e  f@g.h.", "@a@b.c", "x@y z.w",
             "straße & co", "naïve", "ﬁne", "日本 語", "é", "A1b2C", "....1a2b3c", "ABC def ÄÖ", "www.x", "wwwx", "a.com", "acom",
             "visit  my website", "visit me", "earn $5", "earnings", "http://x", "https://x", "httpx://", "free money", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain_ws = F.regexp_replace("t", T.WS + "+", " ")
    stable = T._nfkc_stable_letters()
    pairs = {
        "collapse": (F.regexp_replace("t", T.COLLAPSE_RE, " "), plain_ws),
        "strip": (T.py_strip("t"), F.regexp_replace("t", f"^{T.WS}+|{T.WS}+$", "")),
        "emails": (T.drop_emails("t"), F.regexp_replace("t", T.EMAIL_RE, "")),
        "decode": (T.needs_decoding("t"), F.col("t").rlike(f"[&]|[^\\x00-\\x7F{stable}]")),
        "alnum": (T.has_alnum("t", 3), T.alnum_count("t") >= 3),
        "caps": (SC.caps_ratio("t"), F.when(F.length("t") > 0, F.length(F.regexp_replace("t", r"[^\p{Lu}]", "")).cast("double")
                                            / F.length("t"))),
    }
    for p in SC.review_spam_patterns() + SC.LX.CLEANER_SPAM_PATTERNS:
        pairs[p] = (SC.matches(F.col("t"), SC._to_java(p)), F.col("t").rlike(SC._to_java(p)))
    for name, (fast, plain) in pairs.items():
        assert not df.where(~fast.eqNullSafe(plain)).collect(), name
    assert set(re.findall(r"\s", "".join(map(chr, range(0x10000))))) == set(T.WS_CHARS)


def test_plain_patterns_need_no_regular_expression(spark):
    from chorus.functions.scores import cleaner_spam
    shown = cleaner_spam("t")._jc.toString()
    assert shown.count("rlike(") == 2 and shown.count("contains(") == 6


def _odd_texts():
    import random
    rng = random.Random(7)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "\x00", "\x7f", "\x90", "!", "!!", "?", "??", ".", "....", "@",
             "x@y.z", "http://a.b/c", "https:", "//", "/", "$", "[", "]", "\\", "^", "-", "é", "ß", "Ä", "日本", "’", "😀", "𝐀", "ﬁ", "&amp;", "_",
             "9", "²", "İ", "é", "visit", " my ", "website", "act", "fast", "contact me", "the", "of", "#", "'", '"']
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["", " ", None, "ÄÖÜ" * 9, "𝐀" * 12 + "b"]


def test_texts_in_need_of_no_step_are_told_without_losing_a_change(spark):
    """Every step over every text gives what the guarded steps give, on texts of odd characters."""
    from pyspark.sql import functions as F
    from chorus.functions import text as T
    df = spark.createDataFrame([(t,) for t in _odd_texts()], "t string")
    plain = F.regexp_replace("t", T.WS + "+", " ")
    drop = f"[^{T.W_CLASS}{T.WS_CLASS}.,!?;:()\\-'\"@#]"
    full = plain
    for pattern, by in ((r"\p{Cc}", ""), (T.URL_RE, ""), (T.EMAIL_RE, ""), ("!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{3,}", "..."), (drop, "")):
        full = F.regexp_replace(full, pattern, by)
    strip = lambda c: F.regexp_replace(c, f"^{T.WS}+|{T.WS}+$", "")
    words = F.when(F.coalesce(strip(F.col("t")), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(strip(F.col("t")), T.WS + "+"))
    pairs = {
        "collapse": (T.collapse_ws("t"), plain),
        "clean": (T.clean_text_native("t"), F.coalesce(strip(full), F.lit(""))),
        "simple": (T.clean_text_simple("t"), F.coalesce(strip(F.regexp_replace(plain, drop, "")), F.lit(""))),
        "decode": (T.needs_decoding("t"), F.col("t").rlike(f"[&]|[^\\x00-\\x7F{T._nfkc_stable_letters()}]")),
        "words": (T.ws_words("t"), words),
        "count": (T.ws_word_count("t"), F.size(words)),
        "tokens": (T.tokens("t"), F.regexp_extract_all(F.lower("t"), F.lit(T.W + "+"), F.lit(0))),
    }
    for name, (fast, slow) in pairs.items():
        assert not df.where(~fast.eqNullSafe(slow)).collect(), name


def test_spam_looks_for_plain_words_before_patterns(spark):
    from pyspark.sql import functions as F
    from chorus.functions import scores as SC
    texts = _odd_texts() + ["act fast", "fast act", "visit my website", "visit website my", "contact me"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in [*SC.review_spam_patterns(), "(?!ab[x]+cd[x]+e)act", "act[ ]*fast", "[a]+ct|fast"]:
        assert not df.where(~SC.matches(F.col("t"), p).eqNullSafe(F.col("t").rlike(p))).collect(), p
    shown = SC.matches(F.col("t"), "visit[ ]+my[ ]+website")._jc.toString()
    assert shown.count("contains(") == 3
    low = F.lower(F.coalesce("t", F.lit("")))
    caps = F.coalesce(SC.caps_ratio(low), F.lit(0.0)) > 0.7
    rule = (F.length(F.coalesce("t", F.lit(""))) > 10) & caps
    got = SC.is_review_spam(F.lit(""), F.col("t"), hits=F.lit(0), words=F.array().cast("array<string>"))
    assert not df.where(got != rule).collect() and df.where(got).count() == 1


def test_classification_counts_only_listed_tokens_but_reads_all(spark):
    from chorus.functions.scores import add_classification
    df = spark.createDataFrame([("t", "the Of zzz the and customer care customer-care that at this q")], "title string, content string")
    r = add_classification(df, lexicon={"a": ["the", "of"], "b": ["and", "customer care"]}, positive={"that": 3, "this": 0.5},
                           negative={"at": 2, "that": 9}, keep_helpers=True).first()
    assert r._hits == ["the", "of", "the", "and", "that", "at", "this"] and len(r._toks) == r.n_tokens == 14
    assert (r._pos, r._neg, r.keywords_found) == (3.5, 2.0, ["and", "customer care", "of", "the"])
    assert r._s0 == 1.0 and r._s1 == 1.0
