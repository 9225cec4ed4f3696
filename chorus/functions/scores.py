"""Row-level predicates and scores: spam, language, quality, topics, sentiment.

Every builder returns native Spark expressions.  Text is tokenised once per
row (``tokens``) and lexicon look-ups are hash-based array/map functions, so
a lexicon of any size costs one pass over the tokens, not one regex scan per
keyword.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.functions.normalize import days_old
from chorus.functions.text import (DIGIT, W, WS, col, py_strip, tokens, ws_word_count, ws_words)


# ---------------------------------------------------------------- cleaner rules
def english_marker_count(c, markers=None, low=None) -> Column:
    """How many marker words occur as substrings of lower(text); ``low``: a column that holds it already."""
    t = F.lower(col(c)) if low is None else low
    total = F.lit(0)
    for w in (markers or LX.ENGLISH_MARKERS):
        total = total + t.contains(w).cast("int")
    return total


def is_english(c, markers=None, min_markers: int = 2, low=None) -> Column:
    return english_marker_count(c, markers, low) >= min_markers


def _to_java(pattern: str) -> str:
    # Python's `.` excludes only a newline; Java's `.` also excludes other line terminators.
    return pattern.replace("(.)", "([^\\n])")


def matches(text: Column, pattern: str) -> Column:
    """``rlike``; a plain string is searched for as such, and other patterns only where all the plain strings occur that
    they begin with or hold between runs of a character class."""
    if literal := re.fullmatch(r"(?:[A-Za-z0-9 _]|\\\.)+", pattern):
        return text.contains(literal.group().replace("\\.", "."))
    out = text.rlike(pattern)
    if "|" in pattern:
        return out
    start = re.match(r"[A-Za-z0-9 _]{2,}(?=\[)", pattern)
    parts = [] if "(" in pattern else re.split(r"\[(?:[^\]\\]|\\.)*\]\+", pattern)
    needed = [start.group()] if start else []
    needed += [p for p in parts if re.fullmatch(r"[A-Za-z0-9 _]{2,}", p) and p not in needed]
    for p in reversed(needed):
        out = text.contains(p) & out
    return out


def cleaner_spam(c, patterns=None, caps_on_original: bool = False, low=None) -> Column:
    """Any cleaner spam pattern matches lower(text); ``low``: a column that holds it already.

    The upper-case pattern is tested on lower-cased text in the original and
    so never fires; ``caps_on_original=True`` tests it on the text as given.
    """
    t = col(c)
    low = F.lower(t) if low is None else low
    out = F.lit(False)
    for p in (patterns or LX.CLEANER_SPAM_PATTERNS):
        target = t if (caps_on_original and re.search(r"\[A-Z\]", p)) else low
        out = out | matches(target, _to_java(p))
    return out


def review_spam_patterns(patterns=None) -> list[str]:
    return [p.replace("{WS}", WS).replace("{D}", DIGIT) for p in (patterns or LX.REVIEW_SPAM_PATTERNS)]


def review_spam_hits(title, content, patterns=None) -> Column:
    """Number of distinct spam patterns found in lower(title + ' ' + content)."""
    text = F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.coalesce(col(content), F.lit(""))))
    total = F.lit(0)
    for p in review_spam_patterns(patterns):
        total = total + matches(text, p).cast("int")
    return total


def repetition_ratio(c, words=None) -> Column:
    words = ws_words(F.lower(col(c))) if words is None else col(words)
    n = F.size(words)
    return F.when(n > 0, F.lit(1.0) - F.size(F.array_distinct(words)).cast("double") / n)


def caps_ratio(c) -> Column:
    t = col(c)
    return F.when(F.length(t) > 0,
                  (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("double") / F.length(t))


def is_review_spam(title, content, patterns=None, caps_on_original: bool = False, hits=None, words=None) -> Column:
    """De-dup-stage spam: >=2 patterns; or short text with one; caps; repetition.

    ``hits``, ``words``: columns that already hold ``review_spam_hits`` and the words of the content in lower case.
    """
    hits = review_spam_hits(title, content, patterns) if hits is None else col(hits)
    content_c = F.coalesce(col(content), F.lit(""))
    caps_src = content_c if caps_on_original else F.lower(content_c)
    caps = F.coalesce(caps_ratio(caps_src), F.lit(0.0)) > 0.7
    if not caps_on_original:  # what is still upper case after lowering is not ASCII, so the text has that many more bytes
        caps = (F.octet_length(caps_src) * F.lit(10).cast("long") > F.length(caps_src) * F.lit(17).cast("long")) & caps
    n_words = F.size(ws_words(F.lower(content_c)) if words is None else col(words))
    return ((hits >= 2)
            | ((F.length(content_c) < 20) & (hits >= 1))
            | ((F.length(content_c) > 10) & caps)
            | ((n_words > 5) & (F.coalesce(repetition_ratio(content_c, words), F.lit(0.0)) > 0.7)))


# ----------------------------------------------------------------- quality score
def quality_score(content, helpful_count, verified, title, review_date, as_of: str) -> Column:
    """Length, helpfulness, verified, title and recency bonuses, summed in order."""
    n = F.length(F.coalesce(col(content), F.lit("")))
    length_part = F.when(n > 50, F.least(n / F.lit(200.0), F.lit(2.0))).otherwise(F.lit(0.0))
    helpful_part = F.least(F.coalesce(col(helpful_count), F.lit(0)) / F.lit(10.0), F.lit(2.0))
    verified_part = F.when(F.coalesce(col(verified), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))
    title_part = F.when(F.coalesce(col(title), F.lit("")) != "", F.lit(0.5)).otherwise(F.lit(0.0))
    d = days_old(review_date, as_of)
    recency = F.when(d.isNotNull() & (d < 365), (F.lit(365) - d) / F.lit(365.0)).otherwise(F.lit(0.0))
    return F.lit(0.0) + length_part + helpful_part + verified_part + title_part + recency


# ---------------------------------------------------------------- classification
def _boundary_regex(keyword: str) -> str:
    """``\\b kw \\b`` of Python ``re`` written with explicit look-arounds."""
    kw = keyword.lower()
    esc = re.escape(kw)
    before = f"(?<!{W})" if re.match(r"\w", kw[0]) else f"(?<={W})"
    after = f"(?!{W})" if re.match(r"\w", kw[-1]) else f"(?={W})"
    return before + esc + after


def _is_single_token(keyword: str) -> bool:
    return re.fullmatch(r"\w+", keyword.lower()) is not None


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def category_raw_score(combined_lower: Column, toks: Column, keywords) -> Column:
    """Sum over keywords of (whole-word count x (0.5 x words(keyword) + 1)); ``toks``: the tokens that can be keywords at least."""
    singles = [k.lower() for k in keywords if _is_single_token(k)]
    phrases = [k for k in keywords if not _is_single_token(k)]
    total = F.lit(0.0)
    if singles:
        arr = _lit_array(sorted(set(singles)))
        # several equal keywords in one list each count; weight is 1.5 for a single token
        mult = {k: singles.count(k) for k in set(singles)}
        if all(v == 1 for v in mult.values()):
            total = total + F.size(F.filter(toks, lambda t: F.array_contains(arr, t))) * F.lit(1.5)
        else:
            for k, m in mult.items():
                total = total + F.size(F.filter(toks, lambda t, k=k: t == F.lit(k))) * F.lit(1.5 * m)
    for k in phrases:
        weight = len(k.split()) * 0.5 + 1.0
        found = F.when(combined_lower.contains(k.lower()), F.regexp_count(combined_lower, F.lit(_boundary_regex(k))))
        total = total + F.coalesce(found, F.lit(0)) * F.lit(weight)
    return total


def add_classification(df, title="title", content="content", lexicon=None, positive=None, negative=None,
                       threshold: float = LX.CONFIDENCE_THRESHOLD, keep_helpers: bool = False):
    """Topic scores, primary category, confidence, sentiment and keywords.

    Built as a few stacked projections so the tokens, the scores and their
    maximum are computed once per row (Catalyst does not collapse a project
    into one that references a costly expression several times).  Empty
    combined text gives ``unclassified, {}, 0.0, neutral, 0.0, []``.
    """
    lexicon = lexicon or LX.TOPIC_LEXICON
    positive = LX.POSITIVE_WEIGHTS if positive is None else positive
    negative = LX.NEGATIVE_WEIGHTS if negative is None else negative
    cats = list(lexicon)
    score_names = [f"_s{i}" for i in range(len(cats))]

    df = df.withColumn("_combined", py_strip(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "),
                                                      F.coalesce(col(content), F.lit("")))))
    df = df.withColumns({"_toks": tokens("_combined"), "_low": F.lower("_combined"),
                         "_nw": ws_word_count("_combined")})
    # Few tokens are in a list: the others are left out once, before every list is gone through for each token.
    listed = list(dict.fromkeys([k.lower() for c in cats for k in lexicon[c] if _is_single_token(k)] + [*positive, *negative]))
    df = df.withColumns({"_ntok": F.size("_toks"), "_hits": F.filter("_toks", lambda t: t.isin(listed))})
    toks, low, n_words = F.col("_hits"), F.col("_low"), F.col("_nw")
    denom = n_words * F.lit(0.1) + F.lit(1.0)

    pos_map = F.create_map(*[x for k, v in positive.items() for x in (F.lit(k), F.lit(float(v)))])
    neg_map = F.create_map(*[x for k, v in negative.items() for x in (F.lit(k), F.lit(float(v)))])
    all_kw = [k for c in cats for k in lexicon[c]]
    single_kw = list(dict.fromkeys(k for k in all_kw if _is_single_token(k)))
    phrase_kw = list(dict.fromkeys(k for k in all_kw if not _is_single_token(k)))
    kw_map = F.create_map(*[x for k in single_kw for x in (F.lit(k.lower()), F.lit(k))])
    found = (F.transform(F.array_intersect(F.array_distinct(toks), _lit_array(sorted({k.lower() for k in single_kw}))),
                         lambda t: F.element_at(kw_map, t)) if single_kw else _lit_array([]))
    if phrase_kw:
        found = F.concat(found, F.array_compact(F.array(*[F.when(low.rlike(_boundary_regex(k)), F.lit(k))
                                                          for k in phrase_kw])))
    stage3 = {name: F.when(n_words > 0, F.least(category_raw_score(low, toks, lexicon[c]) / denom, F.lit(1.0)))
              .otherwise(F.lit(0.0)) for name, c in zip(score_names, cats)}
    stage3["_pos"] = F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(pos_map, t), F.lit(0.0)))
    stage3["_neg"] = F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.when(
        F.try_element_at(pos_map, t).isNull(), F.coalesce(F.try_element_at(neg_map, t), F.lit(0.0))).otherwise(F.lit(0.0)))
    stage3["_kw"] = F.array_sort(F.array_distinct(found))
    df = df.withColumns(stage3)

    scores = [F.col(n) for n in score_names]
    stage4 = {"_mx": F.greatest(*scores) if len(scores) > 1 else scores[0],
              "_second": F.element_at(F.sort_array(F.array(*scores), asc=False), 2) if len(scores) > 1 else F.lit(0.0),
              "_net": F.when(F.col("_ntok") > 0, (F.col("_pos") - F.col("_neg")) / F.col("_ntok"))}
    df = df.withColumns(stage4)
    mx = F.col("_mx")
    conf = F.when(mx == 0, mx).otherwise(F.least(mx + (mx - F.col("_second")), F.lit(1.0))) if len(scores) > 1 else mx
    df = df.withColumn("_conf", conf)

    arg = F.coalesce(*[F.when(s == mx, F.lit(c)) for s, c in zip(scores, cats)])
    primary = F.when(F.col("_conf") < threshold, F.lit("unclassified")).otherwise(arg)
    net, n_tok = F.col("_net"), F.col("_ntok")
    label = F.when(n_tok == 0, "neutral").when(net > 0.02, "positive").when(net < -0.02, "negative").otherwise("neutral")
    sscore = F.when(n_tok == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net * 10)))
    empty = F.col("_combined") == ""
    df = df.withColumns({
        "primary_category": F.when(empty, F.lit("unclassified")).otherwise(primary),
        "category_scores": F.when(empty, F.create_map().cast("map<string,double>"))
                            .otherwise(F.map_from_arrays(_lit_array(cats), F.array(*scores))),
        "classification_confidence": F.when(empty, F.lit(0.0)).otherwise(F.col("_conf")),
        "sentiment": F.when(empty, F.lit("neutral")).otherwise(label),
        "sentiment_score": F.when(empty, F.lit(0.0)).otherwise(sscore),
        "keywords_found": F.when(empty, _lit_array([])).otherwise(F.col("_kw")),
        "n_tokens": n_tok,
    })
    helpers = ["_combined", "_toks", "_hits", "_low", "_nw", *score_names, "_pos", "_neg", "_ntok", "_kw", "_mx", "_second",
               "_net", "_conf"]
    return df if keep_helpers else df.drop(*helpers)


def simple_sentiment(text, positive=None, negative=None) -> Column:
    """(#positive words contained - #negative) / whitespace words, x10, clamped."""
    from chorus.functions.text import count_contained
    p = count_contained(text, positive or LX.SIMPLE_POSITIVE)
    n = count_contained(text, negative or LX.SIMPLE_NEGATIVE)
    words = ws_word_count(F.coalesce(col(text), F.lit("")))
    raw = (p - n) / F.greatest(words, F.lit(1))
    return F.when(words == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw * 10)))
