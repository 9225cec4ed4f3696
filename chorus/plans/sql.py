"""DuckDB SQL for the oracle side of the correctness check.

These builders return SQL *text* for DuckDB (RE2 regex, ``lambda x:`` list
functions).  They restate the rules of ``chorus.functions`` in plain SQL so
that ``oracle_sql()`` can run each query independently of Spark.  RE2 has no
back-references or look-arounds; where a rule needs them the SQL uses list
functions instead.
"""

from __future__ import annotations

from chorus import lexicons as LX
# Fixed values, spelled out here so that the SQL does not share patterns with the code that it checks.
W_CLASS = r"\p{L}\p{N}_"
WS_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
URL_RE = r"https?://[!$-_a-z]+"
EMAIL_RE = (r"[^\t-\r\x1c-\x20\x85\p{Z}]+@[^\t-\r\x1c-\x20\x85\p{Z}]+"
            r"\.[^\t-\r\x1c-\x20\x85\p{Z}]+")
DROP_SPECIAL_RE = r"""[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}.,!?;:()\-'"@#]"""
STRIP_RE = r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$"
TOKEN_RE = r"[\p{L}\p{N}_]+"
ISO_PREFIX_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
_DATE = r"([0-9]{4})-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_TIME = r"(2[0-3]|[01]?[0-9]):([0-5]?[0-9]):(6[01]|[0-5]?[0-9])"
_MONTH, _DAY = r"(1[0-2]|0?[1-9])", r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
# (pattern, places of year, month, day, hour, minute, second and fraction; 0: not there), in the order they are tried.
DATE_FORMATS = [
    (f"^{_DATE}{WS}+{_TIME}$", (1, 2, 3, 4, 5, 6, 0)),
    (f"^{_DATE}$", (1, 2, 3, 0, 0, 0, 0)),
    (f"^{_MONTH}/{_DAY}/([0-9]{{4}})$", (3, 1, 2, 0, 0, 0, 0)),
    (f"^{_DAY}/{_MONTH}/([0-9]{{4}})$", (3, 2, 1, 0, 0, 0, 0)),
    (f"^{_DATE}[Tt]{_TIME}\\.([0-9]{{1,6}})$", (1, 2, 3, 4, 5, 6, 7)),
    (f"^{_DATE}[Tt]{_TIME}[Zz]$", (1, 2, 3, 4, 5, 6, 0)),
]
ADAPTER_SQL = """
SELECT d.doc_id AS ord, concat('doc_', CAST(d.doc_id AS VARCHAR)) AS review_id,
  CASE d.doc_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'playstore' ELSE 'appstore' END AS platform,
  d.lang AS app_name, substr(d.text, 1, 30) AS title, d.text AS content,
  CASE WHEN d.doc_id % 7 = 6 THEN NULL ELSE CAST(1 + d.doc_id % 5 AS INTEGER) END AS rating,
  CASE WHEN d.doc_id % 11 = 10 THEN NULL ELSE concat('u', CAST(d.doc_id % 97 AS VARCHAR)) END AS user_id,
  d.doc_id % 3 = 1 AS verified, CAST(d.doc_id % 23 AS INTEGER) AS helpful_count,
  CAST(d.doc_id % 4 AS INTEGER) AS reply_count,
  CAST(DATE '2023-01-01' + CAST(d.doc_id % 730 AS INTEGER) AS VARCHAR) AS review_date
FROM documents d
"""

AS_OF = "2025-01-01T00:00:00"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def strip(expr: str) -> str:
    return rr(expr, STRIP_RE, "")


def clean(expr: str) -> str:
    """clean_text steps 3-9 (the corpus has no HTML entities or NFKC-variant characters)."""
    t = rr(expr, WS + "+", " ")
    t = rr(t, r"\p{Cc}", "")
    t = rr(t, URL_RE, "")
    t = rr(t, EMAIL_RE, "")
    t = rr(t, "!{2,}", "!")
    t = rr(t, r"\?{2,}", "?")
    t = rr(t, r"\.{3,}", "...")
    t = rr(t, DROP_SPECIAL_RE, "")
    t = rr(t, STRIP_RE, "")
    return f"coalesce({t}, '')"


def alnum_count(expr: str) -> str:
    return f"length({rr(expr, r'[^\p{L}\p{N}]', '')})"


def english_count(expr: str, markers=None) -> str:
    return " + ".join(f"CAST(contains(lower({expr}), {q(w)}) AS INTEGER)" for w in (markers or LX.ENGLISH_MARKERS))


def repeated_char(expr: str, times: int = 11) -> str:
    """Some character (other than newline) repeated ``times`` times in a row.

    RE2 has no back-references: test each distinct character of the row.
    """
    return (f"(len(list_filter(list_distinct(string_split({expr}, '')), lambda ch: "
            f"ch <> chr(10) AND contains({expr}, repeat(ch, {times})))) > 0)")


def cleaner_spam(expr: str) -> str:
    low = f"lower({expr})"
    parts = [repeated_char(low)]
    for p in LX.CLEANER_SPAM_PATTERNS[1:]:
        parts.append(f"regexp_matches({low}, {q(p)})")
    return "(" + " OR ".join(parts) + ")"


def validity_reason(expr: str) -> str:
    return (f"CASE WHEN length({expr}) < {LX.MIN_CONTENT_LENGTH} THEN 'too_short' "
            f"WHEN length({expr}) > {LX.MAX_CONTENT_LENGTH} THEN 'too_long' "
            f"WHEN {alnum_count(expr)} < 5 THEN 'few_alnum' "
            f"WHEN {cleaner_spam(expr)} THEN 'spam' "
            f"WHEN ({english_count(expr)}) < 2 THEN 'language' END")


def ws_words(expr: str) -> str:
    s = strip(expr)
    return f"(CASE WHEN coalesce({s}, '') = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, {q(WS + '+')}) END)"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {q(TOKEN_RE)})"


def content_hash(title: str, content: str) -> str:
    t = strip(f"coalesce({title}, '')")
    c = strip(f"coalesce({content}, '')")
    return f"md5(concat(lower({t}), '|', lower({c})))"


def norm_date(expr: str) -> str:
    parts = []
    for rx, (y, mo, d, h, mi, se, fr) in DATE_FORMATS:
        def g(i, w, rx=rx):
            return q("0" * w) if i == 0 else f"lpad(trim(regexp_extract({expr}, {q(rx)}, {i})), {w}, '0')"
        frac = f"rpad(regexp_extract({expr}, {q(rx)}, {fr}), 6, '0')" if fr else q("000000")
        canon = (f"concat({g(y, 4)}, '-', {g(mo, 2)}, '-', {g(d, 2)}, ' ', {g(h, 2)}, ':', {g(mi, 2)}, ':', "
                 f"{g(se, 2)}, '.', {frac})")
        parts.append(f"CASE WHEN regexp_matches({expr}, {q(rx)}) THEN try_strptime({canon}, '%Y-%m-%d %H:%M:%S.%f') END")
    ts = f"coalesce({', '.join(parts)})"
    iso = (f"CASE WHEN strftime({ts}, '%f') = '000000' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
           f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN NULL "
            f"WHEN regexp_matches({expr}, {q(ISO_PREFIX_RE)}) THEN {expr} ELSE {iso} END)")


def days_old(expr: str, as_of: str = AS_OF) -> str:
    ts = f"try_cast({rr(expr, '(Z|[+-][0-9]{2}:?[0-9]{2})$', '')} AS TIMESTAMP)"
    diff = f"(epoch_us(TIMESTAMP {q(as_of.replace('T', ' '))}) - epoch_us({ts}))"
    b = 86_400_000_000
    return f"(({diff} - ((({diff} % {b}) + {b}) % {b})) // {b})"


def quality(content: str, helpful: str, verified: str, title: str, review_date: str, as_of: str = AS_OF) -> str:
    n = f"length(coalesce({content}, ''))"
    d = days_old(review_date, as_of)
    return (f"(0.0::DOUBLE + CASE WHEN {n} > 50 THEN least({n} / 200.0::DOUBLE, 2.0::DOUBLE) ELSE 0.0::DOUBLE END"
            f" + least(coalesce({helpful}, 0) / 10.0::DOUBLE, 2.0::DOUBLE)"
            f" + CASE WHEN coalesce({verified}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
            f" + CASE WHEN coalesce({title}, '') <> '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
            f" + CASE WHEN {d} IS NOT NULL AND {d} < 365 THEN (365 - {d}) / 365.0::DOUBLE ELSE 0.0::DOUBLE END)")


def review_spam_hits(title: str, content: str) -> str:
    text = f"lower(concat(coalesce({title}, ''), ' ', coalesce({content}, '')))"
    pats = [p.replace("{WS}", WS).replace("{D}", r"\p{Nd}") for p in LX.REVIEW_SPAM_PATTERNS]
    return "(" + " + ".join(f"CAST(regexp_matches({text}, {q(p)}) AS INTEGER)" for p in pats) + ")"


def review_spam(title: str, content: str) -> str:
    c = f"coalesce({content}, '')"
    words = ws_words(f"lower({c})")
    hits = review_spam_hits(title, content)
    caps = (f"CASE WHEN length({c}) > 0 THEN length({rr(f'lower({c})', r'[^\p{Lu}]', '')})::DOUBLE / length({c}) "
            f"ELSE 0.0 END")
    rep = f"CASE WHEN len({words}) > 0 THEN 1.0::DOUBLE - len(list_distinct({words}))::DOUBLE / len({words}) ELSE 0.0 END"
    return (f"(({hits}) >= 2 OR (length({c}) < 20 AND ({hits}) >= 1) OR (length({c}) > 10 AND {caps} > 0.7) "
            f"OR (len({words}) > 5 AND {rep} > 0.7))")


def norm_compare(expr: str, stop_words=None) -> str:
    stop = ", ".join(q(w) for w in (stop_words or LX.STOP_WORDS))
    t = rr(f"lower({expr})", f"[^{W_CLASS}{WS_CLASS}]", " ")
    t = rr(t, WS + "+", " ")
    return (f"coalesce(array_to_string(list_filter(string_split(trim({t}), ' '), "
            f"lambda x: x <> '' AND NOT list_contains([{stop}], x)), ' '), '')")


def classify_ctes(src: str, name: str, title: str = "title", content: str = "content", lexicon=None,
                  positive=None, negative=None, threshold: float = LX.CONFIDENCE_THRESHOLD) -> str:
    """CTEs ``{name}`` = ``src`` plus classification columns (single-token lexicons only).

    Adds primary_category, classification_confidence, sentiment, sentiment_score,
    keywords (sorted, comma-joined), n_tokens and score_<category>.
    """
    lexicon = lexicon or LX.TEST_TOPIC_LEXICON
    positive = positive or LX.TEST_POSITIVE_WEIGHTS
    negative = negative or LX.TEST_NEGATIVE_WEIGHTS
    cats = list(lexicon)
    combined = strip(f"concat(coalesce({title}, ''), ' ', coalesce({content}, ''))")
    score_cols = []
    for c in cats:
        kws = ", ".join(q(k.lower()) for k in lexicon[c])
        raw = f"(len(list_filter(_toks, lambda t: list_contains([{kws}], t))) * 1.5::DOUBLE)"
        score_cols.append(f"(CASE WHEN _empty THEN 0.0::DOUBLE WHEN _nw > 0 THEN least({raw} / (_nw * 0.1::DOUBLE + 1.0::DOUBLE), "
                          f"1.0::DOUBLE) ELSE 0.0::DOUBLE END) AS score_{c}")
    svals = [f"score_{c}" for c in cats]
    pos_case = "CASE t " + " ".join(f"WHEN {q(k)} THEN {float(v)}" for k, v in positive.items()) + " ELSE 0.0 END"
    neg_case = ("CASE WHEN t IN (" + ", ".join(q(k) for k in positive) + ") THEN 0.0 ELSE CASE t "
                + " ".join(f"WHEN {q(k)} THEN {float(v)}" for k, v in negative.items()) + " ELSE 0.0 END END")
    all_kw = sorted({k.lower() for c in cats for k in lexicon[c]})
    arg = "CASE " + " ".join(f"WHEN score_{c} = _mx THEN {q(c)}" for c in cats) + " END"
    return f"""{name}_a AS (SELECT *, {combined} AS _combined FROM {src}),
{name}_b AS (SELECT *, {tokens('_combined')} AS _toks, len({ws_words('_combined')}) AS _nw, _combined = '' AS _empty
  FROM {name}_a),
{name}_c AS (SELECT *, {', '.join(score_cols)},
  coalesce(list_sum(list_transform(_toks, lambda t: {pos_case})), 0.0)::DOUBLE AS _pos,
  coalesce(list_sum(list_transform(_toks, lambda t: {neg_case})), 0.0)::DOUBLE AS _neg,
  len(_toks) AS n_tokens FROM {name}_b),
{name}_d AS (SELECT *, greatest({', '.join(svals)}) AS _mx, list_sort([{', '.join(svals)}], 'DESC')[2] AS _second,
  (_pos - _neg) / n_tokens AS _net FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN _empty THEN 0.0::DOUBLE WHEN _mx = 0 THEN _mx
  ELSE least(_mx + (_mx - _second), 1.0::DOUBLE) END AS classification_confidence FROM {name}_d),
{name} AS MATERIALIZED (SELECT * EXCLUDE (_combined, _toks, _nw, _empty, _pos, _neg, _mx, _second, _net),
  CASE WHEN _empty THEN 'unclassified' WHEN classification_confidence < {threshold} THEN 'unclassified'
       ELSE {arg} END AS primary_category,
  CASE WHEN _empty OR n_tokens = 0 THEN 'neutral' WHEN _net > 0.02 THEN 'positive'
       WHEN _net < -0.02 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CASE WHEN _empty OR n_tokens = 0 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, _net * 10)) END
    AS sentiment_score,
  CASE WHEN _empty THEN '' ELSE array_to_string(list_sort(list_intersect(list_distinct(_toks),
    [{', '.join(q(k) for k in all_kw)}])), ',') END AS keywords
  FROM {name}_e)"""


# --------------------------------------------------------------------- CTE chain
def base_ctes(as_of: str = AS_OF) -> str:
    """reviews -> cleaned (all rows, with drop_reason) -> valid (+ hash, quality, spam)."""
    return f"""
reviews AS ({ADAPTER_SQL}),
cleaned0 AS (
  SELECT r.*, {clean('r.title')} AS title_c, {clean('r.content')} AS content_c FROM reviews r),
cleaned AS MATERIALIZED (
  SELECT ord, review_id, platform, app_name, title_c AS title, content_c AS content, content AS raw_content,
         rating, user_id, verified, helpful_count, reply_count, {norm_date('review_date')} AS review_date,
         length(coalesce(content, '')) AS original_length, length(content_c) AS cleaned_length,
         {validity_reason('content_c')} AS drop_reason
  FROM cleaned0),
valid AS MATERIALIZED (
  SELECT *, md5(concat(lower(title), '|', lower(content))) AS content_hash,
         {quality('content', 'helpful_count', 'verified', 'title', 'review_date', as_of)} AS quality_score,
         {review_spam_hits('title', 'content')} AS spam_hits,
         {review_spam('title', 'content')} AS is_spam
  FROM cleaned WHERE drop_reason IS NULL)"""


def with_base(select_sql: str, extra_ctes: str = "", as_of: str = AS_OF) -> str:
    ctes = base_ctes(as_of)
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{select_sql}"


def flagged_ctes(as_of: str = AS_OF) -> str:
    """valid -> stage (exact dup, spam, per-user dup) -> classification -> record flags."""
    return f"""h AS (SELECT *, row_number() OVER (PARTITION BY app_name, platform, content_hash ORDER BY ord) AS _hrn
  FROM valid),
s1 AS (SELECT *, CASE WHEN _hrn > 1 THEN 'hash_duplicate' WHEN is_spam THEN 'spam' END AS _stage0 FROM h),
u AS (SELECT ord, row_number() OVER (PARTITION BY app_name, platform, user_id ORDER BY quality_score DESC, ord) AS _urn
  FROM s1 WHERE _stage0 IS NULL),
staged AS (SELECT s1.* EXCLUDE (_hrn, _stage0),
  coalesce(_stage0, CASE WHEN u._urn > 1 THEN 'user_duplicate' ELSE 'kept' END) AS stage
  FROM s1 LEFT JOIN u ON s1.ord = u.ord),
{classify_ctes('staged', 'fc')},
flagged0 AS (SELECT * EXCLUDE (is_spam), is_spam AS spam_predicate, stage = 'spam' AS is_spam,
  stage IN ('hash_duplicate', 'near_duplicate', 'user_duplicate') AS is_duplicate,
  CASE WHEN stage = 'kept' THEN {q(as_of)} END AS processed_at FROM fc),
flagged AS MATERIALIZED (SELECT *, (NOT is_spam AND NOT is_duplicate AND quality_score >= 0.5 AND length(coalesce(content, '')) >= 20)
  AS is_high_quality FROM flagged0)"""
