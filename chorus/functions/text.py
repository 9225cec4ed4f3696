"""Text expressions as ``Column -> Column`` builders.

All of them are plain Spark SQL functions (regexp_replace, split, higher
order functions), so they run inside whole-stage code generation.  Only
HTML-entity decoding and NFKC normalisation have no Spark built-in; they
live in ``functions/udfs.py`` and are applied to the rows that need them.

Token classes follow the original's Python ``re`` semantics on ``str``:

* ``W``  -- a Unicode word character (letters, numbers, underscore);
* ``WS`` -- a Unicode whitespace character (Spark's ``\\s`` is ASCII-only).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from chorus import lexicons as LX

# Character-class bodies shared by Java regex (Spark) and RE2 (DuckDB oracle).
W_CLASS = r"\p{L}\p{N}_"
WS_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"
W = f"[{W_CLASS}]"
WS = f"[{WS_CLASS}]"
NOT_WS = f"[^{WS_CLASS}]"
DIGIT = r"\p{Nd}"

# clean_text pieces (steps 3-9)
URL_RE = r"https?://[!$-_a-z]+"                # `$-_` in the original class is a range
EMAIL_RE = f"{NOT_WS}+@{NOT_WS}+\\.{NOT_WS}+"
#: ASCII characters that cleaning drops: no words, whitespace or basic punctuation.  Java looks single ones up in a table.
SPECIAL_ASCII = "".join(f"\\x{cp:02x}" for cp in range(128)
                        if not (chr(cp).isalnum() or chr(cp).isspace() or chr(cp) in "_.,!?;:()-'\"@#"))
DROP_SPECIAL_RE = f"[{SPECIAL_ASCII}[[^\\x00-\\x7f]&&[^{W_CLASS}{WS_CLASS}]]]"
#: The characters of ``WS``, for trimming without a regular expression.
WS_CHARS = "".join(c for c in map(chr, range(0x10000)) if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"
                   or unicodedata.category(c).startswith("Z"))
#: Java only: runs that are not one plain space already.  The first half of an intersection spares ASCII the rest.
COLLAPSE_RE = f"[[^ -~]&&[{WS_CLASS}&&[^ ]]]{WS}*| {WS}+"
CONTROL_RE = "[{}\\x80-\\x9f]".format("".join(f"\\x{cp:02x}" for cp in [*range(32), 127]))
ASCII_WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
TOKEN_RE = r"[\w\p{L}\p{N}]+"                # W, with the ASCII part first


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, not only spaces)."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def bound(c, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(col(c)), f)[0]


def change_where(c, test, change) -> Column:
    """``change`` of the texts that ``test`` finds in need of it: most need none, and a test costs less than a replacement."""
    return bound(c, lambda x: F.when(test(x), change(x)).otherwise(x))


def non_ascii(c) -> Column:
    """The characters outside ASCII, in order; texts that have none are told by their length in bytes."""
    x = col(c)
    return F.when(F.octet_length(x) > F.length(x), F.regexp_replace(x, r"[\x00-\x7f]+", "")).otherwise(F.lit(""))


def _newlines(c) -> Column:
    """Newlines as spaces: the whitespace that most texts have, and a plain replacement is the cheapest."""
    return F.replace(col(c), F.lit("\n"), F.lit(" "))


def _one_space(x) -> Column:
    t = F.regexp_replace(x, f"[{ASCII_WS}[[^\\x00-\\x7f]&&[\\x85\\p{{Z}}]]]", " ")
    return change_where(t, lambda x: x.contains("  "), lambda x: F.regexp_replace(x, " {2,}", " "))


def collapse_ws(c) -> Column:
    """Whitespace runs -> one space."""
    return _collapse(_newlines(c))


def _collapse(c) -> Column:
    return change_where(c, lambda x: x.contains("  ") | x.rlike(f"[{ASCII_WS}]") | non_ascii(x).rlike(WS), _one_space)


def drop_emails(c) -> Column:
    """Without e-mail-like tokens; only a text with an ``@`` can have one, and others are not searched."""
    return change_where(c, lambda x: x.contains("@"), lambda x: F.regexp_replace(x, EMAIL_RE, ""))


def _has_special(x, also: str = "") -> Column:
    """Whether a text holds a character to drop, whitespace outside ASCII, or one of the ASCII characters in ``also``."""
    return x.rlike(f"[{SPECIAL_ASCII}{also}]") | non_ascii(x).rlike(r"[^\p{L}\p{N}]")


def _drop_special(x) -> Column:
    ascii_only = F.octet_length(x) == F.length(x)
    return F.when(ascii_only, F.regexp_replace(x, f"[{SPECIAL_ASCII}]", "")).otherwise(F.regexp_replace(x, DROP_SPECIAL_RE, ""))


def _steps_3_to_8(x) -> Column:
    t = change_where(_collapse(x), lambda x: x.rlike(CONTROL_RE), lambda x: F.regexp_replace(x, r"\p{Cc}", ""))
    t = change_where(t, lambda x: x.contains("://"), lambda x: F.regexp_replace(x, URL_RE, ""))
    t = drop_emails(t)
    t = change_where(t, lambda x: x.contains("!!"), lambda x: F.regexp_replace(x, "!{2,}", "!"))
    t = change_where(t, lambda x: x.contains("??"), lambda x: F.regexp_replace(x, r"\?{2,}", "?"))
    t = change_where(t, lambda x: x.contains("...."), lambda x: F.regexp_replace(x, r"\.{3,}", "..."))
    return bound(t, _drop_special)


def _needs_steps(x) -> Column:
    """Whether steps 3-8 can change a text: control characters, and the slash of a URL, count as special."""
    return (x.contains("  ") | x.contains("@") | x.contains("!!") | x.contains("??") | x.contains("....")
            | _has_special(x, ASCII_WS))


def clean_text_native(c) -> Column:
    """Steps 3-9 of ``clean_text``; NULL becomes ``''``.

    3 whitespace runs -> one space; 4 drop control chars; 5 drop URLs;
    6 drop e-mail-like tokens; 7 squeeze ``!!``/``??``/``....``; 8 drop
    characters outside word/space/basic punctuation; 9 strip.  No re-collapse
    after 5, 6 and 8: double spaces stay, as in the original.
    """
    t = change_where(_newlines(c), _needs_steps, _steps_3_to_8)
    return F.coalesce(py_strip(t), F.lit(""))


def clean_text_simple(c) -> Column:
    """Whitespace collapse, special-character drop, strip (steps 3, 8, 9)."""
    t = change_where(collapse_ws(c), _has_special, _drop_special)
    return F.coalesce(py_strip(t), F.lit(""))


def _nfkc_stable_letters(lo: int = 0x80, hi: int = 0x180) -> str:
    """Regex ranges of the letters in [lo, hi) that NFKC leaves unchanged (from the Unicode tables).

    Accented Latin letters are stable and never compose with their
    neighbours unless a combining mark follows (which is outside the set).
    """
    cps = [cp for cp in range(lo, hi)
           if unicodedata.normalize("NFKC", chr(cp)) == chr(cp) and unicodedata.combining(chr(cp)) == 0
           and unicodedata.category(chr(cp)).startswith("L")]
    ranges, start, prev = [], cps[0], cps[0]
    for cp in cps[1:] + [None]:
        if cp != prev + 1 if cp is not None else True:
            ranges.append(f"\\x{{{start:04X}}}" + (f"-\\x{{{prev:04X}}}" if prev != start else ""))
            start = cp
        prev = cp if cp is not None else prev
    return "".join(ranges)


UNSTABLE_RE = f"[^{_nfkc_stable_letters()}]"


def needs_decoding(c) -> Column:
    """True where HTML unescape or NFKC can change the text: ``&``, or a character
    outside ASCII and the NFKC-stable Latin letters."""
    t = col(c)
    return t.contains("&") | non_ascii(t).rlike(UNSTABLE_RE)


def alnum_count(c) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def has_alnum(c, n: int) -> Column:
    """Whether ``alnum_count`` is at least ``n``, without reading on."""
    return col(c).rlike(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*+){%d}" % n)


def tokens(c) -> Column:
    """``re.findall(r'\\b\\w+\\b', text.lower())``: maximal word-character runs."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(TOKEN_RE), F.lit(0))


def ws_words(c) -> Column:
    """``text.split()`` as an array (empty array for blank text)."""
    return bound(F.coalesce(collapse_ws(py_strip(c)), F.lit("")),
                 lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ")))


def ws_word_count(c) -> Column:
    """``len(text.split())``: one more than the single spaces between words."""
    return bound(F.coalesce(collapse_ws(py_strip(c)), F.lit("")), lambda s: F.when(s == "", F.lit(0)).otherwise(
        F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1))


def normalize_for_comparison(c, stop_words=None) -> Column:
    """lower; non-word -> space; collapse; drop stop words; join with one space."""
    stop = F.array(*[F.lit(w) for w in (stop_words or LX.STOP_WORDS)])
    t = F.regexp_replace(F.lower(col(c)), f"[^{W_CLASS}{WS_CLASS}]", " ")
    t = F.regexp_replace(t, WS + "+", " ")
    parts = F.split(F.trim(t), " ")
    kept = F.filter(parts, lambda x: (x != "") & ~F.array_contains(stop, x))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def content_hash(title, content) -> Column:
    """md5 hex of ``lower(strip(title)) | lower(strip(content))``."""
    t = F.lower(py_strip(F.coalesce(col(title), F.lit(""))))
    c = F.lower(py_strip(F.coalesce(col(content), F.lit(""))))
    return F.md5(F.concat(t, F.lit("|"), c))


def truncate_ellipsis(c, n: int) -> Column:
    """Keep ``n`` characters then ``...`` when longer than ``n``."""
    x = col(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def truncate_to(c, n: int) -> Column:
    """Total length at most ``n``: ``n-3`` characters then ``...``; NULL -> ''."""
    x = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def word_jaccard(a, b) -> Column:
    """Jaccard of lower-cased whitespace word sets; 0 when either is empty."""
    wa = F.array_distinct(ws_words(F.lower(col(a))))
    wb = F.array_distinct(ws_words(F.lower(col(b))))
    inter = F.size(F.array_intersect(wa, wb))
    union = F.size(F.array_union(wa, wb))
    empty = (F.coalesce(col(a), F.lit("")) == "") | (F.coalesce(col(b), F.lit("")) == "")
    return F.when(empty | (union == 0), F.lit(0.0)).otherwise(inter / union)


def contains_any(text, words, lower: bool = True) -> Column:
    """Any word is a (case-insensitive) substring of the text."""
    t = F.lower(col(text)) if lower else col(text)
    conds = [t.contains(w.lower() if lower else w) for w in words]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def count_contained(text, words) -> Column:
    """Number of list words contained as substrings of lower(text)."""
    t = F.lower(col(text))
    total = F.lit(0)
    for w in words:
        total = total + t.contains(w.lower()).cast("int")
    return F.coalesce(total, F.lit(0))
