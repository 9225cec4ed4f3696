"""Field normalisation as ``Column -> Column`` builders (all native Spark)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from chorus.functions.text import WS, WS_CLASS, col

# Python ``float()`` accepts surrounding whitespace, a sign, digits with
# single underscores between them, a fraction, an exponent and inf/nan.
_DIGITS = r"[0-9](?:_?[0-9])*"
FLOAT_RE = (f"^{WS}*[+-]?(?:(?:{_DIGITS}(?:\\.(?:{_DIGITS})?)?|\\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
            f"|(?i:inf|infinity|nan)){WS}*$")


def _as_double(c, dtype=None) -> Column:
    """Python ``float(x)`` for strings and numbers; NULL where it would raise."""
    x = col(c)
    if dtype is not None and isinstance(dtype, NumericType):
        return x.cast("double")
    s = x.cast("string")
    body = F.regexp_replace(F.regexp_replace(s, f"^{WS}+|{WS}+$", ""), "_", "")
    return F.when(s.rlike(FLOAT_RE), body.try_cast("double"))


def is_infinite(c, dtype=None) -> Column:
    d = _as_double(c, dtype)
    return F.coalesce(F.abs(d) == F.lit(float("inf")), F.lit(False))


def normalize_rating(c, dtype=None) -> Column:
    """float -> round half to even -> clamp to 1..5; NULL / unparsable / NaN -> NULL.

    ``+-inf`` makes the original raise and drop the whole row; the clean stage
    reports that with ``drop_reason = 'bad_number'`` (see ``is_infinite``).
    """
    d = _as_double(c, dtype)
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return F.when(ok, F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.bround(d, 0))).cast("int"))


def normalize_count(c, dtype=None) -> Column:
    """``max(0, int(float(x)))``; NULL / unparsable / NaN -> 0."""
    d = _as_double(c, dtype)
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    truncated = F.when(ok, F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)))
    return F.greatest(F.lit(0), F.coalesce(truncated.try_cast("bigint"), F.lit(0))).cast("bigint")


# Python strptime field patterns (``%m``, ``%d``, ``%H``, ``%M``, ``%S``).
_Y = r"([0-9]{4})"
_M = r"(1[0-2]|0[1-9]|[1-9])"
_D = r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_HH = r"(2[0-3]|[0-1][0-9]|[0-9])"
_MI = r"([0-5][0-9]|[0-9])"
_SS = r"(6[0-1]|[0-5][0-9]|[0-9])"
_F = r"([0-9]{1,6})"

# (regex, groups as (year, month, day, hour, minute, second, fraction)) in the
# original's try order.  Group numbers are 1-based; 0 means "absent".
DATE_FORMATS = [
    (f"^{_Y}-{_M}-{_D}{WS}+{_HH}:{_MI}:{_SS}$", (1, 2, 3, 4, 5, 6, 0)),   # %Y-%m-%d %H:%M:%S
    (f"^{_Y}-{_M}-{_D}$", (1, 2, 3, 0, 0, 0, 0)),                        # %Y-%m-%d
    (f"^{_M}/{_D}/{_Y}$", (3, 1, 2, 0, 0, 0, 0)),                        # %m/%d/%Y
    (f"^{_D}/{_M}/{_Y}$", (3, 2, 1, 0, 0, 0, 0)),                        # %d/%m/%Y
    (f"^{_Y}-{_M}-{_D}[Tt]{_HH}:{_MI}:{_SS}\\.{_F}$", (1, 2, 3, 4, 5, 6, 7)),  # ...T%H:%M:%S.%f
    (f"^{_Y}-{_M}-{_D}[Tt]{_HH}:{_MI}:{_SS}[Zz]$", (1, 2, 3, 4, 5, 6, 0)),     # ...T%H:%M:%SZ
]
ISO_PREFIX_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"


#: Day-first dates, tried when the month-first reading fails.
DAY_FIRST = 3


def _canonical(s: Column, regex: str, groups) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSSSSS`` of a matching string, as one regular-expression replacement and padding."""
    def g(i, width):
        if i == 0:
            return F.lit("0" * width)
        return F.lpad(F.trim(F.regexp_extract(s, regex, i)), width, "0")

    y, mo, d, h, mi, se, fr = groups
    frac = F.rpad(F.regexp_extract(s, regex, fr), 6, "0") if fr else F.lit("000000")
    return F.concat(g(y, 4), F.lit("-"), g(mo, 2), F.lit("-"), g(d, 2), F.lit(" "), g(h, 2), F.lit(":"), g(mi, 2),
                    F.lit(":"), g(se, 2), F.lit("."), frac)


def parse_date(c) -> Column:
    """The first format (in order) that parses the whole string, as a timestamp.

    Only the two slash forms can both match; all others exclude each other, so a string has one canonical text to
    parse, and a second one (day first) only where the month-first reading is no date.
    """
    s = col(c).cast("string")
    text = F.coalesce(*[F.when(s.rlike(rx), _canonical(s, rx, gr)) for rx, gr in DATE_FORMATS])
    rx, gr = DATE_FORMATS[DAY_FIRST]
    first = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    second = F.try_to_timestamp(F.when(s.rlike(rx), _canonical(s, rx, gr)), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.coalesce(first, second)


def iso_format(ts) -> Column:
    """``datetime.isoformat()``: seconds, plus microseconds only when non-zero."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(ts, "SSSSSS")
    return F.when(micro == "000000", base).otherwise(F.concat(base, F.lit("."), micro))


def normalize_date(c) -> Column:
    """ISO-looking strings pass unchanged; else first matching format -> ISO; else NULL."""
    s = col(c).cast("string")
    return (F.when(s.isNull() | (s == ""), F.lit(None).cast("string"))
            .when(s.rlike(ISO_PREFIX_RE), s)
            .otherwise(iso_format(parse_date(s))))


def parse_iso_naive(c) -> Column:
    """``datetime.fromisoformat(s.replace('Z', '+00:00')).replace(tzinfo=None)``."""
    s = F.regexp_replace(col(c), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return s.try_cast("timestamp_ntz")


def floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint")


def days_old(review_date, as_of: str) -> Column:
    """Whole days (floor) between a naive ISO date string and ``as_of``."""
    ts = parse_iso_naive(review_date)
    us = F.unix_micros(ts.cast("timestamp"))
    as_of_us = F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"))
    return floor_div(as_of_us - us, 86_400_000_000)


def parse_int_prefix(c) -> Column:
    """JavaScript ``parseInt(x) || 0``: optional sign and leading digits, else 0."""
    s = col(c).cast("string")
    digits = F.regexp_extract(s, f"^[{WS_CLASS}\\x{{FEFF}}]*([+-]?[0-9]+)", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0)).cast("bigint")


def falsy_to(c, default) -> Column:
    """JavaScript ``a || default`` for strings: NULL or '' -> default."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(default))


def platform_from_url(c) -> Column:
    q = F.coalesce(col(c), F.lit(""))
    return (F.when(q.contains("apps.apple.com"), F.lit("iOS App Store"))
            .when(q.contains("play.google.com"), F.lit("Google Play Store"))
            .otherwise(F.lit("Unknown")))


def sentiment_to_rating(c) -> Column:
    s = col(c)
    return (F.when(s >= 0.5, 5).when(s >= 0.2, 4).when(s >= -0.2, 3).when(s >= -0.5, 2)
            .otherwise(1)).cast("int")


def epoch_to_iso(c) -> Column:
    """Epoch seconds -> naive ISO string (UTC; the original used the host zone)."""
    return iso_format(F.timestamp_seconds(col(c)))


def safe_rate(num, den) -> Column:
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))
