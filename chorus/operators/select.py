"""Row selection: budgets, seeded samples, bullets, date ranges, orders, previews."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus import lexicons as LX
from chorus.functions.text import contains_any, truncate_ellipsis, truncate_to


def per_group_budget(df: DataFrame, group: str, limit: int, order: str = "ord") -> DataFrame:
    """At most ``limit // #groups`` rows per group (by ``order``), then at most ``limit`` in total.

    The number of groups is a scalar subquery of the same plan, so nothing runs while the query is built.  No group
    can get more than ``limit`` rows: that literal bound is planned as a group limit in each task before the
    shuffle, and the exact budget applies after it.
    """
    w = Window.partitionBy(group).orderBy(order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    groups = df.agg(F.greatest(F.countDistinct(group), F.lit(1)).alias("n")).scalar()
    picked = ranked.where(F.col("_rn") <= F.floor(F.lit(limit) / groups)).drop("_rn")
    return picked.orderBy(order).limit(limit)


def keyword_budgets(posts: DataFrame, keywords: Sequence[str], limit: int, hot_share: float = 0.5,
                    text: Column | None = None, hot_order: str = "score", order: str = "ord") -> DataFrame:
    """The search-then-hot collection rule over landed posts, per source.

    Each keyword gets ``limit // #keywords`` posts of a source whose text has it (by ``order``); the source's hottest
    ``limit * hot_share`` posts (by ``hot_order``, highest first) are kept when any keyword occurs in them.  A post found
    several times comes once, with ``found_by`` naming the first keyword (in the list's order), or ``hot``.
    """
    body = text if text is not None else F.concat_ws(" ", "title", "selftext")
    share = max(1, limit // max(1, len(keywords)))
    low = F.lower(F.coalesce(body, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(n)) for n, k in enumerate(keywords)]))
    by_word = Window.partitionBy("source", "_k").orderBy(order)
    searched = (posts.withColumn("_k", F.explode(hits)).withColumn("_rn", F.row_number().over(by_word))
                .where(F.col("_rn") <= share).select("source", order, "_k"))
    hottest = (posts.withColumn("_rn", F.row_number().over(
        Window.partitionBy("source").orderBy(F.desc_nulls_last(hot_order), order)))
        .where(F.col("_rn") <= max(1, int(limit * hot_share))))
    hot = hottest.where(contains_any(body, list(keywords))).select("source", order, F.lit(len(keywords)).alias("_k"))
    first = searched.unionByName(hot).groupBy("source", order).agg(F.min("_k").alias("_k"))
    names = F.array(*[F.lit(k) for k in [*keywords, "hot"]])
    return posts.join(first, ["source", order]).withColumn("found_by", names[F.col("_k")]).drop("_k")


def seeded_sample(df: DataFrame, group: str, id_col: str, n: int = LX.SAMPLE_SIZE, seed: str = "42",
                  order: str = "ord") -> DataFrame:
    """Reproducible sample of ``n`` rows per group: order by md5(seed || id); 1-based ``pos``."""
    key = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    w = Window.partitionBy(group).orderBy(key, order)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def text_key_expr(schema: T.StructType, row: Column, preferred: Sequence[str] = LX.PREFERRED_TEXT_COLUMNS) -> Column:
    """Name of the text column of ``row`` (a struct of ``schema``): one ranking over all columns.

    A filled preferred column ranks by its place in ``preferred``; below those, string columns rank by their trimmed
    length, then by position; ``text`` if nothing is filled.
    """
    ranks = []
    for place, field in enumerate(schema.fields):
        size = F.length(F.trim(row[field.name].cast("string")))
        if field.name in preferred:
            ranks.append(F.when(size > 0, F.struct(F.lit(2).alias("tier"), F.lit(-preferred.index(field.name)).alias("a"),
                                                   F.lit(-place).alias("b"), F.lit(field.name).alias("name"))))
        if isinstance(field.dataType, T.StringType):
            ranks.append(F.when(size > 0, F.struct(F.lit(1).alias("tier"), size.alias("a"),
                                                   F.lit(-place).alias("b"), F.lit(field.name).alias("name"))))
    if not ranks:
        return F.lit("text")
    return F.coalesce(F.array_max(F.array_compact(F.array(*ranks)))["name"], F.lit("text"))


def text_key(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the text column of the first row by ``order``, as one aggregate."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    first = df.agg(F.min_by(row, F.struct(*order)).alias("row"))
    return first.select(text_key_expr(df.schema, F.col("row")).alias("text_key"))


def bullets(sample: DataFrame, group: str, text_column: str | None = None, id_col: str | None = None,
            cut: int = LX.SAMPLE_TEXT_CUT) -> DataFrame:
    """``- [id] (product) ★rating: text`` lines joined by newlines, per group (<= sample size rows).

    Without ``text_column`` the column is chosen from the first row, as a scalar subquery of the plan.
    """
    key = F.lit(text_column) if text_column else text_key(sample, [group, "pos"]).scalar()
    texts = [text_column] if text_column else [c for c in sample.columns]
    shown = F.coalesce(*[F.when(key == c, F.col(f"`{c}`").cast("string")) for c in texts])
    ident = F.col(id_col).cast("string") if id_col else F.col("pos").cast("string")
    product = (F.when(F.col("product").isNotNull(), F.concat(F.lit(" ("), F.col("product"), F.lit(")")))
               .otherwise(F.lit("")) if "product" in sample.columns else F.lit(""))
    rating = (F.when(F.col("rating").isNotNull() & (F.col("rating").cast("string") != ""),
                     F.concat(F.lit(" ★"), F.col("rating").cast("string"))).otherwise(F.lit(""))
              if "rating" in sample.columns else F.lit(""))
    line = F.concat(F.lit("- ["), ident, F.lit("]"), product, rating, F.lit(": "), truncate_to(shown, cut))
    lines = sample.select(group, "pos", line.alias("line")).groupBy(group).agg(
        F.count(F.lit(1)).alias("count"), F.collect_list(F.struct("pos", "line")).alias("l"))
    joined = F.array_join(F.transform(F.array_sort("l"), lambda x: x["line"]), "\n")
    return lines.select(group, "count", joined.alias("bullets"), key.alias("text_key"))


#: Named ranges: days from the anchor (the day of ``now``, or ``now`` itself) to the start and to the end.
NAMED_RANGES = {"today": ("day", 0, "now", 0), "yesterday": ("day", -1, "day", 0),
                "last_week": ("now", -7, "now", 0), "last_month": ("now", -30, "now", 0)}


def date_range(spec: str, now: str | datetime) -> tuple[datetime, datetime]:
    """Both ends (inclusive) of a range: a name, ``last_N_days``, ``a:b`` or one date (that day and its midnight).

    An explicit range has exactly one colon, so its ends carry no times.
    """
    now = datetime.fromisoformat(now) if isinstance(now, str) else now
    anchors = {"now": now, "day": datetime.combine(now.date(), datetime.min.time(), now.tzinfo)}
    rules = dict(NAMED_RANGES)
    if spec.startswith("last_") and spec.endswith("_days"):
        rules[spec] = ("now", -int(spec.removeprefix("last_").removesuffix("_days")), "now", 0)
    if spec in rules:
        a, da, b, db = rules[spec]
        # A range that ends with a day ends with its last microsecond.
        last = timedelta(days=db) - timedelta(microseconds=int(b == "day"))
        return anchors[a] + timedelta(days=da), anchors[b] + last
    ends = [datetime.fromisoformat(e) for e in spec.split(":")] if spec.count(":") < 2 else []
    if len(ends) == 1:
        ends.append(ends[0] + timedelta(days=1))
    if not ends:
        raise ValueError(f"bad date range: {spec!r}")
    return ends[0], ends[1]


def date_range_filter(df: DataFrame, column: str, spec: str, now: str | datetime) -> DataFrame:
    """Rows whose timestamp lies in the range (a literal predicate: pushed to the Parquet scan)."""
    start, end = date_range(spec, now)
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def newest_first(df: DataFrame, timestamp: str = "timestamp", date: str = "date", order: str = "ord") -> DataFrame:
    """All rows, newest first: by timestamp if set, else the parsed date, rows with neither last; ties in ingest order.

    A global sort (range exchange); a ``limit`` on top is planned as a top-k of each task.
    """
    key = F.coalesce(F.when(F.col(timestamp) != 0, F.col(timestamp)),
                     F.unix_timestamp(F.try_to_timestamp(F.col(date))))
    return df.withColumn("newest_key", key).orderBy(F.desc_nulls_last("newest_key"), order)


def format_timestamp(ts: Column | str, as_of: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """An ISO timestamp without its zone, in a pattern; ``as_of`` where it is NULL, empty or not a timestamp."""
    text = F.regexp_replace(F.col(ts) if isinstance(ts, str) else ts, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return F.date_format(F.coalesce(text.try_cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")), pattern)


def content_preview(cut: int = LX.PREVIEW_CUT) -> Column:
    """A ``cut``-character preview of the display content."""
    return truncate_ellipsis(F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("raw_content")), cut)


def record_summary(df: DataFrame, cut: int = LX.PREVIEW_CUT) -> DataFrame:
    """One-line summary per record with a preview of the display content; rows without texts hold it as ``content_preview``."""
    preview = content_preview(cut).alias("content_preview") if "content" in df.columns else F.col("content_preview")
    return df.select("review_id", "platform", "app_name", "rating", "sentiment", "primary_category", preview, "review_date",
                     "is_high_quality", "helpful_count")
