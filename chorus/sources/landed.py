"""Readers for landed files and canonicalisation to the review schema.

Network collection is out of scope: these start from JSON / CSV / Parquet
already landed on shared storage.  Every reader is a plain ``spark.read``
with an explicit schema where the shape is known, so Parquet pushdown and
pruning apply and malformed JSON lands in a rejects column instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.functions import normalize as N
from chorus.schema import API_REVIEW, REVIEW_SCHEMA

CANONICAL_DEFAULTS = {"helpful_count": 0, "reply_count": 0, "verified": False, "raw_data": "{}"}
#: Containers are never NULL in a record.
CONTAINER_DEFAULTS = {"category_scores": lambda: F.create_map(), "keywords_found": lambda: F.array()}


def canonical(df: DataFrame, platform: str | None = None, scraped_at: str | None = None) -> DataFrame:
    """Project any source onto the review schema with the original's defaults.

    Known fields are kept (unknown ones dropped), missing ones become NULL or
    their default (``helpful=0, reply=0, verified=False, raw_data='{}'``);
    ``platform`` and ``scraped_at`` are stamped when given.  ``ord`` is kept.
    """
    have = set(df.columns)
    cols = [F.col("ord")] if "ord" in have else []
    for f in REVIEW_SCHEMA.fields:
        name = f.name
        if name == "platform" and platform is not None:
            c = F.lit(platform)
        elif name == "scraped_at" and scraped_at is not None:
            c = F.coalesce(F.col(name), F.lit(scraped_at)) if name in have else F.lit(scraped_at)
        elif name == "username" and name not in have and "user_id" in have:
            c = F.col("user_id")
        elif name in have:
            c = F.col(name)
            if name in CANONICAL_DEFAULTS:
                c = F.coalesce(c, F.lit(CANONICAL_DEFAULTS[name]))
            if name in CONTAINER_DEFAULTS:
                c = F.coalesce(c, CONTAINER_DEFAULTS[name]().cast(f.dataType))
        elif name in CONTAINER_DEFAULTS:
            c = CONTAINER_DEFAULTS[name]()
        elif name in CANONICAL_DEFAULTS:
            c = F.lit(CANONICAL_DEFAULTS[name])
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(name))
    return df.select(*cols)


def reject_reason() -> Column:
    """Why the record constructor would refuse a row (NULL = accepted)."""
    def blank(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rating = F.col("rating")
    return (F.when(blank("review_id"), "missing_review_id")
            .when(blank("platform"), "missing_platform")
            .when(blank("app_name"), "missing_app_name")
            .when(rating.isNotNull() & ((rating < 1) | (rating > 5)), "rating_out_of_range"))


def records_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Record JSON texts to review rows: known fields kept, containers filled; other columns of ``df`` go, but ``ord``.

    A text that is no JSON object gives a row of NULLs, which ``reject_reason`` refuses.
    """
    keep = ["ord"] if "ord" in df.columns else []
    return canonical(df.select(*keep, F.from_json(column, REVIEW_SCHEMA).alias("r")).select(*keep, "r.*"))


def records_to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """``df`` with each record as a JSON text: all record fields, NULLs written."""
    fields = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
              for f in REVIEW_SCHEMA.fields]
    return df.withColumn(name, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


#: Landed app information: record field -> field of the store's answer.
APP_FIELDS = {"package_id": "appId", "title": "title", "description": "description", "developer": "developer",
              "category": "genre", "rating": "score", "reviews_count": "reviews", "installs": "installs",
              "price": "price", "free": "free", "version": "version", "updated": "updated", "size": "size",
              "screenshots": "screenshots", "url": "url"}
SEARCH_FIELDS = {"package_id": "appId", "title": "title", "developer": "developer", "category": "genre",
                 "rating": "score", "price": "price", "free": "free", "icon": "icon", "url": "url"}


def _renamed(df: DataFrame, fields: dict[str, str]) -> list[Column]:
    return [(F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(name) for name, src in fields.items()]


def app_metadata(info: DataFrame, scraped_at: str) -> DataFrame:
    """Landed store answers to app metadata rows; absent fields are NULL, absent screenshots an empty array."""
    out = info.select(*_renamed(info, APP_FIELDS), F.lit(scraped_at).alias("scraped_at"))
    shots = F.col("screenshots") if "screenshots" in info.columns else F.lit(None)
    return out.withColumn("screenshots", F.coalesce(shots.cast("array<string>"), F.array().cast("array<string>")))


def app_search(results: DataFrame, query: str, limit: int = 10, order: str = "ord") -> DataFrame:
    """The first ``limit`` landed search results of ``query`` as app rows."""
    hits = results.where(F.col("query") == query).orderBy(order).limit(limit)
    return hits.select(*_renamed(hits, SEARCH_FIELDS))


def sentiment_reject() -> Column:
    s = F.col("sentiment")
    return F.when(s.isNotNull() & ~s.isin("positive", "negative", "neutral"), "bad_sentiment")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multiline: bool = False) -> DataFrame:
    """JSON with corrupt records kept in ``_corrupt_record``; missing path -> empty frame."""
    reader = spark.read.option("mode", "PERMISSIVE").option("multiLine", multiline)
    if schema is not None:
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        reader = reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record")
    try:
        return reader.json(path)
    except Exception as e:  # missing path: the original returns an empty result
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema or T.StructType([]))
        raise


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column a string, quoted multi-line cells allowed."""
    try:
        return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
                .option("inferSchema", False).csv(path))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], T.StructType([]))
        raise


def _batch_documents(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("metadata", T.StructType([
            T.StructField("app_name", T.StringType()), T.StructField("platform", T.StringType()),
            T.StructField("scraped_at", T.StringType()), T.StructField("total_scraped", T.LongType()),
            T.StructField("total_processed", T.LongType()),
            T.StructField("processing_stats", T.MapType(T.StringType(), T.LongType()))])),
        T.StructField("reviews", T.ArrayType(REVIEW_SCHEMA)), T.StructField("_corrupt_record", T.StringType()),
    ])
    return (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("file", F.input_file_name()))


def _rejected(raw: DataFrame) -> Column:
    """Documents that are no JSON, or have neither metadata nor reviews."""
    return F.col("_corrupt_record").isNotNull() | (F.col("metadata").isNull() & F.col("reviews").isNull())


def batch_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the documents that ``read_batch_json`` leaves out."""
    raw = _batch_documents(spark, path)
    reason = F.when(F.col("_corrupt_record").isNotNull(), "corrupt_document").otherwise("no_batch")
    return raw.where(_rejected(raw)).select("file", reason.alias("reason"))


def read_batch_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Batch documents ``{metadata, reviews[]}`` -> (metadata rows, review rows); corrupt ones are left to ``batch_rejects``."""
    raw = _batch_documents(spark, path)
    raw = raw.where(~_rejected(raw)).drop("_corrupt_record")
    meta = raw.select(
        F.coalesce("metadata.app_name", F.lit("")).alias("app_name"),
        F.coalesce("metadata.platform", F.lit("")).alias("platform"),
        F.coalesce("metadata.scraped_at", F.lit("")).alias("scraped_at"),
        F.coalesce("metadata.total_scraped", F.size("reviews").cast("long")).alias("total_scraped"),
        F.coalesce("metadata.total_processed", F.lit(0).cast("long")).alias("total_processed"),
        F.coalesce("metadata.processing_stats", F.create_map().cast("map<string,bigint>")).alias("processing_stats"),
    )
    # One ordinal rule over all documents: the document's place in the sorted list of files, then the position.
    # (The names alone are ranked; the optimiser chooses the join.)
    files = raw.select("file").distinct().withColumn("_k", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    rows = (raw.select("file", F.posexplode("reviews").alias("pos", "r")).join(files, "file")
            .select((F.col("_k") * F.lit(1 << 28) + F.col("pos")).alias("ord"), "r.*"))
    rows = rows.withColumns({
        "category_scores": F.coalesce("category_scores", F.create_map().cast("map<string,double>")),
        "keywords_found": F.coalesce("keywords_found", F.array().cast("array<string>")),
        "raw_data": F.coalesce("raw_data", F.lit("{}")),
    })
    return meta, rows


# ---------------------------------------------------------------- API responses
def _api_review_row(r: Column) -> dict[str, Column]:
    return {
        "platform": N.platform_from_url(r["query"]),
        "review_id": N.falsy_to(r["review_id"], ""),
        "rating": N.parse_int_prefix(r["review_rating"]),
        "title": N.falsy_to(r["review_title"], ""),
        "review_text": N.falsy_to(r["review_text"], ""),
        "author": F.coalesce(F.nullif(r["author_title"], F.lit("")), F.nullif(r["author_name"], F.lit("")), F.lit("")),
        "date": F.coalesce(F.nullif(r["review_updated"], F.lit("")), F.nullif(r["review_date_formated"], F.lit("")),
                           F.lit("")),
        "helpful_count": N.parse_int_prefix(r["vote_sum"]),
        "vote_count": N.parse_int_prefix(r["vote_count"]),
        "version": N.falsy_to(r["version"], ""),
        "country": N.falsy_to(r["country"], ""),
        "timestamp": F.coalesce(F.when(r["review_timestamp"] != 0, r["review_timestamp"]), F.lit(0)).cast("long"),
    }


def flatten_api_responses(raw: DataFrame, json_col: str = "body", app_col: str = "app_name",
                          order_col: str = "ord") -> DataFrame:
    """Landed API responses (one JSON text per row) -> one row per review.

    Array form ``[{status, data: [[review]]}]``: keep ``status = 'Success'``
    items and flatten the nested data.  Object form ``{status, data}``: if
    ``data[0]`` is an array use only ``data[0]``, else ``data`` itself.
    One chain for all forms: the body is read as items whose ``data`` elements
    stay JSON text, and an element, object or array, as an array of reviews.
    ``ord`` is the response's ordinal, then the review's position in it, as one
    number (2**24 reviews a response), so first-occurrence rules see the
    original order.
    """
    text = F.ltrim(F.col(json_col))
    is_object = text.startswith("{")
    items = F.from_json(F.when(is_object, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text),
                        "array<struct<status:string,data:array<string>>>")
    good = F.filter(items, lambda i: (i["status"] == "Success") & i["data"].isNotNull())
    data = F.flatten(F.transform(good, lambda i: i["data"]))
    first_only = is_object & F.coalesce(F.ltrim(F.get(data, F.lit(0))).startswith("["), F.lit(False))
    groups = raw.select(F.col(app_col).alias("app_name"), F.col(order_col).cast("long").alias("resp_ord"),
                        F.when(first_only, F.slice(data, 1, 1)).otherwise(data).alias("groups"))
    parsed = groups.select("app_name", "resp_ord", F.flatten(F.transform(
        "groups", lambda g: F.coalesce(F.from_json(g, T.ArrayType(API_REVIEW)), F.array().cast(T.ArrayType(API_REVIEW)))
    )).alias("reviews"))
    rows = parsed.select("app_name", "resp_ord", F.posexplode("reviews").alias("k", "r"))
    return rows.select((F.col("resp_ord") * F.lit(1 << 24) + F.col("k")).alias("ord"), "app_name",
                       *[v.alias(k) for k, v in _api_review_row(F.col("r")).items()])


def api_reviews(rows: DataFrame) -> DataFrame:
    """Flattened API rows under the review schema's names; a rating of 0 (none given) is NULL."""
    return rows.select("ord", "app_name", "platform", "review_id", F.nullif("rating", F.lit(0)).alias("rating"), "title",
                       F.col("review_text").alias("content"), F.nullif("author", F.lit("")).alias("user_id"),
                       F.nullif("date", F.lit("")).alias("review_date"), "helpful_count", "version", "country")


def first_then_nonempty(df: DataFrame, keys=("review_id", "platform"), text: str = "review_text") -> DataFrame:
    """First row per key over *all* rows, then drop rows whose text is blank.

    A grouped ``min_by`` of the whole row (map-side pre-aggregated, so a hot key
    ships one row per task): the source is read once.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("_r")).select(*keys, "_r.*")
    return first.select(df.columns).where(F.regexp_replace(F.col(text), f"{N.WS}", "") != "")


def normalize_store_reviews(dump: DataFrame, app_name: str | Column, app_info: dict | None = None) -> DataFrame:
    """Landed store-review dump -> review rows (``playstore_`` ids, verified, en/us, app info in raw_data).

    ``app_name`` is a name or a column of the dump; ``ord`` is kept when the dump has it.
    ``app_info`` is the one app's metadata (a handful of fields, a literal).
    A missing score becomes 0 (and the record check rejects it), as in the original.
    """
    info = (F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in app_info.items()])) if app_info
            else F.lit("{}"))
    name = app_name if isinstance(app_name, Column) else F.lit(app_name)
    return dump.select(
        *[F.col("ord")] * ("ord" in dump.columns),
        F.concat(F.lit("playstore_"), F.col("reviewId").cast("string")).alias("review_id"),
        F.lit("playstore").alias("platform"), name.alias("app_name"),
        F.col("reviewId").cast("string").alias("user_id"), F.col("userName").alias("username"),
        F.coalesce(F.col("score"), F.lit(0)).cast("int").alias("rating"),
        F.lit(None).cast("string").alias("title"), F.col("content"),
        F.col("at").cast("string").alias("review_date"),
        F.coalesce(F.col("thumbsUpCount"), F.lit(0)).cast("long").alias("helpful_count"),
        F.lit(True).alias("verified"), F.col("appVersion").alias("version"),
        F.lit("en").alias("language"), F.lit("us").alias("country"),
        info.alias("raw_data"))


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested struct columns -> top-level columns named with dotted paths (arrays untouched)."""
    def walk(dtype, path):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, [*path, f.name])
        else:
            yield path
    cols = []
    for f in df.schema.fields:
        for path in walk(f.dataType, [f.name]):
            c = F.col(path[0])
            for p in path[1:]:
                c = c.getField(p)
            cols.append(c.alias(sep.join(path)))
    return df.select(*cols)


def generic_hash(df: DataFrame, column: str) -> Column:
    """md5 of a string as it is, or of the JSON text of a map or array: keys sorted, ``", "`` and ``": "`` between
    parts, characters beyond ASCII escaped."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if not isinstance(kind, (T.MapType, T.ArrayType)):
        return F.md5(c.cast("string"))

    def text(value: Column, t: T.DataType) -> Column:
        if isinstance(t, T.MapType):
            entries = F.array_sort(F.map_entries(value))
            parts = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), text(e["value"], t.valueType)))
            return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
        if isinstance(t, T.ArrayType):
            return F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: text(v, t.elementType)), ", "), F.lit("]"))
        shown = F.when(value.isNotNull(), quoted(value)) if isinstance(t, T.StringType) else value.cast("string")
        return F.coalesce(shown, F.lit("null"))

    def quoted(value: Column) -> Column:
        raw = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":|\}$', "")
        units = F.transform(F.split(raw, ""), lambda ch: F.when(F.ascii(ch) < 128, ch).otherwise(escaped(ch)))
        return F.array_join(units, "")

    def escaped(ch: Column) -> Column:
        code = F.hex(F.encode(ch, "UTF-16BE"))
        both = F.concat(F.lit("\\u"), F.lower(F.substring(code, 1, 4)),
                        F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.lower(F.substring(code, 5, 4))))
                        .otherwise(F.lit("")))
        return both

    return F.md5(text(c, kind))


def overlay(df: DataFrame, updates: DataFrame, key: str = "review_id", as_of: str | None = None) -> DataFrame:
    """Each non-NULL update value replaces the current one; ``processed_at`` is stamped on every updated row (4.16).

    Several updates of a key apply in the order of ``updates.ord`` (or of all their values, without one): the last
    non-NULL value of each column wins, and the row stays one row.
    """
    cols = [c for c in updates.columns if c not in (key, "ord") and c in df.columns]
    order = F.struct("ord") if "ord" in updates.columns else F.struct(*[F.to_json(F.struct(*cols))])
    u = updates.groupBy(key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)),
                                            F.when(F.col(c).isNotNull(), order)).alias(f"_u_{c}") for c in cols],
                                 F.lit(True).alias("_updated"))
    j = df.join(u, key, "left")
    j = j.withColumns({c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in cols})
    before = F.col("processed_at") if "processed_at" in df.columns else F.lit(None).cast("string")
    j = j.withColumn("processed_at", F.when(F.col("_updated"), F.lit(as_of)).otherwise(before))
    return j.drop("_updated", *[f"_u_{c}" for c in cols])
