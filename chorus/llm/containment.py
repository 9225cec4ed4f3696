"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are short, documents long, so the search asks which documents contain a share ``threshold`` of an
item's ``width``-word shingles.  Items are partitioned by size, in powers of two; a partition allows a document to
miss at most m of an item's shingles.  The sketch of an item is its MinHash bottom-k: the k = 2 m + 1 smallest hashes
of its shingles (all of them, if fewer).  A document that contains the item holds at least k - m of its sketch, so
no item is missed, and a passage that many texts share is not enough to make a candidate.  Documents with too few
shingles for any item of a sketch hash are left out.  Candidates are verified by the exact share of the item's
shingles (as text) that the document has.

Words are maximal runs of letters and digits of the lower-cased text, so case and punctuation do not hide a
passage.  Texts with fewer than ``width`` words form one shingle of all their words.

Defined cases: null, empty and wordless texts and items match nothing; rows with a null id take no part in the
pairs, and ``decontaminate`` keeps them (``decontaminate_rows`` judges them like all others); repeated rows give one pair; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``contained_items`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import numbered, stage, table

# Broadcast sides are counted first; beyond these rows the same joins run as shuffles.
SKETCH_ROWS = 500_000
CANDIDATE_ROWS = 2_000_000


def word_list(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_texts(words: Column, width: int) -> Column:
    """Shingles as text, with repeats; a shorter text is one shingle, no words give none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1)))
    texts = F.transform(starts, lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) > 0, texts).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of the same shingles, with repeats: no shingle text is built."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    hashed = F.transform(F.sequence(F.lit(0), last),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def maybe_broadcast(df: DataFrame, rows: int, bound: int) -> DataFrame:
    return F.broadcast(df) if rows <= bound else df


def item_sketches(items: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(sketch rows, shingle rows) of the items, one row per item and hash, or item and shingle text."""
    # Words are a column of their own: inside a lambda they would be split anew for every shingle.
    words = items.where(F.col("item_id").isNotNull()).select("item_id", word_list(F.col("text")).alias("w"))
    shingles = (words.select("item_id", F.explode(shingle_texts(F.col("w"), width)).alias("shingle")).distinct())
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    # The same hash as a document's: of the words, not of the joined text.
    part = F.split("shingle", " ")
    hashed = shingles.select("item_id", "shingle", F.xxhash64(*[F.get(part, F.lit(k)) for k in range(width)])
                             .alias("hash"))
    full = stage(hashed.join(sizes, "item_id"), "items")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_shingles"))).cast("long")
    miss = F.floor(upper - F.ceil(upper * threshold - 1e-9)).cast("long")
    # An item has n of the partition's upper size; k never passes n.
    k = F.least(F.col("n_shingles"), 2 * miss + 1)
    kept = full.groupBy("item_id", "n_shingles").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    sketch = kept.select("item_id", "n_shingles", (k - miss).alias("least_hits"),
                         F.explode(F.slice("hashes", F.lit(1), k.cast("int"))).alias("hash"))
    return sketch, full


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every document that contains an item."""
    sketch, full = item_sketches(items.select("item_id", "text"), threshold, width)
    sketch_rows, full_rows = sketch.count(), full.count()
    need = F.ceil(F.col("n_shingles") * threshold - 1e-9)
    probe = sketch.groupBy("hash").agg(F.min(need).alias("fewest"))

    whole = docs.where(F.col("doc_id").isNotNull()).select("doc_id", word_list(F.col("text")).alias("w"))
    hashes = whole.select("doc_id", F.size("w").alias("n_words"), F.explode(shingle_hashes(F.col("w"), width))
                          .alias("hash"))
    hit = (hashes.join(maybe_broadcast(probe, sketch_rows, SKETCH_ROWS), "hash")
           .where(F.greatest(F.col("n_words") - (width - 1), F.lit(1)) >= F.col("fewest")))
    hits = hit.select("doc_id", "hash").distinct()
    listed = sketch.select("hash", "item_id", "least_hits")
    candidates = (hits.join(maybe_broadcast(listed, sketch_rows, SKETCH_ROWS), "hash")
                  .groupBy("doc_id", "item_id", "least_hits").agg(F.count("*").alias("hits"))
                  .where(F.col("hits") >= F.col("least_hits")))
    pairs = stage(candidates.select("doc_id", "item_id"), "candidates")

    ids = pairs.select("doc_id").distinct()
    suspects = (docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
                .join(maybe_broadcast(ids, pairs.count(), CANDIDATE_ROWS), "doc_id", "left_semi"))
    texts = (suspects.select("doc_id", word_list(F.col("text")).alias("w"))
             .select("doc_id", F.explode(shingle_texts(F.col("w"), width)).alias("shingle")))
    found = (texts.join(maybe_broadcast(full.select("item_id", "shingle", "n_shingles"), full_rows, SKETCH_ROWS),
                        "shingle")
             .distinct().groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_found"))
             .where(F.col("n_found") >= need))
    return (found.join(pairs, ["doc_id", "item_id"], "left_semi")
            .select("doc_id", "item_id", "n_shingles", "n_found",
                    F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The documents that contain no item; rows with a null id stay."""
    bad = stage(contained_items(docs, items, threshold, width).select("doc_id").distinct(), "contaminated")
    return docs.join(maybe_broadcast(bad, bad.count(), CANDIDATE_ROWS), "doc_id", "left_anti").select(docs.columns)


def decontaminate_rows(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The rows whose own text contains no item, whatever their ids: null and repeated ids are like all others."""
    rows, key = numbered(docs, "numbered")
    found = contained_items(rows.select(F.col(key).alias("doc_id"), "text"), items, threshold, width)
    bad = stage(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return rows.join(maybe_broadcast(bad, bad.count(), CANDIDATE_ROWS), key, "left_anti").select(docs.columns)


def op7_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the share of its 5-word shingles they hold."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM benchmark WHERE item_id IS NOT NULL),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
     bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM b WHERE len(w) > 0)),
     n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
     f AS (SELECT ds.doc_id, bs.item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT f.doc_id, f.item_id, n.n_shingles, f.n_found, round(f.n_found / n.n_shingles, 6) AS containment
FROM f JOIN n USING (item_id) WHERE 10 * f.n_found >= 8 * n.n_shingles
"""
