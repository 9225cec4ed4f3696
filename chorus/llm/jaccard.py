"""N-gram Jaccard join: grouped prefix join.

A document's set holds the 64-bit hashes of its distinct word shingles (five words and a similarity of 0.8 unless
told otherwise).  Documents link when their sets' Jaccard similarity is at least ``percent`` hundredths; a link forces
a common shingle among the first n - ceil(percent * n / 100) + 1 of each set in any fixed order (the prefix).  The
order is rare first, by a table of hashed shingle counts of a fixed number of cells, then by hash.

1. Documents with equal sets form a class; classes with equal prefix and size form a group.
2. Group pairs come from common prefix shingles, with the size and position filters; pairs of classes then pass a
   filter on histograms of their hashes (an upper bound of the overlap), and survivors are verified on whole sets.
3. What is asked for are components, so pairs already connected need no check.  First every prefix shingle links its
   groups to one central group (a star: as many pairs as rows, not their square).  Then, of shingles whose groups are
   still in several components, all pairs across components are checked, which loses no link.

Sets are read again from the texts only for classes in surviving pairs.  Nothing is capped, and no group is collected
into one task: hot shingles are split by the skew handling of the joins.

Defined cases: texts without words (null, empty) have an empty set, link with nothing and are their own component;
documents with a null id take part, and a component's id is the smallest id that is not null; repeated rows are equal
sets; rows with one id and different texts are one document, whose texts' classes belong together; very long texts are
read whole, in memory that follows the one text; equal counts in the rare-first order go by hash; ``keep_first`` judges rows, whatever their ids; an empty table gives an empty result; other columns are ignored by ``components`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import WordHashes, numbered, shingle_hashes, stage, table, text_bytes

CELL_BITS = 20
SEGMENTS = 64
BROADCAST_ROWS = 2_000_000


def cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many documents' shingles fall into each cell.  Tasks add up their own table; the parts of all tables
    are summed by segment, and the sum (a fixed 4 MB) comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, held, size = WordHashes(), np.zeros(1 << CELL_BITS, np.uint64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(cells(shingle_hashes(words(text.as_py()), width)))
                size += len(held[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint64)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint64)
        parts = np.minimum(total, np.uint64(2**32 - 1)).astype("<u4").reshape(SEGMENTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()),
                                          pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "n"])

    def add(left: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << CELL_BITS) // SEGMENTS, np.uint64)
        for n in left["n"]:
            total += np.frombuffer(n, "<u4")
        return pd.DataFrame({"part": [left["part"].iloc[0]],
                             "n": [np.minimum(total, np.uint64(2**32 - 1)).astype("<u4").tobytes()]})

    rows = texts.mapInArrow(count, "part int, n binary").groupBy("part").applyInPandas(add, "part int, n binary")
    got = sorted((r.part, bytes(r.n)) for r in rows.collect())
    return np.frombuffer(b"".join(n for _, n in got), "<u4") if got else np.zeros(1 << CELL_BITS, "<u4")


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Hashes counted by their top bits: 64 cells up to 1024 shingles, twice as many per doubling after that."""
    bits = 6 + max(0, (len(shingles) - 1).bit_length() - 10)
    bits = min(bits, 16)
    n = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(n, 65535).astype("<u2")


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these histograms share more."""
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    if x.max(initial=0) == 65535 or y.max(initial=0) == 65535:
        return 1 << 40
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.minimum(x, y).sum())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def set_rows(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, n, set_key, prefix, prefix_key, hist) of every document; no words give n = 0 and null keys."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, frequency = WordHashes(), shared.value
        for batch in batches:
            sizes, keys, prefixes, prefix_keys, hists = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_hashes(words(text.as_py()), width)
                n = len(s)
                sizes.append(n)
                if n == 0:
                    for column in (keys, prefixes, prefix_keys, hists):
                        column.append(None)
                    continue
                p = prefix_size(n, percent)
                f = frequency[cells(s)]
                if p < n:  # only those that can be in the prefix are sorted
                    edge = np.partition(f, p - 1)[p - 1]
                    some = f <= edge
                    s_in, f_in = s[some], f[some]
                else:
                    s_in, f_in = s, f
                first = s_in[np.lexsort((s_in, f_in))[:p]]
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefixes.append(first.view(np.int64))
                prefix_keys.append(xxhash.xxh3_128_digest(first.tobytes() + n.to_bytes(8, "little")))
                hists.append(histogram(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(prefix_keys, pa.binary()),
                 pa.array(hists, pa.binary())],
                names=["doc_id", "n", "set_key", "prefix", "prefix_key", "hist"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, set_key binary, prefix array<long>, prefix_key binary, hist binary")


def enough(overlap: Column, both: Column, percent: int) -> Column:
    """percent * union <= 100 * intersection, in whole numbers."""
    return overlap * (100 + percent) >= both * percent


def may_link(n1: Column, i: Column, n2: Column, j: Column, percent: int) -> Column:
    """Size filter, and position filter for a first common shingle at places i and j (from 0)."""
    bound = F.least(n1 - i, n2 - j)
    return enough(bound, n1 + n2, percent) & enough(F.least(n1, n2), n1 + n2, percent)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the class pairs (a, b) that link."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("hist").alias("h1"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("hist").alias("h2"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n1, n2, h1, h2 = (batch.column(k).to_pylist() for k in range(6))
            keep = [overlap_bound(h1[k], h2[k]) * (100 + percent) >= percent * (n1[k] + n2[k]) for k in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    near = stage(pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "h1", "h2")
                 .mapInArrow(bounded, "a long, b long"), "near-pairs")
    ends = near.select(F.col("a").alias("cid")).union(near.select(F.col("b").alias("cid"))).distinct()
    needed = stage(classes.join(ends, "cid", "left_semi").select("cid", "set_key", "first_id"), "needed")
    n_needed = needed.count()
    if n_needed == 0:
        return near
    ids = needed.where(F.col("first_id").isNotNull()).select(F.col("first_id").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    held = rows.join(F.broadcast(ids) if n_needed <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    held = held.union(rows.where(F.col("doc_id").isNull()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            got = [shingle_hashes(words(t.as_py()), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in got], pa.binary()),
                 pa.array([s.tobytes() for s in got], pa.binary())], names=["set_key", "shingles"])

    found = held.mapInArrow(sets, "set_key binary, shingles binary")
    wanted = needed.select("cid", "set_key")
    whole = (found.join(F.broadcast(wanted) if n_needed <= BROADCAST_ROWS else wanted, "set_key")
             .groupBy("cid").agg(F.first("shingles").alias("shingles")))
    whole = stage(whole, "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                same = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]) \
                .filter(pa.array(keep, pa.bool_()))

    left = whole.select(F.col("cid").alias("a"), F.col("shingles").alias("s1"))
    right = whole.select(F.col("cid").alias("b"), F.col("shingles").alias("s2"))
    return stage(near.join(left, "a").join(right, "b").select("a", "b", "s1", "s2")
                 .mapInArrow(check, "a long, b long"), "links")


def connected(edges: DataFrame) -> DataFrame:
    """(cid, label) of the nodes of edges (a, b): label is the smallest node of the component.

    Rounds of taking the smallest label around, then the label of that label; each round is a written table.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = (both.join(labels.select(F.col("cid").alias("b"), "label"), "b")
                  .groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near")))
        jump = labels.select(F.col("cid").alias("label"), F.col("label").alias("beyond"))
        fresh = stage(labels.join(around, "cid").join(jump, "label")
                      .select("cid", F.least("label", "near", "beyond").alias("label"),
                              (F.least("near", "beyond") < F.col("label")).alias("moved")), "labels")
        labels = fresh.select("cid", "label")
        if fresh.where("moved").isEmpty():
            return labels


def same_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) that hold texts of one doc_id: each with the first class of that id."""
    rows = sets.where("n > 0 and doc_id is not null").select("doc_id", "set_key")
    several = (rows.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most"))
               .where("least <> most").select("doc_id", "least"))
    pairs = rows.join(several, "doc_id").where("set_key <> least").select("set_key", "least").distinct()
    one = classes.select("set_key", F.col("cid").alias("a"))
    two = classes.select(F.col("set_key").alias("least"), F.col("cid").alias("b"))
    return pairs.join(one, "set_key").join(two, "least").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int, given: DataFrame) -> DataFrame:
    """(cid, label) of the classes that link to another class; ``given`` holds pairs of classes known to belong together."""
    groups = classes.groupBy("prefix_key").agg(F.min("cid").alias("gid"), F.first("n").alias("n"),
                                               F.first("prefix").alias("prefix"), F.count("*").alias("members"))
    groups = stage(groups, "groups")
    shingles = groups.select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    # Shingles that more than one class has in its prefix.
    shared = shingles.groupBy("token").agg(F.sum("members").alias("of")).where("of > 1").select("token")
    rows = stage(shingles.join(shared, "token").select("token", "gid", "n", "pos"), "prefix-rows")
    in_rows = rows.select("gid").distinct()
    members = stage(classes.select("cid", "prefix_key").join(groups.select("prefix_key", "gid"), "prefix_key")
                    .join(in_rows, "gid", "left_semi").select("gid", "cid"), "members")

    # Stars: the centre of a shingle is its group with the most shared shingles.
    central = rows.groupBy("gid").agg(F.count("*").alias("ties"))
    ranked = rows.join(central, "gid")
    centre = ranked.groupBy("token").agg(F.max(F.struct("ties", (-F.col("gid")).alias("g"), "n", "pos")).alias("c"))
    star = (rows.join(centre, "token").select("gid", "n", "pos", (-F.col("c.g")).alias("centre"),
                                              F.col("c.n").alias("cn"), F.col("c.pos").alias("cpos"))
            .where(F.col("gid") != F.col("centre"))
            .where(may_link(F.col("n"), F.col("pos"), F.col("cn"), F.col("cpos"), percent))
            .select("gid", "centre").distinct())
    first = (star.join(members, "gid").select(F.col("centre").alias("a"), F.col("cid").alias("b"))
             .union(members.where("gid <> cid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))))
    first = stage(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star-pairs")
    links = verified(first, classes, docs, width, percent).union(given)
    labels = connected(links)

    # All pairs across components, of shingles that still have several.
    known = members.join(labels, "cid", "left").select("gid", "cid", F.coalesce("label", "cid").alias("label"))
    known = stage(known, "known")
    parts = rows.join(known.select("gid", "label").distinct(), "gid").select("token", "gid", "n", "pos", "label")
    sizes = parts.groupBy("token", "label").agg(F.count("*").alias("rows"))
    largest = (sizes.groupBy("token").agg(F.max(F.struct("rows", "label")).alias("top"), F.count("*").alias("parts"))
               .where("parts > 1").select("token", F.col("top.label").alias("top")))
    open_rows = stage(parts.join(largest, "token"), "open-rows")
    other = open_rows.select("token", F.col("gid").alias("g2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"),
                             F.col("label").alias("label2"))
    # Rows outside the largest part against all rows of other parts: no pair of the largest part with itself.
    across = (open_rows.where("label <> top").join(other, "token")
              .where((F.col("label") != F.col("label2"))
                     & may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent))
              .select("gid", "label", "g2", "label2").distinct())
    left = known.select("gid", "label", F.col("cid").alias("a"))
    right = known.select(F.col("gid").alias("g2"), F.col("label").alias("label2"), F.col("cid").alias("b"))
    more = across.join(left, ["gid", "label"]).join(right, ["g2", "label2"])
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stage(more.join(first, ["a", "b"], "left_anti"), "across-pairs")
    new = verified(more, classes, docs, width, percent)
    if new.isEmpty():
        return labels
    return connected(links.union(new))


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    counts = shingle_counts(docs.select(text_bytes().alias("text")), width)
    sets = stage(set_rows(docs, counts, width, percent), "sets")
    classes = (sets.where("n > 0").groupBy("set_key")
               .agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
                    F.first("prefix_key").alias("prefix_key"), F.first("hist").alias("hist")))
    # A class has a number of its own: several classes may have one smallest id, or none.
    classes = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = linked_classes(docs, classes, width, percent, stage(same_id(sets, classes), "same-id"))
    placed = classes.select("cid", "set_key", "first_id").join(labels, "cid", "left") \
        .select("set_key", "first_id", F.coalesce("label", "cid").alias("label"))
    placed = stage(placed, "placed")
    smallest = placed.groupBy("label").agg(F.min("first_id").alias("component"))
    ids = placed.select("set_key", "label").join(smallest, "label").select("set_key", "component")
    return (sets.select("doc_id", "n", "set_key").join(ids, "set_key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of rows: that with the smallest id (a null id comes last), then the first row.

    Rows are judged by a number of their own, so rows with null or repeated ids are like all others.
    """
    rows, key = numbered(docs, "numbered")
    found = stage(components(rows.select(F.col(key).alias("doc_id"), "text"), width, percent), "components")
    several = found.where("doc_id <> component_id").select("component_id").distinct()
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id"))
    members = stage(found.join(several, "component_id", "left_semi")
                    .select("component_id", F.col("doc_id").alias("row")).join(ids, "row"), "members")
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    drop = stage(members.join(first, "component_id").where(F.col("row") != F.col("first.row"))
                 .select(F.col("row").alias(key)), "dropped")
    n_drop = drop.count()
    return rows.join(F.broadcast(drop) if n_drop <= BROADCAST_ROWS else drop, key, "left_anti").select(docs.columns)


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of at least 0.9."""
    return components(table(spark, sf_dir, "documents"), width=3, percent=90)
