"""Near-duplicate removal: greedy leaders over the graph of all similar pairs.

The original compares every review with every accepted one in Python.
Here, per batch:

1. rows of a batch whose normalised (content, title) are identical collapse to their
   first row -- exact, since such rows have similarity 1 with each other and
   identical similarities to everyone else; a grouped ``min(ord)`` on a hash,
   over rows without texts;
2. any two of these rows meet in blocks of neighbouring lengths (``block_pairs``), where bounds that lose no pair are checked
   before a pair is written: the length bound (``ratio <= 2*min/(la+lb)``), the titles' characters, bitmaps of q-grams
   and sketches of q-grams, with the number of blocks ``difflib`` can match;
3. survivors are verified with the original's similarity, arguments
   (later, earlier), in cells to which each text is sent once (``verified_edges``);
4. leaders = lexicographically-first maximal independent set of the
   verified graph by ``ord`` (the greedy pass): a row becomes a leader once all its
   earlier neighbours are non-leaders; a row with an earlier leader neighbour joins
   the lowest such leader.  Not every pair is compared, see ``leaders_in_layers``;
5. the survivor of each cluster is its highest-quality row, earliest on ties
   (the original's strict ``>`` replacement).

MinHash signatures of character shingles (Arrow UDF, numpy), cut into bands, only tell which rows are likely similar to many
others (``star_pairs``), so that those are not compared with each other; no pair depends on them.

Deviation: the original compares later rows with a slot's *replacement*
text; we compare with the leader (no drift).  No step misses a pair.  The work of step 2 is quadratic in the rows of a batch
whose lengths allow the threshold (some 100 ns a pair); its memory is bounded by the block size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from chorus import lexicons as LX
from chorus.functions.text import normalize_for_comparison
from chorus.functions.udfs import (BITS_Q, TITLE_BITS, bitmap_words, bitmaps, block_bounds, folded, packed, part_hashes,
                                   similarity_at_least, sketches, sketches_fit, title_bitmaps, unpacked)
from chorus.operators.dedup import BATCH, first_per_key, with_content_hash
from chorus.plans.store import table_stage



def _hash_params(n_hashes: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63 - 1, size=n_hashes, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63 - 1, size=n_hashes, dtype=np.int64).astype(np.uint64)
    return a, b


def minhash(text: str, shingle: int, n_hashes: int, seed: int, params=None) -> list[int] | None:
    """MinHash signature (``n_hashes`` values) of a text's character shingles; None for empty text.

    The k-th occurrence of a shingle is an element of its own, so two texts' similarity counts repeats, as the q-gram
    bound of ``qgrams_allow`` does: a repetitive text is found no less often than others.
    """
    if not text:
        return None
    a, b = params if params is not None else _hash_params(n_hashes, seed)
    cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(cps) <= shingle:
        windows = cps[None, :]
    else:
        windows = np.lib.stride_tricks.sliding_window_view(cps, shingle)
    powers = np.array([pow(1_000_003, k, 2**64) for k in range(windows.shape[1])], dtype=np.uint64)
    with np.errstate(over="ignore"):
        sh = np.sort((windows * powers).sum(axis=1, dtype=np.uint64))
        new = np.append(True, sh[1:] != sh[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        sh += (np.arange(len(sh)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sig = ((sh[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1)
    return sig.astype(np.int64).tolist()


def _signature_udf(shingle: int, n_hashes: int, seed: int):
    @pandas_udf(ArrayType(LongType()))
    def sig(texts: pd.Series) -> pd.Series:
        params = _hash_params(n_hashes, seed)
        return texts.map(lambda t: minhash(t, shingle, n_hashes, seed, params))
    return sig


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumns({"norm_content": normalize_for_comparison("content"),
                           "norm_title": normalize_for_comparison("title")})


#: (name, shingle length, bands, rows per band)
SHORT, LONG = ("short", 3, 96, 2), ("long", 5, 64, 3)
#: The share of the bands that ``with_signatures`` builds: they only tell which rows are likely similar to many.
BANDS_BUILT = 4
#: Texts below this length are short: ``difflib`` skips popular characters from here on.
BORDER = 200
#: From this many different characters on few are popular, and 3-grams are rare: such long texts carry both layouts.
RICH = 65


def content_need(threshold: float) -> float:
    """The least content ratio that can reach ``threshold``: titles weigh a fifth where both are there."""
    return (threshold - 0.2) / 0.8


def with_bounds(reps: DataFrame) -> DataFrame:
    """What the bounds of a pair need of each text that is not empty."""
    reps = reps.where(F.col("norm_content") != "").withColumn("_sketch", sketches("norm_content", F.coalesce("norm_title", F.lit(""))))
    reps = reps.withColumns({"_bits": bitmaps("norm_content"), "blocks": block_bounds("norm_content"), "len": F.length("norm_content"),
                             "title_bits": title_bitmaps(F.coalesce("norm_title", F.lit("")))})
    reps = reps.withColumn("packed", packed("_sketch", "_bits", "len")).drop("_sketch", "_bits")
    return reps.withColumn("titled", F.coalesce(F.col("norm_title") != "", F.lit(False)))


def with_signatures(reps: DataFrame, threshold: float, seed: int = 7) -> DataFrame:
    """``bands``: for each layout of a text, its band buckets as (layout and band number, hash)."""
    need = content_need(threshold)
    reach = BORDER * (2 - need) / need  # the longest text that a text below the border can be similar to
    n = F.length("norm_content")
    rich = F.size(F.array_distinct(F.split("norm_content", ""))) >= RICH
    parts = []
    for (name, shingle, bands, rows), fits in ((SHORT, (n < reach) | rich), (LONG, n >= BORDER)):
        bands //= BANDS_BUILT
        sig = _signature_udf(shingle, bands * rows, seed)(F.when(fits, F.col("norm_content")))
        reps = reps.withColumn(f"_{name}", sig)
        first = 0 if name == "short" else 1000
        parts.append(F.coalesce(F.when(F.col(f"_{name}").isNotNull(), F.array(*[
            F.struct(F.lit(first + b).alias("band"), F.xxhash64(F.slice(f"_{name}", b * rows + 1, rows)).alias("bucket"))
            for b in range(bands)])), F.array().cast("array<struct<band:int,bucket:bigint>>")))
    return reps.withColumn("bands", F.concat(*parts)).drop("_short", "_long")


def lengths_allow(a: str, b: str, threshold: float):
    """The length bound of two rows with the prefixes ``a`` and ``b``: a ratio is at most twice the shorter over both."""
    both = F.col(f"{a}.titled") & F.col(f"{b}.titled")
    need = F.when(both, F.lit(content_need(threshold))).otherwise(F.lit(threshold))
    x, y = F.col(f"{a}.len"), F.col(f"{b}.len")
    return 2.0 * F.least(x, y) / (x + y) >= need - 1e-12


def star_pairs(rows: DataFrame, threshold: float, above: int, shared: int = 2) -> DataFrame:
    """The rows of each bucket of more than ``above`` rows, paired with its first row only, where the lengths allow
    ``threshold`` and two rows meet like that in at least ``shared`` buckets: others are most likely not similar."""
    keys = rows.select("ord", "len", "titled", F.explode(bucket_keys()).alias("key"))
    first = (keys.groupBy("key").agg(F.min(F.struct("ord", "len", "titled")).alias("b"), F.count("*").alias("n"))
             .where(F.col("n") > above).select("key", "b"))
    need = F.when(F.col("titled") & F.col("b.titled"), F.lit(content_need(threshold))).otherwise(F.lit(threshold))
    fits = 2.0 * F.least("len", "b.len") / (F.col("len") + F.col("b.len")) >= need - 1e-12
    met = keys.join(first, "key").where((F.col("ord") > F.col("b.ord")) & fits)
    met = met.groupBy(F.col("ord").alias("later"), F.col("b.ord").alias("earlier")).agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= shared).select("later", "earlier")


def bucket_keys():
    """A text's band buckets as 64-bit keys within all batches."""
    return F.transform("bands", lambda b: F.xxhash64("batch_key", b["band"], b["bucket"]))


PAIRS = "later long, earlier long"


class _Side:
    """One side of a group of ``block_pairs``: its rows by length, and their bitmaps in every size."""

    def __init__(self, t: pa.Table) -> None:
        t = t.take(pc.sort_indices(t, [("len", "ascending")])).combine_chunks()
        for c in ("ord", "len", "title_len", "blocks", "is_later", "is_earlier", "is_new"):
            setattr(self, c, t.column(c).to_numpy())
        self.below = pc.fill_null(t.column("below"), np.iinfo(np.int64).max).to_numpy()
        self.title = np.frombuffer(b"".join(t.column("title_bits").to_pylist()), np.uint64).reshape(-1, TITLE_BITS // 64)
        self.no_title = (self.title_len - np.bitwise_count(self.title).sum(1, dtype=np.int64)).astype(np.float32)
        self.words = bitmap_words(self.len)
        self.sketch, self.own = unpacked(t.column("packed").to_pylist(), self.words)
        self.plain = bool(self.is_later.all() and self.is_earlier.all() and self.is_new.all()) and t.column("below").null_count == t.num_rows
        self.levels: dict[int, tuple] = {}

    def level(self, words: int) -> tuple:
        """(first row, bitmaps of so many words in two halves, the cells set in each half) of the rows that have as many or more."""
        if words not in self.levels:
            bits = [folded(b, words) for w, b in self.own.items() if w >= words]
            bits = np.concatenate(bits) if bits else np.empty((0, words), np.uint64)
            halves = [np.ascontiguousarray(h) for h in (bits[:, : words // 2], bits[:, words // 2:])]
            pops = [np.bitwise_count(h).sum(1, dtype=np.int64) for h in halves]
            self.levels[words] = int(np.searchsorted(self.words, words)), *halves, *pops
        return self.levels[words]


def _pairs_of_block(threshold: float, chunk: int = 1 << 15, step: int = 1 << 10):
    """The function of one group of ``block_pairs``: the pairs of its rows that the bounds allow."""
    needed = content_need(threshold)
    wide = (2 - needed) / needed * (1 + 1e-9) if needed > 0 else np.inf

    def run(t: pa.Table) -> pa.Table:
        within = bool(t.column("i")[0].as_py() == t.column("j")[0].as_py())
        x = _Side(t.filter(pc.equal(t.column("side"), 0)))
        y = x if within else _Side(t.filter(pc.equal(t.column("side"), 1)))
        later: list[np.ndarray] = []
        earlier: list[np.ndarray] = []
        open_pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            a, b = (np.concatenate(p) if p else np.empty(0, np.int64) for p in zip(*open_pairs)) if open_pairs else ((), ())
            open_pairs.clear()
            for k in range(0, len(a), 1 << 12):
                i, j = a[k: k + (1 << 12)], b[k: k + (1 << 12)]
                blocks = np.where(x.ord[i] > y.ord[j], y.blocks[j], x.blocks[i])
                fits = sketches_fit(x.sketch[i], y.sketch[j], x.len[i], y.len[j], x.title_len[i], y.title_len[j], threshold, blocks)
                both = x.ord[i[fits]], y.ord[j[fits]]
                later.append(np.maximum(*both))
                earlier.append(np.minimum(*both))

        waiting = 0
        size, titles = y.len.astype(np.float32), y.title_len.astype(np.float32)
        for k in range(len(x.ord)):
            n, m, o = int(x.len[k]), int(x.title_len[k]), x.ord[k]
            lo, hi = np.searchsorted(y.len, [n / wide - 1e-6, n * wide + 1e-6])
            lo = max(int(lo), k + 1) if within else int(lo)
            if lo >= hi:
                continue
            # Of the title: its characters. They give what the contents need (with room for rounding).
            need = np.float32(threshold - 1e-5)
            if m:
                common = np.bitwise_count(y.title[lo:hi] & x.title[k]).sum(1, dtype=np.uint8)
                ratio = (common + np.minimum(y.no_title[lo:hi], x.no_title[k])) / (0.5 * (titles[lo:hi] + m))
                need = np.where(titles[lo:hi] > 0, (need - np.float32(0.2) * np.minimum(ratio, 1)) / np.float32(0.8), need)
            total = size[lo:hi] + n
            ok = (2 * np.minimum(size[lo:hi], n) >= need * total) & (y.ord[lo:hi] != o)
            if not (x.plain and y.plain):
                after = y.ord[lo:hi] > o
                ok &= np.where(after, y.is_later[lo:hi] & x.is_earlier[k] & (o < y.below[lo:hi]),
                               y.is_earlier[lo:hi] & x.is_later[k] & (y.ord[lo:hi] < x.below[k]))
                ok &= y.is_new[lo:hi] | x.is_new[k]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            need = need[at].astype(float) if m else np.full(len(at), float(need))
            at += lo
            # The q-grams' bitmaps, in the size of the shorter text's; of the first half, if that is enough.
            blocks = np.where(y.ord[at] > o, x.blocks[k], y.blocks[at])
            total = y.len[at] + float(n)
            least = need * total / 2 - (BITS_Q - 1) * np.minimum((1 - need) * total + 1, blocks)
            for w in np.unique(np.minimum(y.words[at], x.words[k])):
                part = np.flatnonzero(np.minimum(y.words[at], x.words[k]) == w)
                first, a1, a2, p1, p2 = x.level(int(w))
                start, b1, b2, r1, r2 = y.level(int(w))
                for c in range(0, len(part), step):
                    some = part[c: c + step]
                    row, own = at[some] - start, k - first
                    asked = least[some] + np.maximum(p1[own] + p2[own] - n, r1[row] + r2[row] - y.len[at[some]]) + BITS_Q - 1 - 1e-6
                    have = np.bitwise_count(b1[row] & a1[own]).sum(1, dtype=np.int64)
                    left = np.flatnonzero(have + np.minimum(r2[row], p2[own]) >= asked)
                    have = have[left] + np.bitwise_count(b2[row[left]] & a2[own]).sum(1, dtype=np.int64)
                    left = left[have >= asked[left]]
                    if len(left):
                        open_pairs.append((np.full(len(left), k), at[some[left]]))
                        waiting += len(left)
            if waiting > chunk:
                flush()
                waiting = 0
        flush()
        found = [np.concatenate(p) if p else np.empty(0, np.int64) for p in (later, earlier)]
        return pa.table({"later": pa.array(found[0], pa.int64()), "earlier": pa.array(found[1], pa.int64())})
    return run


def block_pairs(rows: DataFrame, threshold: float, size: int = 24_000) -> DataFrame:
    """(later, earlier) pairs of rows of a batch whose lengths, titles, bitmaps and sketches allow ``threshold``.

    Any two rows of a batch meet, and no bound loses a similar pair, so none is lost.  The bounds are checked where the rows
    meet, so that only pairs that are left are written: the rows of a batch, by their lengths, are cut into blocks of about
    ``size`` rows, and each two blocks with lengths that allow ``threshold`` meet in one group.  What is shuffled is rows
    times such blocks, without texts, not pairs.

    ``rows`` have the columns of ``signed`` and which part they take: ``is_later``, ``is_earlier`` (of a pair), ``is_new``
    (one row of a pair is) and ``below`` (null, or only rows before it are the earlier one).
    """
    need = content_need(threshold)
    own = ["batch_key", "len"]
    title = F.coalesce(F.length("norm_title"), F.lit(0)).cast("long")
    rows = rows.select("batch_key", "ord", F.col("len").cast("long").alias("len"), title.alias("title_len"), "title_bits", "packed",
                       "blocks", "is_later", "is_earlier", "is_new", F.col("below").cast("long").alias("below"))
    lens = rows.groupBy(*own).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("batch_key").orderBy("len")) - F.col("n")
    # Small batches are cut into smaller blocks, for the cores' sake.
    of_batch = F.sum("n").over(Window.partitionBy("batch_key"))
    lens = lens.withColumn("most", F.least(F.lit(size), F.greatest(F.lit(4_000), of_batch / 8)))
    lens = lens.withColumn("block", F.floor(before / F.col("most")))
    blocks = lens.groupBy("batch_key", "block").agg(F.min("len").alias("low"), F.max("len").alias("high"), F.greatest(
        F.lit(1), F.floor(F.sum("n") / F.max("most") + 0.5)).cast("long").alias("parts"))
    a, b = blocks.alias("a"), blocks.alias("b")
    far = F.greatest(F.col("a.low") - F.col("b.high"), F.col("b.low") - F.col("a.high")) > 0
    short, long_ = F.least("a.high", "b.high"), F.greatest("a.low", "b.low")
    meets = ~far | (2.0 * short / (short + long_) >= need - 1e-9)
    layout = (a.join(b, (F.col("a.batch_key") == F.col("b.batch_key")) & meets).groupBy("a.batch_key", "a.block", "a.parts")
              .agg(F.collect_list(F.struct("b.block", "b.parts")).alias("others")))
    layout = lens.select(*own, "block").join(layout, ["batch_key", "block"])
    if layout.count() <= 100_000:
        layout = F.broadcast(layout)
    number = lambda block, part: block * F.lit(1 << 24) + part
    rows = rows.join(layout, own).withColumn("at", number(F.col("block"), F.pmod(F.xxhash64("ord"), F.col("parts"))))
    groups = F.flatten(F.transform("others", lambda o: F.transform(
        F.sequence(F.lit(0).cast("long"), o["parts"] - 1), lambda k: number(o["block"], k))))
    met = rows.withColumn("to", F.explode(groups)).select(
        "batch_key", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), (F.col("at") > F.col("to")).cast("int").alias("side"),
        "ord", "len", "title_len", "title_bits", "packed", "blocks", "is_later", "is_earlier", "is_new", "below")
    spark = rows.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(n, "batch_key", "i", "j").groupBy("batch_key", "i", "j").applyInArrow(_pairs_of_block(threshold), PAIRS).distinct()


def with_part(rows: DataFrame, later: bool = True, earlier: bool = True) -> DataFrame:
    """``rows`` with the columns that ``block_pairs`` asks for, where they have none."""
    part = {"is_later": F.lit(later), "is_earlier": F.lit(earlier), "is_new": F.lit(True), "below": F.lit(None).cast("long")}
    return rows.withColumns({k: v for k, v in part.items() if k not in rows.columns})


def _verified_in_cell(threshold: float):
    """The function of one cell of ``verified_edges``: pairs, and the texts of their rows, to the similar pairs."""
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        of: dict[int, list[tuple]] = {}
        for o, *text in zip(*(texts.column(c).to_pylist() for c in ("ord", "batch_key", "norm_content", "norm_title"))):
            of.setdefault(o, []).append(text)
        memo: dict = {}
        found = []
        # By the earlier text, whose index the matcher keeps for the next pair.
        for e, l in sorted(zip(pairs.column("earlier").to_pylist(), pairs.column("later").to_pylist())):
            if memo.get("of") != e:
                memo = {"of": e}
            for b in of.get(e, ()):
                for a in of.get(l, ()):
                    sim = similarity_at_least(a[1], b[1], a[2], b[2], threshold, memo) if a[0] == b[0] else 0.0
                    if sim >= threshold:
                        found.append((l, e, sim))
        return pa.table({c: pa.array([r[k] for r in found], t) for k, (c, t) in enumerate(
            (("later", pa.int64()), ("earlier", pa.int64()), ("similarity", pa.float64())))})
    return run


def verified_edges(signed: DataFrame, pairs: DataFrame, threshold: float, rows: int = 8_000) -> DataFrame:
    """Candidate pairs whose similarity (later, earlier) reaches ``threshold``.

    The length bound runs natively.  The rows of the pairs are dealt to buckets of at most about ``rows``; a pair is
    verified in the cell of its two buckets, to which each text is sent once, however many pairs of the cell it is in.
    """
    small = signed.select("batch_key", "ord", "len", "titled")
    la, ea = small.alias("l"), small.alias("e")
    j = pairs.join(la, F.col("later") == F.col("l.ord")).join(ea, F.col("earlier") == F.col("e.ord"))
    near = j.where((F.col("l.batch_key") == F.col("e.batch_key")) & lengths_allow("l", "e", threshold)).select("later", "earlier")
    spark = pairs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    paired = pairs.select(F.explode(F.array("later", "earlier")).alias("ord")).distinct().count()
    buckets = max(-(-paired // rows), int((4 * cores) ** 0.5) + 1)
    near = near.withColumns({c: F.pmod(F.xxhash64(o), F.lit(buckets)) for c, o in (("row", "later"), ("col", "earlier"))})
    wanted = near.select(F.col("row").alias("r"), F.col("col").alias("c"), F.explode(F.array("later", "earlier")).alias("ord")).distinct()
    texts = wanted.join(signed.select("ord", "batch_key", "norm_content", "norm_title"), "ord")
    # CPU-heavy Python step: an explicit partition count (AQE keeps it) spreads
    # the cells over every core instead of a few coalesced tasks.
    n = max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = near.repartition(n, "row", "col").groupBy("row", "col").cogroup(texts.repartition(n, "r", "c").groupBy("r", "c"))
    return cells.applyInArrow(_verified_in_cell(threshold), PAIRS + ", similarity double")


def word_sets(v: DataFrame, batch: Sequence[str]) -> DataFrame:
    """(batch, ord, w, set_key): the sorted word set of each normalised content; rows without an ord or a batch have no pairs."""
    there = reduce(and_, [F.col(c).isNotNull() for c in [*batch, "ord"]])
    sets = v.where(there).select(*batch, "ord", F.array_sort(F.array_distinct(F.split(normalize_for_comparison("content"), " ")))
                                 .alias("w"))
    return sets.withColumn("set_key", F.sha2(F.to_json(F.struct(*batch, "w")), 256))


def word_jaccard_edges(sets: DataFrame, batch: Sequence[str], percent: int) -> DataFrame:
    """(later, earlier) pairs of rows of ``word_sets`` with a Jaccard similarity of at least ``percent``.

    Two such sets differ in few words.  Words are dealt to one part more than that number by a hash, so one part is the
    same in both: candidates share the hash of a whole part, not one word that many texts have.
    """
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    keys = sets.select(*batch, "ord", F.size("w").alias("n"), F.explode(part_hashes(percent)(hashes)).alias("part"))
    keys = keys.select(F.xxhash64(*batch, "part").alias("part"), "ord", "n")
    a, b = keys.alias("a"), keys.alias("b")
    pairs = (a.join(b, F.col("a.part") == F.col("b.part")).where(
        (F.col("a.ord") > F.col("b.ord")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")))
        .select(F.col("a.ord").alias("later"), F.col("b.ord").alias("earlier")).distinct())
    left = sets.select(F.col("ord").alias("later"), *[F.col(c).alias(f"_{c}") for c in batch], F.col("w").alias("w1"))
    right = sets.select(F.col("ord").alias("earlier"), *batch, F.col("w").alias("w2"))
    same, both = F.size(F.array_intersect("w1", "w2")), F.size(F.array_union("w1", "w2"))
    alike = reduce(and_, [F.col(f"_{c}") == F.col(c) for c in batch], 100 * same >= percent * both)
    return pairs.join(left, "later").join(right, "earlier").where(alike).select("later", "earlier").distinct()


def word_jaccard_leaders(v: DataFrame, batch: Sequence[str], percent: int, stage=None) -> DataFrame:
    """(ord, leader) of the greedy pass over ``word_jaccard_edges``, for every row that has a pair.

    Of equal sets only the first row is compared: the others have its neighbours and itself as one, so they never
    lead and have its leader.  Rows whose ord comes with several sets are all compared.
    """
    stage = stage or table_stage
    sets = stage("word-sets", lambda: word_sets(v, batch))
    keys = stage("word-keys", lambda: sets.select("ord", "set_key").distinct())
    of_ord = keys.groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.min("set_key").alias("set_key"))
    single, several = of_ord.where("n = 1").select("ord", "set_key"), of_ord.where("n > 1").select("ord")
    groups = single.groupBy("set_key").agg(F.min("ord").alias("rep"), F.count(F.lit(1)).alias("copies"))
    compared = groups.select(F.col("rep").alias("ord"), "set_key").unionByName(keys.join(several, "ord", "left_semi"))
    chosen = stage("word-chosen", lambda: sets.join(compared, ["ord", "set_key"], "left_semi").dropDuplicates(["ord", "set_key"]))
    edges = stage("word-edges", lambda: word_jaccard_edges(chosen, batch, percent))
    leaders = greedy_leaders(edges, stage)
    of_rep = leaders.select(F.col("ord").alias("rep"), "leader")
    members = single.join(groups, "set_key").join(of_rep, "rep", "left").where((F.col("copies") > 1) | F.col("leader").isNotNull())
    return members.select("ord", F.coalesce("leader", "rep").alias("leader")).unionByName(
        leaders.join(several, "ord", "left_semi").select("ord", "leader"))


def greedy_leaders(edges: DataFrame, stage=None) -> DataFrame:
    """(ord, leader) for every row in the edge graph; leaders map to themselves.

    Each round is one aggregation of the edge list joined to the current
    status; the status table is materialised per round (``stage``) so the
    lineage stays short.
    """
    e = edges.select("later", "earlier")
    nodes = e.select(F.col("later").alias("ord")).union(e.select(F.col("earlier").alias("ord"))).distinct()
    status = nodes.withColumn("st", F.lit("U"))
    rnd = 0
    while True:
        rnd += 1
        st = status.select(F.col("ord").alias("earlier"), F.col("st").alias("est"))
        agg = (e.join(st, "earlier")
               .groupBy(F.col("later").alias("ord"))
               .agg(F.max((F.col("est") == "L").cast("int")).alias("has_l"),
                    F.max((F.col("est") == "U").cast("int")).alias("has_u")))
        nxt = (status.join(agg, "ord", "left")
               .select("ord", F.when(F.col("st") != "U", F.col("st"))
                       .when(F.coalesce(F.col("has_l"), F.lit(0)) == 1, F.lit("M"))
                       .when(F.coalesce(F.col("has_u"), F.lit(0)) == 0, F.lit("L"))
                       .otherwise(F.lit("U")).alias("st")))
        nxt = (stage or table_stage)(f"leaders-round-{rnd}", lambda n=nxt: n)
        undecided = nxt.where(F.col("st") == "U").count()
        status = nxt
        if undecided == 0:
            break
    leaders = status.where(F.col("st") == "L").select(F.col("ord").alias("earlier"))
    member_of = (e.join(leaders, "earlier").groupBy(F.col("later").alias("ord"))
                 .agg(F.min("earlier").alias("leader")))
    st = status.join(member_of, "ord", "left")
    return st.select("ord", F.when(F.col("st") == "L", F.col("ord")).otherwise(F.col("leader")).alias("leader"))


def leaders_in_layers(signed: DataFrame, threshold: float, stage, small: int = 32) -> DataFrame:
    """(ord, leader) of the greedy pass over the texts of ``signed``, without comparing all pairs of a bucket.

    A row that is similar to its bucket's first row is most likely a member and never a leader, so it needs no
    comparison with the many rows like it.  Each layer:
    1. open rows (first all) are compared with the first open row of each of their buckets of more than ``small``
       open rows; those similar to an earlier open row wait, the others become heads;
    2. heads are compared with each other, which gives the leaders among them;
    3. the waiting rows are compared with those leaders that come before their lowest known one;
    4. waiting rows without an earlier similar leader are open in the next layer.
    When none is open, every row that is no leader has an earlier similar leader, and no leader has one: only the
    greedy pass's result is like that, so it is exact.  Each layer has at least one new head.
    """
    def pick(keys: DataFrame, how: str = "left_semi") -> DataFrame:
        return signed.join(keys, "ord", how)

    everyone = signed.select("ord")
    compared = edges = heads = None
    open_rows, layer = everyone, 0
    while True:
        def put(name: str, df: DataFrame, layer: int = layer) -> DataFrame:
            return stage(f"{name}-{layer}", lambda: df)

        def verify(name: str, pairs: DataFrame) -> None:
            nonlocal compared, edges
            fresh = put(f"pairs-{name}", pairs if compared is None else
                        pairs.join(compared, ["later", "earlier"], "left_anti"))
            found = put(f"edges-{name}", verified_edges(signed, fresh, threshold).select("later", "earlier"))
            compared = fresh if compared is None else compared.unionByName(fresh)
            edges = found if edges is None else edges.unionByName(found)

        verify("star", star_pairs(signed if layer == 0 else pick(open_rows), threshold, small))
        waiting = (edges.join(open_rows.select(F.col("ord").alias("later")), "later", "left_semi")
                   .join(open_rows.select(F.col("ord").alias("earlier")), "earlier", "left_semi")
                   .select(F.col("later").alias("ord")).distinct())
        new = open_rows.join(waiting, "ord", "left_anti").withColumn("is_new", F.lit(True))
        heads = put("heads", new if heads is None else
                    heads.withColumn("is_new", F.lit(False)).unionByName(new))
        verify("heads", block_pairs(with_part(signed.join(heads, "ord")), threshold))

        among = (edges.join(heads.select(F.col("ord").alias("later")), "later", "left_semi")
                 .join(heads.select(F.col("ord").alias("earlier")), "earlier", "left_semi"))
        status = greedy_leaders(among, lambda name, build: stage(f"{name}-{layer}", build))
        members = status.where(F.col("ord") != F.col("leader"))
        leaders = put("leaders", heads.join(members, "ord", "left_anti").select("ord"))

        def lowest(rows: DataFrame) -> DataFrame:
            """The lowest leader among the known earlier neighbours of each row."""
            return (rows.join(leaders.select(F.col("ord").alias("earlier")), "earlier", "left_semi")
                    .groupBy(F.col("later").alias("ord")).agg(F.min("earlier").alias("below")))

        others = pick(heads, "left_anti").join(lowest(edges), "ord", "left")
        both = with_part(others, earlier=False).unionByName(with_part(pick(leaders), later=False))
        verify("leaders", block_pairs(both, threshold))
        lead = lowest(edges)
        open_rows = put("open", everyone.join(heads, "ord", "left_anti").join(lead, "ord", "left_anti"))
        if open_rows.isEmpty():
            known = leaders.withColumn("leads", F.lit(True))
            return (everyone.join(known, "ord", "left").join(lead, "ord", "left")
                    .select("ord", F.when(F.col("leads"), F.col("ord")).otherwise(F.col("below")).alias("leader")))
        layer += 1


def representatives(v: DataFrame, batch: Sequence[str], threshold: float, stage, seed: int,
                    hash_dedup_first: bool, bands: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows without texts, first row of each normalised text, the signed texts of those first rows, with ``bands`` or not)."""
    base = v
    if hash_dedup_first:
        h = v if "content_hash" in v.columns else with_content_hash(v)
        base = h.join(first_per_key(h, [*batch, "content_hash"]), "ord", "left_semi")
    texts = normalized(base).select(*batch, "ord", "norm_content", "norm_title", "quality_score")
    # As JSON, so that batches with nulls are keys like others.
    texts = texts.withColumn("batch_key", F.to_json(F.struct(*batch)) if batch else F.lit(""))
    texts = texts.withColumn("text_key", F.sha2(F.concat_ws("\u0000", "batch_key", "norm_content", "norm_title"), 256))
    tag = f"{threshold}-{seed}-{'.'.join(batch)}-{hash_dedup_first}"
    rows = stage(f"neardup-rows-{tag}", lambda: texts.select(*batch, "ord", "text_key", "quality_score"))
    rep_of = rows.groupBy("text_key").agg(F.min("ord").alias("rep"))

    def sign() -> DataFrame:
        reps = texts.select("batch_key", "ord", "norm_content", "norm_title").join(
            rep_of.select(F.col("rep").alias("ord")), "ord", "left_semi")
        return with_signatures(with_bounds(reps), threshold, seed) if bands else with_bounds(reps)
    return rows, rep_of, stage(f"neardup-reps-{tag}-{bands}", sign)


def similar_pairs(v: DataFrame, batch: Sequence[str] = BATCH, threshold: float = LX.SIMILARITY_THRESHOLD, stage=None,
                  seed: int = 7, hash_dedup_first: bool = True) -> DataFrame:
    """(later, earlier, similarity) of all similar pairs of different texts; each text stands for its copies."""
    stage = stage or table_stage
    _, _, signed = representatives(v, list(batch), threshold, stage, seed, hash_dedup_first, bands=False)
    tag = f"{threshold}-{seed}-{'.'.join(batch)}-{hash_dedup_first}"
    pairs = stage(f"neardup-pairs-{tag}", lambda: block_pairs(with_part(signed), threshold))
    return verified_edges(signed, pairs, threshold)


def near_duplicate_clusters(v: DataFrame, batch: Sequence[str] = BATCH,
                            threshold: float = LX.SIMILARITY_THRESHOLD, stage=None, seed: int = 7,
                            hash_dedup_first: bool = True) -> DataFrame:
    """(ord, cluster, quality_score) for the rows entering the similarity step.

    ``cluster`` is the leader's ``ord``; rows outside every cluster lead
    their own.
    """
    batch, stage = list(batch), stage or table_stage
    rows, rep_of, signed = representatives(v, batch, threshold, stage, seed, hash_dedup_first)
    tag = f"{threshold}-{seed}-{'.'.join(batch)}-{hash_dedup_first}"
    leader = leaders_in_layers(signed, threshold, lambda name, build: stage(f"neardup-{name}-{tag}", build))
    cluster_of = rep_of.join(leader.select(F.col("ord").alias("rep"), "leader"), "rep", "left").select(
        "text_key", F.coalesce("leader", "rep").alias("cluster"))
    return rows.join(cluster_of, "text_key").select(*batch, "ord", "cluster", "quality_score")


def near_duplicate_winners(v: DataFrame, batch: Sequence[str] = BATCH,
                           threshold: float = LX.SIMILARITY_THRESHOLD, stage=None, **kw) -> DataFrame:
    """``ord`` of every row that survives the similarity step (one per cluster)."""
    c = near_duplicate_clusters(v, batch, threshold, stage, **kw)
    best = F.max(F.struct(F.col("quality_score").alias("q"), (-F.col("ord")).alias("neg")))
    return c.groupBy("cluster").agg(best.alias("b")).select((-F.col("b.neg")).alias("ord"))
