"""LM scoring: weighted backoff automaton over smoothed n-grams (trigrams by default).

Tokens are a text's words (A-Z lower-cased) and one end.  The root state has an arc for every word with its add-0.1
probability p(w).  Each n-gram h of the training texts below the highest order is a state with an arc for every word w
that followed it, of probability (c(h w) + mu p(w | h')) / (c(h) + mu), and a failure arc of weight mu / (c(h) + mu) to
the state of h', its words but the first; the two kinds of arcs of a state sum to one.  One left-to-right traversal
carries the state: it takes the arc of the next word if the state has it, else failure arcs until a state has it (the
root has all), and adds up log10 of the weights.

No task ever needs the whole model: documents are cut into blocks of a bounded number of tokens, written once with
their words numbered within the block.  Each block sends the sorted hashes of its distinct words and n-grams, with
their training counts, to shards (a shard is a range of hashes; hot words come once per block); a shard sums them and
sends each block its totals back in the same order.  A block then builds the part of the automaton that its own
documents can reach and traverses them.  What is shuffled follows the distinct n-grams of blocks, so it grows with
the input; blocks and shards stay bounded.

64-bit hashes stand for words, 52 bits of such hashes for longer n-grams: of 10**12 distinct ones, one in 4,500 would
meet another.

Defined cases: null and empty texts hold the end only; rows with a null id are scored, held out and not learned from;
repeated rows count each; without training texts p1 is 1 for any word (its one unseen class); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import MIX_A, WordHashes, doc_bucket, finalise, stage, table, text_bytes

END = np.uint64(xxhash.xxh3_64_intdigest(b""))
GRAM_BITS = np.uint64((1 << 64) - (1 << 12))
BLOCKS = ("block string, doc_ids array<long>, held_out array<boolean>, lengths array<long>, tokens binary, "
          "words binary, counts binary, n_tokens long, n_train long")
TOTALS = "block string, level int, shard int, totals binary, seen long"


def squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers as compressed bytes: their byte planes (of the differences, if ascending), so that the mostly
    equal high bytes take no room."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: str, ascending: bool = False) -> np.ndarray:
    """The integers of ``squeeze``."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if ascending else values


def cut_blocks(docs: DataFrame, folds: int, block_tokens: int, fold: int = 0) -> DataFrame:
    """Blocks of whole documents: numbered tokens, the hashes they stand for (sorted) and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, held_out, parts, size = WordHashes(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts])
            words, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            learned = np.repeat(~np.array(held_out), lengths)
            counts = np.bincount(tokens[learned], minlength=len(words))
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([held_out]),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([squeeze(tokens.astype("<u4"))], pa.binary()),
                 pa.array([squeeze(words, True)], pa.binary()), pa.array([squeeze(counts.astype("<u4"))], pa.binary()),
                 pa.array([len(tokens)]), pa.array([int(learned.sum())])],
                names=["block", "doc_ids", "held_out", "lengths", "tokens", "words", "counts", "n_tokens", "n_train"])

        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                parts.append(np.append(hashes(text.as_py()), END))
                ids.append(doc_id)
                held_out.append(held)
                size += len(parts[-1])
                if size >= block_tokens:
                    yield flush()
                    ids, held_out, parts, size = [], [], [], 0
        if ids:
            yield flush()

    held = F.coalesce(doc_bucket("doc_id") % folds == fold, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"),
                       text_bytes().alias("text")).mapInArrow(run, BLOCKS)


def grams_of(tokens: np.ndarray, words: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that ends at each token, whether there is one): a document's first n - 1 tokens have none."""
    own = words[tokens]
    keys = own
    for _ in range(n - 1):
        before = np.zeros(len(tokens), np.uint64)
        before[1:] = keys[:-1]
        keys = finalise(before * MIX_A + own)
    if n > 1:
        keys &= GRAM_BITS
    return keys, np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= n - 1


def deal(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Sorted hashes cut into the shards' ranges."""
    edges = np.array([s * ((1 << 64) // shards) for s in range(1, shards)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def totals(blocks: DataFrame, level: int, shards: int) -> DataFrame:
    """Training counts over all blocks, in the order of each block's sorted distinct n-grams (TOTALS).

    ``seen``, on one row per shard: how many distinct n-grams of the shard occur in the training texts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, words, counts, tokens, lengths, held = (batch.column(k)[row] for k in range(6))
                keys, n = expand(words.as_py(), "<u8", True), expand(counts.as_py(), "<u4")
                if level > 1:
                    size = np.array(lengths.as_py())
                    grams, inside = grams_of(expand(tokens.as_py(), "<u4"), keys, size, level)
                    learned = np.repeat(~np.array(held.as_py(), bool), size)[inside]
                    keys, place = np.unique(grams[inside], return_inverse=True)
                    n = np.bincount(place[learned], minlength=len(keys)).astype("<u4")
                dealt = deal(keys, shards)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in dealt], pa.int32()), pa.array([block.as_py()] * len(dealt), pa.string()),
                     pa.array([squeeze(keys[c], True) for _, c in dealt], pa.binary()),
                     pa.array([squeeze(n[c]) for _, c in dealt], pa.binary())],
                    names=["shard", "block", "keys", "counts"])

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [expand(k, "<u8", True) for k in group["keys"]]
        distinct, place = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.concatenate([expand(c, "<u4") for c in group["counts"]])
        n = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, parts)])
        out = n[place].astype("<u8")
        return pd.DataFrame({
            "block": group["block"], "level": level, "shard": int(key[0]),
            "totals": [squeeze(out[a:b]) for a, b in zip(cuts, cuts[1:])],
            "seen": [int((n > 0).sum()), *[0] * (len(parts) - 1)]})

    rows = blocks.select("block", "words", "counts", *(["tokens", "lengths", "held_out"] if level > 1 else
                                                        [F.lit(None).alias(c) for c in ("t", "l", "h")]))
    return (rows.mapInArrow(send, "shard int, block string, keys binary, counts binary")
            .groupBy("shard").applyInPandas(total, TOTALS))


def joined_totals(rows: pd.DataFrame, level: int, n: int) -> np.ndarray:
    """A block's totals in the order of its sorted n-grams."""
    own = rows[rows["level"] == level].sort_values("shard")
    if not len(own):
        return np.zeros(n, np.int64)
    return np.concatenate([expand(t, "<u8") for t in own["totals"]]).astype(np.int64)


class Automaton:
    """The states and arcs that the documents of one block can reach.

    A state is the root (no words) or a seen n-gram of up to ``order - 1`` words.  State h has an arc for each word w
    that followed it, of log10 weight p(w | h), and a failure arc to the state of its words but the first.  ``grams[n]``
    holds, by token, the number of the n-gram that ends there (-1: none, or not seen in training texts).
    """

    def __init__(self, tokens: np.ndarray, root: np.ndarray, grams: dict[int, np.ndarray], counts: dict[int, np.ndarray],
                 mu: float) -> None:
        self.tokens, self.root, self.grams, self.order = tokens, root, grams, max(grams)
        self.arc, self.failure = {1: root}, {}
        for n in range(1, self.order):
            self.failure[n] = np.log10(mu / (counts[n] + mu))
            at = np.flatnonzero(grams[n + 1] >= 0)
            number = grams[n + 1][at]
            # Each seen n-gram stands where it ends; its suffix, of one word less, ends there too.
            lower = self.arc[n][grams[n][at]] if n > 1 else root[tokens[at]]
            weight = np.log10((counts[n + 1][number] + mu * 10.0 ** lower) / (counts[n][grams[n][at - 1]] + mu))
            self.arc[n + 1] = np.zeros(len(counts[n + 1]))
            self.arc[n + 1][number] = weight

    def traverse(self, starts: np.ndarray) -> np.ndarray:
        """Log10 weight of the path that reads each token, from the root at each document's start.

        The state carried to a token is the longest one that the words before it name: an arc taken from a state of L
        words leads to L + 1 words (``order - 1`` at most), and a failure arc drops one.  No state holds more than
        ``order - 1`` words, so those words alone tell it, and all tokens step at once, failure by failure.
        """
        words = np.zeros(len(self.tokens), np.int64)
        for n in range(1, self.order):
            words[1:][self.grams[n][:-1] >= 0] = n
        words[starts] = 0
        weight = np.zeros(len(self.tokens))
        for n in range(self.order - 1, 0, -1):
            here = np.flatnonzero(words == n)
            found = self.grams[n + 1][here] >= 0
            take, fail = here[found], here[~found]
            weight[take] += self.arc[n + 1][self.grams[n + 1][take]]
            words[take] = -1
            weight[fail] += self.failure[n][self.grams[n][fail - 1]]
            words[fail] = n - 1
        at_root = words == 0
        weight[at_root] += self.root[self.tokens[at_root]]
        return weight


def score_documents(docs: DataFrame, folds: int = 10, mu: float = 600.0, add: float = 0.1, block_tokens: int = 2_000_000,
                    shard_tokens: int = 4_000_000, order: int = 3, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``order``: words of the longest n-grams, 2 or more; ``fold``: the one of ``folds`` that is held out.
    """
    blocks = stage(cut_blocks(docs, folds, block_tokens, fold), "lm-blocks")
    sums = blocks.agg(F.sum("n_tokens").alias("n"), F.sum("n_train").alias("train")).first()
    shards = max(1, ceil((sums.n or 0) / shard_tokens))
    unigrams = stage(totals(blocks, 1, shards), "lm-words")
    n_train, vocabulary = int(sums.train or 0), int(unigrams.agg(F.sum("seen")).first()[0] or 0)
    rest = n_train + add * (vocabulary + 1)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                                         "score"])
        block = left.iloc[0]
        tokens, words = expand(block["tokens"], "<u4"), expand(block["words"], "<u8", True)
        lengths = np.array(block["lengths"])
        counts = {1: joined_totals(right, 1, len(words))}
        grams = {1: np.where(counts[1][tokens] > 0, tokens.astype(np.int64), -1)}
        for n in range(2, order + 1):
            hashes, inside = grams_of(tokens, words, lengths, n)
            keys, place = np.unique(hashes[inside], return_inverse=True)
            counts[n], grams[n] = joined_totals(right, n, len(keys)), np.full(len(tokens), -1)
            grams[n][inside] = np.where(counts[n][place] > 0, place, -1)
        root = np.log10((counts[1] + add) / rest)
        starts = np.cumsum(lengths) - lengths
        path = Automaton(tokens, root, grams, counts, mu).traverse(starts)
        return pd.DataFrame({
            "doc_id": pd.array(block["doc_ids"], "Int64") if len(block["doc_ids"]) else [],
            "held_out": list(block["held_out"]), "n_tokens": lengths,
            "n_known": np.add.reduceat((grams[1] >= 0).astype(np.int64), starts), "train_tokens": n_train,
            "base_score": np.add.reduceat(root[tokens], starts), "score": np.add.reduceat(path, starts)})

    columns = ["block", "level", "shard", "totals"]
    found = unigrams.select(*columns)
    for n in range(2, order + 1):
        found = found.unionByName(totals(blocks, n, shards).select(*columns))
    whole = blocks.select("block", "doc_ids", "held_out", "lengths", "tokens", "words")
    return whole.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double")


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the trigram automaton of the training documents."""
    return score_documents(table(spark, sf_dir, "documents"))
