"""Cross-tokenizer alignment: links between the tokens of two tokenizers, counted by minimal perfect hashing.

A text (with a space in front) is encoded by a byte-level vocabulary (A) and a sentence-piece vocabulary (B).  Byte offsets
where a token of A and one of B both end cut the tokens into groups; all pairs of an A and a B token in a group are links.

1. Documents are encoded once, as whole texts, and written with their ids.
2. The distinct id pairs of all documents are dealt into buckets by hash.  Each bucket builds a minimal perfect hash (levels
   of bit sets; a key that collides goes to the next level; the index is the rank of its bit) and its keys in that order.
   A bucket has at most a 256th or so of the pairs that the two vocabularies allow, however many documents there are.
3. Each task counts in a dense vector indexed by the hash how many of its documents hold a pair; keys are verified.  The
   vectors are added up in a tree, segment by segment, with a bounded fan-in.
4. A second pass aligns the documents again from their ids and looks the counts up.

Tables go to all tasks in rounds of at most ``round_pairs`` pairs; with more pairs than that, steps 3 and 4 run once per
round, and the rounds' sums are added by row.

Defined cases: null and empty texts, and texts whose tokens do not spell the text (a literal U+2581, which B reads as a
space) have no tokens: all counts are 0 and groups_sha256 is ''; special tokens' strings in a text are plain text; very long
texts are encoded whole, in memory that follows the one text, and a group of very many tokens is counted by its distinct
ids; repeated rows and rows with a null or repeated doc_id are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import BYTE_OF, MIX_A, ByteEncoder, finalise, stage, table, tokenizer_path

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary")
OUT = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
       "groups_sha256 string")
BUCKETS, SEGMENT, FAN_IN = 256, 1 << 16, 64
RUN_TOKENS, LARGE_GROUP = 50_000, 4096


class TokenBytes:
    """Bytes of the tokens of both vocabularies, and the number of bits of a B id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = ByteEncoder(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, size_b = self.a.tokenizer.get_vocab_size(), self.b.get_piece_size()
        if size_a > 1 << 16 or size_b > 1 << 16:
            raise ValueError("ids are kept as 16-bit numbers: vocabularies of more than 65,536 tokens are not supported")
        spelled = [self.a.tokenizer.id_to_token(k) or "" for k in range(size_a)]
        self.bytes_a = [bytes(map(BYTE_OF.get, t)) if all(c in BYTE_OF for c in t) else b"" for t in spelled]
        self.bytes_b = [self._piece(k) for k in range(size_b)]
        self.bits = (size_b - 1).bit_length()
        self.length_a, self.length_b = (np.array([max(1, len(t)) for t in ts]) for ts in (self.bytes_a, self.bytes_b))
        # Decimal forms of ids, with room for a separator.
        texts = [str(k).encode() for k in range(max(size_a, size_b))]
        self.width = np.array([*map(len, texts)])
        self.digits = np.array([list(x.ljust(6)) for x in texts], np.uint8)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(k) or self.b.is_unknown(k) else piece.replace("▁", " ").encode()


class Encoder:
    """(A ids, B ids) of texts as 16-bit numbers."""

    _shared: dict = {}

    def __init__(self, path_a: str, path_b: str) -> None:
        self.tokens = TokenBytes(path_a, path_b)

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> Encoder:
        """The worker's encoder."""
        if (path_a, path_b) not in cls._shared:
            cls._shared[path_a, path_b] = cls(path_a, path_b)
        return cls._shared[path_a, path_b]

    def __call__(self, text: str) -> tuple[bytes, bytes]:
        """Empty if the ids do not spell the text."""
        if not text:
            return b"", b""
        t, spelled = self.tokens, " " + text
        a, b, whole = array("H", t.a(spelled)).tobytes(), t.b.encode(text), spelled.encode()
        # Byte-level tokens always spell their text; their lengths are enough.
        if t.length_a[np.frombuffer(a, "<u2")].sum() != len(whole) or b"".join(map(t.bytes_b.__getitem__, b)) != whole:
            return b"", b""
        return a, array("H", b).tobytes()


class Groups:
    """Groups of the tokens of documents whose bytes follow each other on both sides."""

    def __init__(self, a: np.ndarray, b: np.ndarray, t: TokenBytes) -> None:
        ends_a, ends_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        ends = np.zeros(int(max(ends_a[-1:].sum(), ends_b[-1:].sum())) + 1, np.int8)
        ends[ends_a] = 1
        ends[ends_b] += 2
        closes_a, closes_b = ends[ends_a] == 3, ends[ends_b] == 3
        self.of_a, self.of_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        self.in_a, self.in_b = np.bincount(self.of_a), np.bincount(self.of_b)
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b


def group_texts(a: np.ndarray, b: np.ndarray, t: TokenBytes, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document, of documents with so many tokens."""
    g = Groups(a, b, t)
    # A group's A tokens stand before its B tokens; each token is followed by its separator.
    at_a, at_b = np.arange(len(a)) + g.first_b[g.of_a], np.arange(len(b)) + g.first_a[g.of_b] + g.in_a[g.of_b]
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    marks[at_a[g.first_a + g.in_a - 1]], marks[at_b[g.first_b + g.in_b - 1]] = ord("|"), ord(";")
    letters, width = t.digits[ids], t.width[ids]
    letters[np.arange(len(ids)), width] = marks
    data = letters[np.arange(letters.shape[1]) <= width[:, None]].tobytes()
    cuts = np.concatenate([[0], np.cumsum(width + 1)])[np.concatenate([[0], np.cumsum(sizes_a + sizes_b)])]
    return [data[i: max(i, j - 1)] for i, j in zip(cuts, cuts[1:])]


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Ids and groups of every row (ALIGNED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.shared(path_a, path_b)
        names = [c.split()[0] for c in ALIGNED.split(", ")]

        def flush(held: list[tuple]) -> pa.RecordBatch:
            rows, ids, a, b = zip(*held)
            n_a, n_b = (np.array([len(x) // 2 for x in side]) for side in (a, b))
            groups = group_texts(np.frombuffer(b"".join(a), "<u2"), np.frombuffer(b"".join(b), "<u2"), encode.tokens, n_a, n_b)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(n_a), pa.array(n_b),
                 pa.array([g.count(b";") + (g != b"") for g in groups], pa.int64()),
                 pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
                 pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=names)

        held, size = [], 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((row, doc_id, *encode(text.as_py() or "")))
                size += len(held[-1][2]) // 2
                if size >= RUN_TOKENS or len(held) >= 2000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ALIGNED)


def links(a: np.ndarray, b: np.ndarray, t: TokenBytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document << 32 | pair), sorted, and how many links each has, of documents whose A tokens begin at
    ``starts`` (their bytes follow each other on both sides)."""
    g = Groups(a, b, t)
    sizes = np.diff(starts, append=len(a))
    doc = np.repeat(np.arange(len(starts), dtype=np.uint64) << np.uint64(32), sizes)
    keys_a, keys_b = doc | a.astype(np.uint64) << np.uint64(t.bits), b.astype(np.uint64)
    large = g.in_a * g.in_b > LARGE_GROUP
    # Small groups: every pair of tokens.
    reach = np.where(large, 0, g.in_b)[g.of_a]
    place = np.arange(reach.sum()) + np.repeat(g.first_b[g.of_a] - np.cumsum(reach) + reach, reach)
    keys, counts = np.unique(np.repeat(keys_a, reach) | keys_b[place], return_counts=True)
    if not large.any():
        return keys, counts
    # Groups of very many tokens: every pair of distinct ids.
    more_keys, more_counts = [keys], [counts]
    for k in np.flatnonzero(large):
        x, nx = np.unique(keys_a[g.first_a[k]: g.first_a[k] + g.in_a[k]], return_counts=True)
        y, ny = np.unique(keys_b[g.first_b[k]: g.first_b[k] + g.in_b[k]], return_counts=True)
        more_keys.append((x[:, None] | y).reshape(-1))
        more_counts.append((nx[:, None] * ny).reshape(-1))
    keys, place = np.unique(np.concatenate(more_keys), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, np.concatenate(more_counts))
    return keys, total


def runs(batch: pa.RecordBatch, t: TokenBytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, keys, counts) of the links of runs of documents, each of a bounded number of tokens but for a
    document that is longer by itself.  The last two columns of the batch hold the ids."""
    column_a, column_b = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    first, held_a, held_b, sizes, tokens = 0, [], [], [], 0
    for k in range(batch.num_rows):
        held_a.append(np.frombuffer(column_a[k].as_buffer(), "<u2"))
        held_b.append(np.frombuffer(column_b[k].as_buffer(), "<u2"))
        sizes.append(len(held_a[-1]))
        tokens += sizes[-1]
        if tokens >= RUN_TOKENS or k + 1 == batch.num_rows:
            starts = np.cumsum(sizes) - sizes
            yield (first, len(sizes), *links(np.concatenate(held_a), np.concatenate(held_b), t, starts))
            first, held_a, held_b, sizes, tokens = k + 1, [], [], [], 0


PAIR = np.uint64((1 << 32) - 1)


def spread(pairs: np.ndarray) -> np.ndarray:
    return finalise(pairs * MIX_A)


def slots(pairs: np.ndarray, level: int, bits: np.ndarray | int) -> np.ndarray:
    """Where keys fall in a level's bit set."""
    seed = np.uint64((2 * level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return (finalise((pairs + seed) * MIX_A) >> np.uint64(8)) % np.asarray(bits, np.uint64)


def perfect_hash(pairs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(64-bit words of each level, all words, keys in the order of their index) of distinct keys."""
    sizes, words, ordered, left = [], [], [], pairs
    while len(left):
        size = max(1, -(-2 * len(left) // 64))
        slot = slots(left, len(sizes), size * 64).astype(np.int64)
        alone = np.bincount(slot, minlength=size * 64)[slot] == 1
        bits = np.zeros(size * 64, np.uint8)
        bits[slot[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        ordered.append(left[alone][np.argsort(slot[alone])])
        left = left[~alone]
    return sizes, np.concatenate(words), np.concatenate(ordered)


class PairTable:
    """The minimal perfect hashes of some buckets as one: indexes run through the buckets in order."""

    def __init__(self, buckets: list[tuple[int, list[int], bytes, bytes]]) -> None:
        levels = max((len(sizes) for _, sizes, _, _ in buckets), default=0)
        self.size = np.zeros((levels, BUCKETS), np.int64)
        self.base = np.zeros((levels, BUCKETS), np.int64)
        at = 0
        for bucket, sizes, _, _ in buckets:
            for level, size in enumerate(sizes):
                self.size[level, bucket], self.base[level, bucket] = size, at
                at += size
        self.words = np.concatenate([np.frombuffer(w, "<u8") for _, _, w, _ in buckets] or [np.empty(0, np.uint64)])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.concatenate([np.frombuffer(k, "<u4") for _, _, _, k in buckets] or [np.empty(0, np.uint32)])

    def __len__(self) -> int:
        return len(self.keys)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """Verified indexes; -1 for pairs of other buckets."""
        out = np.full(len(pairs), -1)
        bucket = (spread(pairs) >> np.uint64(56)).astype(np.int64)
        todo = np.arange(len(pairs))
        for level in range(len(self.size)):
            todo = todo[self.size[level, bucket[todo]] > 0]
            slot = slots(pairs[todo], level, self.size[level, bucket[todo]] * 64)
            word = self.base[level, bucket[todo]] + (slot >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (slot & np.uint64(63))
            held = (self.words[word] & bit) != 0
            out[todo[held]] = self.rank[word[held]] + np.bitwise_count(self.words[word[held]] & (bit[held] - np.uint64(1)))
            todo = todo[~held]
        found = np.flatnonzero(out >= 0)
        wrong = self.keys[out[found]] != pairs[found]
        out[found[wrong]] = -1
        return out


def distinct_pairs(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(bucket, pair) of all documents: distinct within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, size = Encoder.shared(*paths).tokens, [np.empty(0, np.uint64)], 0

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(seen))
            return pa.RecordBatch.from_arrays([pa.array((spread(pairs) >> np.uint64(56)).astype(np.int32)),
                                               pa.array(pairs.astype(np.int64))], names=["bucket", "pair"])

        for batch in batches:
            for _, _, keys, _ in runs(batch, t):
                seen.append(np.unique(keys & PAIR))
                size += len(seen[-1])
                if size > 4_000_000:
                    seen = [np.unique(np.concatenate(seen))]
                    size = len(seen[0])
                    if size > 3_000_000:
                        yield flush()
                        seen, size = [np.empty(0, np.uint64)], 0
        yield flush()

    return rows.select("a", "b").mapInArrow(run, "bucket int, pair long").distinct()


def built(pairs: DataFrame) -> DataFrame:
    """(bucket, n, sizes, words, keys): a minimal perfect hash per bucket."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        sizes, words, keys = perfect_hash(np.sort(group["pair"].to_numpy().astype(np.uint64)))
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "n": [len(keys)], "sizes": [sizes],
                             "words": [words.tobytes()], "keys": [keys.astype("<u4").tobytes()]})

    return pairs.groupBy("bucket").applyInPandas(build, "bucket int, n long, sizes array<int>, words binary, keys binary")


def packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


def tree_sum(parts: DataFrame, tasks: int) -> DataFrame:
    """Segments (segment, node, counts) of the tasks' vectors added up, ``FAN_IN`` vectors at a time."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT, np.int64)
        for data in group["counts"]:
            total += unpacked(data)
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "node": [group["node"].iloc[0]], "counts": [packed(total)]})

    while tasks > 1:
        tasks = ceil(tasks / FAN_IN)
        parts = (parts.select("segment", F.floor(F.col("node") / FAN_IN).cast("int").alias("node"), "counts")
                 .groupBy("segment", "node").applyInPandas(add, "segment int, node int, counts binary"))
    return parts.select("segment", "counts")


def document_counts(rows: DataFrame, pairs: PairTable, paths: tuple[str, str], tasks: int) -> np.ndarray:
    """How many documents hold each pair of the table, in its order (a round's bounded vector)."""
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, pairs = Encoder.shared(*paths).tokens, shared.value
        total = np.zeros(ceil(len(pairs) / SEGMENT) * SEGMENT, np.int64)
        for batch in batches:
            for _, _, keys, _ in runs(batch, t):
                once, documents = np.unique(keys & PAIR, return_counts=True)
                at = pairs.index(once)
                total[at[at >= 0]] += documents[at >= 0]
        parts = total.reshape(-1, SEGMENT)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), TaskContext.get().partitionId(), np.int32)),
             pa.array([packed(parts[s]) for s in used], pa.binary())], names=["segment", "node", "counts"])

    sums = tree_sum(rows.select("a", "b").mapInArrow(run, "segment int, node int, counts binary"), tasks)
    total = np.zeros(ceil(len(pairs) / SEGMENT) * SEGMENT, np.int64)
    for row in sums.collect():
        total[row.segment * SEGMENT: (row.segment + 1) * SEGMENT] += unpacked(bytes(row.counts))
    return total[: len(pairs)]


def looked_up(rows: DataFrame, pairs: PairTable, counts: np.ndarray, best: np.ndarray, paths: tuple[str, str]) -> DataFrame:
    """The second pass: links of every document, and its sums over the links of this round's pairs (OUT)."""
    shared = rows.sparkSession.sparkContext.broadcast((pairs, counts, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (pairs, counts, best) = Encoder.shared(*paths).tokens, shared.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for first, n, keys, times in runs(batch, t):
                at = pairs.index(keys & PAIR)
                count = np.where(at >= 0, counts[np.maximum(at, 0)] if len(counts) else 0, 0)
                top = (at >= 0) & (count == best[((keys & PAIR) >> np.uint64(t.bits)).astype(np.int64)])
                edges = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
                for k, values in enumerate((times, times * top, times * count)):
                    sums = np.concatenate([[0], np.cumsum(values)])
                    out[k, first: first + n] = sums[edges[1:]] - sums[edges[:-1]]
            by_name = dict(zip(batch.schema.names, batch.columns)) | {
                "n_links": pa.array(out[0]), "n_best": pa.array(out[1]), "count_sum": pa.array(out[2])}
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([by_name[c] for c in names], names=names)

    return rows.mapInArrow(run, OUT)


def align_documents(docs: DataFrame, path_a: str, path_b: str, round_pairs: int = 4_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    paths = (path_a, path_b)
    rows = stage(aligned_documents(docs, *paths), "aligned")
    tasks = rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
    tasks = 1 if tasks is None else tasks + 1
    hashes = stage(built(distinct_pairs(rows, paths)), "pair-hashes")
    sizes = {r.bucket: r.n for r in hashes.select("bucket", "n").collect()}  # at most BUCKETS rows
    rounds, held = [[]], 0
    for bucket in sorted(sizes):
        if rounds[-1] and held + sizes[bucket] > round_pairs:
            rounds.append([])
            held = 0
        rounds[-1].append(bucket)
        held += sizes[bucket]

    def table_of(buckets: list[int]) -> PairTable:
        got = hashes.where(F.col("bucket").isin(buckets)).orderBy("bucket").collect() if buckets else []
        return PairTable([(r.bucket, list(r.sizes), bytes(r.words), bytes(r["keys"])) for r in got])

    tokens = Encoder.shared(*paths).tokens
    best, kept = np.zeros(len(tokens.length_a), np.int64), []
    for buckets in rounds:
        pairs = table_of(buckets)
        counts = document_counts(rows, pairs, paths, tasks)
        np.maximum.at(best, (pairs.keys >> np.uint32(tokens.bits)).astype(np.int64), counts)
        kept.append(packed(counts))
    if len(rounds) == 1:
        found = looked_up(rows, pairs, counts, best, paths)
    else:
        parts = [stage(looked_up(rows, table_of(buckets), unpacked(data), best, paths), "lookups")
                 for buckets, data in zip(rounds, kept)]
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        found = found.groupBy("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_pair_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the byte-level and the sentence-piece tokens of every document."""
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))
