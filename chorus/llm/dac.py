"""Token-ID output: directly addressable codes.

Ids are split into 8-bit chunks.  Level 0 holds the low chunk of every id; level l holds chunk l of those ids
whose chunks do not end before it.  A continuation bitmap per level says which ids go on, and a rank directory
(the count of set bits before every 512th) finds an id's place in the next level, so any id is read from one
byte per level without decoding its neighbours.

One file holds the ids of some documents, at most about ``shard_ids`` of them, in document order; files follow
each other in ascending doc_id (nulls first; equal ids by a hash of their text).  A file is written under a
temporary name and then renamed, so a repeated task leaves the same file.

Layout (little-endian): b"DAC1", u32 levels, u64 documents, u64 ids, u64 chunks per level; then doc ids (i64),
null marks (u8), document starts (u64, one more than documents), and per level its chunks (u8), its bitmap
(least significant bit first) and its ranks (u64).

Defined cases: null and empty texts hold the end id alone; strings of special tokens give the tokenizer's special ids; very
long texts are encoded whole, in memory that follows the one text; null ids come first; repeated ids and repeated rows are
documents of their own, in an order by text and then by row number, so that equal rows are spread over tasks; an empty
table writes no file and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.llm.common import UnitEncoder, new_folder, stage, table, tokenizer_path

BLOCK = 512
BROADCAST_FILES = 10_000
MANIFEST = "partition long, shard long, file string, n_docs long, n_ids long"


def encode(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, ranks) of each level, one level at a time."""
    first = True
    while len(ids) or first:
        first = False
        more = ids > 255
        chunks = np.ascontiguousarray(ids.view(np.uint8)[::4])
        ranks = np.zeros((len(ids) + BLOCK - 1) // BLOCK + 1, "<u8")
        if len(ids):
            ranks[1:] = np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64))
        yield chunks, np.packbits(more, bitorder="little"), ranks
        ids = ids[more]
        ids >>= 8


def pack_file(doc_ids: list, lengths: list, ids: np.ndarray) -> list[bytes]:
    """One file's bytes, in parts."""
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    body, sizes = [known.tobytes(), nulls.tobytes(), starts.tobytes()], []
    for level in encode(ids):
        sizes.append(len(level[0]))
        body += [x.tobytes() for x in level]
    head = b"DAC1" + np.uint32(len(sizes)).tobytes() + np.array([len(doc_ids), len(ids), *sizes], "<u8").tobytes()
    return [head, *body]


class DacFile:
    """Random access to the ids and documents of one file's bytes."""

    def __init__(self, data: bytes | memoryview) -> None:
        assert bytes(data[:4]) == b"DAC1"
        n_levels = int(np.frombuffer(data, "<u4", 1, 4)[0])
        sizes = np.frombuffer(data, "<u8", 2 + n_levels, 8)
        at = 8 + 8 * len(sizes)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        self.n_docs, self.n_ids = int(sizes[0]), int(sizes[1])
        self.doc_ids, self.nulls = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.starts = take("<u8", self.n_docs + 1)
        self.levels = [(take("u1", n), take("u1", (n + 7) // 8), take("<u8", (n + BLOCK - 1) // BLOCK + 1))
                       for n in map(int, sizes[2:])]

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before position ``i``."""
        _, bits, ranks = self.levels[level]
        begin = i // BLOCK * BLOCK
        tail = np.unpackbits(bits[begin // 8: (i + 7) // 8], bitorder="little")[: i - begin]
        return int(ranks[begin // BLOCK]) + int(tail.sum())

    def token(self, i: int) -> int:
        """Id number ``i`` of the file."""
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` (exclusive): each level gives one run of its chunks."""
        out = np.zeros(end - begin, "<u4")
        where = np.arange(end - begin)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks[begin:end].astype("<u4") << np.uint32(8 * level)
            more = np.unpackbits(bits[begin // 8: (end + 7) // 8], bitorder="little")[begin % 8:][: end - begin]
            where = where[more.astype(bool)]
            if not len(where):
                break
            begin = self.rank(level, begin)
            end = begin + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


def _put(folder: str, name: str, parts: list[bytes]) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
        else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{path}/{name}")


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, leading_space: bool = False,
              lower: bool = True, shard_ids: int = 4_000_000) -> DataFrame:
    """Write every document's ids (then ``end_id``) to files in ``folder``; returns the files' manifest.

    Documents are range-partitioned and sorted by doc_id, by a hash of the text, and by row number, so repeated ids
    and equal rows do not fill one task.  A task holds one file's ids at a time.
    """
    folder = "file:" + folder if folder.startswith("/") else folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.shared(vocabulary, leading_space, lower)
        tail, partition, shard = array("I", [end_id]).tobytes(), TaskContext.get().partitionId(), 0
        keys, lengths, held, size = [], [], bytearray(), 0

        def flush() -> pa.RecordBatch:
            name = f"ids-{partition:06d}-{shard:06d}.dac"
            _put(folder, name, pack_file(keys, lengths, np.frombuffer(held, "<u4")))
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (partition, shard, name, len(keys), size)],
                names=["partition", "shard", "file", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, got in zip(batch.column(0).to_pylist(), (encoder(t.as_py()) for t in batch.column(1))):
                got += tail
                keys.append(doc_id)
                lengths.append(len(got) // 4)
                held += got
                size += len(got) // 4
                if size >= shard_ids:
                    yield flush()
                    keys, lengths, held, size, shard = [], [], bytearray(), 0, shard + 1
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).orderBy(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "row").select("doc_id", "text")
    return stage(ordered.mapInArrow(run, MANIFEST), "dac-manifest")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document from the files: (doc_id, start, ids as uint32 bytes); start counts all ids before it.

    A file's offset is the ids of earlier partitions (one summed row per partition) and of earlier files of
    its own partition.
    """
    spark = manifest.sparkSession
    offsets, total, n_files = [], 0, 0
    sums = manifest.groupBy("partition").agg(F.sum("n_ids").alias("ids"), F.count("*").alias("files"))
    for partition, n, files in sums.orderBy("partition").collect():
        offsets.append((partition, total))
        total += n
        n_files += files
    before = F.sum("n_ids").over(Window.partitionBy("partition").orderBy("shard")) - F.col("n_ids")
    places = (manifest.withColumn("before", before)
              .join(spark.createDataFrame(offsets, "partition long, passed long"), "partition")
              .select("file", (F.col("passed") + F.col("before")).alias("offset")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file = DacFile(batch.column(1)[row].as_buffer())
                offset = batch.column(0)[row].as_py()
                for k in range(0, file.n_docs, 2000):  # some documents' ids are one run of each level
                    cuts = file.starts[k: k + 2001].astype(np.int64)
                    ids = file.span(int(cuts[0]), int(cuts[-1]))
                    cuts -= cuts[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[k: k + 2000], pa.int64(), mask=file.nulls[k: k + 2000].astype(bool)),
                         pa.array(file.starts[k: min(k + 2000, file.n_docs)].astype(np.int64) + offset),
                         pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                        names=["doc_id", "start", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    content = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return (content.join(F.broadcast(places), "file") if n_files <= BROADCAST_FILES else content.join(places, "file")) \
        .select("offset", "content").mapInArrow(run, "doc_id long, start long, ids binary")


def op6_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to files in ascending doc_id, and what the files give back."""
    folder = new_folder(spark, "dac")
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(manifest, folder).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
