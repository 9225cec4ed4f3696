"""Helpers shared by the operators: tables, stage tables, hashed samples, word hashes, token ids."""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from unicodedata import is_normalized

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.session import ensure_checkpoint_dir

# Odd multipliers and shifts of a 64-bit finaliser.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
SHIFT_A, SHIFT_B = np.uint64(29), np.uint64(32)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in an Arrow batch, if the session has the default: texts may be long, and a batch lies in
    the memory of both the JVM and the Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    It cuts lineage: later steps re-read the table when an executor is lost, and a
    step used twice runs once.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``key``: the same rows whatever the partitioning.

    Only the key column is ranked (a partial top-n in each task); its n values are then joined back, so
    the broadcast side never has more than ``n`` rows.
    """
    ranked = df.where(F.col(key).isNotNull()).select(F.col(key), F.xxhash64(key).alias("_h")).distinct()
    keys = ranked.orderBy("_h", key).limit(n).select(key)
    return df.join(F.broadcast(keys), key, "left_semi")


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written once with a unique number each, and the name of that column."""
    key, taken = "row_key", {c.lower() for c in docs.columns}
    while key in taken:
        key = f"_{key}"
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def doc_bucket(*cols) -> F.Column:
    """crc32 of a key as text: the fold that contracts use to hold rows out."""
    return F.crc32(F.col(cols[0]).cast("string").cast("binary"))


def text_bytes(col: str = "text") -> F.Column:
    """The text as UTF-8 bytes, null as empty: Python tasks then need no decoding to split words."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def finalise(h: np.ndarray) -> np.ndarray:
    """Spread the bits of combined 64-bit hashes (in place)."""
    h ^= h >> SHIFT_A
    h *= MIX_B
    h ^= h >> SHIFT_B
    return h


class WordHashes(dict):
    """64-bit hashes of a text's words, memoised per task: the dictionary from words to hashes.

    Words are maximal runs without ASCII white space, A-Z lower-cased.  It is emptied at ``room`` words; words longer
    than ``longest`` bytes are never kept.
    """

    def __init__(self, room: int = 300_000, longest: int = 48) -> None:
        super().__init__()
        self.room, self.longest = room, longest

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[word] = h
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words form one shingle, none no shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = words[: n - width + 1].copy()
    for k in range(1, width):
        h = h * MIX_A + words[k: n - width + 1 + k]
    if width < size:  # a short text never equals a part of a longer one
        h = h * MIX_A + np.uint64(width)
    return np.unique(finalise(h))


# A cut before a space that a non-space follows never falls inside a pre-token of the byte-level pattern.
_CUT = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


# How byte-level vocabularies write each byte: printable ones as themselves, the others from 256 upwards.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + sorted({*range(256)} - _PRINTABLE).index(b) for b in range(256)}
#: The byte that a character of a byte-level token stands for.
BYTE_OF = {chr(c): b for b, c in _BYTE_CHARS.items()}
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class UnitEncoder(dict):
    """Token ids of whole texts as little-endian uint32 bytes, equal to encoding each text at once.

    A text is cut where its pre-tokenizer always cuts (at spaces), and each distinct unit is encoded once by
    the tokenizers library and memoised per Python worker: the encoder is the dictionary from units (without the
    space before them) to ids.  It is emptied at ``room`` units; units longer than ``longest`` characters are
    encoded but not kept.
    ``leading_space``: the vocabulary sees the space in front of a word (byte-level pre-tokens);
    otherwise white space is dropped by the tokenizer.  ``lower``: the tokenizer lower-cases each character.
    Texts that hold a special token's string are encoded as a whole, as the tokenizers library does; with ``plain`` such
    strings are ordinary text.
    """

    _shared: dict = {}

    def __init__(self, path: str, leading_space: bool, lower: bool = False, room: int = 500_000,
                 longest: int = 40, plain: bool = False) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.specials = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.space, self.lower, self.room, self.longest = " " if leading_space else "", lower, room, longest
        self.tails: dict[str, bytes] = {}
        self.word = self.tokenizer.model.tokenize
        self.mark = chr(_BYTE_CHARS[32]) if leading_space else ""

    @classmethod
    def shared(cls, path: str, leading_space: bool, lower: bool = False) -> UnitEncoder:
        """The worker's encoder: its memo serves all tasks of the worker."""
        key = (path, leading_space, lower)
        if key not in cls._shared:
            cls._shared[key] = cls(path, leading_space, lower)
        return cls._shared[key]

    def has_special(self, text: str) -> bool:
        """Whether a text holds a special token's string."""
        return any(s in text for s in self.specials)

    def encode(self, text: str) -> bytes:
        """Ids of a text as it is."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.encode(tail)
        return self.tails[tail]

    def __missing__(self, unit: str) -> bytes:
        """Letters, then perhaps marks, are two pre-tokens: the letters go to the model as they are (in its
        spelling of bytes), the marks are memoised apart.  Other units are encoded as texts."""
        core = unit.rstrip(_TAIL)
        if core.isascii() and core.isalpha():
            spelled = core
        elif core.isalpha() and is_normalized("NFC", core):
            spelled = core.encode().decode("latin-1").translate(_BYTE_CHARS)
        else:
            spelled = ""
        if not spelled:
            ids = self.encode(self.space + unit) if unit else b""
        elif len(core) < len(unit):
            ids = self[core] + self._tail(unit[len(core):])
        else:
            ids = array("I", [t.id for t in self.word(self.mark + spelled)]).tobytes()
        if len(unit) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[unit] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Ids of a text."""
        get = self.__getitem__
        if self.has_special(text):
            return self.encode(text)
        if not self.space:
            if self.lower and "\u03a3" in text:  # the final form of this letter depends on its neighbours
                return b"".join(map(self.encode, text.split(" ")))
            if self.lower:
                text = text.lower()
            return b"".join(map(get, text.split(" ")))
        if _ODD_SPACE.search(text):
            return b"".join(map(self.encode, _CUT.split(text)))
        first, _, rest = text.partition(" ")
        return self.encode(first) + (b"".join(map(get, rest.split(" "))) if rest else b"")


# The pre-token pattern of byte-level vocabularies (a fixed value).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteEncoder:
    """Token ids of whole texts under a byte-level vocabulary file of the tokenizers library.

    Where ids follow the order of the merges, as in the public files, tiktoken applies the same ranks to the same
    pre-tokens; other vocabularies are encoded unit by unit.  Texts that hold a special token's string are encoded by
    the tokenizers library; with ``plain`` such strings are ordinary text.
    """

    _shared: dict = {}

    def __init__(self, path: str, plain: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.units = UnitEncoder(path, leading_space=True, plain=plain)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        vocabulary, merges = model["vocab"], model.get("merges", [])
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        in_order = all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(parts))
        usual = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
        self.ranks = None
        if in_order and usual and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges"):
            size = 256 + len(merges)
            ranks = {bytes(map(BYTE_OF.get, t)): k for t, k in vocabulary.items() if k < size}
            self.ranks = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})

    @classmethod
    def shared(cls, path: str, plain: bool = False) -> ByteEncoder:
        """The worker's encoder."""
        if (path, plain) not in cls._shared:
            cls._shared[path, plain] = cls(path, plain)
        return cls._shared[path, plain]

    @property
    def tokenizer(self):
        return self.units.tokenizer

    def __call__(self, text: str) -> array:
        """Ids of a text, as unsigned 32-bit numbers."""
        if self.ranks is None or self.units.has_special(text):
            return array("I", self.units(text))
        return array("I", self.ranks.encode_ordinary(text))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
