"""Token counts: linear longest-match automaton.

The vocabulary's trie gets failure links: when no child fits the next character, the link pops the longest pieces
matched so far and goes on from the trie node of what is left.  Each node keeps how many pieces its link pops, so
one pass over a word counts its greedy longest-match pieces without building any.

Words are maximal runs without white space (Unicode); a word is matched with the word mark in front.  A word
that no sequence of greedy matches covers counts as one unknown token.  Counts of distinct words are memoised per
Python worker, in a dictionary of bounded size.

Defined cases: null and empty texts have no words and no tokens; repeated rows are counted each; rows with a null
id are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import table, tokenizer_path

MARK = "▁"
UNKNOWN = 1 << 40  # added to a word's count if it is unknown; low bits hold the count


class LongestMatch:
    """Greedy longest-match counts over a vocabulary."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    ends.append(False)
                node = self.children[node][c]
            ends[node] = node > 0
        self.fail: list[int] = [-1] * len(ends)  # -1: none, what was matched can't be popped whole
        self.pops: list[int] = [0] * len(ends)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.children[parent].items():
                queue.append(node)
                if ends[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                back, popped = self.fail[parent], self.pops[parent]
                while back >= 0 and c not in self.children[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[node], self.pops[node] = self.children[back][c], popped

    def count(self, text: str) -> int:
        """Number of pieces, or -1 if greedy matching does not cover the text."""
        children, fail, pops = self.children, self.fail, self.pops
        node = total = 0
        for c in text:
            while c not in children[node]:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = children[node][c]
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return total


class WordCounts(dict):
    """Memo of word -> count, with UNKNOWN added for unknown words."""

    def __init__(self, automaton: LongestMatch, room: int = 600_000, longest: int = 64) -> None:
        super().__init__()
        self.automaton, self.room, self.longest = automaton, room, longest

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        n = n if n >= 0 else 1 + UNKNOWN
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[word] = n
        return n


_COUNTERS: dict[str, WordCounts] = {}


def counter(path: str) -> WordCounts:
    """The worker's memo over the ordinary pieces of a sentencepiece model."""
    if path not in _COUNTERS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        _COUNTERS[path] = WordCounts(LongestMatch(pieces))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_words, n_unknown) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = counter(vocabulary)
        for batch in batches:
            words = [t.as_py().split() for t in batch.column(1)]
            sums = [sum(map(memo.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s % UNKNOWN for s in sums], pa.int64()),
                 pa.array([len(w) for w in words], pa.int64()), pa.array([s // UNKNOWN for s in sums], pa.int64())],
                names=["doc_id", "n_tokens", "n_words", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_words long, n_unknown long")


def op8_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
