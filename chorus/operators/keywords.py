"""Large keyword lists: one pass over each text with a multi-pattern automaton.

``contains`` per keyword costs a scan of the text each; an automaton with failure links reads a text once, however many
keywords there are.  Keywords go to the tasks in blocks of a checked size; with more keywords than a block holds, the texts
are read once per block, so no keyword is left out and no task holds more than one block.

Defined cases: null texts and null or empty keywords match nothing; a keyword listed twice counts once; overlapping
occurrences all count; matching is on lower-cased texts and keywords.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords, and their characters, that one block may hold.
BLOCK_KEYWORDS, BLOCK_CHARS = 200_000, 4_000_000


def keyword_hits(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, keyword_col: str = "keyword",
                 whole_words: bool = True, block_keywords: int = BLOCK_KEYWORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``id_col``, keyword, hits) of every text and keyword that occurs in it.

    ``whole_words``: neither neighbour of an occurrence is a letter, digit or underscore; otherwise any substring counts.
    """
    spark = texts.sparkSession
    words = keywords.select(F.lower(F.col(keyword_col)).alias("keyword")).where(F.length("keyword") > 0).distinct()
    size = words.agg(F.count("*").alias("n"), F.sum(F.length("keyword")).alias("chars")).first()
    blocks = max(1, ceil(size.n / block_keywords), ceil((size.chars or 0) / block_chars))
    rows = texts.select(F.col(id_col), F.lower(F.col(text_col)).alias("_text"))
    schema = rows.select(id_col, F.lit("").alias("keyword"), F.lit(0).cast("long").alias("hits")).schema

    def hits(block: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([r.keyword for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for k in shared.value:
                automaton.add_word(k, k)
            automaton.make_automaton()
            for batch in batches:
                places, found, counts = [], [], []
                for place, text in enumerate(batch.column(1).to_pylist()):
                    if not text or not len(automaton):
                        continue
                    seen: dict[str, int] = {}
                    for end, k in automaton.iter(text):
                        if not whole_words or _apart(text, end - len(k), end + 1):
                            seen[k] = seen.get(k, 0) + 1
                    places += [place] * len(seen)
                    found += seen
                    counts += seen.values()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places, pa.int64())), pa.array(found, pa.string()),
                     pa.array(counts, pa.int64())], names=schema.names)

        return rows.mapInArrow(run, schema)

    block_of = F.pmod(F.xxhash64("keyword"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [hits(words.where(block_of == b)) for b in range(blocks)])


def _apart(text: str, before: int, after: int) -> bool:
    """Whether no word goes on across the places ``before`` and ``after`` an occurrence."""
    return not (before >= 0 and (text[before].isalnum() or text[before] == "_")
                or after < len(text) and (text[after].isalnum() or text[after] == "_"))
