"""Token ids, packing, directly addressable codes and word-piece counts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorus.llm import dac, packing, wordpiece
from chorus.llm.common import ByteEncoder, UnitEncoder, new_folder, tokenizer_path

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
HARD = ["", " ", "  a", "a  b\n c \n\nd  ", "x \t y", "it's we'll  don't", "don't. we's, a' 'b x's!", "a.b. c.. ...",
        "Ünïcode é  ÉÇ ß İ", "é. é. ́x", "ﬁ ﬁ.", "ΑΣ. ΑΣ ς", "a_b_ _", "日本。 日本. テキスト　全角", "1234 5678  90",
        "<|endoftext|> a <|endoftext|>", "a  <|endoftext|>.<|startoftext|> \n b", "a" * 3000, " \n", "\n a", "a\x1c b\x85 c  d", "\x01 \x00   x"]


def whole(name, texts, plain=False):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(name))
    if plain:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("name", "space", "lower"), [(BYTES, True, False), (WORDS, False, True)])
def test_units_equal_whole_texts(name, space, lower):
    got = list(map(UnitEncoder(tokenizer_path(name), space, lower, room=50), HARD + HARD[::-1]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == whole(name, HARD + HARD[::-1])


@pytest.mark.parametrize("plain", [False, True])
def test_ranks_equal_the_vocabulary(plain):
    encoder = ByteEncoder(tokenizer_path(BYTES), plain)
    assert encoder.ranks is not None
    assert [encoder(t).tolist() for t in HARD] == whole(BYTES, HARD, plain)
    units = UnitEncoder(tokenizer_path(BYTES), True, plain=plain)
    assert [np.frombuffer(units(t), "<u4").tolist() for t in HARD] == whole(BYTES, HARD, plain)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=" \n\t.,'!sTaétßΣσ1́ x日<|>\x1c\x85\u00a0\u2003", max_size=40))
def test_ranks_equal_the_vocabulary_on_any_text(text):
    assert ByteEncoder.shared(tokenizer_path(BYTES))(text).tolist() == whole_one(text)


def whole_one(text, made={}):
    from tokenizers import Tokenizer
    t = made.setdefault("t", None) or made.update(t=Tokenizer.from_file(tokenizer_path(BYTES))) or made["t"]
    return t.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'!sTaétßΣσ1́ x", max_size=30), max_size=5))
def test_units_equal_whole_texts_on_any_text(texts):
    for name, space, lower in ((BYTES, True, False), (WORDS, False, True)):
        encoder = UnitEncoder.shared(tokenizer_path(name), space, lower)
        assert [np.frombuffer(g, "<u4").tolist() for g in map(encoder, texts)] == whole(name, texts)


def test_sum_of_squares_fits_and_is_near_the_lower_bound():
    lengths = np.sort(np.random.default_rng(3).integers(1, 1025, 4000))[::-1]
    where, offset = packing.sum_of_squares(lengths, 1024)
    used = np.bincount(where, lengths)
    assert used.max() <= 1024 and len(used) <= 1.03 * lengths.sum() / 1024
    for s in range(0, len(used), 97):
        own = sorted((o, n) for o, n in zip(offset[where == s], lengths[where == s]))
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]]


def test_sum_of_squares_takes_the_smallest_change():
    # Two gaps of 4 are open: each 4 closes one of them.
    where, _ = packing.sum_of_squares(np.array([6, 6, 4, 4]), 10)
    assert np.bincount(where, [6, 6, 4, 4]).tolist() == [10, 10]


def test_packing_covers_every_document(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, tokenizer_path(BYTES)).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    ids = [i + [2] for i in whole(BYTES, [d.text or "" for d in docs])]
    want = sorted((d.doc_id if d.doc_id is not None else -1, zlib.crc32(np.array(i[s:e], "<u4").tobytes()), s, e - s)
                  for d, i in zip(docs, ids)
                  for s, e in ([(0, len(i))] if len(i) <= 1024 else
                               [(max(0, e - 1024), e) for e in range(len(i) % 1024 or 1024, len(i) + 1, 1024)]))
    assert want == sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32, r.start, r.length) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(no_docs, tokenizer_path(BYTES)).collect() == []


def test_equal_rows_spread_over_buckets_and_tasks(spark):
    docs = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = packing.token_pieces(docs, tokenizer_path(BYTES)).select("doc_id", "piece", "start", "length",
                                                                   F.crc32("ids").alias("ids_crc32"))
    sizes = Counter(r.sequence_id >> 32 for r in packing.pack(rows, bucket_rows=500).collect())
    assert len(sizes) == 8 and max(sizes.values()) < 1000
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # the table is too small for several tasks otherwise
    spark.conf.set(coalesce, "false")
    try:
        manifest = dac.write_ids(docs.repartition(4), new_folder(spark, "dac"), tokenizer_path(WORDS), shard_ids=500)
    finally:
        spark.conf.set(coalesce, "true")
    tasks = [r["n"] for r in manifest.groupBy("partition").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(tasks) == 4000 and len(tasks) >= 4 and max(tasks) < 2500


def test_codes_give_any_id_and_run():
    ids = np.random.default_rng(1).choice([0, 1, 255, 256, 49406, 65536, 2**31], 5000).astype("<u4")
    file = dac.DacFile(b"".join(dac.pack_file([5, None, 9], [2000, 0, 3000], ids)))
    assert [file.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    for a, b in ((0, 5000), (0, 0), (511, 513), (512, 1024), (4999, 5000), (17, 3001)):
        assert file.span(a, b).tolist() == ids[a:b].tolist()
    assert file.document(2).tolist() == ids[2000:].tolist() and file.nulls.tolist() == [0, 1, 0]


def test_files_round_trip(spark, odd_docs, no_docs):
    folder = new_folder(spark, "dac")
    manifest = dac.write_ids(odd_docs, folder, tokenizer_path(WORDS), shard_ids=20_000)
    got = dac.read_documents(manifest, folder).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    ids = [i + [1] for i in whole(WORDS, [d.text or "" for d in docs])]
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(
        (d.doc_id or -1, i) for d, i in zip(docs, ids))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d.doc_id for d in docs), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert dac.write_ids(no_docs, new_folder(spark, "dac"), tokenizer_path(WORDS)).isEmpty()


def greedy(pieces, text):
    n = at = 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab▁", min_size=1, max_size=5), max_size=12), st.text("ab▁", max_size=14))
def test_automaton_equals_greedy(pieces, text):
    assert wordpiece.LongestMatch(pieces).count(text) == greedy(pieces, text)


def test_word_piece_counts(spark, odd_docs, no_docs):
    import sentencepiece
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    for r, d in zip(wordpiece.count_tokens(odd_docs, path).collect(), odd_docs.select("doc_id", "text").collect()):
        n = [greedy(pieces, "▁" + w) if len(w) < 1000 else None for w in (d.text or "").split()]
        assert (r.doc_id, r.n_words) == (d.doc_id, len(n))
        if None not in n:
            assert (r.n_tokens, r.n_unknown) == (sum(max(1, k) if k != -1 else 1 for k in n), n.count(-1))
    assert wordpiece.count_tokens(no_docs, path).collect() == []
