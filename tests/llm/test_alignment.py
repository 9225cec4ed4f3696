"""Token alignment against whole-text encoding and plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chorus.llm import alignment
from chorus.llm.common import BYTE_OF, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


class Plain:
    """The definition, on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(BYTE_OF[c] for c in self.a.id_to_token(t)) for t in a]
        bytes_b = [bytes([int(self.b.id_to_piece(t)[3:5], 16)]) if self.b.is_byte(t)
                   else self.b.id_to_piece(t).replace("▁", " ").encode() for t in b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out

    def table(self, texts):
        found = [self.groups(t) for t in texts]
        counts = Counter(p for g in found for p in {(x, y) for a, b in g for x in a for y in b})
        top = defaultdict(int)
        for (x, _), n in counts.items():
            top[x] = max(top[x], n)
        rows = []
        for g in found:
            pairs = [(x, y) for a, b in g for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs),
                         sum(counts[p] == top[p[0]] for p in pairs), sum(counts[p] for p in pairs),
                         hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
plain = Plain()
encoder = alignment.Encoder(*PATHS)


def aligner(*texts):
    """(A ids, groups as text) of each text, aligned together."""
    a, b = zip(*map(encoder, texts))
    sizes = [np.array([len(x) // 2 for x in side]) for side in (a, b)]
    ids = [np.frombuffer(b"".join(side), "<u2") for side in (a, b)]
    return list(zip(a, alignment.group_texts(*ids, encoder.tokens, *sizes)))


def same(rows, docs):
    expected = plain.table([d.text for d in docs])
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    got = sorted([(r.doc_id, *(r[c] for c in COLUMNS)) for r in rows], key=key)
    assert got == sorted([(d.doc_id, *e) for d, e in zip(docs, expected)], key=key)


def test_query_equals_plain_counting(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    docs = [d for d in docs if len(d.text) < 6000]  # the plain form is quadratic
    frame = spark.createDataFrame([(d.doc_id, d.text) for d in docs], "doc_id long, text string").repartition(5)
    same(alignment.align_documents(frame, *PATHS).collect(), docs)
    assert alignment.op12_pair_hash_alignment(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_rounds_give_the_same(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    one = alignment.align_documents(docs, *PATHS).collect()
    many = alignment.align_documents(docs, *PATHS, round_pairs=500).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = alignment.align_documents(odd_docs, *PATHS).collect()
    assert len(rows) == odd_docs.count()
    short = odd_docs.where("length(text) < 1000 or text is null")
    same(alignment.align_documents(short, *PATHS).collect(), short.collect())
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in empty] == [(0, 0, "")] * 2
    assert alignment.align_documents(no_docs, *PATHS).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t  ab.Zé日x<s>|▁ 　\x1c'0١")), max_size=24)
       | st.text(max_size=12))
def test_units_equal_whole_texts(text):
    (_, _), (a, groups), _ = aligner("before", text, "after")
    expected = plain.groups(text)
    assert groups.decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in expected)
    assert np.frombuffer(a, "<u2").tolist() == [t for x, _ in expected for t in x]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "a  <s> b </s>", "<0x41> <unk>", "a▁b", " lead", "trail ", "  ", "\n\n x"])
def test_special_strings_are_plain_text(text):
    groups = aligner(text)[0][1].decode()
    assert groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain.groups(text))


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 1 << 31, 50_000).astype(np.uint64))
    bucket = (alignment.spread(pairs) >> np.uint64(56)).astype(int)
    parts = []
    for k in np.unique(bucket):
        sizes, words, keys = alignment.perfect_hash(pairs[bucket == k])
        parts.append((int(k), sizes, words.tobytes(), keys.astype("<u4").tobytes()))
    table = alignment.PairTable(parts)
    at = table.index(pairs)
    assert sorted(at) == list(range(len(pairs))) and (table.keys[at] == pairs).all()
    assert table.words.nbytes * 8 < 5 * len(pairs)
    others = np.setdiff1d(rng.integers(0, 1 << 31, 5000).astype(np.uint64), pairs)
    assert (table.index(others) == -1).all()


def test_large_groups_are_counted_by_distinct_ids():
    t = encoder.tokens
    rng = np.random.default_rng(1)
    a, b = rng.choice([300, 400, 500], 200).astype(np.uint16), rng.choice([1000, 2000], 150).astype(np.uint16)
    t2 = type("T", (), {"bits": t.bits, "length_a": np.full(60000, 3), "length_b": np.full(40000, 4)})
    keys, counts = alignment.links(a, b, t2, np.array([0]))
    alignment_small, alignment.LARGE_GROUP = alignment.LARGE_GROUP, 2
    try:
        again = alignment.links(a, b, t2, np.array([0]))
    finally:
        alignment.LARGE_GROUP = alignment_small
    assert counts.sum() == 200 // 4 * 12 and (again[0] == keys).all() and (again[1] == counts).all()
