"""Quality ranking, the backoff automaton, personal data and tool calls."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import lm, pii, quality, toolcalls

SMALL = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op4_bradley_terry_quality(spark, SMALL)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    for truth in (0, 1):
        own = [r.predicted for r in held if r.quality == truth]
        assert own and own.count(truth) >= 0.9 * len(own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit_quality(docs, labels), quality.fit_quality(docs, turned)
    assert np.array_equal(one.weights, two.weights) and one.shift == two.shift


def test_pairwise_weights_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, quality.N_FEATURES))
    good = x[:, 3] - x[:, 5] > 0.2
    model = quality.BradleyTerry(pairs=5000).fit(x, good)
    raw = ((x - model.mean) / model.scale) @ model.weights
    assert raw[good].min() > np.quantile(raw[~good], 0.95)
    assert model.threshold_quantile(x) == pytest.approx((~good).mean(), abs=0.05)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (8, 0), (9, None), (None, 1), (1, 1)],
                                   "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, labels)
    rows = quality.score_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    kept = quality.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    nothing = quality.fit_quality(odd_docs, labels.where("false"))
    assert {r.score for r in quality.score_documents(odd_docs, nothing).collect()} == {0.5}
    assert quality.score_documents(no_docs, model).collect() == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def brute_scores(rows, mu, order=2):
    train = [i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    texts = [(i, words(t)) for i, t in rows]
    counts = Counter(tuple(t[k - n: k]) for i, t in texts if i in train for n in range(1, order + 1)
                     for k in range(n, len(t) + 1))
    one = {g: c for g, c in counts.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)

    def p(gram):
        if len(gram) == 1:
            return (counts[gram] + 0.1) / (n + 0.1 * (v + 1))
        return (counts[gram] + mu * p(gram[1:])) / (counts[gram[:-1]] + mu)

    return [(i, len(t), sum(counts[w,] > 0 for w in t), n, sum(math.log10(p((w,))) for w in t),
             sum(math.log10(p(tuple(t[max(0, k - order): k]))) for k in range(1, len(t) + 1))) for i, t in texts]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_automaton_equals_brute_force(spark, odd_docs, no_docs, order):
    again = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d", "b c d", "x a b c", "a b", "c d a b c d"] * 5, 100)],
                                  "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(again)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score_documents(docs, mu=7.0, block_tokens=500, shard_tokens=9000, order=order).collect()
    want = brute_scores(rows, 7.0, order)
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    assert lm.score_documents(no_docs, order=order).collect() == []
    untrained = lm.score_documents(odd_docs.where("doc_id is null"), order=order).collect()
    assert [(r.train_tokens, r.n_known, r.base_score, r.held_out) for r in untrained] == [(0, 0, 0.0, True)]


def test_arcs_of_a_state_and_its_failure_sum_to_one():
    tokens = np.array([0, 1, 2, 0, 1, 1, 0, 1, 2])
    root = np.log10(np.bincount(tokens) / len(tokens))
    pairs, two = np.unique(tokens[:-1] * 3 + tokens[1:], return_inverse=True)
    machine = lm.Automaton(tokens, root, {1: tokens, 2: np.append(-1, two)}, {1: np.bincount(tokens[:-1]), 2: np.bincount(two)}, 5.0)
    for h in range(3):
        arcs = {int(p) % 3: 10 ** machine.arc[2][k] for k, p in enumerate(pairs) if p // 3 == h}
        rest = 10 ** machine.failure[1][h] * sum(10 ** root[w] for w in range(3) if w not in arcs)
        assert sum(arcs.values()) + rest == pytest.approx(1)


def test_longer_grams_beat_shorter_ones_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    total = lambda rows: rows.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    three, two = total(lm.op9_backoff_automaton(spark, SMALL)), total(lm.score_documents(docs, order=2))
    assert three[1] > two[1] > two[0]


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                    "card": 16 <= len(d) <= 19 and plain_luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = ["a@b.c d@e f@g.h@i.j k@@l.m x.y+z%q@w-v.u.t. @a.b c@.d", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 1.2.3 .9.9.9.9",
         "4539 1488 0343 6467, 4539148803436467 4539148803436468 45391488-0343-6467 0 1-2 3", "+1 (319) 555-5132 ext",
         "+1+2 345 678 90 +12345678 +1((((.. +49.30.123456-", "é@ü.de ünï a@b.cé", "1" * 500, "+" * 50 + "1 2", "a" * 99 + "@b",
         "reach bob [at] example [dot] com or 319-555-5132 and (319) 555-5132", ""]


def test_base_spans_equal_plain_patterns(spark):
    for text in TEXTS + [" ".join(TEXTS)]:
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)[0]] == plain_base(text)


def test_long_runs_stay_linear():
    import time
    began = time.time()
    for c in ("1", "a", "@", "1.", "+", "+1", "(", "1 ", "a@", "a.", "[at]", ":", "1:"):
        pii.base_spans(c * 100_000)
        pii.generated_spans(c * 100_000)
    assert time.time() - began < 20


def test_finder_adds_spans_and_keeps_base_ones(spark, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    finder = pii.fit_finder(docs)
    assert finder.thresholds
    text = "please call 319-555-5132 or write to bob [at] example [dot] com, host 10.20.30.40 here"
    base, every = finder(text)
    assert [pii.KINDS[k] for k, _, _ in base] == ["ip"] and set(base) < set(every)
    assert "555-5132" not in pii.redact_text(text, every) and "[IP]" in pii.redact_text(text, every)
    # Numbers that only look alike stay.
    assert finder("order 12345, total 99.50, version 1.2.3, in 2024-10-11")[1] == []
    # Documents without any candidate are left alone.
    clean = docs.where(~F.col("text").rlike(r"[0-9@]")).limit(50)
    assert {r.spans for r in pii.find_spans(clean, finder).collect()} == {""}
    assert pii.fit_finder(no_docs).thresholds == {}


def test_chosen_spans_never_overlap():
    class Even:
        def __call__(self, x):
            return np.linspace(0.6, 0.9, len(x))

    finder = pii.Finder(Even(), {k: 0.5 for k in range(4)})
    inside = "-".join(f"1.2.3.{k}" for k in range(9)) + "-319-555-5132@b.co"  # many base spans within one e-mail
    many = " ".join(f"319-555-{k:04d} 4539 148803 {k:05d} +1 (319) 555-5132" for k in range(3000))
    for text in (inside, many, inside + " " + many):
        base, every = finder(text)
        added = sorted(set(every) - set(base), key=lambda s: s[1])
        assert set(base) <= set(every) and all(a[2] <= b[1] for a, b in zip(added, added[1:]))
        assert all(e <= s or end <= a for _, a, e in added[:50] for _, s, end in base)
    assert len(finder(many)[1]) > len(finder(many)[0])


def test_spans_of_odd_rows(spark, odd_docs, no_docs):
    finder = pii.Finder()
    got = pii.find_spans(odd_docs, finder).collect()
    assert len(got) == odd_docs.count()
    assert {r.base for r in got if r.doc_id in (3, 4, 5)} == {""}
    rows = odd_docs.withColumn("text", F.when(F.col("doc_id") == 6, "mail a@b.co now").otherwise(F.col("text")))
    back = pii.redact(rows, finder)
    assert back.columns == rows.columns
    assert {r.doc_id: r.text for r in back.collect()}[6] == "mail [EMAIL] now"
    assert sorted(map(str, back.where("doc_id <> 6").collect())) == sorted(map(str, odd_docs.where("doc_id <> 6").collect()))
    assert pii.find_spans(no_docs, finder).collect() == [] and pii.redact(no_docs, finder).collect() == []


def test_cards_beside_digits_and_long_addresses(spark):
    finder = pii.fit_finder(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    one, two = "4111 1111 1111 1111", "5500 0000 0000 0004"
    for text, hidden in ((f"please pay by card {one} 123 today", [one]), (f"my cards are {one} {two} for you", [one, two]),
                         (f"my card is {one}-2024 as of now", [one]),
                         ("the host is 2001:db8:85a3:8d3:1319:8a2e:370:7348 now", ["2001:db8:85a3:8d3:1319:8a2e:370:7348"])):
        clean = pii.redact_text(text, finder(text)[1])
        assert not any(h in clean for h in hidden), (text, clean)
    many = "+" + " ".join(["4111"] * 20_000)
    assert len(pii.runs_within(many, pii.base_spans(many)[1])) <= 40_000


def test_finder_does_not_depend_on_ids_or_density(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    whole = pii.fit_finder(texts).thresholds
    assert whole
    assert pii.fit_finder(texts.withColumn("doc_id", F.col("doc_id") * 2)).thresholds == whole
    assert pii.fit_finder(texts.withColumn("doc_id", F.lit(None).cast("long"))).thresholds == whole
    clean = spark.range(20_000).select((F.col("id") + 10**9).alias("doc_id"), F.concat(F.lit("plain words "), "id").alias("text"))
    assert pii.fit_finder(texts.unionByName(clean)).thresholds == whole


def test_finder_learns_from_every_document(spark):
    """More documents than any sample held: first score, trees and thresholds are those of all their candidates."""
    texts = [f"call +49 30 {k:05d} {k % 7} or mail user{k}@example{k % 9}.com" + (f" and +1 {k}" if k % 3 else f" of 300.{k % 400}.1.1")
             for k in range(1500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string").repartition(5)
    rows = [(r.h >> 20 & 1 == 0, *row) for r in docs.select("text").distinct().select(F.xxhash64("text").alias("h"), "text").collect()
            for row in pii.training_rows(r.text, r.h % (1 << 32))]
    train = np.array([r[0] for r in rows])
    x, y, kind = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    finder = pii.fit_finder(docs)
    share = y[train].mean()
    assert finder.trees.start == pytest.approx(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[:-1], method="lower")) for c in x[train].T]
    assert all(np.array_equal(a, b) for a, b in zip(edges, finder.trees.edges, strict=True))
    plain = pii.BoostedTrees()
    plain.edges = edges
    bins = plain.bins(x)
    plain.fit(edges, share, lambda tree, nodes: plain.sums(bins[train], y[train], np.ones(train.sum(), np.int64), tree, nodes))
    assert plain.trees == finder.trees.trees and np.array_equal(plain.raw(x), plain.raw(bins, "bin"))
    scores, want = plain(x), {}
    for k in range(4):
        own = ~train & (kind == k)
        fine = [s for s in set(scores[own]) if y[own & (scores >= s)].mean() >= 0.98]
        if fine:
            want[k] = max(0.5, min(fine))
    assert want and finder.thresholds == pytest.approx(want)


def test_pii_digest_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in pii.op10_candidate_boosting(spark, SMALL).collect():
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in base) <= set(r.spans.split(","))


CALL = "conv_id long, call_id string, turn long, name string, arguments map<string,string>, uses array<string>, level int"
RESULT = "conv_id long, call_id string, turn long, content string, status string"


def test_tool_calls(spark):
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "note", "string", False),
                                     ("say", "t", "string", True)], "name string, argument string, type string, required boolean")
    calls = [
        (1, "a", 1, "add", {"x": "1"}, None, 9), (1, "b", 1, "add", {"x": "2", "note": '"é\\n"'}, ["a"], 9),
        (1, "c", 1, "say", {"t": '"hi"'}, ["b", "a"], 9), (1, "c", 1, "say", {"t": '"hi"'}, ["b", "a"], 9),
        (1, "d", 2, "add", {"x": '"1"'}, ["a"], 9), (1, "e", 2, "add", {}, [], 9), (1, "f", 2, "add", {"x": "1", "q": "1"}, [], 9),
        (1, "g", 2, "none", None, [], 9), (1, "h", 2, "say", {"t": '"x"'}, ["zz"], 9), (1, "i", 2, "say", {"t": '"x"'}, ["j"], 9),
        (1, "j", 3, "say", {"t": '"x"'}, ["k"], 9), (1, "k", 3, "say", {"t": '"x"'}, ["j"], 9), (1, "l", 3, "say", {"t": '"x"'}, ["k"], 9),
        (2, "a", 1, "say", {"t": '"x"'}, [], 9), (2, "a", 4, "say", {"t": '"y"'}, [], 9), (2, "m", 5, "say", {"t": '"x"'}, [], 9),
        (None, "a", 1, "say", {"t": '"x"'}, [], 9), (2, None, 1, "say", {"t": '"x"'}, [], 9)]
    results = [(1, "a", 1, "3", "s"), (1, "b", 2, "late", "s"), (1, "b", 1, "first \"q\"", "s"), (1, "c", 2, None, "s"),
               (1, "c", 2, None, "s"), (9, "a", 1, "other", "s"), (None, "a", 1, "x", "s")]
    got = toolcalls.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), schemas).collect()
    assert len(got) == 19
    orphans = sorted((str(r.conv_id), r.call_id, r.turn, r.level, r.more_results, r.record) for r in got if r.status == "no_call")
    assert orphans == [("9", "a", 1, None, 0, '{"arguments":null,"id":"a","name":null,"result":"other"}'),
                       ("None", "a", 1, None, 0, '{"arguments":null,"id":"a","name":null,"result":"x"}')]
    got = [r for r in got if r.status != "no_call"]
    one = {r.call_id: r for r in got if r.conv_id == 1}
    assert {k: r.status for k, r in one.items()} == {
        "a": "linked", "b": "linked", "c": "linked", "d": "invalid", "e": "invalid", "f": "invalid", "g": "invalid",
        "h": "bad_reference", "i": "bad_reference", "j": "cycle", "k": "cycle", "l": "blocked"}
    assert [one[k].level for k in "abc"] == [0, 1, 2]
    assert one["b"].more_results == 1 and one["c"].more_results == 0
    assert one["b"].record == '{"arguments":{"note":"é\\n","x":2},"id":"b","name":"add","result":"first \\"q\\""}'
    for r in got:
        if r.record is not None:
            assert json.dumps(json.loads(r.record), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.record
    two = sorted((str(r.call_id), r.status) for r in got if r.conv_id == 2)
    assert two == [("None", "no_id"), ("a", "duplicate_id"), ("a", "duplicate_id"), ("m", "unanswered")]
    none = spark.createDataFrame([], CALL)
    assert toolcalls.link_calls(none, spark.createDataFrame(results, RESULT).where("false"), schemas).collect() == []
    assert {r.status for r in toolcalls.link_calls(none, spark.createDataFrame(results, RESULT), schemas).collect()} == {"no_call"}


def test_nested_arguments_are_canonical(spark):
    schemas = spark.createDataFrame([("f", "o", "object", True), ("f", "l", "array", False)],
                                    "name string, argument string, type string, required boolean")
    long = json.dumps({"z": "word " * 200_000, "a": 1})
    calls = [(1, "a", 1, "f", {"o": '{"b": 1, "a":{"d" : [1, {"y":2,"x":null}], "c":"\u00e9 \\n"}}', "l": "[ 1,2 ]"}, [], 9),
             (1, "b", 1, "f", {"o": "[1]"}, [], 9), (1, "c", 1, "f", {"o": "{broken"}, [], 9), (1, "d", 1, "f", {"o": "{}", "l": "3"}, [], 9),
             (1, "e", 1, "f", {"o": long}, [], 9), (1, "g", 1, "f", {"o": '{"b":1,"a":2}'}, ["h"], 9),
             (1, "h", 1, "f", {"o": "{}"}, ["i"], 9), (1, "i", 1, "f", {"o": "{}"}, ["h"], 9), (1, "j", 1, "f", {"o": "{}"}, ["g"], 9)]
    got = {r.call_id: r for r in toolcalls.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT),
                                                      schemas).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "a": "unanswered", "b": "invalid", "c": "invalid", "d": "invalid", "e": "unanswered", "g": "blocked", "h": "cycle",
        "i": "cycle", "j": "blocked"}
    for k in "abdegh":
        shape = json.dumps(json.loads(got[k].record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert shape == got[k].record
    assert '"o":{"a":{"c":"é \\n","d":[1,{"x":null,"y":2}]},"b":1}' in got["a"].record


def test_every_status_occurs_in_the_query(spark):
    got = toolcalls.op2_tool_call_linking(spark, SMALL).groupBy("status").count().collect()
    assert {r.status for r in got} >= {"linked", "unanswered", "cycle", "blocked", "bad_reference", "invalid"}


def test_turns_of_a_hot_conversation(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"text {k}", "x") for k in range(400)]
    turns += [(2, 0, "system", None, "x"), (2, 1, "user", "", "x"), (3, None, "user", "lost", "x"), (None, 0, "user", "x", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, level string")
    calls, results = toolcalls.turns_as_calls(df)
    schemas = spark.createDataFrame(toolcalls.REPLY_SCHEMAS, "name string, argument string, type string, required boolean")
    got = toolcalls.link_calls(calls, results, schemas).collect()
    assert sum(r.status == "linked" for r in got if r.conv_id == 1) == 200
    assert {r.call_id: r.status for r in got if r.conv_id == 2} == {
        "0": "unanswered", "1": "unanswered", "0n": "cycle", "0c": "blocked", "1n": "cycle", "1c": "blocked"}
    assert {r.status for r in got if r.conv_id is None} == {"no_id"}
