"""The toxicity grammar: clauses by hand, held-out labels, odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import toxicity as tox

LARGE = "/root/testdata/sf0.1"
LEXICON = tox.Lexicon({"idiot": "3", "silly": "1"}, {"scumb": "2"})


def by_hand(clause):
    """A clause's score by the rules as they are written, word by word."""
    words = tox.TOKEN.findall(clause.lower())
    symbols = [LEXICON[w] for w in words]
    total, quoted, told, last = 0.0, False, False, None
    for k, s in enumerate(symbols):
        if s == "r":
            told, quoted = True, False
        elif s == "q":
            told, quoted = False, not quoted
        if s in "123h":
            negated, reported = "n" in symbols[max(0, k - 3):k], told or quoted
            aimed = "t" in symbols[max(0, k - 4):k]
            factor = (tox.NEGATED if negated else 1) * (tox.REPORTED if reported else 1)
            if s != "h" or aimed:
                total += tox.WEIGHT[s] * factor * (tox.AIMED if aimed else 1)
            last = (k, s) if factor == 1 and not aimed else None
        elif s == "t" and last and k - last[0] <= 3:
            total += tox.AIMED_AFTER if last[1] != "h" else tox.WEIGHT["h"]
            last = None
    return total


@pytest.mark.parametrize("clause", [
    "an idiot", "you are an idiot", "you are not an idiot", "he said you are an idiot", "the silly word \"idiot\" is silly",
    "idiot you are", "we will kill you", "kill the process", "you kill", "never kill you", "not at all a big idiot",
    "you one two three four idiot", "idiot one two three you", "silly idiot you", "scumbags", "SCUMBAG he wrote idiot",
    "nothing here", "they said not one idiot said you", "« silly » idiot"])
def test_machine_equals_the_rules(clause):
    scanner = tox.Scanner(LEXICON)
    symbols = "".join(LEXICON[w] for w in tox.TOKEN.findall(clause.lower()))
    assert scanner.clause(symbols) == pytest.approx(by_hand(clause))


def test_machine_on_random_clauses():
    rng = np.random.default_rng(2)
    scanner, words = tox.Scanner(LEXICON), ["idiot", "silly", "not", "said", "\"", "you", "kill", "tree", "scumbag"]
    for _ in range(2000):
        clause = " ".join(rng.choice(words, rng.integers(1, 12)))
        symbols = "".join(LEXICON[w] for w in tox.TOKEN.findall(clause))
        assert scanner.clause(symbols) == pytest.approx(by_hand(clause)), clause


def test_composition_adds_weights_and_passes_symbols():
    one, two = tox.Transducer(0), tox.Transducer(0)
    one.arc(0, "a", "b", 1.0, 1)
    two.arc(0, "b", "c", 0.5, 0)
    both = one.then(two, "ab")
    assert both.step(both.start, "a") == ("c", 1.5, (1, 0)) and both.step((1, 0), "a") == ("a", 0.0, (1, 0))


def test_clauses_count_matches_only():
    scanner = tox.Scanner(LEXICON)
    scores, words, different = scanner.clauses("A tree. You idiot! Scumbag, silly;\nkill the tree")
    assert len(scores) == 2 and words == 9 and different == 4


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = tox.op11_toxicity_grammar(spark, LARGE).join(labels.where("toxic is not null"), "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = ([r.predicted for r in held if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_learns_from_training_labels_only(spark):
    small = LARGE.replace("0.1", "0.01")
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = tox.fit_toxicity(docs, labels), tox.fit_toxicity(docs, turned)
    assert one.lexicon.words == two.lexicon.words and one.lexicon.starts == two.lexicon.starts
    assert np.array_equal(one.weights, two.weights)


def test_learned_stem_of_compounds(spark):
    rng = np.random.default_rng(0)
    syllables = ["ba", "ko", "ti", "mu", "re", "sal", "don", "fi"]

    def word():
        return "".join(rng.choice(syllables, rng.integers(2, 4)))

    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(40)]
        if k % 4 == 0:
            words[5] = "grumf" + word()
            words[20] = "Grumf" + word()
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit_toxicity(docs, marks)
    assert any(s.startswith("grum") for s in model.lexicon.starts)
    new = spark.createDataFrame([(1, "tree grumfnever seen before"), (2, "tree never seen before"), (3, "")], docs.schema)
    got = {r.doc_id: r.predicted for r in tox.score_documents(new, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (8, 0), (9, None), (None, 1), (1, 1), (3, 1)],
                                   "doc_id long, toxic int")
    model = tox.fit_toxicity(odd_docs, labels)
    rows = tox.score_documents(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert not [r for r in rows if r.doc_id is None and r.held_out]
    none = tox.fit_toxicity(odd_docs, labels.where("false"))
    assert {(r.score, r.predicted) for r in tox.score_documents(odd_docs, none).collect()} == {(0.0, 0)}
    assert tox.score_documents(no_docs, model).collect() == [] and tox.fit_toxicity(no_docs, labels).weights is None


def test_long_text_is_read_whole():
    scanner = tox.Scanner(LEXICON)
    text = "tree " * 300_000 + "idiot"
    assert scanner.clauses(text)[0] == [3.5] and not re.search("idiot", text[:-5])
