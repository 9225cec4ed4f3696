"""Toxicity: a weighted finite-state grammar over clauses.

A text is cut into clauses, and words become symbols: insult of level 1 to 3, threat, target, negation, reporting verb,
quotation mark, or other.  Four transducers are composed into one machine that reads a clause once:

negation   marks insults and threats up to three words after a negation
report     marks those after a reporting verb or inside quotation marks, to the end of the clause
target     marks those up to four words after a target; a target up to three words after one adds a weight of its own
scoring    gives each marked symbol its weight: aimed ones more, negated and reported ones less, threats only if aimed

A clause's score is the weight of its path, and clauses without an insult or threat have none.  The insult transducer is a
trie whose accepting states are whole words and word beginnings with their weights (a word's is that of its longest
accepting state).  It is learned from labels: log odds of toxic against other documents, for entries whose share of toxic
documents has a binomial tail below ``chance``.  The other word lists are fixed.  A logistic curve over the clause scores
(fitted on halves of the sample, each scored with the other half's trie) gives the score of a document.

Labels are learned from at most ``sample`` toxic and ``sample`` other rows (by a hash of doc_id) and at most twice as many
documents of each kind; every whole text is scored.

Defined cases: null, empty and blank texts have no clauses and all get the same score; very long texts are scored whole, in
memory that follows the one text; repeated rows get equal scores; rows with a null doc_id are scored and count as not held
out; a doc_id with several labels counts as toxic if one says so; without labels of both classes there is no trie and every
score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import WordHashes, doc_bucket, finalise, hashed_sample, shingle_hashes, stage, table

# Fixed word lists of the grammar (English, German, French, Spanish).
NEGATIONS = """not no never none nobody neither nor without isn't aren't wasn't don't doesn't didn't won't can't
nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco""".split()
REPORTS = """said says wrote writes called calls quoted quotes reported reports claimed claims told tells asked
sagte sagt schrieb nannte behauptete dit disait écrit affirmé appelé dijo dice escribió llamó afirmó""".split()
TARGETS = """you your yours you're yourself he she they them him her these those people everyone
du dich dir dein deine ihr euch sie tu te toi ton ta vous votre eux ils tú tus usted ustedes vosotros ellos ellas""".split()
THREATS = """kill kills hurt destroy shoot stab murder strangle töten umbringen verprügeln erschießen
tuer frapper crever détruire matar golpear morir destruir""".split()

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n\"“”„«»]")
ENDS, QUOTES = ".!?;\n", "\"“”„«»"
INSULTS, THREAT = "123", "h"
LEVELS = (2.5, 4.0)  # log odds from which an entry is of level 2, of level 3
WEIGHT = {"1": 1.0, "2": 2.0, "3": 3.5, "h": 3.0}
AIMED, NEGATED, REPORTED, AIMED_AFTER = 1.25, 0.6, 0.7, 0.5
OUT = "doc_id long, held_out boolean, score double, predicted int"


class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (symbol out, weight, next state).  A symbol out is the symbol
    with the marks so far; symbols without an arc pass unchanged and leave the state as it is."""

    def __init__(self, start) -> None:
        self.start, self.arcs = start, {}

    def arc(self, state, symbol: str, out: str, weight: float, then) -> None:
        self.arcs[state, symbol] = out, weight, then

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (symbol, 0.0, state))

    def then(self, second: Transducer, alphabet: Iterable[str]) -> Transducer:
        """The composition: what this one puts out, ``second`` reads; weights add up."""
        out, todo, seen = Transducer((self.start, second.start)), [(self.start, second.start)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            for symbol in alphabet:
                middle, w1, one = self.step(pair[0], symbol)
                last, w2, two = second.step(pair[1], middle)
                out.arc(pair, symbol, last, w1 + w2, (one, two))
                todo.append((one, two))
        return out


def scope(opens: str, size: int, mark: str, symbols: Iterable[str]) -> Transducer:
    """Marks insults and threats up to ``size`` words after the symbol ``opens``."""
    t = Transducer(0)
    for left in range(size + 1):
        for s in symbols:
            hit = left and s[0] in INSULTS + THREAT
            t.arc(left, s, s + mark if hit else s, 0.0, size if s == opens else max(0, left - 1))
    return t


def reports(symbols: Iterable[str]) -> Transducer:
    """Marks insults and threats after a reporting verb and between quotation marks."""
    t = Transducer("plain")
    for state in ("plain", "told", "quoted"):
        for s in symbols:
            then = {"r": "told", "q": "plain" if state == "quoted" else "quoted"}.get(s, state)
            t.arc(state, s, s + "~" if state != "plain" and s[0] in INSULTS + THREAT else s, 0.0, then)
    return t


def scoring(symbols: Iterable[str], after: int = 3) -> Transducer:
    """Weights of marked symbols, and of a target that follows one."""
    t = Transducer((0, ""))
    for left in range(after + 1):
        for kind in ("", *INSULTS, THREAT):
            for s in symbols:
                weight, then = 0.0, (max(0, left - 1), kind if left > 1 else "")
                if s[0] in INSULTS + THREAT:
                    factor = (NEGATED if "-" in s else 1.0) * (REPORTED if "~" in s else 1.0)
                    if "+" in s or s[0] in INSULTS:
                        weight = WEIGHT[s[0]] * factor * (AIMED if "+" in s else 1.0)
                    then = (after, s[0]) if factor == 1.0 and "+" not in s else (0, "")
                elif s == "t" and left and kind:
                    weight, then = AIMED_AFTER if kind in INSULTS else WEIGHT[THREAT], (0, "")
                t.arc((left, kind), s, s, weight, then)
    return t


ALPHABET = [*"onrqt", THREAT, *INSULTS]


def grammar() -> tuple[list[dict[str, tuple[float, int]]], int]:
    """The composed machine as a table: state number to symbol to (weight, next state number); and the start's number."""
    def marked(symbols: Iterable[str], mark: str) -> list[str]:
        return [*symbols, *(s + mark for s in symbols if s[0] in INSULTS + THREAT)]

    one = marked(ALPHABET, "-")
    two = marked(one, "~")
    three = marked(two, "+")
    machine = scope("n", 3, "-", ALPHABET).then(reports(one), ALPHABET)
    machine = machine.then(scope("t", 4, "+", two), ALPHABET).then(scoring(three), ALPHABET)
    number = {}
    for state, _ in machine.arcs:
        number.setdefault(state, len(number))
    rows: list[dict[str, tuple[float, int]]] = [{} for _ in number]
    for (state, symbol), (_, weight, then) in machine.arcs.items():
        rows[number[state]][symbol] = weight, number[then]
    return rows, number[machine.start]


class Lexicon(dict):
    """Symbols of words, memoised: fixed lists, then the longest accepting state of the trie.  Emptied at ``room`` words."""

    def __init__(self, words: dict[str, str], starts: dict[str, str], room: int = 500_000) -> None:
        super().__init__()
        self.words, self.starts, self.room = words, starts, room
        self.longest = max(map(len, starts), default=0)
        self.fixed = {w: s for s, ws in (("n", NEGATIONS), ("r", REPORTS), ("t", TARGETS), ("h", THREATS)) for w in ws}
        self.fixed |= {c: "." for c in ENDS} | {c: "q" for c in QUOTES}

    def __missing__(self, word: str) -> str:
        symbol = self.words.get(word) or self.fixed.get(word) or next(
            (s for k in range(min(len(word), self.longest), 0, -1) if (s := self.starts.get(word[:k]))), "o")
        if len(word) <= 40:
            if len(self) >= self.room:
                self.clear()
            self[word] = symbol
        return symbol


class Scanner:
    """Clause scores of texts."""

    MATCH = re.compile(f"[{INSULTS}{THREAT}]")

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, (self.rows, self.start) = lexicon, grammar()
        self.known: dict[str, float] = {}

    def clause(self, symbols: str) -> float:
        """Weight of the machine's path over a clause."""
        total, state = 0.0, self.start
        for s in symbols:
            weight, state = self.rows[state][s]
            total += weight
        return total

    def clauses(self, text: str) -> tuple[list[float], int, int]:
        """(scores of the clauses with a match, number of words, number of different matched words)."""
        tokens = TOKEN.findall(text.lower())
        symbols = "".join(map(self.lexicon.__getitem__, tokens))
        words = len(symbols) - symbols.count(".") - symbols.count("q")
        if not self.MATCH.search(symbols):
            return [], words, 0
        got = [self.clause(c) for c in symbols.split(".") if self.MATCH.search(c)]
        return [g for g in got if g > 0], words, len({tokens[m.start()] for m in self.MATCH.finditer(symbols)})

    def features(self, text: str | None) -> list[float]:
        scores, words, different = self.clauses(text or "")
        total = sum(scores)
        if not total:
            return [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        size = log1p(words)
        return [1.0, log1p(total), max(scores), log1p(total) - 0.5 * size, total / (words + 20) ** 0.5, log1p(different)]


N_FEATURES = 6


def entries(text: str, shortest: int = 4, longest: int = 10) -> set[str]:
    """A text's distinct words, as ``=word``, and their beginnings."""
    words = {w for w in TOKEN.findall(text.lower()) if 2 < len(w) <= 40}
    found = {f"={w}" for w in words}
    for w in words:
        found.update(w[:k] for k in range(shortest, min(len(w), longest + 1)))
    return found


def log_tail(k: int, n: int, p: float) -> float:
    """An upper bound (first term over a geometric series) of log P(X >= k) for a binomial X, k above its mean."""
    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
    ratio = (n - k) / (k + 1) * p / (1 - p)
    return first - log(1 - ratio) if ratio < 1 else 0.0


def choose(counts: dict[str, tuple[int, int]], toxic: int, other: int, chance: float = 1e-7) -> Lexicon:
    """The trie of the entries whose (toxic, other) document counts part the classes."""
    share, found = toxic / (toxic + other), {}
    for entry, (a, b) in counts.items():
        if a < 3:
            continue
        odds = log((a + 0.1) / (toxic + 0.2)) - log((b + 0.1) / (other + 0.2))
        if odds >= 1.5 and log_tail(a, a + b, share) < log(chance):
            found[entry] = odds
    # A beginning that hardly adds toxic documents to those of one entry below it says nothing of its own.
    drop = set()
    for entry in found:
        bare = entry.lstrip("=")
        drop.update(bare[:k] for k in range(1, len(bare) + (entry != bare))
                    if bare[:k] in found and bare[:k] != entry and counts[entry][0] >= 0.97 * counts[bare[:k]][0])
    level = {e: str(1 + sum(odds >= x for x in LEVELS)) for e, odds in found.items() if e not in drop}
    return Lexicon({e[1:]: s for e, s in level.items() if e[0] == "="}, {e: s for e, s in level.items() if e[0] != "="})


class ToxicityModel:
    """The trie and the curve over clause scores."""

    def __init__(self, lexicon: Lexicon | None = None, weights: np.ndarray | None = None) -> None:
        self.lexicon, self.weights = lexicon, weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        raw = np.clip(np.hstack([np.ones((len(rows), 1)), rows]) @ self.weights, -40, 40)
        return 1 / (1 + np.exp(-raw))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights (the first is the constant) by Newton steps on the penalised logistic loss."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) / len(y) + keep @ w / len(y) ** 0.5
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + keep / len(y) ** 0.5 + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
    return w


def labelled(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """(half, toxic, text) of the bounded sample of labelled rows outside the held-out fold."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .where(doc_bucket("doc_id") % folds != 0)
              .groupBy("doc_id").agg((F.max("toxic") == 1).alias("is_toxic")))
    chosen = hashed_sample(marked.where("is_toxic"), sample).union(hashed_sample(marked.where("not is_toxic"), sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # Repeated doc_ids may bring more rows than ids: the bound holds for texts, too.
    keyed = rows.select("doc_id", "is_toxic", "text", F.xxhash64("text").alias("own"))
    kept = [keyed.where(F.col("is_toxic") == toxic).groupBy("own").agg(F.min("doc_id").alias("doc_id"))
            .orderBy(F.xxhash64("own"), "own").limit(2 * sample) for toxic in (True, False)]
    bounded = keyed.join(F.broadcast(kept[0].union(kept[1])), ["doc_id", "own"], "left_semi").dropDuplicates(["own", "is_toxic"])
    return one_of_copies(bounded.select("is_toxic", "text"))


def one_of_copies(rows: DataFrame, keys: int = 3) -> DataFrame:
    """(half, is_toxic, text) without most near copies, as the tails assume independent documents: of texts of a class with
    an equal smallest hash of word pairs, under any of ``keys`` hash functions, one stays."""
    seeds = np.random.default_rng(5).integers(0, 1 << 63, keys, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            least = []
            for text in batch.column(1):
                pairs = shingle_hashes(words(text.as_py().encode()), 2)
                least.append([int(finalise(pairs ^ s).min(initial=(1 << 64) - 1)) >> 1 for s in seeds])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.int64()))],
                                             names=["is_toxic", "text", "least"])

    rows = rows.mapInArrow(run, "is_toxic boolean, text string, least array<long>")
    kept = stage(rows.withColumn("own", F.xxhash64("text")), "toxicity-sample")
    narrow = kept.select("is_toxic", "least", "own")
    for k in range(keys):
        first = narrow.groupBy("is_toxic", F.col("least")[k].alias("key")).agg(F.min(F.struct("own", "least")).alias("one"))
        narrow = first.select("is_toxic", F.col("one.least").alias("least"), F.col("one.own").alias("own"))
    stays = narrow.select("is_toxic", "own")
    half = F.pmod(F.xxhash64("own"), F.lit(2)).cast("int").alias("half")
    return stage(kept.join(stays, ["is_toxic", "own"], "left_semi").select(half, "is_toxic", "text"), "toxicity-sample")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000, folds: int = 5, most: int = 20_000) -> ToxicityModel:
    """Fit outside the held-out fold (crc32(doc_id) mod folds = 0); at most ``most`` entries come to the driver."""
    rows = labelled(docs, labels, sample, folds)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Four counts a entry: half 0 and 1, other and toxic; a task adds up its documents before they are shuffled.
        names = ["entry", "n0", "n1", "n2", "n3"]
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*counts.values())) if counts else [()] * 4
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                              *(pa.array(c, pa.int64()) for c in columns)], names=names)
            counts.clear()
            return out

        for batch in batches:
            for half, toxic, text in zip(*(batch.column(k) for k in range(3))):
                cell = 2 * half.as_py() + toxic.as_py()
                for entry in (*entries(text.as_py()), ""):
                    if entry not in counts:
                        counts[entry] = [0, 0, 0, 0]
                    counts[entry][cell] += 1
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    sums = rows.mapInArrow(found, "entry string, n0 long, n1 long, n2 long, n3 long").groupBy("entry").agg(
        *(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    toxic, other = F.col("n1") + F.col("n3"), F.col("n0") + F.col("n2")
    whole = sums.where("entry = ''").union(
        sums.where("entry <> ''").where((toxic >= 3) & (toxic > other / 2)).orderBy(F.desc(toxic), other, "entry").limit(most))
    counts = {r.entry: (r.n0, r.n1, r.n2, r.n3) for r in whole.collect()}
    n = counts.pop("", (0, 0, 0, 0))
    if min(n[0] + n[2], n[1] + n[3]) == 0:
        return ToxicityModel()
    lexicon = choose({e: (c[1] + c[3], c[0] + c[2]) for e, c in counts.items()}, n[1] + n[3], n[0] + n[2])
    # Each half is scored with the trie of the other one, as new documents are.
    tries = [choose({e: (c[3 - 2 * h], c[2 - 2 * h]) for e, c in counts.items()}, n[3 - 2 * h], n[2 - 2 * h])
             if min(n[3 - 2 * h], n[2 - 2 * h]) else lexicon for h in (0, 1)]
    shared = rows.sparkSession.sparkContext.broadcast([(t.words, t.starts) for t in tries])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(Lexicon(*t)) for t in shared.value]
        for batch in batches:
            got = [scanners[h.as_py()].features(t.as_py()) for h, t in zip(batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.float64()))],
                                             names=["is_toxic", "features"])

    got = rows.mapInArrow(measured, "is_toxic boolean, features array<double>").groupBy("is_toxic", "features").count()
    got = got.orderBy("is_toxic", "features").collect()  # at most four times ``sample`` rows
    x = np.repeat(np.array([r.features for r in got]).reshape(-1, N_FEATURES), [r["count"] for r in got], axis=0)
    y = np.repeat(np.array([r.is_toxic for r in got], float), [r["count"] for r in got])
    return ToxicityModel(lexicon, logistic(x, y))


def score_documents(docs: DataFrame, model: ToxicityModel, folds: int = 5, accept: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    trie = (model.lexicon.words, model.lexicon.starts) if model.lexicon is not None else ({}, {})
    shared = docs.sparkSession.sparkContext.broadcast((trie, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, weights = shared.value
        scanner, model = Scanner(Lexicon(*trie)), ToxicityModel(None, weights)
        for batch in batches:
            rows = np.array([scanner.features(t.as_py()) for t in batch.column(2)]).reshape(-1, N_FEATURES)
            scores = model.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                                              pa.array((scores >= accept).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(doc_bucket("doc_id") % folds == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, OUT)


def op11_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
