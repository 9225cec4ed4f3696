"""PII: candidate gradient boosting.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers; they always stay.  High-recall
generators propose further spans, which may overlap: spelled-out e-mail addresses, phone numbers without a country
code, shorter card numbers, IPv6 addresses, what the base rules matched and dropped, and within that the runs of
whole digit groups with 13 to 19 digits that pass the Luhn test (a card with more digits beside it).  Boosted trees score
each candidate by its format and context, and a threshold per kind, calibrated for precision, selects redactions.

Trees are trained on all documents that have base matches, equal texts once, whatever their ids.  Spark gathers what a tree
needs: the quantiles of each feature, then for each level of a tree the sums of gradients by node, feature and bin, over the
distinct rows of bins with their counts.  The sums are whole numbers, so no order of rows changes a tree.
Its labels come from the base rules: matches that pass are positive, also in the other formats (their address spelled
out, their number without the country code or grouped otherwise, an IPv6 address for an IPv4 one, in the same context,
cards also with digits beside them); matches that fail, passing ones with digits changed until they fail, and other runs
of groups around a card are negative.  A bit of the text's hash tells whether a document
trains or calibrates: a kind's threshold is the lowest score at which at least ``precision`` of the candidates are positive; a
kind without such a score gets none, and a log line says so.  Every document is searched in full.

Scanning is linear in the length of a text: patterns start only at '@', '+', brackets or the start of digits, and
repetitions are possessive or bounded.

Defined cases: null and empty texts have no spans; rows with a null id are searched; repeated rows give equal rows;
an empty table gives an empty result; ``redact`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
import logging
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorus.llm.common import stage, table

LOG = logging.getLogger(__name__)
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Generators.
SPELLED_AT = re.compile(r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?")
SPELLED_REST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?|\.)[A-Za-z0-9-]{1,63}){1,6}")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
SHORT_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,15})(?![0-9])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
GROUP = re.compile(r"[0-9]+")
CUES = ("mail", "contact", "write", "phone", "tel", "call", "fax", "mobile", "card", "visa", "credit", "pay", "ip",
        "host", "server", "address")
NUMBERS = ("id", "no", "isbn", "version", "order", "total", "token", "key", "hash", "sha")
Span = tuple[int, int, int]  # kind, start, end


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def passes(kind: int, text: str) -> bool:
    """The base rules' test of a match."""
    if kind == 1:
        return all(map(small, text.split(".")))
    if kind == 2:
        d = digits_of(text)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 8 <= len(digits_of(text)) <= 15
    return True


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(matches that pass, matches that fail), by kind, then start."""
    good: list[Span] = []
    bad: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        # All matches with this '@' start within the run of local characters before it.
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            good.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            (good if passes(kind, m.group()) else bad).append((kind, m.start(), m.end()))
    return good, bad


def card_runs(text: str, start: int, end: int) -> list[Span]:
    """Runs of whole digit groups between two places that have 13 to 19 digits and pass the Luhn test."""
    found: list[Span] = []
    for run in DIGIT_RUN.finditer(text, start, end):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        for k, (first, _) in enumerate(groups):
            n = 0
            for begin, stop in groups[k:k + 19]:
                n += stop - begin
                if n > 19:
                    break
                if n >= 13 and luhn(digits_of(text[first:stop])):
                    found.append((2, first, stop))
    return found


def runs_within(text: str, dropped: list[Span]) -> list[Span]:
    """The card runs inside dropped card and phone matches, but not those matches themselves."""
    found = [r for kind, s, e in dropped if kind in (2, 3) for r in card_runs(text, s, e)]
    return [r for r in dict.fromkeys(found) if r not in set(dropped)] if found else found


def generated_spans(text: str) -> list[Span]:
    """What the generators propose beyond the base rules' matches."""
    found: list[Span] = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        for m in SPELLED_AT.finditer(text):
            start = m.start()
            while start > max(0, m.start() - 64) and text[start - 1] in LOCAL:
                start -= 1
            rest = SPELLED_REST.match(text, m.end())
            if rest and start < m.start():
                found.append((0, start, rest.end()))
    found += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    found += [(2, m.start(), m.end()) for m in SHORT_CARD.finditer(text)]
    if text.count(":") >= 7:
        found += [(1, m.start(), m.end()) for m in IPV6.finditer(text)]
    return found


def span_features(kind: int, span: str, before: str, after: str) -> list[float]:
    """Format of a span and of up to 40 characters on either side."""
    d = digits_of(span)
    groups = re.findall(r"[0-9]+", span)
    marks = {c for c in span if not c.isalnum()}
    left, right = before[-1:], after[:1]
    words = re.findall(r"[a-z]+", before.lower()[-24:])
    parts = span.split(".")
    return [
        *(float(kind == k) for k in range(4)), len(span), len(d), len(set(d)) / max(1, len(d)), len(groups),
        max(map(len, groups), default=0), min(map(len, groups), default=0), len(marks),
        float(bool(d) and luhn(d)), float(d[:1] in ("3", "4", "5", "6")), float(span.startswith("+")),
        float("(" in span), float("@" in span), float(":" in span), len(parts),
        float(len(parts) == 4 and all(p.isdigit() and small(p) for p in parts)),
        float(span[-3:].isalpha() or span[-2:].isalpha()), float(13 <= len(d) <= 19), float(7 <= len(d) <= 15),
        float(left.isalnum()), float(right.isalnum()), float(left in "./-_=#$") if left else 0.0,
        float(right in "./-_=%") if right else 0.0, float(left.isspace() or not left),
        float(right.isspace() or right in ".,;:!?)" or not right),
        float(any(w.startswith(CUES) for w in words)), float(any(w.startswith(NUMBERS) for w in words)),
        sum(c in "0123456789" for c in before + after) / 80,
    ]


def features_at(text: str, span: Span, instead: str | None = None) -> list[float]:
    kind, start, end = span
    return span_features(kind, text[start:end] if instead is None else instead,
                         text[max(0, start - 40):start], text[end:end + 40])


def other_formats(kind: int, span: str) -> list[str]:
    """A positive span as it is also written."""
    if kind == 0:
        local, _, domain = span.partition("@")
        return [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}"]
    if kind == 1:
        h = hashlib.md5(span.encode()).hexdigest()
        groups = [h[k:k + 4] for k in range(0, 32, 4)]
        return [":".join(groups), ":".join(g.lstrip("0") or "0" for g in ["2001", "0db8", *groups[2:5], "0000", *groups[6:]])]
    d = digits_of(span)
    if kind == 2:
        return [" ".join(d[k:k + 4] for k in range(0, len(d), 4)), "-".join(d[k:k + 4] for k in range(0, len(d), 4))]
    if kind == 3 and len(d) >= 10:
        return [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"]
    return []


def spoiled(kind: int, span: str, rng: np.random.Generator) -> list[str]:
    """Spans of the same look that the rules drop."""
    if kind == 1:
        parts = span.split(".")
        return [".".join(str(int(rng.integers(256, 999))) if k == int(rng.integers(4)) or k == 2 else p
                         for k, p in enumerate(parts)),
                ":".join(f"{int(n):02d}" for n in rng.integers(0, 60, 8))]
    if kind == 2:
        return [span[:-1] + str((int(span[-1]) + int(rng.integers(1, 10))) % 10),
                "".join(map(str, rng.integers(0, 10, 14)))]
    if kind == 3:
        return ["-".join(["".join(map(str, rng.integers(0, 10, k))) for k in (4, 4, 4)]), digits_of(span)[:6]]
    return []


#: Whole numbers that stand for one in sums of gradients.
UNIT = 1 << 24


class BoostedTrees:
    """Gradient boosting on the logistic loss: depth-limited trees, splits at quantiles, Newton leaves.

    A row is known by its bins: the number of cuts (``edges``, by feature) below each value.
    """

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, cuts: int = 16, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.cuts, self.penalty = rounds, depth, rate, cuts, penalty
        self.trees: list[dict | float] = []
        self.edges: list[np.ndarray] = []
        self.start = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(cuts, c) for cuts, c in zip(self.edges, x.T)], np.uint8).T

    def sums(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray, open_tree: dict | float, nodes: int) -> np.ndarray:
        """Gradients, second derivatives and rows by open node, feature and bin; each of the rows counts ``n`` times."""
        node = self._leaf(open_tree, bins, "bin").astype(np.int64)
        p = 1 / (1 + np.exp(-self.raw(bins, "bin")))
        inside = node >= 0
        bins, node, width = bins[inside], node[inside], self.cuts + 1
        parts = [np.rint(v[inside] * UNIT).astype(np.int64) * n[inside] for v in (p - y, p * (1 - p))] + [n[inside]]
        out = np.zeros((3, nodes, bins.shape[1], width), np.int64)
        for f in range(bins.shape[1]):
            at = node * width + bins[:, f]
            for k, part in enumerate(parts):
                out[k, :, f] += np.bincount(at, part, nodes * width).astype(np.int64).reshape(nodes, width)
        return out

    def _split(self, sums: np.ndarray) -> dict | float:
        """The best split of a node, or its leaf, from its sums by feature and bin."""
        g, h = sums[0] / UNIT, sums[1] / UNIT
        whole_g, whole_h = g[0].sum(), h[0].sum()
        leaf = float(-whole_g / (whole_h + self.penalty))
        if sums[2, 0].sum() < 8:
            return leaf
        best, gain = None, 1e-6
        whole = whole_g ** 2 / (whole_h + self.penalty)
        for f, cuts in enumerate(self.edges):
            gl, hl = np.cumsum(g[f])[:len(cuts)], np.cumsum(h[f])[:len(cuts)]
            if not len(gl):
                continue
            got = gl ** 2 / (hl + self.penalty) + (whole_g - gl) ** 2 / (whole_h - hl + self.penalty) - whole
            k = int(got.argmax())
            if got[k] > gain:
                best, gain = (f, k), float(got[k])
        if best is None:
            return leaf
        f, k = best
        return {"f": f, "bin": k, "cut": float(self.edges[f][k]), "leaves": [
            float(-s[0] / (s[1] + self.penalty)) for s in ((g[f, :k + 1].sum(), h[f, :k + 1].sum()), (g[f, k + 1:].sum(), h[f, k + 1:].sum()))]}

    def fit(self, edges: list[np.ndarray], share: float, measure: Callable[[dict | float, int], np.ndarray]) -> BoostedTrees:
        """``share``: of positive rows.  ``measure`` gives the ``sums`` over all rows for a tree whose leaves number the open
        nodes (-1: no open node) and how many there are."""
        self.edges = edges
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            tree: dict = {"root": 0.0}
            open_nodes: list[tuple[dict, str]] = [(tree, "root")]
            for level in range(self.depth):
                sums = measure(self._numbered(tree["root"], open_nodes), len(open_nodes))
                places, open_nodes = open_nodes, []
                for k, (node, side) in enumerate(places):
                    node[side] = found = self._split(sums[:, k])
                    if isinstance(found, dict):
                        found["low"], found["high"] = found.pop("leaves")
                        open_nodes += [(found, "low"), (found, "high")]
                if not open_nodes:
                    break
            self.trees.append(tree["root"])
        return self

    def _numbered(self, tree: dict | float, open_nodes: list[tuple[dict, str]]) -> dict | float:
        """The tree with the numbers of its open nodes as leaves."""
        number = {(id(node), side): float(k) for k, (node, side) in enumerate(open_nodes)}

        def walk(part: dict | float) -> dict | float:
            return {**part, **{side: walk(part[side]) if isinstance(part[side], dict) else number.get((id(part), side), -1.0)
                               for side in ("low", "high")}}
        return walk(tree) if isinstance(tree, dict) else 0.0

    def _leaf(self, tree: dict | float, x: np.ndarray, by: str = "cut") -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        low = x[:, tree["f"]] <= tree[by]
        out = np.empty(len(x))
        out[low], out[~low] = self._leaf(tree["low"], x[low], by), self._leaf(tree["high"], x[~low], by)
        return out

    def raw(self, x: np.ndarray, by: str = "cut") -> np.ndarray:
        raw = np.full(len(x), self.start)
        for tree in self.trees:
            raw += self.rate * self._leaf(tree, x, by)
        return raw

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


class Finder:
    """Trees and thresholds; finds all spans of a text."""

    def __init__(self, trees: BoostedTrees | None = None, thresholds: dict[int, float] | None = None) -> None:
        self.trees, self.thresholds = trees, thresholds or {}

    def __call__(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind, then start."""
        base, dropped = base_spans(text)
        more = generated_spans(text) + dropped + runs_within(text, dropped) if self.thresholds else []
        if not more:
            return base, base
        taken = sorted((s, e) for _, s, e in base)
        free = []
        starts = [s for s, _ in taken]
        reach = list(accumulate((e for _, e in taken), max))
        for span in more:
            k = bisect_left(starts, span[2])  # base spans that start before the candidate ends
            if (k == 0 or reach[k - 1] <= span[1]) and span[0] in self.thresholds:
                free.append(span)
        if not free:
            return base, base
        scores = self.trees(np.array([features_at(text, s) for s in free]))
        chosen: list[Span] = []
        held: list[tuple[int, int]] = []  # places of the chosen spans, in order: they do not overlap
        for k in np.lexsort(([s[1] for s in free], -scores)):
            kind, start, end = free[k]
            at = bisect_left(held, (start, end))
            if (scores[k] >= self.thresholds[kind] and (at == 0 or held[at - 1][1] <= start)
                    and (at == len(held) or end <= held[at][0])):
                held.insert(at, (start, end))
                chosen.append(free[k])
        return base, sorted(base + chosen)


def beside_digits(text: str, span: Span, rng: np.random.Generator) -> list[tuple[list[float], int, int]]:
    """Labelled candidates of a card with further digits beside it, and of a run without a card."""
    card, before, after = text[span[1]:span[2]], text[max(0, span[1] - 40):span[1]], text[span[2]:span[2] + 40]
    rows = []

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def another(shown: str) -> str:
        """A different card, written the same way."""
        d = digits_of(shown)
        d = d[0] + digits(len(d) - 2)
        new = iter(next(d + c for c in "0123456789" if luhn(d + c)))
        return "".join(next(new) if c in "0123456789" else c for c in shown)

    for shown in (card, *other_formats(2, card)):
        next_card = another(shown)
        for left, right in (("", f" {digits(3)}"), ("", f"-{digits(4)}"), (f"{digits(4)} ", ""), (f"{next_card} ", ""),
                            ("", f" {next_card}")):
            whole, at = before + left + shown + right + after, len(before) + len(left)
            rows.append((features_at(whole, (2, at, at + len(shown))), 1, 2))
            cards = {(2, m.start(), m.end()) for c in (shown, next_card) for m in re.finditer(re.escape(c), whole)}
            place = (len(before), len(before) + len(left) + len(shown) + len(right))
            rows += [(features_at(whole, r), 0, 2) for r in card_runs(whole, *place) if r not in cards]
            if not passes(2, whole[place[0]:place[1]]):
                rows.append((features_at(whole, (2, *place)), 0, 2))
    noise = " ".join(digits(int(n)) for n in rng.integers(1, 8, 8))
    whole = before + noise + after
    return rows + [(features_at(whole, r), 0, 2) for r in card_runs(whole, len(before), len(before) + len(noise))]


def training_rows(text: str, seed: int) -> list[tuple[list[float], int, int]]:
    """(features, label, kind) of a document's labelled candidates."""
    rng = np.random.default_rng(seed)
    good, bad = base_spans(text)
    rows = []
    for span in good:
        shown = text[span[1]:span[2]]
        rows.append((features_at(text, span), 1, span[0]))
        rows += [(features_at(text, span, s), 1, span[0]) for s in other_formats(span[0], shown)]
        rows += [(features_at(text, span, s), 0, span[0]) for s in spoiled(span[0], shown, rng)]
        if span[0] == 2:
            rows += beside_digits(text, span, rng)
    return rows + [(features_at(text, span), 0, span[0]) for span in bad]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    """A column of equally long binary values as rows of bytes."""
    values = t.column(column).to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def candidates(docs: DataFrame) -> DataFrame:
    """(x, y, kind, train) of the labelled candidates of every distinct text that has base matches."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(base_spans(t)) for t in batch.column(0).to_pylist()], pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["x", "y", "kind", "train"]
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = training_rows(text, h % (1 << 32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32()),
                     pa.array([r[2] for r in rows], pa.int32()), pa.array([h >> 20 & 1 == 0] * len(rows), pa.bool_())], names=names)

    texts = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(matched, "text string").distinct()
    return texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "x array<double>, y int, kind int, train boolean")


def quantiles(rows: DataFrame, n: int, cuts: int) -> list[np.ndarray]:
    """The distinct lower quantiles of each feature of ``n`` rows of ``x``, from 0 in ``cuts`` steps."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            x = np.array(t.column(0).to_pylist())
            for f, column in enumerate(x.T if len(x) else ()):
                v, count = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(v), pa.int32()), pa.array(v), pa.array(count, pa.int64())],
                                                 names=["f", "v", "n"])

    places = sorted({int(q * (n - 1)) for q in np.linspace(0, 1, cuts + 1)[:-1]})
    counted = rows.select("x").mapInArrow(values, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("f").orderBy("v"))
    holds = F.exists(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
    found: dict[int, list[float]] = {}
    for r in counted.withColumn("upto", upto).where(holds).select("f", "v").collect():
        found.setdefault(r.f, []).append(r.v)
    return [np.array(sorted(found[f])) for f in sorted(found)]


def fit_trees(binned: DataFrame, trees: BoostedTrees, share: float) -> BoostedTrees:
    """Boosting over all rows of (bins, y, n): each task adds up its sums, the driver those of the tasks."""
    # At most twice as many tasks as cores: each gives one set of sums.
    binned = binned.coalesce(2 * binned.sparkSession.sparkContext.defaultParallelism)

    def measure(open_tree: dict | float, nodes: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for t in _chunks(batches):
                if t.num_rows:
                    part = trees.sums(_matrix(t, "bins"), t.column("y").to_numpy(), t.column("n").to_numpy(), open_tree, nodes)
                    total = part if total is None else total + part
            yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["sums"])

        parts = [np.frombuffer(r.sums, np.int64) for r in binned.mapInArrow(run, "sums binary").collect()]
        return sum(parts).reshape(3, nodes, -1, trees.cuts + 1)

    edges = trees.edges
    return trees.fit(edges, share, measure)


def thresholds_of(binned: DataFrame, trees: BoostedTrees, precision: float) -> dict[int, float]:
    """For each kind the lowest score at which at least ``precision`` of the rows of (bins, y, kind, n) are positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            raw = trees.raw(_matrix(t, "bins"), "bin") if t.num_rows else np.empty(0)
            good = pc.multiply(t.column("n"), t.column("y").cast(pa.int64()))
            yield from pa.table({"kind": t.column("kind"), "raw": raw, "good": good, "n": t.column("n")}).to_batches()

    scored = binned.mapInArrow(run, "kind int, raw double, good long, n long").groupBy("kind", "raw").agg(
        F.sum("good").alias("good"), F.sum("n").alias("n"))
    part = F.least(F.greatest(F.floor(F.col("raw") * 32), F.lit(-1024)), F.lit(1024)).cast("int")
    scored = stage(scored.withColumn("part", part), "pii-scores")
    # Running totals from the highest score down: those of the parts before, then within a part.
    before, above, of = [], (0, 0), None
    for r in sorted(scored.groupBy("kind", "part").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect(),
                    key=lambda r: (r.kind, -r.part)):
        if r.kind != of:
            above, of = (0, 0), r.kind
        before.append((r.kind, r.part, *above))
        above = above[0] + r.good, above[1] + r.n
    if not before:
        return {}
    offsets = binned.sparkSession.createDataFrame(before, "kind int, part int, good_above long, n_above long")
    down = Window.partitionBy("kind", "part").orderBy(F.col("raw").desc())
    good, n = F.sum("good").over(down) + F.col("good_above"), F.sum("n").over(down) + F.col("n_above")
    fine = scored.join(F.broadcast(offsets), ["kind", "part"]).withColumn("fine", good >= F.lit(precision) * n).where("fine")
    return {r.kind: max(0.5, float(1 / (1 + np.exp(-r.raw)))) for r in fine.groupBy("kind").agg(F.min("raw").alias("raw")).collect()}


def fit_finder(docs: DataFrame, precision: float = 0.98) -> Finder:
    """Train and calibrate on every document that has base matches."""
    rows = stage(candidates(docs), "pii-candidates")
    there = {(r.train, r.y): r["count"] for r in rows.groupBy("train", "y").count().collect()}
    if not there:
        LOG.warning("no document has a base match: no candidate is added")
        return Finder()
    if len({t for t, _ in there}) < 2 or not there.get((True, 0)) or not there.get((True, 1)):
        LOG.warning("documents with base matches are too few to train and calibrate: no candidate is added")
        return Finder()
    trees, n = BoostedTrees(), there[True, 0] + there[True, 1]
    trees.edges = quantiles(rows.where("train"), n, trees.cuts)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            coded = trees.bins(np.array(t.column("x").to_pylist())) if t.num_rows else ()
            codes = pa.array([c.tobytes() for c in coded], pa.binary())
            yield from pa.table({"bins": codes, **{c: t.column(c) for c in ("y", "kind", "train")}}).to_batches()

    binned = stage(rows.mapInArrow(bins, "bins binary, y int, kind int, train boolean")
                   .groupBy("bins", "y", "kind", "train").agg(F.count(F.lit(1)).alias("n")), "pii-bins")
    fit_trees(binned.where("train").select("bins", "y", "n"), trees, there[True, 1] / n)
    thresholds = thresholds_of(binned.where(~F.col("train")), trees, precision)
    for k, name in enumerate(KINDS):
        if k not in thresholds:
            LOG.warning("no threshold for kind %s: none of its candidates is added", name)
    return Finder(trees, thresholds)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame, finder: Finder) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): base spans counted and listed, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [finder(t) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([joined(base) for base, _ in found], pa.string()),
                 pa.array([joined(every) for _, every in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def redact_text(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones by that of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, finder: Finder) -> DataFrame:
    """The documents with their spans replaced in ``text`` (null stays null); other columns as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact_text(t, finder(t)[1]) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, fit_finder(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
