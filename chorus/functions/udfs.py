"""The few Arrow-batched Python functions (Spark has no built-in for them).

* ``unescape_nfkc`` -- HTML entity decoding followed by NFKC normalisation.
* ``packed``, ``title_bitmaps``, ``block_bounds`` -- what the bounds of a pair of texts need of each.

Each works on one Arrow batch at a time inside an executor task; Spark
partitions and shuffles the rows.  Callers only route rows that need the
Python step (see ``needs_decoding``); all other rows pass NULL and skip it.
"""

from __future__ import annotations

import html
import unicodedata
import zlib
from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType

from chorus.functions.text import col, needs_decoding


def _decode_one(s):
    if s is None:
        return None
    if "&" in s:
        s = html.unescape(s)
    return unicodedata.normalize("NFKC", s)


@pandas_udf(StringType())
def _unescape_nfkc(s: pd.Series) -> pd.Series:
    return s.map(_decode_one, na_action="ignore")


def unescape_nfkc(c) -> Column:
    """``NFKC(html.unescape(text))``; the Python step runs only where it can matter.

    A Python UDF inside ``when`` is still evaluated for every row, so rows that
    cannot change are sent as NULL and take their own value back.
    """
    x = col(c)
    return F.coalesce(_unescape_nfkc(F.when(needs_decoding(x), x)), x)


def similarity(a_content: str, b_content: str, a_title: str, b_title: str) -> float:
    """Pair similarity on normalised texts; argument order (new, accepted) matters."""
    if not a_content or not b_content:
        return 0.0
    sim = SequenceMatcher(None, a_content, b_content).ratio()
    if a_title and b_title:
        sim = sim * 0.8 + SequenceMatcher(None, a_title, b_title).ratio() * 0.2
    return sim


def gram_counts(text: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct q-grams of a text as numbers, sorted, and how often each occurs."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = points[: max(0, len(points) - q + 1)].copy()
    # Up to three characters fit a number; longer grams are hashed, where equal ones stay equal.
    factor = np.uint64(0x110000 if q <= 3 else 0x100000001B3)
    for k in range(1, q):
        grams = grams * factor + points[k: len(points) - q + 1 + k]
    return np.unique(grams, return_counts=True)


def qgrams_allow(a: str, b: str, need: float, memo: dict | None = None) -> bool:
    """Whether the texts share enough q-grams for a ratio of ``need``; never False for a pair that reaches it.

    A ratio of ``need`` has M >= need * (la + lb) / 2 matched characters and u = la + lb - 2 M others.  Matched blocks are
    separated by at least one other character, so there are at most u + 1, and a block of length L holds L - q + 1
    common q-grams: at least M - (q - 1) (u + 1) are common, counted with repeats.  For q = 1 this is the bound of
    ``quick_ratio``; longer grams ask for fewer but rarer ones.  There are at most ``most_blocks(b)`` blocks, too, which
    lets long grams of long texts count.
    """
    memo = {} if memo is None else memo
    total = len(a) + len(b)
    matched = need * total / 2
    if ("blocks", b) not in memo:
        memo["blocks", b] = most_blocks(b)
    blocks = min(total - 2 * matched + 1, memo["blocks", b])
    for q in (1, 2, 3, 6, 12, 24):
        common = matched - (q - 1) * blocks
        if common <= 0:
            return True
        for text in (a, b):
            if (text, q) not in memo:
                memo[text, q] = gram_counts(text, q)
        (ga, na), (gb, nb) = memo[a, q], memo[b, q]
        if not len(ga) or not len(gb):
            return False
        at = np.minimum(np.searchsorted(gb, ga), len(gb) - 1)
        if np.minimum(na, nb[at])[gb[at] == ga].sum() < common - 1e-6:
            return False
    return True


def subsequence_allows(a: str, b: str, need: float, memo: dict | None = None) -> bool:
    """Whether the longest common subsequence allows a ratio of ``need``; never False for a pair that reaches it, as matched
    blocks lie in the same order in both texts.

    One row of the table at a time, a bit per character of ``a``: a cleared bit is where the row steps up.  The walk
    ends as soon as too many characters of ``b`` have found no place.
    """
    memo = {} if memo is None else memo
    if ("bits", a) not in memo:
        places: dict[str, int] = {}
        for k, c in enumerate(a):
            places[c] = places.get(c, 0) | 1 << k
        memo["bits", a] = places
    places, full = memo["bits", a], (1 << len(a)) - 1
    least = need * (len(a) + len(b)) / 2 - 1e-6
    row, spare = full, len(b) - least
    for k, c in enumerate(b, 1):
        hit = row & places.get(c, 0)
        row = (row + hit) | (row - hit)
        if k % 128 == 0 and k - len(a) + (row & full).bit_count() > spare:
            return False
    return len(a) - (row & full).bit_count() >= least


#: Cells of a sketch: (q, cells) of the content's q-grams, and of the title's characters.
SKETCH, TITLE_SKETCH = ((1, 32), (2, 128), (3, 512)), ((1, 32), (2, 64))
SKETCH_CELLS = sum(n for _, n in SKETCH + TITLE_SKETCH)


def sketch(content: str, title: str) -> bytes | None:
    """Counts of a text's q-grams by hash cell: what two texts have in common is at most the sum of the smaller counts.

    None if a count is beyond its 16 bits; such texts have no bound.
    """
    parts = []
    for text, layout in ((content, SKETCH), (title, TITLE_SKETCH)):
        for q, cells in layout:
            grams, n = gram_counts(text, q)
            cell = (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(cells)
            parts.append(np.bincount(cell.astype(np.int64), weights=n, minlength=cells))
    counts = np.concatenate(parts)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) < 1 << 16 else None


@pandas_udf(BinaryType())
def sketches(content: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([sketch(c, t) for c, t in zip(content, title)], dtype=object)


def _room(data: pd.Series) -> np.ndarray:
    full = np.full(SKETCH_CELLS, (1 << 16) - 1, "<u2").tobytes()
    rows = [full if d is None else bytes(d) for d in data]
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, SKETCH_CELLS)


def sketches_fit(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray, ta: np.ndarray, tb: np.ndarray,
                 threshold: float, blocks: np.ndarray | float = np.inf) -> np.ndarray:
    """Whether sketches of two texts (with the lengths of contents and titles) let them reach ``threshold``; never false for
    a pair that does.  The arithmetic is that of ``qgrams_allow``, on cells instead of q-grams; ``blocks``: a further bound
    of the number of matched blocks (``most_blocks``)."""
    common = np.minimum(x, y)
    total, titles = (la + lb).astype(float), (ta + tb).astype(float)
    both = (ta > 0) & (tb > 0)
    # c common q-grams: c >= M - (q - 1) (T - 2 M + 1) bounds the M matched characters of the T of both titles.
    at, matched = sum(n for _, n in SKETCH), np.full(len(x), np.inf)
    for q, cells in TITLE_SKETCH:
        matched = np.minimum(matched, (common[:, at: at + cells].sum(1, dtype=np.int64) + (q - 1) * (titles + 1)) / (2 * q - 1))
        at += cells
    title = np.minimum(1.0, 2 * matched / np.maximum(titles, 1))
    need = np.where(both, (threshold - 0.2 * title) / 0.8, threshold) - 1e-9
    fits, at = need <= 1 + 1e-9, 0
    for q, cells in SKETCH:
        least = need * total / 2 - (q - 1) * np.minimum((1 - need) * total + 1, blocks)
        fits &= common[:, at: at + cells].sum(1, dtype=np.int64) >= least - 1e-6
        at += cells
    return fits


def sketches_allow(threshold: float):
    """Arrow UDF: ``sketches_fit`` of two columns of sketches."""
    @pandas_udf(BooleanType())
    def f(a: pd.Series, b: pd.Series, la: pd.Series, lb: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        lengths = [c.to_numpy() for c in (la, lb, ta, tb)]
        return pd.Series(sketches_fit(_room(a), _room(b), *lengths, threshold))
    return f


#: ``difflib`` starts no match at characters that make up over 1 % of a later argument of at least this length.
AUTOJUNK = 200
#: A text's bitmap: which cells its q-grams fall into.
BITS_Q, BITS = 6, 8192


def most_blocks(text: str) -> int:
    """The most matched blocks that ``difflib`` can find in any text against this one, given as its second argument.

    From ``AUTOJUNK`` characters on, a match starts at a character that is not popular in this text and grows to both
    sides; only a common beginning needs none.  So each block but one holds a place of an unpopular character.
    """
    if len(text) < AUTOJUNK:
        return 1 << 31
    n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
    return int(n[n <= len(text) // 100 + 1].sum()) + 1


@pandas_udf(LongType())
def block_bounds(content: pd.Series) -> pd.Series:
    return content.map(most_blocks).astype("int64")


def gram_bits(text: str) -> bytes:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = points[: max(0, len(points) - BITS_Q + 1)].copy()
    for k in range(1, BITS_Q):
        grams = grams * np.uint64(0x100000001B3) + points[k: len(points) - BITS_Q + 1 + k]
    bits = np.zeros(BITS, bool)
    bits[((grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


@pandas_udf(BinaryType())
def bitmaps(content: pd.Series) -> pd.Series:
    return pd.Series([gram_bits(c) for c in content], dtype=object)


def bitmaps_fit(x: np.ndarray, y: np.ndarray, la: np.ndarray, lb: np.ndarray, need: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Whether bitmaps (rows of 64-bit words) of two texts allow a ratio of ``need`` with at most ``blocks`` matched blocks;
    never false for a pair that reaches it.

    At least c = M - (q - 1) blocks of the q-grams are common, so at most l - q + 1 - c of a text are not; each cell
    that only one text has holds such a q-gram.
    """
    total = (la + lb).astype(float)
    matched = (need - 1e-9) * total / 2
    common = matched - (BITS_Q - 1) * np.minimum(total - 2 * matched + 1, blocks)
    fits = np.ones(len(x), bool)
    for p, q, length in ((x, y, la), (y, x, lb)):
        own = np.bitwise_count(p & ~q).sum(1, dtype=np.int64)
        fits &= (common <= 0) | (own <= length - BITS_Q + 1 - common + 1e-6)
    return fits


#: Cells of a title's bitmap: which of them its characters, numbered by their occurrences, fall into.
TITLE_BITS = 128


def char_bits(title: str) -> bytes:
    points = np.sort(np.frombuffer(title.encode("utf-32-le"), np.uint32)).astype(np.uint64)
    bits = np.zeros(TITLE_BITS, bool)
    if len(points):
        new = np.append(True, points[1:] != points[:-1])
        nth = np.arange(len(points)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        number = points * np.uint64(0x100000001B3) + nth.astype(np.uint64)
        bits[((number * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(TITLE_BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


@pandas_udf(BinaryType())
def title_bitmaps(title: pd.Series) -> pd.Series:
    return pd.Series([char_bits(t) for t in title], dtype=object)


def bitmap_words(length: np.ndarray) -> np.ndarray:
    """64-bit words of the folded bitmap of a text of this length: four cells a character, in a power of two, up to ``BITS``."""
    return np.select([length <= 256, length <= 512, length <= 1024], [16, 32, 64], BITS // 64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of so many words: a cell is set where any of the cells it stands for is."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


@pandas_udf(BinaryType())
def packed(sketch: pd.Series, bits: pd.Series, length: pd.Series) -> pd.Series:
    """Sketch (or nothing) and folded bitmap of a text in one compressed value, see ``unpacked``."""
    words = bitmap_words(length.to_numpy())
    return pd.Series([zlib.compress((s or b"") + folded(np.frombuffer(b, np.uint64)[None], w).tobytes(), 1)
                      for s, b, w in zip(sketch, bits, words)], dtype=object)


def unpacked(data: list[bytes], words: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The sketches of ``packed`` values, and for each number of words the bitmaps of the values that have it, in order."""
    raw = [zlib.decompress(d) for d in data]
    bits = {int(w): b"".join(r[-8 * w:] for r, own in zip(raw, words) if own == w) for w in np.unique(words)}
    room = _room([r[:-8 * w] or None for r, w in zip(raw, words)])
    return room, {w: np.frombuffer(b, np.uint64).reshape(-1, w) for w, b in bits.items()}


def size_classes(percent: int, most: int) -> list[int]:
    """The least sizes of classes up to one above ``most``: sets of a Jaccard similarity of ``percent`` are in one class or
    in neighbouring ones."""
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * 100 // percent + 1)
    return least


def part_hashes(percent: int):
    """Arrow UDF: hashes of the parts of a set (of distinct 64-bit hashes) of which two sets of at least ``percent`` Jaccard
    similarity have one in common.

    A set of n elements and one of at most as many more as the similarity allows differ in at most
    n (100 - percent) / percent elements: with one part more, one part holds none of them.  The number of parts is that
    of the smaller set's size class, so a set has the parts of its own class and of the class below.
    """
    @pandas_udf(ArrayType(LongType()))
    def f(sets: pd.Series) -> pd.Series:
        least = size_classes(percent, max((len(s) for s in sets), default=0))
        out = []
        for s in sets:
            h = np.asarray(s, np.int64).view(np.uint64)
            own = int(np.searchsorted(least, len(h), side="right")) - 1
            keys = []
            for c in range(max(own - 1, 0), own + 1):
                parts = (least[c + 1] - 1) * (100 - percent) // percent + 1
                sums = np.zeros(parts, np.uint64)
                np.add.at(sums, ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), h * np.uint64(0x9E3779B97F4A7C15))
                sums ^= (np.arange(parts) + (c << 32)).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                keys.append((sums ^ sums >> np.uint64(29)).view(np.int64))
            out.append(np.concatenate(keys))
        return pd.Series(out, dtype=object)
    return f


def _same(a: str, i: int, ahi: int, b: str, j: int, bhi: int) -> int:
    """How many characters of a[i:ahi] and b[j:bhi] agree from the start."""
    most, n, step = min(ahi - i, bhi - j), 0, 16
    while n < most and a[i + n: i + min(n + step, most)] == b[j + n: j + min(n + step, most)]:
        n, step = min(n + step, most), 2 * step
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def starts(b: str) -> dict[str, list[int]]:
    """Places of each character at which ``difflib`` starts a match with its second argument ``b``: popular ones start none."""
    places: dict[str, list[int]] = {}
    for k, c in enumerate(b):
        places.setdefault(c, []).append(k)
    if len(b) >= AUTOJUNK:
        most = len(b) // 100 + 1
        places = {c: p for c, p in places.items() if len(p) <= most}
    return places


def ratio_at_least(a: str, b: str, need: float, memo: dict | None = None) -> float:
    """``SequenceMatcher(None, a, b).ratio()``, or 0.0 as soon as the matched blocks and the room that is left are too small for
    ``need``.

    The blocks are those of ``find_longest_match``: the longest run of characters that start matches, the first in ``a``, then
    in ``b``, grown to both sides; it only looks at the places of ``a`` that hold such characters.
    """
    memo = {} if memo is None else memo
    if ("starts", b) not in memo:
        memo["starts", b] = starts(b)
    places, total = memo["starts", b], len(a) + len(b)
    at = [k for k, c in enumerate(a) if c in places]
    matched, room, open_ranges = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while open_ranges:
        alo, ahi, blo, bhi = open_ranges.pop()
        room -= min(ahi - alo, bhi - blo)
        i, j, k = alo, blo, 0
        runs: dict[int, int] = {}
        first, end = bisect_left(at, alo), bisect_left(at, ahi)
        for n in range(first, end):
            x = at[n]
            there = places[a[x]]
            before, runs = runs if n > first and at[n - 1] == x - 1 else {}, {}
            if not before and (n + 1 == end or at[n + 1] != x + 1):
                # A run of one: it counts only where none is known.
                if not k and (y := bisect_left(there, blo)) < len(there) and there[y] < bhi:
                    i, j, k = x, there[y], 1
                continue
            for y in there[bisect_left(there, blo):]:
                if y >= bhi:
                    break
                size = runs[y] = before.get(y - 1, 0) + 1
                if size > k:
                    i, j, k = x - size + 1, y - size + 1, size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        k += _same(a, i + k, ahi, b, j + k, bhi)
        if k:
            matched += k
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    room += min(part[1] - part[0], part[3] - part[2])
                    open_ranges.append(part)
        if 2.0 * (matched + room) / total < need:
            return 0.0
    return 2.0 * matched / total


def similarity_at_least(a_content, b_content, a_title, b_title, threshold: float, memo: dict | None = None) -> float:
    """``similarity`` when it can reach ``threshold``, else 0.0.

    Titles are short, so their ratio comes first: it fixes what the contents must
    reach, often more than 1.  The q-gram and subsequence bounds then spare most pairs the quadratic matcher.
    """
    if not a_content or not b_content:
        return 0.0
    title, need = 0.0, threshold
    both_titles = bool(a_title) and bool(b_title)
    if both_titles:
        title = SequenceMatcher(None, a_title, b_title).ratio()
        need = (threshold - 0.2 * title) / 0.8
    if need > 1 + 1e-9:
        return 0.0
    memo = {} if memo is None else memo
    if ("blocks", b_content) not in memo:
        memo["blocks", b_content] = most_blocks(b_content)
    # Where few characters start a match, the blocks are found faster than any bound.
    if 4 * memo["blocks", b_content] > len(b_content) and not (
            qgrams_allow(a_content, b_content, need - 1e-9, memo) and subsequence_allows(a_content, b_content, need - 1e-9, memo)):
        return 0.0
    sim = ratio_at_least(a_content, b_content, need - 1e-9, memo)
    return sim * 0.8 + title * 0.2 if both_titles else sim
