"""Nearest neighbours, Jaccard join and containment search against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.llm import ann, containment, jaccard

NAN, INF = float("nan"), float("inf")


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        x = vectors[q]
        score = {i: float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)) for i, v in vectors.items() if i != q}
        out[q] = sorted(score.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
    return out


@pytest.mark.parametrize("bits", [64, 16])
def test_nearest_with_copies_and_bad_rows(spark, bits):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    vectors = {i: (centres[i % 20] + 0.3 * rng.normal(size=24)).round(3) for i in range(600)}
    vectors |= {i: vectors[50].copy() for i in range(600, 900)}  # a third of all rows are copies of a query
    rows = [(i, v.tolist(), "own", 1) for i, v in vectors.items()]
    bad = [(1000, None), (1050, [0.0] * 24), (1100, [NAN] + [1.0] * 23), (1101, [INF] + [1.0] * 23),
           (1102, [None] + [1.0] * 23), (1103, [1.0] * 5), (None, [1.0] * 24), (1150, [])]
    df = spark.createDataFrame([*rows, *((*b, "own", 1) for b in bad)],
                               "vec_id long, embedding array<double>, key string, block int").repartition(5)
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, bits=bits, shard_rows=100, block_queries=4).collect()
    want = brute_nearest(vectors, [i for i in vectors if i % 50 == 0], 5)
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert {r.query_id for r in got} == set(want)
    assert all(len(f) == 5 for f in found.values())
    right = sum(len({i for i, _ in f} & {i for i, _ in want[q]}) for q, f in found.items())
    assert right >= 0.9 * 5 * len(want)
    assert [i for i, _ in found[50]] == [600, 601, 602, 603, 604]  # ties to the smallest ids
    for q, f in found.items():
        for i, s in f:
            assert s == pytest.approx(float(np.dot(vectors[i], vectors[q]) / np.linalg.norm(vectors[i])
                                            / np.linalg.norm(vectors[q])), abs=1e-12)


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).collect() == []


def test_nearest_of_far_outliers_beside_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    vectors = {i: centre + 1e-4 * rng.normal(size=24) for i in range(1, 800)}
    vectors |= {50 * i: rng.normal(size=24) for i in range(1, 16)}  # each query is an outlier
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=300, block_queries=4).collect()
    for q in range(50, 800, 50):
        assert [r.rank for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [1, 2, 3, 4, 5]
    want = brute_nearest(vectors, range(50, 800, 50), 5)
    right = {q: sum(r.vec_id in {i for i, _ in want[q]} for r in got if r.query_id == q) for q in want}
    assert sum(right.values()) >= 0.9 * 5 * len(want) and min(right.values()) >= 3


def test_nearest_in_mixed_dense_and_sparse_parts(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(3, 32))
    vectors = {i: centres[i % 3] + 0.01 * rng.normal(size=32) for i in range(1, 3000)}
    vectors |= {10 * i: rng.normal(size=32) for i in range(1, 120)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    queries = [i for i in vectors if i % 20 == 0]
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=1000, block_queries=64).collect()
    want = brute_nearest(vectors, queries, 5)
    for own in ([q for q in queries if q < 1200], [q for q in queries if q >= 1200]):
        right = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got if r.query_id in own)
        assert right >= 0.9 * 5 * len(own)


def shingle_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width=3, percent=90):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t, width) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rows[a][0] is not None and rows[a][0] == rows[b][0]:
                parent[find(a)] = find(b)
            if sets[a] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [j for b, (j, _) in enumerate(rows) if find(b) == find(a) and j is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return sorted(out, key=str)


def test_ids_with_several_texts_lose_no_link(spark):
    rows = near_copies(300, 9)
    rng = np.random.default_rng(4)
    # Ids with two or three texts, nulls among ids and texts, and repeated rows.
    rows = [(int(rng.integers(0, 130)) if rng.random() > 0.1 else None, t if rng.random() > 0.1 else None) for _, t in rows]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df, 3, 90).collect()), key=str)
    assert got == brute_components(rows)
    a, b = ("one two three four five six seven eight nine ten " * 3).split(), [f"x{k}" for k in range(40)]
    for first, second in ((a, b), (b, a)):
        rows = [(5, " ".join(first)), (5, " ".join(second)), (2, " ".join(b + ["y"])), (9, " ".join([*a, "y"]))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r.component_id for r in jaccard.components(df, 3, 80).collect()} == {2}


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(n // 20):
        words = rng.choice(vocabulary, int(rng.integers(3, 90))).tolist()
        for _ in range(20):
            own = list(words)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 90), (2, 3, 90), (3, 5, 80)])
def test_components_equal_brute_force(spark, seed, width, percent):
    rows = near_copies(400, seed)
    rows += [(1000 + i, "one hot text of many copies in this table of rows") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df, width, percent).collect()), key=str)
    assert got == brute_components(rows, width, percent)


def test_stars_alone_are_not_enough_and_no_link_is_lost(spark):
    # A chain: each text links to the next only.
    words = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 20 + k])) for k in range(30)] + [(100, "a b c"), (101, "A B C"), (102, "a b d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df, 3, 90).collect()), key=str)
    assert got == brute_components(rows)


def test_components_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(odd_docs, 3, 90).collect()), key=str)
    assert got == brute_components(rows)
    assert jaccard.components(no_docs).collect() == []
    kept = jaccard.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, 10, None]))
    assert jaccard.keep_first(no_docs).collect() == []


def test_histogram_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(4)
    for n in (1, 30, 1024, 1025, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        bound = jaccard.overlap_bound(jaccard.histogram(a).tobytes(), jaccard.histogram(b).tobytes())
        assert bound >= len(np.intersect1d(a, b))


def plain_shingles(text, width):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def test_containment_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary, int(n)))) for k, n in enumerate([3, 5, 6, 8, 9, 12, 17, 33, 40, 64])]
    items += [(50, None), (51, ""), (52, "?!"), (None, "v1 v2 v3 v4 v5 v6"), (3, items[3][1])]
    docs = []
    for i in range(120):
        words = rng.choice(vocabulary, int(rng.integers(0, 200))).tolist()
        own = items[int(rng.integers(10))][1].split()
        for _ in range(int(rng.integers(0, 3))):  # changed words
            own[int(rng.integers(len(own)))] = "changed"
        at = int(rng.integers(len(words) + 1))
        docs.append((i, " ".join(words[:at]) + "; " + ", ".join(own).upper() + ".\n" + " ".join(words[at:]), "mine"))
    docs += [(200, None, ""), (201, "", ""), (None, items[5][1], ""), (202, items[0][1], ""), (202, items[0][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, hash string").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in containment.contained_items(df, table).collect())
    want = set()
    for d, text, _ in docs:
        for i, item in items:
            own, have = plain_shingles(item, 5), plain_shingles(text, 5)
            if d is not None and i is not None and own and 10 * len(own & have) >= 8 * len(own):
                want.add((d, i, len(own), len(own & have)))
    assert got == sorted(want) and len(want) > 30
    kept = containment.decontaminate(df, table)
    assert kept.columns == df.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(
        str(d) for d, _, _ in docs if d not in {w[0] for w in want})


def test_containment_of_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert containment.contained_items(odd_docs, none).collect() == []
    assert containment.contained_items(no_docs, none).collect() == []
    assert containment.decontaminate(odd_docs, none).count() == odd_docs.count()


def test_containment_runs_no_python(spark, odd_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    plan = containment.contained_items(odd_docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan
