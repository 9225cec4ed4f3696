"""Near-duplicate removal vs a brute-force greedy pass on a small fixture."""

import random

import pytest
from pyspark.sql import functions as F

from bruteforce import greedy_near_dups
from paths import SF_SMALL
from chorus.operators.dedup import hash_dedup
from chorus.operators.neardup import near_duplicate_clusters, near_duplicate_winners, normalized
from chorus.plans import queries as Q
from chorus.plans.store import table_stage


def _fixture_rows(spark, sf):
    v = Q.valid(spark, sf)
    h = normalized(hash_dedup(v, ["app_name"])).select(F.col("app_name").alias("batch"), "ord", "norm_content", "norm_title",
                                          F.col("quality_score").alias("quality"))
    return [r.asDict() for r in h.collect()], v


def _check(spark, sf):
    rows, v = _fixture_rows(spark, sf)
    truth = greedy_near_dups(rows, 0.9, drift=False)
    expected_survivors = set(truth.values())
    got = {r.ord for r in near_duplicate_winners(v, ["app_name"], 0.9).collect()}
    assert got == expected_survivors
    clusters = {r.ord: r.cluster for r in near_duplicate_clusters(v, ["app_name"], 0.9).collect()}
    # every row's cluster survivor equals the brute-force slot survivor
    by_cluster = {}
    for o, c in clusters.items():
        by_cluster.setdefault(c, []).append(o)
    assert len(by_cluster) == len(expected_survivors)
    return rows, truth


@pytest.fixture(scope="module")
def checked(spark):
    """Rows and brute-force result of the small documents, after Spark's result was found equal."""
    return _check(spark, SF_SMALL)


def test_near_dup_matches_bruteforce_small(checked):
    assert checked[0]


def test_near_dup_drift_agreement_small(checked):
    rows, truth = checked
    drift = greedy_near_dups(rows, 0.9, drift=True)
    same = sum(1 for o in truth if (truth[o] == o) == (drift[o] == o))
    assert same / len(truth) > 0.99


def _edited(text, edits, rng):
    chars = list(text)
    for at in rng.sample(range(len(chars)), edits):
        chars[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(chars)


def test_short_texts_equal_bruteforce(spark):
    """600 texts of 30 to 200 characters with 1 to 4 changed characters, and one text on a third of all rows."""
    rng = random.Random(5)
    rows = []
    for base in range(150):
        words = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
                         for _ in range(rng.randint(5, 25)))
        rows += [words] + [_edited(words, rng.randint(1, 4), rng) for _ in range(3)]
    rows += ["one hot text that many rows of the table share"] * 300
    rng.shuffle(rows)
    data = [("app", k, t, "", float(k % 7)) for k, t in enumerate(rows)]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    df = df.repartition(6)
    texts = {r.ord: r for r in normalized(df).collect()}
    truth = greedy_near_dups([{"batch": "app", "ord": o, "norm_content": texts[o].norm_content, "norm_title": "",
                               "quality": q} for _, o, _, _, q in data if o == min(
                                   p for _, p, t, _, _ in data if t == rows[o])], 0.9)
    # Without a content_hash column the hash is computed: equal texts collapse, others stay.
    got = {r.ord for r in near_duplicate_winners(df, ["app_name"], 0.9).collect()}
    assert got == set(truth.values())


def test_qgram_bound_never_drops_a_similar_pair():
    from bruteforce import similarity
    from chorus.functions.udfs import qgrams_allow
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("ab cd") for _ in range(rng.randint(1, 60)))
        b = _edited(a, rng.randint(0, min(len(a), 6)), rng) + "x" * rng.randint(0, 3)
        for need in (0.6, 0.875, 0.9):
            if similarity(a, b, "", "") >= need:
                assert qgrams_allow(a, b, need)


def test_sketch_and_subsequence_bounds_never_drop_a_similar_pair(spark):
    from bruteforce import similarity
    from chorus.functions.udfs import sketches, sketches_allow, subsequence_allows
    rng = random.Random(23)
    rows = []
    for k in range(500):
        letters = "ab cd" if k % 2 else "abcdefghijklmnopqrstuvwxyz 日本語éß"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400)))
        b = _edited(a, rng.randint(0, len(a) // 12), rng) if k % 3 else "".join(c for c in a if rng.random() > 0.15) or "x"
        title = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        other = title if k % 5 else _edited(title, min(2, len(title)), rng)
        rows.append((k, a, b, title, other, similarity(a, b, title, other)))
        plain = similarity(a, b, "", "")
        for need in (0.6, 0.875, 0.9, plain):
            assert plain < need or subsequence_allows(a, b, need)
    assert not subsequence_allows("abc" * 100, "xyz" * 100, 0.5) and subsequence_allows("abcd", "xbcd", 0.75)
    df = spark.createDataFrame(rows, "k long, a string, b string, ta string, tb string, sim double")
    df = df.withColumns({"sa": sketches("a", "ta"), "sb": sketches("b", "tb")})
    n = [F.length(c) for c in ("a", "b", "ta", "tb")]
    for threshold in (0.7, 0.9):
        lost = df.where(F.col("sim") >= threshold).where(~sketches_allow(threshold)("sa", "sb", *n))
        assert lost.count() == 0 and df.where(F.col("sim") >= threshold).count() > 100


def test_changed_input_gives_fresh_results(spark, tmp_path):
    """The same folder, read again after its table was replaced: no answer from old stage tables."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["near_dup_pairs", "near_dup_clusters", "leaders_by_word_jaccard"]
    docs.limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    for name in names:
        Q.QUERIES[name](spark, str(tmp_path)).collect()
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name in names:
        again = sorted(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect()))
        assert again == sorted(map(tuple, Q.QUERIES[name](spark, SF_SMALL).collect())), name


def test_no_join_on_texts(spark):
    v = Q.valid(spark, SF_SMALL)
    plan = near_duplicate_clusters(v, ["app_name"], 0.9)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("norm_content" in j or "norm_title" in j for j in joins)


def test_a_hot_group_of_different_similar_texts(spark):
    """400 variants of one text, most of all rows: the greedy result without their all-pairs comparison."""
    rng = random.Random(11)

    def text():
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12))

    base = text()
    rows = [(True, _edited(base, rng.randint(0, 7), rng)) for _ in range(400)] + [(False, text()) for _ in range(40)]
    rng.shuffle(rows)
    data = [(None if k % 3 == 0 else "app", k, t, "", float(k % 7)) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    norm = {r.ord: r.norm_content for r in normalized(df).collect()}
    truth = greedy_near_dups([{"batch": b, "ord": o, "norm_content": norm[o], "norm_title": "", "quality": q}
                              for b, o, _, _, q in data], 0.9)
    compared = []

    def stage(name, build):
        df = table_stage(name, build)
        if "pairs-" in name:
            compared.append(df.count())
        return df

    got = {r.ord for r in near_duplicate_winners(df, ["app_name"], 0.9, stage).collect()}
    assert got == set(truth.values())
    hot = [sum(is_hot and (k % 3 == 0) == null for k, (is_hot, _) in enumerate(rows)) for null in (True, False)]
    assert sum(compared) < sum(n * (n - 1) // 2 for n in hot) / 3


def test_deletions_in_texts_of_middling_length(spark):
    """Texts of 130 to 200 characters with evenly or randomly spread deletions, at a ratio of 0.90 to 0.92."""
    from bruteforce import similarity
    from chorus.operators.neardup import similar_pairs
    rng = random.Random(17)
    data, want = [], set()
    while len(want) < 120:
        text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(rng.randint(17, 24)))
        gone = round(0.167 * len(text))
        places = {int(k * len(text) / gone) for k in range(gone)} if len(want) % 2 else rng.sample(range(len(text)), gone)
        less = " ".join("".join(c for k, c in enumerate(text) if k not in set(places)).split())
        if 0.9 <= similarity(less, text, "", "") <= 0.92 and 130 <= len(text) <= 200:
            want.add((len(data) + 1, len(data)))
            data += [("app", len(data) + k, t, "", 0.0) for k, t in enumerate((text, less))]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    got = {(r.later, r.earlier) for r in similar_pairs(df, ["app_name"], 0.9).collect()}
    assert got == want


def test_long_texts_of_many_characters(spark):
    from bruteforce import similarity
    from chorus.operators.neardup import similar_pairs
    rng = random.Random(19)
    texts = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(500)) for _ in range(20)]
    less = ["".join(c for k, c in enumerate(t) if k % 6) for t in texts]
    assert all(similarity(b, a, "", "") >= 0.9 for a, b in zip(texts, less))
    data = [("app", k, t, "", 0.0) for k, t in enumerate(texts + less)]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    got = {(r.later, r.earlier) for r in similar_pairs(df, ["app_name"], 0.9).collect()}
    assert got == {(k + 20, k) for k in range(20)}


def test_repetitive_texts_share_a_band():
    """Pairs of texts of few distinct 3-grams: repeats count, so the bands find them like others."""
    from bruteforce import similarity
    from chorus.operators.neardup import SHORT, _hash_params, minhash
    _, shingle, bands, rows = SHORT
    params, rng = _hash_params(bands * rows, 7), random.Random(31)
    pairs = missed = 0
    for k in range(1500):
        unit = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 4)))
        a = (unit * 200)[: rng.randint(60, 190)]
        letters = list(a)
        for spot in rng.sample(range(len(a)), max(1, len(a) // rng.choice((9, 12, 20, 40)))):
            letters[spot] = "" if k % 2 else rng.choice("mnopqrstuvw")
        b = "".join(letters)
        if similarity(a, b, "", "") < 0.875:
            continue
        x, y = (minhash(t, shingle, bands * rows, 7, params) for t in (a, b))
        pairs += 1
        missed += not any(x[i: i + rows] == y[i: i + rows] for i in range(0, bands * rows, rows))
    assert pairs > 300 and missed == 0


def test_word_leaders_equal_bruteforce_and_copies_are_not_paired(spark):
    """The greedy pass over word sets: equal sets are one entry, so 200 copies of a text make no pairs."""
    from chorus.operators.neardup import word_jaccard_leaders
    rng = random.Random(37)
    sets = [{0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}] * 200
    for size in (1, 3, 9, 10, 19, 20, 21, 40, 100, 130):
        for _ in range(6):
            base = rng.sample(range(300), size)
            for _ in range(4):
                near = set(base) - set(rng.sample(base, rng.randint(0, max(0, size // 9 - 1))))
                sets.append(near | set(rng.sample(range(300), rng.randint(0, max(1, size // 15)))))
    rng.shuffle(sets)
    apps = [rng.choice(["a", "b"]) for _ in sets]
    data = [(a, k, " ".join(f"w{x}" for x in rng.sample(sorted(s), len(s)))) for k, (a, s) in enumerate(zip(apps, sets))]
    # Without an app a row has no pairs; an ord that comes with two texts is one row of the greedy pass.
    data += [(None, 900, "w1 w2"), (None, 901, "w1 w2"), ("a", 902, "x y z"), ("a", 902, "u v w"), ("a", 903, "u v w")]
    rows = [(a, k, frozenset(t.split())) for a, k, t in data if a]
    earlier: dict[int, set[int]] = {}
    for a, k, s in rows:
        for b, j, t in rows:
            if a == b and k > j and 100 * len(s & t) >= 90 * len(s | t):
                earlier.setdefault(k, set()).add(j)
    nodes, leads, want = sorted(set(earlier) | {j for e in earlier.values() for j in e}), set(), {}
    for k in nodes:
        above = earlier.get(k, set()) & leads
        want[k] = min(above, default=k)
        if not above:
            leads.add(k)
    kept = {}

    def stage(name, build):
        kept[name] = table_stage(name, build)
        return kept[name]

    df = spark.createDataFrame(data, "app_name string, ord long, content string").repartition(5)
    got = word_jaccard_leaders(df, ["app_name"], 90, stage).collect()
    assert {r.ord: r.leader for r in got} == want and len(got) == len(want)
    assert kept["word-edges"].count() < sum(map(len, earlier.values())) / 10


def test_size_classes_hold_every_allowed_pair():
    from chorus.functions.udfs import size_classes
    for percent in (50, 80, 90, 95):
        least = size_classes(percent, 3000)
        of = [sum(x <= n for x in least) - 1 for n in range(1, 2001)]
        for n in range(1, 1000):
            most = n * 100 // percent
            assert most > 2000 or of[most - 1] - of[n - 1] <= 1


def test_block_bounds_never_drop_a_similar_pair():
    """Texts beyond 200 characters, where ``difflib`` leaves popular characters out."""
    from difflib import SequenceMatcher
    import numpy as np
    from chorus.functions.udfs import bitmaps_fit, gram_bits, most_blocks, qgrams_allow, ratio_at_least
    rng = random.Random(29)
    seen = 0
    for k in range(300):
        letters = "ab cd" * 40 + "xyzqwjk" if k % 2 else "abcdefghijklmnopqrstuvwxyz      "
        a = "".join(rng.choice(letters) for _ in range(rng.randint(150, 700)))
        b = _edited(a, rng.randint(0, 12), rng) if k % 3 else a[:len(a) // 2] + a[len(a) // 2 + rng.randint(0, 60):]
        matcher = SequenceMatcher(None, a, b)
        assert most_blocks(b) >= sum(m.size > 0 for m in matcher.get_matching_blocks())
        for need in (0.3, 0.6, 0.875, matcher.ratio()):
            if matcher.ratio() >= need:
                seen += 1
                words = [np.frombuffer(gram_bits(t), np.uint64)[None] for t in (a, b)]
                la, lb = np.array([len(a)]), np.array([len(b)])
                assert qgrams_allow(a, b, need - 1e-9)
                assert bitmaps_fit(*words, la, lb, np.array([need]), np.array([most_blocks(b)]))[0]
                assert ratio_at_least(a, b, need - 1e-9) == matcher.ratio()
            else:
                assert ratio_at_least(a, b, need) in (0.0, matcher.ratio())
    assert seen > 400


def test_candidates_that_cannot_be_similar_are_not_written(spark):
    """Texts of one small vocabulary share buckets by chance: blocks of any size write few of these pairs and lose none that is similar."""
    from bruteforce import similarity
    from chorus.operators.neardup import block_pairs, bucket_keys, representatives, similar_pairs, with_part
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 160))) for _ in range(240)]
    texts += [_edited(t, 4, rng) for t in texts[:40]]
    data = [("app" if k % 240 % 2 else "other", k, t, "", 0.0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    _, _, signed = representatives(df, ["app_name"], 0.9, table_stage, 7, True)
    keys = signed.select("ord", F.explode(bucket_keys()).alias("key"))
    shared = (keys.alias("a").join(keys.alias("b"), "key").where("a.ord > b.ord")
              .select(F.col("a.ord").alias("later"), F.col("b.ord").alias("earlier")).distinct().count())
    found = [{(r.later, r.earlier) for r in block_pairs(with_part(signed), 0.9, size).collect()} for size in (12_000, 9)]
    text = {r.ord: (r.batch_key, r.norm_content) for r in signed.collect()}
    similar = {(240 + k, k) for k in range(40) if similarity(text[240 + k][1], text[k][1], "", "") >= 0.9}
    assert found[0] == found[1] and similar <= found[0] and len(similar) > 3
    assert shared > 1000 and 10 * len(found[0]) < shared
    assert {(r.later, r.earlier) for r in similar_pairs(df, ["app_name"], 0.9).collect()} == similar
    # Parts: only some rows are the later one, and of one row only rows before ``below`` are the earlier one.
    first = min(similar)
    part = with_part(signed.withColumns({"is_later": F.col("ord") != max(similar)[0],
                                         "below": F.when(F.col("ord") == first[0], first[1]).cast("long")}))
    got = {(r.later, r.earlier) for r in block_pairs(part, 0.9, 50).collect()}
    assert got == {p for p in found[0] if p[0] != max(similar)[0] and (p[0] != first[0] or p[1] < first[1])}


def test_pairs_that_share_no_band_are_found(spark):
    """Long texts of 60 characters, 40 of them rare, without every seventh one: similar, but most of their 5-grams are not the same."""
    from bruteforce import similarity
    from chorus.operators.neardup import similar_pairs
    rng = random.Random(41)

    def text():
        signs = [chr(0x430 + k // 4) for k in range(128)] + [c for c in "01234567" * 4] + rng.choices("abcdefghijklmnopqrst", k=140)
        rng.shuffle(signs)
        return "".join(signs)

    texts = [text() for _ in range(20)]
    less = ["".join(c for k, c in enumerate(t) if k % 7) for t in texts]
    assert all(similarity(b, a, "", "") >= 0.9 for a, b in zip(texts, less))
    data = [("app", k, t, "", 0.0) for k, t in enumerate(texts + less)]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    assert {(r.later, r.earlier) for r in similar_pairs(df, ["app_name"], 0.9).collect()} == {(k + 20, k) for k in range(20)}
    clusters = {r.ord: r.cluster for r in near_duplicate_clusters(df, ["app_name"], 0.9).collect()}
    assert clusters == {k: k % 20 for k in range(40)}


def test_blocks_and_cells_equal_all_pairs(spark):
    """Blocks and cells of any size give the pairs of a plain loop; titles and batches as they come."""
    from bruteforce import similarity
    from chorus.operators.neardup import block_pairs, representatives, verified_edges, with_part
    rng = random.Random(43)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    texts = []
    for _ in range(40):
        text = "".join(rng.choice(letters) for _ in range(rng.choice((8, 60, 190, 205, 240, 300, 700, 1100)))).strip() or "q"
        texts += [(text, "one title here"), (_edited(text, len(text) // 25, rng), "one title here"),
                  (_edited(text, len(text) // 30, rng), rng.choice(("", "one title there", "quite another")))]
    data = [("app" if k % 5 else None, k, c, t, 0.0) for k, (c, t) in enumerate(texts)]
    df = spark.createDataFrame(data, "app_name string, ord long, content string, title string, quality_score double")
    _, _, signed = representatives(df, ["app_name"], 0.9, table_stage, 7, True, bands=False)
    rows = sorted(signed.collect(), key=lambda r: r.ord)
    want = {(a.ord, b.ord) for a in rows for b in rows if a.ord > b.ord and a.batch_key == b.batch_key
            and similarity(a.norm_content, b.norm_content, a.norm_title, b.norm_title) >= 0.9}
    assert len(want) > 20
    for size, cell in ((24_000, 8_000), (7, 9)):
        found = table_stage("pairs", lambda size=size: block_pairs(with_part(signed), 0.9, size))
        got = verified_edges(signed, found, 0.9, cell).collect()
        assert {(r.later, r.earlier) for r in got} == want and len(got) == len(want)


def test_matcher_equals_difflib():
    from difflib import SequenceMatcher
    from chorus.functions.udfs import ratio_at_least
    rng = random.Random(47)
    alphabets = ["abcd ", "abcdefghijklmnopqrstuvwxyz      eeeetttaaa", "".join(chr(0x4E00 + k) for k in range(300))]
    for k in range(400):
        letters = alphabets[k % 3]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 500)))
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            at = rng.randrange(len(b) + 1)
            b[at: at + rng.randint(0, 9)] = rng.choice(letters) * rng.randint(0, 9)
        b = "".join(b) or "x"
        ratio = SequenceMatcher(None, a, b).ratio()
        assert ratio_at_least(a, b, 0.0) == ratio == ratio_at_least(a, b, ratio)
