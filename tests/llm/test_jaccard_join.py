import random

import numpy as np
import pytest

from feldspark.llm import components
from feldspark.llm import jaccard_join as J

DOC = "doc_id long, text string"


def brute(rows, width, percent):
    sets, posts = [], {}
    for i, (_, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        sets.append(s)
        for x in s:
            posts.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in posts[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=5):
    """A group of near copies, a passage in many texts, small groups, copies, and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]

    def changed(ws, k):
        ws = list(ws)
        for _ in range(k):
            i = rnd.randrange(len(ws))
            ws[i : i + rnd.randrange(2)] = [rnd.choice(vocabulary)] * rnd.randrange(2)
        return ws

    base, passage = ([rnd.choice(vocabulary) for _ in range(n)] for n in (160, 60))
    out = [" ".join(changed(base, rnd.randrange(6))) for _ in range(90)]
    for _ in range(90):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 300))]
        if rnd.random() < 0.6:
            k = rnd.randrange(len(w))
            w[k:k] = passage
        out += [" ".join(changed(w, rnd.randrange(1 + len(w) // 40))) for _ in range(rnd.randrange(1, 4))]
    out += ["", None, "  \n", "a b", "A B", "a", "a b c d", "a b c d e", "a b c d", "É x y z", "é x y z"] + ["the same text again now"] * 20
    rnd.shuffle(out)
    return [(3 * i + 1, t) for i, t in enumerate(out)]


def found(spark, rows, width=4, percent=85):
    return sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, DOC), width, percent).collect())


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_against_brute_force(spark, width, percent):
    rows = corpus()
    assert found(spark, rows, width, percent) == brute(rows, width, percent)


@pytest.mark.parametrize("name,value", [("BLOCK_ROWS", 15), ("HEAVY", 5), ("HOT", 2), ("BROADCAST_ROWS", 0)])
def test_every_way_gives_the_same(spark, monkeypatch, name, value):
    monkeypatch.setattr(J, name, value)
    rows = corpus(7)
    assert found(spark, rows) == brute(rows, 4, 85)


def test_thresholds_are_exact(spark):
    base = [f"x{i}" for i in range(103)]  # 100 shingles of 4 words
    rows = [(1, " ".join(base)), (2, " ".join(base[:-15])), (3, " ".join(base[:-16]))]
    # 85 of 100 shingles link, 84 of 100 don't, but 84 of 85 do
    assert found(spark, rows) == [(1, 100, 1), (2, 85, 1), (3, 84, 1)]
    assert found(spark, [rows[0], rows[2]]) == [(1, 100, 1), (3, 84, 3)]


def test_empty_tables_null_keys_and_other_columns(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e", 1), (4, "a b c d e", 2), (4, "a b c d e", 2), (None, None, 3)], DOC + ", n int")
    got = sorted((tuple(r) for r in J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None)], key=str)


def test_representatives(spark):
    df = spark.createDataFrame([(5, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (9, None, "z"), (7, "other words here now yes", "q")], DOC + ", sig string")
    got = J.keep_representatives(df, 4, 85)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.select("doc_id", "sig").collect()) == [(2, "y"), (7, "q"), (9, "z")]


def test_prefixes_share_what_they_must():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        n = int(rnd.integers(1, 200))
        a = np.sort(rnd.choice(10**6, n, replace=False))
        b = np.sort(np.unique(np.concatenate([rnd.choice(a, max(1, int(n * 0.95)), replace=False), rnd.choice(10**6, int(rnd.integers(0, 4)))])))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (n + len(b) - common):
            continue
        for level in range(1, int(min(J.top_level(n, 85), J.top_level(len(b), 85))) + 1):
            pa, pb = (x[: len(x) - J.overlap(len(x), 85) + level] for x in (a, b))
            assert len(np.intersect1d(pa, pb)) >= level


def test_link_within():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.choice(40, int(rnd.integers(1, 30)))).astype(np.uint64) for _ in range(120)]
    parent = list(range(120))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = list(range(120))
    for i in range(120):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 60 * (len(sets[i]) + len(sets[j]) - c):
                parent[root(i)] = root(j)
    want = [root(i) for i in range(120)]
    parent = list(range(120))
    for i, j in J.link_within(sets, 60):
        parent[root(i)] = root(j)
    got = [root(i) for i in range(120)]
    pairs = lambda r: {(i, j) for i in range(120) for j in range(i) if r[i] == r[j]}
    assert pairs(got) == pairs(want)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + 100), (60, 60), (-5, 1)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == -5 for i in range(1, 41)) and got[150] == got[100] == 100 and all(got[k] == 500 for k in range(500, 540))
    assert 60 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_through_null_and_repeated_keys(spark):
    base = [f"x{i}" for i in range(100)]
    texts = [" ".join(base[k : k + 85]) for k in (0, 6, 12)]  # neighbours link, ends don't
    for middle in (None, 2, 1):
        rows = [(1, texts[0]), (middle, texts[1]), (3, texts[2])]
        got = J.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
        assert {r["component_id"] for r in got} == {1}, middle
        kept = J.keep_representatives(spark.createDataFrame(rows, DOC), 4, 85).collect()
        assert [r["doc_id"] for r in kept] == [1] and (middle == 1 or kept[0]["text"] == texts[0])
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, "other words here now"), (None, None), (None, None)]
    got = J.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
    assert {r["component_id"] for r in got} == {None}
    kept = sorted(r["text"] or "" for r in J.keep_representatives(spark.createDataFrame(rows, DOC), 4, 85).collect())
    assert len(kept) == 4 and kept[:2] == ["", ""] and "other words here now" in kept


def test_a_key_with_two_texts_keeps_the_one_of_its_own(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite other words in this one")]
    kept = sorted(tuple(r) for r in J.keep_representatives(spark.createDataFrame(rows, DOC), 4, 85).collect())
    assert kept == [(1, "a b c d e f"), (2, "quite other words in this one")]


@pytest.mark.parametrize("rows_of_block", [4, 9])
def test_large_clusters_in_blocks(spark, monkeypatch, rows_of_block):
    """Unlike texts that share a passage are one cluster of many components and sizes."""
    monkeypatch.setattr(J, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(J, "HOT", 2)
    rnd = random.Random(12)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for g in range(30):
        own = [f"g{g}w{rnd.randrange(999)}" for _ in range(rnd.randrange(20, 160))]
        for _ in range(rnd.randrange(1, 6)):
            w = own[: len(own) - rnd.randrange(4)]
            rows.append((len(rows) + 1, " ".join(w[:5] + passage + w[5:])))
    rnd.shuffle(rows)
    assert found(spark, rows) == brute(rows, 4, 85)


def test_classes_of_sizes_hold_all_links():
    import math

    for percent in (50, 80, 85, 99):
        step = 1.0001 * math.log(100 / percent)
        for n in range(1, 5000, 7):
            least = -(-percent * n // 100)
            assert math.floor(math.log(n) / step) - math.floor(math.log(max(least, 1)) / step) <= 1
