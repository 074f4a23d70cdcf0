import random
import re
from collections import Counter

import numpy as np
import pytest

from feldspark.llm import collocations as C


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least, longest, share, top):
    found, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in found.items() if len(x[1]) > 1 and a >= least}
    drop = set()
    for (lang, words), f in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * f >= share * found[lang, words[i : i + k]]:
                    drop.add((lang, words[i : i + k]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in drop:
            cuts = [(1_000_000 * a * a // (found[lang, words[:k]] * found[lang, words[k:]]), k, found[lang, words[:k]], found[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def check(spark, rows, least=3, longest=3, share=50, top=2000, size=50):
    df = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, word int, n int")
    got = C.collocations(df, least=least, longest=longest, share=share, top=top, size=size).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, share, top)
    return got


def texts(seed, n):
    draw = random.Random(seed)
    return [(draw.choice(["en", "de", None]), "".join(draw.choice(["a", "B", "c", "Éa", "d", "a"]) + draw.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(draw.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize(("size", "longest", "top"), [(10, 3, 5), (100_000, 3, 2000), (70, 4, 2000), (50, 2, 7)])
def test_against_brute_force(spark, size, longest, top):
    check(spark, texts(size, 60), longest=longest, top=top, size=size)


def test_runs_of_one_word_overlap(spark):
    check(spark, [("en", "The the " * 40), ("en", "the"), ("en", "the, the! the")])


def test_a_full_table_of_bits_holds_nothing_back(spark, monkeypatch):
    """With 1024 bits for all phrases the result is the same."""
    monkeypatch.setattr(C, "told_of", lambda phrases, told=C.told_of: told(phrases, most=1024))
    check(spark, texts(5, 80), least=2)


def test_odd_rows(spark):
    check(spark, [(None, None), ("en", ""), ("en", "..,,\n"), (None, "x y " * 5), ("und", "x y"), ("en", "x y"), ("en", "x y"), ("en", "x y"), ("fr", "  z " * 9), ("", "q q q q")])
    check(spark, [("en", " ".join(f"w{i % 7}" for i in range(40_000)))], size=1000)
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_hot_language(spark):
    check(spark, [("en", "a b c. a b")] * 400 + texts(9, 30), least=10)


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_007, 3_000_000_011, 4_000_000_009), (999_999_999_999, 999_999_999_999, 999_999_999_999)], "a long, l long, r long")
    from pyspark.sql import functions as F

    for r in rows.withColumn("s", C._floored(F.col("a"), F.col("l"), F.col("r"))).collect():
        assert r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"])


def test_collisions_are_seen(spark):
    assert C.collisions(spark.createDataFrame([("en", "a", 5), ("en", "b", 5)], "lang string, word string, h1 long"))
    assert not C.collisions(spark.createDataFrame([("en", "a", 5), ("en", "b", 6)], "lang string, word string, h1 long"))


def test_bitmaps_shift_over_bytes():
    """Each occurrence of a phrase is found once, wherever its words lie in bytes of positions."""
    ids = np.array([0, 1] * 20 + [-1] + [0, 1, -1], np.int32)
    hashed = np.array([11, 12], np.uint64)
    every = C.Told(np.full(16, ~np.uint64(0)))
    got = {tuple(int(c[i]) for c in columns): int(n[i]) for columns, n in C.counted(ids, hashed, [every], chunk=3) for i in range(len(n))}
    assert got == {(11, 12): 21, (12, 11): 19}
